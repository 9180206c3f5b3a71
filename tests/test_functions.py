from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import labels as L


def one(spark, expr, *values):
    return [r[1] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


def test_aggregate_labels(spark):
    values = ["合計", "合 計", "東京 合計（税込）", "Grand Total", "東京", None, "会計", ""]
    assert one(spark, L.is_agg_label, *values) == [True, True, True, True, False, False, True, False]
    assert [L.is_agg_name(v) for v in values if v is not None] == [True, True, True, True, False, True, False]
    assert L.agg_residual_name("2023年合計") == "2023年" and L.agg_residual_name("合計") == "" and L.agg_residual_name("売上") is None


def test_numbers(spark):
    assert one(spark, L.numeric_clean, "△1,200", "12.5", "x1", None) == [1200.0, 12.5, None, None]
    assert one(spark, L.is_numeric_cell, "***", "X", "▲3", "abc", None) == [True, True, True, False, False]
    assert one(spark, L.is_na_marker, "N/A", " - ", "1") == [True, True, False]


def test_times(spark):
    names = ["2011年1月", "12月", "2024Q1", "q1 2024", "Q3", "第2四半期", "2022年度上期", "2020年度", "２０２０年", "2020", "売上"]
    kinds = ["year_month", "month", "fiscal_quarter", "fiscal_quarter", "quarter", "quarter_ja", "fiscal_half", "fiscal_year", "year", "year_num", None]
    assert one(spark, L.time_kind, *names) == kinds
    assert [L.time_kind_name(n) for n in names] == kinds


def test_units_notes_and_children(spark):
    assert one(spark, lambda c: L.unit_parts(c)[0], "人口 (千人)", "労働力率（％）", "なし") == ["人口", "労働力率", None]
    assert one(spark, lambda c: L.unit_parts(c)[1], "人口 (千人)", "労働力率（％）", "なし") == ["千人", "％", None]
    assert one(spark, L.uchi_child, "うち男性", "（うち女性）", "（再掲）女性", "うち", "男性", None) == ["男性", "女性", "女性", None, None, None]
    assert one(spark, L.note_type, "AとBの合計", "Aを除く", "Aを参照", "A") == ["aggregation", "exclusion", "reference", "general"]
    assert one(spark, L.entities, "「東京」と「大阪」の合計") == [["東京", "大阪"]]
    assert one(spark, L.indent_width, "  a", "　a", "a") == [2, 2, 0]
    assert one(spark, L.safe_filename, "a/b c") == ["a_b_c"]
