from __future__ import annotations

from .conftest import rows

from pyspark.sql import functions as F

from gridloom import dicts as D
from gridloom.frame import ROW, previous
from gridloom.operators import aggregates as A
from gridloom.operators import derive as U
from gridloom.operators import fill, headers, naming
from gridloom.operators import relate as X
from gridloom.operators import reshape as R


def test_fill_and_totals_with_integrity(frame):
    df = frame([("東京", "営業", 60), (None, "総務", 40), (None, "合計", 100), ("大阪", "営業", 30), (None, "総務", 20), (None, "合計", 45), ("福岡", "営業", 50), (None, "総務", 60), (None, "合計", 150)], "支店 string, 部門 string, 売上 long")
    filled, names = fill.fill_grouping_columns(df)
    assert names == ["支店"] and [r[0] for r in rows(filled)][:3] == ["東京"] * 3
    out = A.remove_aggregates(filled)
    assert len(rows(out.frame)) == 6 and out.row_audit.count() == 3
    totals = filled.where("`部門` = '合計'").select("支店", "売上").withColumnRenamed("売上", "報告")
    checks = {r["支店"]: (r["status"], r["cause"]) for r in A.check_integrity(out.frame, totals, ["支店"], "売上", "報告").collect()}
    assert checks == {"東京": ("PASS", None), "大阪": ("FAIL", "二重計上または単位ミス"), "福岡": ("FAIL", "内訳あり（未表示項目）")}


def test_fill_leaves_aggregates_and_empty_columns(frame):
    df = frame([("合計", None), (None, None), ("a", None), (None, None), ("a", None), ("a", None)], "x string, y string")
    filled, names = fill.fill_grouping_columns(df)
    assert names == ["x"] and [r[0] for r in rows(filled)] == ["合計", None, "a", "a", "a", "a"]
    empty = frame([], "x string, v long")
    assert rows(fill.fill_grouping_columns(empty)[0]) == [] and rows(A.remove_aggregates(empty).frame) == []


def test_fill_carries_over_blocks(frame, monkeypatch):
    import gridloom.frame as f

    monkeypatch.setattr(f, "BLOCK_ROWS", 3)
    df = frame([("a" if i % 10 == 0 else None,) for i in range(30)], "x string")
    assert [r[0] for r in rows(fill.fill_grouping_columns(df)[0])] == ["a"] * 30


def test_aggregate_columns(frame):
    yearly = frame([("東京", 10, 0.5, 20, 0.6, 30), ("大阪", 1, 0.1, 2, 0.2, 3)], "支店 string, `2023年合計` long, `2023年達成率` double, `2024年合計` long, `2024年達成率` double, `合計` long")
    assert A.remove_aggregates(yearly).removed_columns == ["合計"]
    flat = frame([("x", 100, 80, 60, 240)], "地域 string, 東京 long, 大阪 long, 福岡 long, 合計 long")
    out = A.remove_aggregates(flat)
    assert out.removed_columns == ["合計"] and out.column_audit.collect()[0]["reported_value"] == 240.0
    alone = frame([("x", 5)], "地域 string, 現金給与総額 long")
    assert A.remove_aggregates(alone).removed_columns == []


def test_aggregate_row_without_details_stays(frame):
    df = frame([("2015", "全国計", 5), ("2019", "北海道", 1), ("2019", "青森", 2), ("2019", "全国計", 3), ("2019", "岩手", 0), ("2019", "岩手", 0), ("2019", "岩手", 0), ("2019", "岩手", 0), ("2019", "岩手", 0)], "年 string, 県 string, 値 long")
    kept = {r[:2] for r in rows(A.remove_aggregates(df).frame)}
    assert ("2015", "全国計") in kept and ("2019", "全国計") not in kept


def test_of_which(frame):
    df = frame([("東京", "社員", 100), ("東京", "うち男性", 60), ("東京", "うち女性", 40), ("大阪", "社員", 50), ("大阪", "うち男性", 20), ("大阪", "うち女性", 20)], "支店 string, 区分 string, 人数 long")
    out = A.split_of_which(df)
    assert {r[1:3] for r in rows(out.breakdown)} == {("社員", "男性"), ("社員", "女性")} and out.breakdown.count() == 4
    assert sorted(r["status"] for r in out.checks.collect()) == ["FAIL", "PASS"]
    assert [r[-1] for r in rows(out.main)] == [True, True]
    assert A.split_of_which(frame([("a", 1)], "x string, v long")) is None


def test_rollups_and_hierarchies(frame):
    indent = frame([("東日本", 1600), ("  神奈川事業部", 1100), ("    横浜支店", 700), ("    川崎支店", 400), ("  千葉事業部", 500)], "地域 string, 売上 long")
    info = R.detect_hierarchy(indent)
    assert (info.mode, info.depth) == ("indent", 3)
    levels = R.level_names("地域", 3)
    expanded = R.expand_hierarchy(indent, info)
    assert rows(expanded)[2][:3] == ("東日本", "神奈川事業部", "横浜支店") and rows(expanded)[4][:3] == ("東日本", "千葉事業部", "")
    kept, gone = A.rollup_rows(expanded, levels)
    assert len(rows(kept)) == 3 and gone.count() == 2
    paths = frame([("東日本＞神奈川＞横浜", 700), ("東日本＞静岡", 400), ("東日本＞静岡＞浜松", 250)], "地域 string, 売上 long")
    assert R.detect_hierarchy(paths).delimiter == "＞"
    assert rows(R.expand_hierarchy(paths, R.detect_hierarchy(paths)))[1][:3] == ("東日本", "静岡", "")


def test_key_value_pivot(frame):
    df = frame([("東京", "売上", 100), ("東京", "利益", 20), ("大阪", "売上", 80), ("大阪", "利益", 15)], "支店 string, 属性 string, 値 long")
    info = R.detect_key_value(df)
    assert info.attributes == ("売上", "利益") and info.warning is None
    assert rows(R.pivot_key_value(df, info)) == [("東京", 100, 20), ("大阪", 80, 15)]
    holes = frame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3), ("c", "x", 4), ("c", "y", 5)], "k string, attr string, v long")
    assert rows(R.pivot_key_value(holes, R.detect_key_value(holes))) == [("a", 1, "2"), ("b", 3, ""), ("c", 4, "5")]
    ranked = frame([("A",), ("B",), ("A",), ("C",), ("A",), ("B",)], "attr string")
    assert [(r["attribute"], r["n"]) for r in R.rank_attributes(ranked, "attr").collect()] == [("A", 3), ("B", 2), ("C", 1)]
    wide = R.KeyValue(("k",), "a", "v", tuple(f"a{i:04}" for i in range(1001)), 2)
    assert wide.warning == "many" and R.limit_attributes(wide, ["a0003", "a0001"], 2).attributes == ("a0001", "a0003")
    assert R.decide_pivot(df, wide, "hold") is None and R.decide_pivot(df, wide, "cancel") is df


def test_cross_table_and_wide(frame):
    df = frame([("東京", 100, 120), ("大阪", 80, 90)], "支店 string, `2023年` long, `2024年` long")
    out = R.stack_cross_table(df, R.detect_cross_table(["支店", "2023年", "2024年"]))
    assert rows(out) == [("東京", "2023年", 100), ("大阪", "2023年", 80), ("東京", "2024年", 120), ("大阪", "2024年", 90)]
    assert R.detect_cross_table(["区分", "4月", "5月"], "2025年度 実績").year == "2025"
    clash = R.stack_cross_table(frame([("基準", 1, 2)], "年 string, `2023年` long, `2024年` long"), R.detect_cross_table(["年", "2023年", "2024年"]))
    assert clash.columns[1:] == ["年_1", "年", "値"]
    wide = R.detect_wide(["支店", "2023_売上", "2023_原価", "2024_売上", "2024_原価"])
    assert (wide.tier, wide.tokens, wide.indicators) == (1, ("2023", "2024"), ("売上", "原価"))
    branches = [f"{b}支社_{m}" for b in ("東京", "大阪", "名古屋", "福岡", "札幌") for m in ("売上", "原価")]
    assert R.detect_wide(["商品", *branches]).tier == 2 and R.detect_wide(["月", "ゴールド利用額", "ゴールド来店数"]) is None
    stacked = R.stack_wide(frame([("東京", 100, 60, 120)], "支店 string, `2023_売上` long, `2023_原価` long, `2024_売上` long"), R.detect_wide(["支店", "2023_売上", "2023_原価", "2024_売上"]))
    assert rows(stacked) == [("東京", "2023", 100, 60), ("東京", "2024", 120, None)]


def test_header_axes(frame):
    head = [[None, "売上", "売上", "原価", "原価"], [None, "東京", "大阪", "東京", "大阪"]]
    names = naming.unique_columns(["列", "c1", "c2", "c3", "c4"])
    info = headers.detect_axes(head, ["name", "name"], names)
    assert info.kinds == ("candidate", "candidate") and info.labels == ("列",)
    df = frame([("2024年", 100, 80, 60, 45)], "列 string, c1 long, c2 long, c3 long, c4 long")
    assert rows(R.stack_header_axes(df, info, ["指標", "支店"], "値"))[0] == ("2024年", "売上", "東京", 100)
    assert rows(R.stack_header_axes(df, info, ["指標", "支店"], "値", indicator=0)) == [("2024年", "東京", 100, 60), ("2024年", "大阪", 80, 45)]


def test_header_axes_keep_labels_of_the_same_name(frame):
    info = R.HeaderAxes(("支店", "値"), (("売上", "原価"), ("2023", "2023")), ("c1", "c2"), ("candidate", "time"))
    df = frame([("東京", "x", 1, 2)], "支店 string, `値` string, c1 long, c2 long")
    out = R.stack_header_axes(df, info, ["指標", "支店"], "値")
    assert out.columns[1:] == ["支店_1", "値_1", "指標", "支店", "値"]
    assert rows(out) == [("東京", "x", "売上", "2023", 1), ("東京", "x", "原価", "2023", 2)]


def test_splits(frame):
    df = frame([("東京支店", "フレッツ光 / おまかせ", 12.5), ("大阪営業所", "光コラボ / リモート", 9.7), ("名古屋支店", "フレッツ光 / 対策", 15.1)], "支店 string, `プラン1 / プラン2` string, `T/O比` double")
    splits = R.detect_name_splits(df)
    assert list(splits) == ["プラン1 / プラン2"] and rows(R.split_columns(df, splits))[0] == ("東京支店", "フレッツ光", "おまかせ", 12.5)
    notes = frame([("東京(本社)", "人口(人)"), ("大阪(支店)", "率(％)"), ("名古屋(支店)", "人口(人)")], "支店 string, 人口 string")
    assert R.detect_annotations(notes) == ["支店"] and rows(R.split_annotations(notes, {"支店": "種別"}))[0][:2] == ("東京", "本社")
    units = R.split_units(frame([("人口(人)", 1.0), ("労働力率(％)", 2.0), ("人口(人)", 3.0)], "指標 string, 値 double"))
    assert rows(units.frame)[0][0] == "人口" and dict(r[:2] for r in rows(units.master)) == {"人口": "人", "労働力率": "％"}


def test_invalid_columns_and_transpose(frame):
    df = frame([("東京", 1001, None, "参考A", 100), ("大阪", 1002, None, None, 200)], "支店 string, 支店_1 long, 値 string, `Unnamed: 3` string, 件数 long")
    found = {x.name: (x.reasons, x.selected) for x in fill.detect_invalid_columns(df)}
    assert found == {"値": (("empty",), True), "Unnamed: 3": (("placeholder",), False)}
    assert "値" not in fill.drop_invalid_columns(df).columns
    out = R.transpose(frame([("売上", 100, 80), ("利益", 20, 15)], "指標 string, 東京 long, 大阪 long"), "支店")
    assert rows(out) == [("東京", 100, 20), ("大阪", 80, 15)]


def test_transpose_of_repeated_and_empty_heads(frame):
    out = R.transpose(frame([("売上", 100), ("売上", 80), (None, 5)], "指標 string, 東京 long"), "支店")
    assert out.columns[1:] == ["支店", "売上", "売上_1", D.EMPTY_HEADER] and rows(out) == [("東京", 100, 80, 5)]


def test_row_order_after_unpivot_and_union(frame):
    """Rows keep their order past ten, and blanks are filled after an unpivot, where the order key is nested."""
    df = frame([(f"r{i}" if i % 2 == 0 else None, i, -i) for i in range(12)], "名 string, a long, b long")
    flat = R.unpivot(df, ["名"], [({"軸": "x"}, {"値": "a"}), ({"軸": "y"}, {"値": "b"})], ["軸"], ["値"])
    filled = previous(flat, {"前": F.col("名")}, [])
    assert [r["前"] for r in filled.orderBy(ROW).collect()] == [f"r{i - i % 2}" for i in range(12)] * 2
    for parts in ((df, df), (df, flat.drop("軸"))):
        both = U.integrate([X.Table(str(k), "s", "t", p) for k, p in enumerate(parts)], ["表"], [("一",), ("二",)])
        names = [r["名"] for r in both.where("`表` = '一'").orderBy(ROW).collect()]
        assert names == [f"r{i}" if i % 2 == 0 else None for i in range(12)]
        assert previous(both, {"前": F.col("名")}, []).count() == both.count()


def test_headers_and_names():
    assert headers.merge_headers([["支店", "従業者数"], [None, "人"]], ["name", "unit"], 2)[0] == ["支店", "従業者数 [人]"]
    merged = headers.merge_headers([headers.fill_header(["商品", "東京", None, "大阪", None]), [None, "売上", "原価", "売上", "原価"]], ["name", "name"], 5)[0]
    assert merged == ["商品", "東京_売上", "東京_原価", "大阪_売上", "大阪_原価"]
    assert headers.header_roles([["表1", None], ["支店", "売上"], ["東京", 1]]) == (1, ["name"])
    assert headers.is_unit_row(["人", "百万円/年", None]) and not headers.is_unit_row(["東京", "大阪"])
    assert naming.unique_columns(["a", None, "a", ""]) == ["a", "列", "a_1", "列_1"]
    assert naming.common_affix(["東京支社", "大阪支社"]) == "支社" and naming.axis_name(["2023年", "2024年"]) == ("年", "dictionary")
    assert naming.value_name("売上表") == ("売上", "title") and naming.resolve_collision("年", ["年"]) == ("年_1", "年", "fallback")
    assert R.place_axis(["a", "b", "t", "v"], ["t"], "a", "before") == ["a", "t", "b", "v"]
    assert naming.disambiguate({"1": ("A", "x"), "2": ("B", "x"), "3": ("B", "y")}) == {"1": "A x", "2": "B x", "3": "y"}


def test_merged_headers_of_two_languages_and_spare_units():
    merge = headers.merge_headers
    names, used = merge([["従業者数", "給与"], ["人", "千円"], ["Persons", "Salary"], ["persons", "yen"], [2023, 2024]], ["name", "unit", "name", "unit", "name"], 2)
    assert names == ["従業者数 [人]_2023", "給与 [千円]_2024"] and used == [0, 1, 4]
    assert merge([["地域", "nan"], ["地域", None]], ["name", "name"], 2)[0] == ["地域_地域", "列2"]
    assert merge([[None, "甲"], ["人", None], ["数", "乙"]], ["name", "unit", "name"], 2)[0] == ["数 [人]", "甲_乙"]
    assert merge([["数", "甲"], [None, "乙"], ["人", None]], ["name", "name", "unit"], 2)[0] == ["数 [人]", "甲_乙"]


def test_dependent_columns(frame):
    df = frame([("a", "x", None, 1), ("a", "x", "p", 2), ("b", "y", "p", 1), ("c", "y", "q", 2), ("c", "y", "q", 3)], "k string, g string, o string, v long")
    assert A.dependent_columns(df, ["k", "g", "o"]) == {"k": {"g", "o"}, "g": {"k"}, "o": {"k"}}
    assert A.dependent_columns(df.limit(1), ["k", "g"]) == {"k": set(), "g": set()} == A.dependent_columns(df.limit(0), ["k", "g"])


def test_relations_and_derivation(frame, spark):
    make = lambda sheet, vs: X.Table(sheet, sheet, sheet, frame(vs, "区分 string, `4月` long, `5月` long"))
    tables = [make("全社計", [("A", 300, 330), ("B", 150, 165)]), make("東京", [("A", 100, 110), ("B", 50, 55)]), make("大阪", [("A", 120, 130), ("B", 60, 66)]), make("名古屋", [("A", 80, 90), ("B", 40, 44)])]
    found = X.sum_relations(tables)
    assert [(r.parent, set(r.children)) for r in found] == [("全社計", {"東京", "大阪", "名古屋"})]
    assert set(X.aggregate_sheets(tables)) == {"全社計"}
    scaled = [make("AP", [("x", 10, 20)]), make("plan", [("x", 5, 10)]), make("id", [("x", 100, 200)])]
    assert X.aggregate_sheets(scaled) == {} and X.sum_relations(scaled) == []
    assert rows(U.subtract(tables[0], tables[1:3])) == [("A", 80, 90), ("B", 40, 44)]
    both = U.integrate(tables[1:3], ["支店"], [("東京",), ("大阪",)])
    assert both.columns[1] == "支店" and both.count() == 4
    assert U.entity_names("「東京」と「大阪」の合計") == ["東京", "大阪"]
    noted = [X.Table(t.id, t.sheet, t.title, t.frame, ["「東京」「大阪」「名古屋」「福岡」の合計"] if t.id == "全社計" else []) for t in tables]
    assert U.latent_tables(noted)[0].missing == ("福岡",)
    assert X.classify(tables, found, {"全社計"})["東京"] == ("detail", True)
    assert X.validate([X.Recommendation(("東京", "nope"), ("a",), (("1",), ("2",)))], tables) == []


def test_plans(frame, spark):
    from gridloom.plans.normalize import normalize, normalize_all
    from gridloom.plans.propose import propose

    df = frame([("東京", 100, 120, 220), ("大阪", 80, 90, 170), ("合計", 180, 210, 390)], "支店 string, `2023年` long, `2024年` long, 合計 long")
    r = normalize(X.Table("t", "s", "売上", df))
    assert r.frame.columns[1:] == ["支店", "年", "売上"] and r.frame.count() == 4 and r.log == ["cross table"]
    wide = frame([(f"k{i % 2}", f"a{i // 2:04}", i) for i in range(0)] + [(k, f"a{i:04}", i) for k in ("x", "y") for i in range(1001)], "k string, a string, v long")
    assert normalize(X.Table("w", "s", "", wide)).held
    split = normalize_all([X.Table("u", "s", "", frame([("社員", 3), ("うち男", 1), ("うち女", 2)], "区分 string, 人数 long"))])
    assert [t.id for t, _ in split] == ["u", "u_uchi_breakdown"]
    final = propose(spark, [X.Table(n, n, n, frame(v, "区分 string, m long")) for n, v in (("計", [("A", 6)]), ("a", [("A", 1)]), ("b", [("A", 2)]), ("c", [("A", 3)]))])
    assert any(f.is_integrated and set(f.sources) == {"a", "b", "c"} for f in final.values())


def test_plan_asks_the_namer(frame):
    from gridloom.plans.normalize import Options, normalize

    class Asked(naming.Namer):
        def __init__(self):
            self.samples = []

        def transpose(self, sample):
            self.samples.append(sample)

        def value_name(self, title):
            return "台数"

        def collision(self, name):
            return f"元の{name}", name

    df = frame([("基準", 1, 2)], "年 string, `2023年` long, `2024年` long")
    namer = Asked()
    r = normalize(X.Table("t", "s", "", df), Options(namer=namer))
    assert r.frame.columns[1:] == ["元の年", "年", "台数"]
    assert namer.samples == [[{"年": "基準", "2023年": 1, "2024年": 2}]]
    four = frame([("x", 1, 2, 3, 4)], "品 string, `A_甲` long, `A_乙` long, `B_甲` long, `B_乙` long")
    axes = R.HeaderAxes(("品",), (("A", "A", "B", "B"), ("甲", "乙", "甲", "乙")), ("A_甲", "A_乙", "B_甲", "B_乙"), ("candidate", "candidate"))
    assert normalize(X.Table("t", "s", "", four), Options(axes=axes)).log == ["wide to long"]  # axes declined: the lower bounds
    assert normalize(X.Table("t", "s", "", four)).log == []


def test_redundant_axes_compare_every_matched_value(frame):
    def found(first):
        parts = {"2020": range(3000), "2021": range(first, first + 3000)}
        tables = [X.Table(y, y, y, frame([(f"2020/2021 {i}", i) for i in r], "期間 string, 値 long")) for y, r in parts.items()]
        return U.redundant_axes(tables, ["年"], [("2020",), ("2021",)])

    assert found(2999) == []  # one value in both
    assert found(3000) == ["年"]
