"""Files to final tables: forms of many tables at once, header rows that say nothing, batches, lineage and bundles."""

from __future__ import annotations

import json
import zipfile

import pytest

from gridloom.operators import grid, headers
from gridloom.operators.naming import Namer
from gridloom.plans import catalog as K
from gridloom.plans.normalize import Options, normalize
from gridloom.operators.relate import Table
from gridloom.sources import cells as C

from .conftest import rows
from .test_files import workbook

BRANCHES = "支店別売上,,,\n,,,\n支店,部門,売上,件数\n東京,営業,60,6\n東京,総務,40,4\n東京,合計,100,10\n大阪,営業,30,3\n大阪,総務,20,2\n大阪,合計,50,5\n"


def test_forms_equal_tables_one_by_one(spark, tmp_path):
    (tmp_path / "a.csv").write_text("支店,売上,,地域,人口\n東京,100,,関東,4000.5\n大阪,80,,関西,2000\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("支店,売上\n札幌,7\n\n福岡,8\n仙台,9\n", encoding="utf-8")
    (tmp_path / "c.csv").write_text("商品,東京,,大阪,\n,売上,原価,売上,原価\n家電,100,70,80,50\n衣料,90,60,70,45\n", encoding="utf-8")
    (tmp_path / "d.csv").write_text("支店,売上\n京都,未定\n神戸,5\n奈良,6\n津,7\n", encoding="utf-8")
    cells, widths = C.read_csv_cells(spark, str(tmp_path))
    found = grid.detect_tables(cells, widths)
    forms = grid.extract_forms(cells, found)
    assert sorted(len(f.tables) for f in forms) == [1, 1, 1, 2]  # a's left table and b's have one form
    seen = 0
    for form in forms:
        for place in form.tables:
            alone = grid.extract(cells, place)
            own = form.frame.where(form.frame["__table"] == place["__table"]).drop("__table")
            assert own.columns == alone.columns and [t[1] for t in own.dtypes] == [t[1] for t in alone.dtypes] and rows(own) == rows(alone)
            seen += 1
    assert seen == found.count() == 5
    assert grid.extract_forms(cells, found.limit(0)) == []


def test_redundant_header_rows():
    rows_ = [[None, "売上", None, None, None], [None, "上期", None, "下期", None], ["支店", "4月", "5月", "10月", "11月"]]
    assert headers.redundant_rows(rows_, ["name"] * 3) == [0, 1]
    assert headers.names_without(rows_, ["name"] * 3, [0, 1]) == ["支店", "4月", "5月", "10月", "11月"]
    assert headers.redundant_rows([[None, "x", "x", "y", "y"], [None, "a", "b", "a", "b"]], ["name", "name"]) == []
    assert headers.redundant_rows([["a", "b"]], ["name"]) == [] and headers.names_without([["a"]], ["name"], [0]) is None
    assert headers.redundant_rows([[None, "x", "y", "x", "y"], ["支店", "1月", "1月", "2月", "2月"]], ["name", "name"]) == []  # an axis beside times


def test_titles_of_a_sheet():
    assert grid.propagate_title(["売上 / 2023年", "2024年", "別表", " 2025 "]) == ["売上_2023年", "売上_2024年", "別表", "売上_2025"]
    assert grid.propagate_title(["売上 / 2023年", "別表"]) == ["売上 / 2023年", "別表"]
    assert grid.propagate_title(["売上", "2024年"]) == ["売上", "2024年"] and grid.propagate_title([]) == []
    assert grid.propagate_title(["2022 / 2023", "2024"]) == ["2022 / 2023", "2024"]


def test_axis_where_a_namer_wants_it(frame):
    class Placed(Namer):
        def __init__(self, anchor, side):
            self.wanted = anchor, side

        def axis_position(self, labels):
            return self.wanted

    df = frame([("東", "a", 1, 2), ("西", "b", 3, 4)], "支店 string, 部門 string, 2023年 long, 2024年 long")
    told = lambda *w: [c for c in normalize(Table("t", "s", "売上", df), Options(namer=Placed(*w))).frame.columns if c != "__row"]
    assert told("支店", "before") == ["支店", "年", "売上", "部門"]  # the first label stays first
    assert told("gone", "after") == ["支店", "部門", "年", "売上"]


def inline(r, t):
    return f'<c r="{r}" t="inlineStr"><is><t>{t}</t></is></c>'


def test_files_to_a_bundle(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "支店.csv").write_text(BRANCHES, encoding="utf-8")
    sheet = f'<row>{inline("A1", "実績")}</row><row>{inline("A3", "指標")}{inline("B3", "2023年")}{inline("C3", "2024年")}</row>'
    sheet += "".join(f'<row>{inline(f"A{r}", n)}<c r="B{r}"><v>{v}</v></c><c r="C{r}"><v>{v + 1}</v></c></row>' for r, n, v in ((4, "人口", 10), (5, "世帯", 4)))
    workbook(tmp_path / "in" / "w.xlsx", sheet)
    found = K.files_to_bundle(spark, str(tmp_path / "in"), str(tmp_path / "cat"), str(tmp_path / "o.zip"))
    by_file = {e["file"].rsplit(".", 1)[-1]: i for i, e in found.entries.items()}
    assert len(found.entries) == 2 and found.frame().where("held").count() == 0
    branches = {t.id: t for t in found.tables}[by_file["csv"]]
    assert branches.title == "支店別売上" and rows(branches.frame) == [("東京", "営業", 60, 6), ("東京", "総務", 40, 4), ("大阪", "営業", 30, 3), ("大阪", "総務", 20, 2)]
    stacked = {t.id: t for t in found.tables}[by_file["xlsx"]]
    assert sorted(rows(stacked.frame)) == [("世帯", "2023年", 4), ("世帯", "2024年", 5), ("人口", "2023年", 10), ("人口", "2024年", 11)]
    assert {r["source_id"] for r in found.lineage(by_file["csv"], "row_audit").collect()} == {by_file["csv"]}
    with zipfile.ZipFile(tmp_path / "o.zip") as z:
        names = set(z.namelist())
        assert {"支店別売上.csv", "支店別売上_metadata.json"} <= names and "実績.csv" in names
        removed = json.loads(z.read("支店別売上_metadata.json"))["aggregate_rows_removed"]  # one a row and column
    assert sorted((x["context"]["支店"], x["sum_column"], x["reported_value"]) for x in removed) == [("大阪", "件数", 5), ("大阪", "売上", 50), ("東京", "件数", 10), ("東京", "売上", 100)]
    with pytest.raises(ValueError):
        K.read_cells(spark, ["x.xls"])


def test_batches_of_a_stream(spark, tmp_path):
    source, folder = tmp_path / "in", str(tmp_path / "cat")
    source.mkdir()
    (source / "a.csv").write_text(BRANCHES, encoding="utf-8")
    K.follow(spark, str(source), folder, str(tmp_path / "ck")).awaitTermination()
    first = K.load(spark, folder)
    assert len(first.tables) == 1 and first.tables[0].sheet == "CSV"
    (source / "b.csv").write_text(BRANCHES.replace("60,", "61,").replace("100,", "101,"), encoding="utf-8")
    K.follow(spark, str(source), folder, str(tmp_path / "ck")).awaitTermination()
    both = K.load(spark, folder)
    assert [t.sheet for t in both.tables] == ["a CSV", "b CSV"] and both.entries[first.tables[0].id]["frame"].startswith("batch=0")
    K.add(spark, [str(source / "b.csv")], folder, 1)  # once more, as after a lost driver
    assert len(K.load(spark, folder).tables) == 2
