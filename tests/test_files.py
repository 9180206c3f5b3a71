from __future__ import annotations

import zipfile

from .conftest import rows
from pyspark.sql import functions as F

from gridloom import sinks
from gridloom.operators import grid, select
from gridloom.sources import cells as C
from gridloom.streaming import files

SHEET = """売上表,,
,,
支店,売上,備考
東京,1000, 順調 
 名古屋,600.5,微減
大阪,800,

※概算
"""


def test_csv_cells():
    assert [C.csv_cell(x) for x in (" 123", "12.5", "  ", "", "  abc ")] == [123, 12.5, None, None, "  abc"]
    assert C.csv_rows("支店,x\n東京,1\n,\n".encode("cp932")) == [["支店", "x"], ["東京", 1]]


def test_detect_and_extract(spark, tmp_path):
    (tmp_path / "a.csv").write_text(SHEET, encoding="utf-8")
    cells, widths = C.read_csv_cells(spark, str(tmp_path))
    found = grid.detect_tables(cells, widths).collect()
    assert len(found) == 1 and found[0]["title"] == "売上表" and found[0]["notes"] == ["※概算"] and found[0]["table_id"] == "CSV_T1"
    out = grid.extract(cells, found[0].asDict())
    assert out.columns[1:] == ["支店", "売上", "備考"]
    assert rows(out) == [("東京", 1000.0, " 順調"), (" 名古屋", 600.5, "微減"), ("大阪", 800.0, None)]
    assert sinks.tree_text("a.csv", grid.detect_tables(cells, widths)).splitlines()[0] == "a.csv"


def test_side_by_side_tables(spark, tmp_path):
    (tmp_path / "b.csv").write_text("支店,売上,,地域,人口\n東京,100,,関東,4000\n大阪,80,,関西,2000\n", encoding="utf-8")
    cells, widths = C.read_csv_cells(spark, str(tmp_path))
    assert sorted((r["c0"], r["c1"]) for r in grid.detect_tables(cells, widths).collect()) == [(1, 2), (4, 5)]


def test_formulas():
    g = {(1, 1): 1, (2, 1): 2, (3, 1): "x", (1, 2): True}
    assert C.formula_value("=SUM(A1:A3)", g) == 3 and C.formula_value("$A$2", g) == 2 and C.formula_value("A1*A2", g) == 2
    assert C.formula_value("A1/A2", g) is None and C.formula_value("SUM(B1:B2)", g) is None
    C.fill_formulas(g, {(4, 1): "A5+A1", (5, 1): "SUM(A1,A2)"})
    assert g[(4, 1)] == 4 and C.column_number("AB") == 28


def workbook(path, sheet):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf/><xf><alignment indent="2"/></xf></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{sheet}</sheetData><mergeCells><mergeCell ref='A1:B1'/></mergeCells></worksheet>")


def test_workbook(spark, tmp_path):
    cell = lambda r, t: f'<c r="{r}" t="inlineStr"{" s=" + chr(34) + "1" + chr(34) if r == "A3" else ""}><is><t>{t}</t></is></c>'
    workbook(tmp_path / "w.xlsx", f'<row>{cell("A1", "head")}</row><row>{cell("A3", "支店")}<c r="B3"><v>5</v></c><c r="C3"><f>B3+B3</f></c></row>')
    found = {(r["r"], r["c"]): r["s"] if r["kind"] == "s" else r["d"] for r in C.read_workbook_cells(spark, str(tmp_path)).collect()}
    assert found == {(1, 1): "head", (1, 2): "head", (3, 1): "    支店", (3, 2): 5.0, (3, 3): 10.0}


def test_export_and_project(spark, frame, tmp_path):
    df = frame([("a", None), ("b", 1)], "x string, v long")
    names = sinks.bundle({"表 1": (df, None, None), "表/1": (df, None, None)}, str(tmp_path / "o.zip"))
    assert names == {"表 1": "表_1", "表/1": "表_1_1"}
    with zipfile.ZipFile(tmp_path / "o.zip") as z:
        assert z.read("表_1.csv").decode("utf-8") == "﻿x,v\na,\nb,1\n"
    sinks.save_project({"t": df}, str(tmp_path / "p"))
    assert rows(sinks.load_project(spark, str(tmp_path / "p"))["t"]) == [("a", None), ("b", 1)]
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    catalog = spark.createDataFrame([(True, False, False, False), (False, None, None, None)], "is_integrated boolean, is_minimum boolean, is_master boolean, recommended boolean")
    assert [r[0] for r in catalog.select(select.selection_group()).collect()] == ["integrated", "other"]
    assert rows(select.head(df, 1)) == [("a", None)]


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("x,y\n1,2\n")
    got = []
    q = files.on_each_batch(files.stream_csv_cells(spark, str(tmp_path / "in")), lambda df, _: got.append(df.agg(F.count("*")).first()[0]), str(tmp_path / "ck"))
    q.awaitTermination()
    assert sum(got) == 4
