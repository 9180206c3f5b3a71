"""Files as cells: typed cells of delimited text (see `delimited`), and workbooks, one task a workbook."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..operators.formulas import column_number, fill, reference  # noqa: F401  references in workbooks are theirs
from ..operators.grid import CELLS

ENCODINGS = ("utf-8-sig", "cp932", "shift_jis", "utf-8", "latin-1")
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}


def csv_cell(raw: str) -> str | int | float | None:
    """Trailing white space goes, leading stays; what reads as a number is one."""
    text = raw.rstrip()
    if text == "":
        return None
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def _decode(content: bytes) -> str:
    for encoding in ENCODINGS:
        try:
            return content.decode(encoding)
        except UnicodeDecodeError:
            continue
    raise AssertionError("latin-1 decodes anything")


def csv_rows(content: bytes) -> list[list]:
    rows = [[csv_cell(x) for x in row] for row in csv.reader(io.StringIO(_decode(content), newline=""))]
    while rows and all(v is None for v in rows[-1]):
        rows.pop()
    return rows


def _cell(file: str, sheet: str, r: int, c: int, v: object) -> tuple:
    if isinstance(v, bool):
        return (file, sheet, r, c, "b", str(v), None)
    return (file, sheet, r, c, "n", None, float(v)) if isinstance(v, (int, float)) else (file, sheet, r, c, "s", v, None)


COLUMNS = ["file", "sheet", "r", "c", "kind", "s", "d"]


def read_csv_cells(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cells, widths): every file below path is a sheet named CSV; widths are the rows' own field counts.

    Both come from the same stored rows, so a file is parsed once.
    """
    from .delimited import cells_of, read_rows, widths_of

    rows = read_rows(spark, path)
    return cells_of(rows), widths_of(rows)


def formula_value(formula: str, grid: dict[tuple[int, int], object]) -> float | None:
    """SUM of ranges and cells, a single reference, or two references with + - *; None if it can't be told."""
    copy = {at: v for at, v in grid.items() if at != (0, 0)}
    fill(copy, {(0, 0): formula})
    return copy.get((0, 0))


def fill_formulas(grid: dict[tuple[int, int], object], formulas: dict[tuple[int, int], str]) -> None:
    """Values for cells that have a formula but no value, each after those that it needs."""
    fill(grid, formulas)


def workbook(content: bytes) -> dict[str, dict[tuple[int, int], object]]:
    """Sheets of an OOXML workbook: values, indents as leading blanks, merged ranges filled, formulas filled."""
    z = zipfile.ZipFile(io.BytesIO(content))
    xml = lambda name: ElementTree.fromstring(z.read(name)) if name in z.namelist() else None
    strings = [] if (root := xml("xl/sharedStrings.xml")) is None else ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in root.findall("m:si", _NS)]
    styles = xml("xl/styles.xml")
    indents = [int(a.get("indent", 0)) if (a := xf.find("m:alignment", _NS)) is not None else 0 for xf in styles.findall("m:cellXfs/m:xf", _NS)] if styles is not None else []
    targets = {x.get("Id"): x.get("Target") for x in xml("xl/_rels/workbook.xml.rels")}
    out: dict[str, dict[tuple[int, int], object]] = {}
    for sheet in xml("xl/workbook.xml").findall("m:sheets/m:sheet", _NS):
        root = xml("xl/" + targets[sheet.get(f"{{{_NS['r']}}}id")].removeprefix("/xl/").lstrip("/"))
        grid: dict[tuple[int, int], object] = {}
        formulas: dict[tuple[int, int], str] = {}
        for cell in root.iter(f"{{{_NS['m']}}}c"):
            at = reference(cell.get("r"))
            kind, v, f = cell.get("t", "n"), cell.find("m:v", _NS), cell.find("m:f", _NS)
            if f is not None and f.text:
                formulas[at] = f.text
            if kind == "inlineStr":
                value = "".join(t.text or "" for t in cell.iter(f"{{{_NS['m']}}}t"))
            elif v is None or v.text is None:
                continue
            elif kind == "s":
                value = strings[int(v.text)]
            elif kind == "b":
                value = v.text == "1"
            elif kind in ("str", "e", "d"):
                value = v.text
            else:
                value = float(v.text)
                value = int(value) if value.is_integer() else value
            if isinstance(value, str) and (k := int(cell.get("s", 0))) < len(indents):
                value = "  " * indents[k] + value
            grid[at] = value
        for merge in root.iter(f"{{{_NS['m']}}}mergeCell"):
            a, b = (reference(x) for x in merge.get("ref").split(":"))
            if grid.get(a) is not None:
                grid.update({(r, c): grid[a] for r in range(a[0], b[0] + 1) for c in range(a[1], b[1] + 1)})
        fill_formulas(grid, formulas)
        out[sheet.get("name")] = grid
    return out


def read_workbook_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cells of every .xlsx and .xlsm below path; other spreadsheet formats are refused by name."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def cells(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                if not file.lower().endswith((".xlsx", ".xlsm")):
                    raise ValueError(f"{file}: only .xlsx and .xlsm workbooks can be read")
                for sheet, grid in workbook(content).items():
                    yield pd.DataFrame([_cell(file, sheet, r, c, v) for (r, c), v in sorted(grid.items())], columns=COLUMNS)

    return files.mapInPandas(cells, CELLS)
