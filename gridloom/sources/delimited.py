"""Delimited text of any size as rows of cells: files are read in splits, each line once.

Spark's text reader deals out splits of files (anywhere that Spark can read) as lines. A quoted field may hold line
ends, so a line alone doesn't tell whether it begins a row. Two passes settle that: the first notes of each
split only whether it ends inside quotes, if it begins outside them and if inside, and which encodings fit; composed
over a file's splits, a row each, that says how every split begins. The second parses. Rows that cross splits come
in pieces, which are put together by file. Numbers of rows are sums over splits.

A row is (file, sheet, r, width, cells): sheet is "CSV", width the count of its fields, cells those that hold
something. Empty rows at a file's end are left out, others have no cells.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..frame import stored
from .cells import csv_cell

#: In this order; whatever none of the others fits is the last.
ENCODINGS = ("utf-8", "cp932", "shift_jis", "latin-1")
CELL = "array<struct<c: int, kind: string, s: string, d: double>>"
SPLITS = "file string, block long, outside boolean, inside boolean, fits array<boolean>"
PARSED = f"file string, block long, k long, width int, cells {CELL}, piece binary"
#: Splits up to which their states are broadcast; beyond, lines are shuffled to them.
BROADCAST_SPLITS = 50_000
NEXT = re.compile(rb"[,\r]")


def ends_inside(line: bytes, inside: bool) -> bool:
    """Whether a line ends in an open quoted field. Quotes count only where a field begins, as the csv module has it."""
    i = 0
    while True:
        if inside:
            i = line.find(b'"', i) + 1
            if i == 0:
                return True
            if line[i : i + 1] == b'"':
                i += 1
                continue
            inside = False
        elif line[i : i + 1] == b'"':
            inside, i = True, i + 1
            continue
        found = NEXT.search(line, i)
        if not found:
            return False
        i = found.end()


def fields(lines: list[bytes], encoding: str) -> Iterator[list[str]]:
    raw = b"\n".join([*lines, b""])  # what an open field gains at a file's end is stripped from its cell
    csv.field_size_limit(1 << 30)
    return csv.reader(io.StringIO(raw.decode(encoding), newline=""))


def cell(c: int, v: object) -> dict:
    if isinstance(v, str):
        return {"c": c, "kind": "s", "s": v, "d": None}
    return {"c": c, "kind": "n", "s": None, "d": float(v)}


def _parsed(row: list[str]) -> tuple[int, list[dict]]:
    return len(row), [cell(c, v) for c, x in enumerate(row, 1) if (v := csv_cell(x)) is not None]


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, block, id, line): the lines of a split stand in one partition, in order."""
    text = spark.read.option("lineSep", "\n").text(paths)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").cast("binary").alias("line"))


def _runs(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, pd.DataFrame, bool]]:
    """(split, some of its lines in order, whether it is new); a split's lines follow one another."""
    before = None
    for pdf in parts:
        if len(pdf):
            change = (pdf["file"] != pdf["file"].shift()) | (pdf["block"] != pdf["block"].shift())
            for _, run in pdf.groupby(change.cumsum(), sort=False):
                split = (run["file"].iloc[0], int(run["block"].iloc[0]))
                yield split, run, split != before
                before = split


def _summaries(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    split, state, fits = None, [False, True], [True] * len(ENCODINGS)
    out = lambda: pd.DataFrame([(*split, *state, fits)], columns=["file", "block", "outside", "inside", "fits"])
    for now, run, new in _runs(parts):
        if new:
            if split:
                yield out()
            split, state, fits = now, [False, True], [True] * len(ENCODINGS)
        for line in run["line"]:
            if b'"' in line:
                state = [ends_inside(line, s) for s in state]
        raw = b"\n".join(run["line"])
        if not raw.isascii():
            fits = [f and _fits(raw, e) for f, e in zip(fits, ENCODINGS, strict=True)]
    if split:
        yield out()


def _fits(raw: bytes, encoding: str) -> bool:
    try:
        raw.decode(encoding)
    except UnicodeDecodeError:
        return False
    return True


def _begin(pdf: pd.DataFrame) -> pd.DataFrame:
    """How each of a file's splits begins, and the file's encoding."""
    pdf = pdf.sort_values("block")
    encoding = next(e for i, e in enumerate(ENCODINGS) if all(f[i] for f in pdf["fits"]))
    begins, state = [], False
    for outside, inside in zip(pdf["outside"], pdf["inside"], strict=True):
        begins.append(state)
        state = bool(inside if state else outside)
    return pd.DataFrame({"file": pdf["file"], "block": pdf["block"], "begins": begins, "encoding": encoding})


def _parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of splits, numbered within them, and pieces: what began before has k = -1, what goes on has the next k."""
    columns = ["file", "block", "k", "width", "cells", "piece"]
    split, inside, foreign, open_row, k = None, False, False, [], 0

    def left() -> pd.DataFrame:
        return pd.DataFrame([(*split, -1 if foreign else k, None, None, b"\n".join(open_row))] if open_row else [], columns=columns)

    for now, run, new in _runs(parts):
        if new:
            yield left()
            split, inside, open_row, k = now, bool(run["begins"].iloc[0]), [], 0
            foreign = inside
        encoding, whole, out = run["encoding"].iloc[0], [], []
        for line in run["line"]:
            open_row.append(line)
            if b'"' in line:
                inside = ends_inside(line, inside)
            if not inside:
                if foreign:
                    out.append((*split, -1, None, None, b"\n".join(open_row)))
                    foreign = False
                else:
                    whole += open_row
                open_row = []
        for row in fields(whole, encoding) if whole else ():
            out.append((*split, k, *_parsed(row), None))
            k += 1
        yield pd.DataFrame(out, columns=columns)
    if split:
        yield left()


def _join_pieces(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows of a file that cross splits, each in the split where it begins."""
    groups: list[tuple[int, int, list[bytes]]] = []
    for x in pdf.sort_values(["block", "k"]).itertuples(index=False):
        if x.k >= 0 or not groups:
            groups.append((x.block, max(x.k, 0), []))
        groups[-1][2].append(x.piece)
    encoding = pdf["encoding"].iloc[0]
    out = [(key[0], block, k + i, *_parsed(row), None) for block, k, pieces in groups for i, row in enumerate(fields(pieces, encoding))]
    return pd.DataFrame(out, columns=["file", "block", "k", "width", "cells", "piece"])


def read_rows(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Rows of all delimited files at the paths; both passes run at once, and the rows are stored."""
    lines = _lines(spark, paths)
    splits = stored(lines.mapInPandas(_summaries, SPLITS).groupBy("file").applyInPandas(_begin, "file string, block long, begins boolean, encoding string"))
    if splits.limit(BROADCAST_SPLITS + 1).count() <= BROADCAST_SPLITS:
        told = lines.join(F.broadcast(splits), ["file", "block"])  # keeps the lines' order
    else:
        told = lines.join(splits, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "id")
    parsed = stored(told.select("file", "block", "line", "begins", "encoding").mapInPandas(_parse, PARSED))
    pieces = parsed.where("piece is not null").join(splits.select("file", "encoding").distinct(), "file")
    rows = parsed.where("piece is null").unionByName(pieces.groupBy("file").applyInPandas(_join_pieces, PARSED)).drop("piece")
    counts = rows.groupBy("file", "block").agg((F.max("k") + 1).alias("n"), F.max(F.when(F.size("cells") > 0, F.col("k"))).alias("filled"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    based = counts.withColumn("base", before).withColumn("last", F.max(F.col("base") + F.col("filled")).over(Window.partitionBy("file")))
    placed = rows.join(based.select("file", "block", "base", "last"), ["file", "block"]).where("base + k <= last")
    return placed.select("file", F.lit("CSV").alias("sheet"), (F.col("base") + F.col("k") + 1).cast("int").alias("r"), "width", "cells")


def cells_of(rows: DataFrame) -> DataFrame:
    """Rows as cells in long form."""
    return rows.select("file", "sheet", "r", F.explode("cells").alias("x")).select("file", "sheet", "r", "x.c", "x.kind", "x.s", "x.d")


def widths_of(rows: DataFrame) -> DataFrame:
    return rows.select("file", "sheet", "r", "width")
