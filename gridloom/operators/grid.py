"""From cells to tables: row profiles and kinds, regions, column groups, quality, extraction.

Cells are rows (file, sheet, r, c, kind, s, d): kind "n" has its number in d, everything else its text in s.
Profiles and kinds are column expressions over all sheets at once; `bands` reads the rows' kinds, in blocks where
a sheet is long, and joins of cells with boxes go by slices of rows, so no sheet is one task. Header and data rows
of a table are ranges (first, last, n): n rows from first to last that aren't empty.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dicts as D
from ..frame import ROW, q, stored
from ..functions import labels as L
from .bands import BLOCK, KEYS, events, short_regions
from .headers import header_roles, merge_headers
from .naming import unique_columns

CELLS = "file string, sheet string, r int, c int, kind string, s string, d double"
#: Rows that cells and boxes are joined by at a time; rows of a table that are read to name its columns.
SLICE, HEADERS = 4096, 64
#: A band ends after five empty rows at most, so its rows are no farther apart than this.
LOOSE = 6


def is_filled() -> Column:
    return F.col("kind").isNotNull() & ((F.col("kind") != "s") | ~L.is_blank(F.col("s")))


def is_number() -> Column:
    """A number, a mark for a withheld one, or text that reads as one."""
    return (F.col("kind") == "n") | ((F.col("kind") == "s") & L.is_numeric_cell(F.col("s")))


def row_profiles(cells: DataFrame) -> DataFrame:
    filled, number = is_filled(), F.coalesce(is_number(), F.lit(False))
    text = filled & ~number
    value = F.when(F.col("kind") == "s", L.strip(F.col("s"))).otherwise(F.col("d").cast("string"))
    return cells.groupBy(*KEYS, "r").agg(
        F.count_if(filled).alias("filled"), F.count_if(filled & number).alias("numeric"), F.count_if(text).alias("text"), F.min(F.when(filled, F.col("c"))).alias("c_min"), F.max(F.when(filled, F.col("c"))).alias("c_max"),
        F.transform(F.array_sort(F.collect_list(F.when(text, F.struct("c", L.strip(F.col("s")).alias("t"))))), lambda x: x["t"]).alias("texts"),
        F.array_sort(F.collect_list(F.when(filled, F.struct("c", value.alias("v"))))).alias("values"),
    )


def row_kind() -> Column:
    """empty, data, note, title, col_hdr or mixed, from a row's profile."""
    ratio = F.col("numeric") / F.col("filled")
    first, distinct = F.get("texts", F.lit(0)), F.size(F.array_distinct("texts"))
    note = F.coalesce(first.rlike("^" + L.one_of(D.NOTE_ROW_PREFIXES)) | (F.length(first) > 60) | first.rlike(D.ENUMERATED_AGGREGATE), F.lit(False))
    longest = F.array_max(F.transform("texts", F.length))
    same = (F.col("numeric") == 0) & (F.col("text") >= 2) & (distinct == 1)
    single = (F.col("filled") == 1) & (F.col("text") == 1)
    return (
        F.when(F.col("filled") == 0, "empty").when(ratio >= 0.55, "data").when(single & note, "note").when(single, "title").when(same & note, "note").when(same & (F.col("c_min") > 1), "col_hdr")
        .when(same & (F.length(first) <= 40), "title").when(same, "col_hdr").when((longest > 80) & (ratio <= 0.3), "note").when((F.col("text") >= 2) & (ratio <= 0.3), "col_hdr").otherwise("mixed")
    )


def ranges(what: str) -> Column:
    """A band's rows of a kind as ranges in order, from its events."""
    return F.array_sort(F.collect_list(F.when(F.col("what") == what, F.struct(F.col("r0").alias("first"), F.col("r1").alias("last"), "n"))))


def regions(cells: DataFrame, block_rows: int = BLOCK) -> DataFrame:
    """Candidate tables of every sheet; a sheet of more than block_rows rows is read in blocks, by many tasks."""
    text = F.when(F.col("kind") == "title", F.array_join(F.array_distinct("texts"), " ")).when(F.col("kind") == "note", F.get("texts", F.lit(0)))
    rows = row_profiles(cells).withColumn("kind", row_kind()).select(*KEYS, "r", "kind", "c_min", "c_max", text.alias("text"), F.when(F.col("kind") == "col_hdr", F.col("values")).alias("values"))
    if cells.where(F.col("r") > block_rows).isEmpty():
        return short_regions(rows)
    found = stored(events(rows, block_rows))  # few rows, read three times below
    of = lambda what, c: F.when(F.col("what") == what, F.col(c))
    bands = found.where("what not in ('title', 'note') and band > 0").groupBy(*KEYS, "band").agg(
        F.max(of("open", "text")).cast("long").alias("titles_of"), F.min(of("open", "r0")).alias("start"), F.coalesce(F.max(of("close", "r0")), F.max(of("end", "r0"))).alias("band_end"), F.min("c0").alias("c0"), F.max("c1").alias("c1"),
        ranges("header").alias("header_rows"), ranges("data").alias("data_rows"), F.coalesce(F.sum(of("header", "n")), F.lit(0)).alias("n_header"),
    ).where("c1 >= c0 and (size(data_rows) > 0 or n_header >= 2)")
    lines = lambda what: F.transform(F.array_sort(F.collect_list(of(what, "told"))), lambda x: x["text"])
    told = found.where("what in ('title', 'note')").withColumn("told", F.struct("r0", "text"))
    titles = told.where("what = 'title'").groupBy(*KEYS, F.col("band").alias("titles_of")).agg(F.min("r0").alias("title_row"), lines("title").alias("titles"))
    notes = told.where("what = 'note'").groupBy(*KEYS, "band").agg(lines("note").alias("notes"))
    named = bands.join(titles, [*KEYS, "titles_of"], "left").join(notes, [*KEYS, "band"], "left")
    return named.select(
        *KEYS, (F.col("band") - 1).cast("int").alias("region"), F.coalesce("title_row", "start").alias("band_start"), "band_end", "c0", "c1", F.coalesce(F.array_join("titles", " "), F.lit("")).alias("title"),
        "header_rows", "data_rows", F.coalesce("notes", F.array().cast("array<string>")).alias("notes"),
    )


def inside(cells: DataFrame, boxes: DataFrame, first: str, last: str, then: str = "true") -> DataFrame:
    """Cells joined with the boxes whose rows they are in, by slices of SLICE rows, so that one long sheet is many keys."""
    part = F.floor(F.col("r") / SLICE)
    cut = boxes.withColumn("__slice", F.explode(F.sequence(F.floor(F.col(first) / SLICE), F.floor(F.col(last) / SLICE))))
    return cells.withColumn("__slice", part).join(cut, [*KEYS, "__slice"]).where(f"r between {first} and {last} and {then}").drop("__slice")


def column_groups(cells: DataFrame, found: DataFrame, widths: DataFrame | None = None) -> DataFrame:
    """Regions split at empty columns, judged by header and data rows only: gaps and islands over filled columns."""
    from pyspark.sql import Window

    rows = found.select(*KEYS, "region", F.explode(F.concat("header_rows", "data_rows")).alias("x")).select(*KEYS, "region", F.col("x.first").alias("r0"), F.col("x.last").alias("r1"))
    used = inside(cells.where(is_filled()).select(*KEYS, "r", "c"), rows, "r0", "r1").select(*KEYS, "region", "c").distinct()
    w = Window.partitionBy(*KEYS, "region").orderBy("c")
    islands = used.withColumn("g", F.col("c") - F.row_number().over(w)).groupBy(*KEYS, "region", "g").agg(F.min("c").alias("c0"), F.max("c").alias("c1"))
    islands = islands.withColumn("part", F.row_number().over(Window.partitionBy(*KEYS, "region").orderBy("c0")) - 1).drop("g")
    if widths is not None:  # delimited files: trailing empty columns up to the band's own width belong to the last group
        band = found.select(*KEYS, "region", "band_start", "band_end")
        own = inside(widths, band, "band_start", "band_end").groupBy(*KEYS, "region").agg(F.max("width").alias("width"))
        last = F.max("part").over(Window.partitionBy(*KEYS, "region"))
        islands = islands.join(own, [*KEYS, "region"], "left").withColumn("c1", F.when(F.col("part") == last, F.greatest("c1", F.coalesce("width", "c1"))).otherwise(F.col("c1"))).drop("width")
    return islands.join(found.drop("c0", "c1"), [*KEYS, "region"])


def quality(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """Adds `quality` (ok or discard): too sparse, no dense row, or prose."""
    box = tables.select(*KEYS, "region", "part", "band_start", "band_end", "c0", "c1")
    own = inside(cells.where(is_filled()), box, "band_start", "band_end", "c between c0 and c1")
    text = ~F.coalesce(is_number(), F.lit(False))
    size = F.length(L.strip(F.col("s")))
    per_row = own.groupBy(*KEYS, "region", "part", "r", "c0", "c1").agg(F.count("*").alias("n"), F.count_if(text).alias("t"), F.count_if(text & (size > 40)).alias("long"), F.max(F.when(text, size)).alias("longest"), F.count_if(~text).alias("num"))
    total = per_row.groupBy(*KEYS, "region", "part").agg(F.sum("n").alias("n"), F.sum("t").alias("t"), F.sum("long").alias("long"), F.max("longest").alias("longest"), F.sum("num").alias("num"), F.count_if(F.col("n") / (F.col("c1") - F.col("c0") + 1) >= 0.25).alias("dense"))
    area = (F.col("band_end") - F.col("band_start") + 1) * (F.col("c1") - F.col("c0") + 1)
    prose = (F.coalesce("longest", F.lit(0)) > 80) | ((F.col("t") >= 3) & (F.col("long") / F.col("t") > 0.25))
    bad = F.coalesce(F.col("n") / area < 0.2, F.lit(True)) | (F.col("dense") < 1) | (prose & (F.col("num") < 10) & (F.col("num") / area < 0.15))
    return tables.join(total, [*KEYS, "region", "part"], "left").withColumn("quality", F.when(bad, "discard").otherwise("ok")).drop("n", "t", "long", "longest", "num", "dense")


def detect_tables(cells: DataFrame, widths: DataFrame | None = None, block_rows: int = BLOCK) -> DataFrame:
    """One row a table: place, title, header and data rows as ranges, notes, quality, id."""
    from pyspark.sql import Window

    found = quality(cells, column_groups(cells, regions(cells, block_rows), widths)).where("quality = 'ok' and band_end > band_start")
    plain = F.translate("sheet", " /\\", "___")
    number = F.row_number().over(Window.partitionBy("file", plain).orderBy("sheet", "region", "part"))
    return found.withColumn("table_id", F.concat(plain, F.lit("_T"), number.cast("string")))


def _named(at: list[int], rows: list[list], width: int) -> tuple[list[str], int, list[list], list[str]]:
    """(names, row after which data begin, header rows, their roles) from a table's first rows and their numbers."""
    titles, roles = header_roles(rows)
    if not roles:
        return unique_columns([f"{D.EMPTY_HEADER}{i + 1}" for i in range(width)]), min(at, default=0) - 1, [], []
    heads = rows[titles : titles + len(roles)]
    return unique_columns(merge_headers(heads, roles, width)[0]), at[titles + len(roles) - 1], heads, roles


def extract(cells: DataFrame, place: dict) -> DataFrame:
    """A table's data as a DataFrame with `__row`; header rows (a few) are read to name the columns."""
    box = cells.where((F.col("file") == place["file"]) & (F.col("sheet") == place["sheet"]) & F.col("c").between(place["c0"], place["c1"]))

    def first_rows(spans: list, n: int) -> list[int]:
        any_of = reduce(lambda a, b: a | b, [F.col("r").between(x["first"], x["last"]) for x in spans[:n]], F.lit(False))
        return [x["r"] for x in box.where(any_of & is_filled()).select("r").distinct().orderBy("r").limit(n).collect()] if n > 0 and spans else []

    heads = first_rows(place["header_rows"], HEADERS)
    lead = heads + first_rows(place["data_rows"], 12 - len(heads))
    seen = {(x["r"], x["c"]): (x["d"] if x["kind"] == "n" else x["s"]) for x in box.where(F.col("r").isin(lead)).collect()}
    span = range(place["c0"], place["c1"] + 1)
    names, after, _, _ = _named(sorted(lead), [[seen.get((r, c)) for c in span] for r in sorted(lead)], len(span))
    body = box.where((F.col("r") > after) & (F.col("r") <= place["band_end"]))
    kinds = {x["c"]: x for x in body.groupBy("c").agg(F.count_if(F.col("kind") == "s").alias("t"), F.count_if((F.col("kind") == "n") & (F.col("d") != F.floor("d"))).alias("f")).collect()}
    wide = body.groupBy("r").pivot("c", list(span)).agg(F.first(F.struct("kind", "s", "d")))

    def value(c: int) -> Column:
        x, k = F.col(f"`{c}`"), kinds.get(c)
        if k and not k["t"]:
            return x["d"] if k["f"] else x["d"].cast("long")
        whole = x["d"].cast("long")
        return F.when(x["kind"] == "n", F.when(x["d"] == whole, whole.cast("string")).otherwise(x["d"].cast("string"))).otherwise(x["s"])

    out = wide.select(F.col("r").cast("long").alias(ROW), *[value(c).alias(n) for c, n in zip(span, names)])
    return out.na.drop(how="all", subset=names)


HEADINGS = "file string, sheet string, table_id string, names array<string>, after int, heads array<array<string>>, roles array<string>"


def headings(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """For every detected table its columns' names, the row after which its data begin, its header rows and their roles.

    Only a table's first rows are looked at, HEADERS header rows and up to 12 in all with data, so a table's share is
    small however long it is. Rows of a band are at most LOOSE rows apart.
    """
    from pyspark.sql import Window

    def spans(of: str, n: int, rank: int) -> DataFrame:
        span = F.explode(F.slice(of, 1, n)).alias("x")
        reach = F.least(F.col("x.last"), F.col("x.first") + n * LOOSE)
        return tables.select(*KEYS, "table_id", "c0", "c1", span).select(*KEYS, "table_id", "c0", "c1", F.col("x.first").alias("first"), reach.alias("last"), F.lit(rank).alias("rank"))

    own = inside(cells.where(is_filled()), spans("header_rows", HEADERS, 0).unionByName(spans("data_rows", 12, 1)), "first", "last", "c between c0 and c1")
    number = F.dense_rank().over(Window.partitionBy(*KEYS, "table_id").orderBy("rank", "r"))  # of at most some hundred rows
    own = own.withColumn("k", number).where(f"rank = 0 and k <= {HEADERS} or k <= 12")

    def name(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        c0, width = int(pdf["c0"].iloc[0]), int(pdf["c1"].iloc[0] - pdf["c0"].iloc[0]) + 1
        at = sorted(set(pdf["r"].tolist()))
        rows: dict[int, list] = {r: [None] * width for r in at}
        for r, c, kind, text, d in zip(pdf["r"].tolist(), pdf["c"].tolist(), pdf["kind"], pdf["s"], pdf["d"].tolist(), strict=True):
            rows[r][c - c0] = d if kind == "n" else text
        names, after, heads, roles = _named(at, [rows[r] for r in at], width)
        text = [[None if v is None else str(int(v)) if isinstance(v, float) and v.is_integer() else str(v) for v in row] for row in heads]
        return pd.DataFrame([(*key, names, after, text, roles)], columns=["file", "sheet", "table_id", "names", "after", "heads", "roles"])

    return own.groupBy(*KEYS, "table_id").applyInPandas(name, HEADINGS)


@dataclass
class Form:
    """Tables whose columns have the same names and types, in one frame: `__table` names each, (file, table_id) as JSON."""

    names: list[str]
    tables: list[dict]
    frame: DataFrame


def table_key() -> Column:
    return F.to_json(F.array("file", "table_id"))


def extract_forms(cells: DataFrame, tables: DataFrame) -> list[Form]:
    """All detected tables at once: one plan a form and not a table, over cells that are joined with boxes once.

    What comes back to the driver is a row a table (its place, names and columns' types), never cells.
    """
    tables = stored(tables)  # its plan is deep, and it is read four times
    told = stored(tables.join(headings(cells, tables), [*KEYS, "table_id"]).withColumn("__table", table_key()))
    box = told.select(*KEYS, "__table", "c0", "c1", "band_end", (F.col("after") + 1).alias("begin")).where("begin <= band_end")
    body = stored(inside(cells, box, "begin", "band_end", "c between c0 and c1").select("__table", F.col("r").cast("long").alias(ROW), (F.col("c") - F.col("c0")).alias("i"), "kind", "s", "d"))
    fraction = (F.col("kind") == "n") & (F.col("d") != F.floor("d"))
    cells_of = body.groupBy("__table", "i").agg(F.count_if(F.col("kind") == "s").alias("t"), F.count_if(fraction).alias("f"))
    types = cells_of.groupBy("__table").agg(F.map_from_entries(F.collect_list(F.struct("i", F.when(F.col("t") > 0, "s").when(F.col("f") > 0, "d").otherwise("n")))).alias("types"))
    forms: dict[tuple, list[dict]] = {}
    for x in told.join(types, "__table", "left").orderBy(*KEYS, "region", "part").collect():  # a row a table
        found = x["types"] or {}
        forms.setdefault((tuple(x["names"]), tuple(found.get(i, "n") for i in range(len(x["names"])))), []).append(x.asDict(recursive=True))
    return [Form(list(names), own, _one_form(body, list(names), kinds, [x["__table"] for x in own])) for (names, kinds), own in forms.items()]


def _one_form(body: DataFrame, names: list[str], kinds: tuple[str, ...], keys: list[str]) -> DataFrame:
    own = body.join(F.broadcast(body.sparkSession.createDataFrame([(k,) for k in keys], "__table string")), "__table")
    wide = own.groupBy("__table", ROW).pivot("i", list(range(len(names)))).agg(F.first(F.struct("kind", "s", "d")))

    def value(i: int) -> Column:
        x = F.col(f"`{i}`")
        whole = x["d"].cast("long")
        if kinds[i] != "s":
            return x["d"] if kinds[i] == "d" else whole
        return F.when(x["kind"] == "n", F.when(x["d"] == whole, whole.cast("string")).otherwise(x["d"].cast("string"))).otherwise(x["s"])

    return wide.select("__table", ROW, *[value(i).alias(n) for i, n in enumerate(names)]).na.drop(how="all", subset=[q(n) for n in names])


def propagate_title(titles: list[str]) -> list[str]:
    """A sheet's titles, where the first is a name and a year set apart by ` / `: others that are only a year get the name before it.

    The first then has the same form. Without such a title, or any that it applies to, all stay.
    """
    parts = [p.strip() for p in titles[0].split("/")] if titles and " / " in titles[0] else []
    name = " ".join(p for p in parts if p and not re.search(r"\d{4}", p))
    years = [p for p in parts if re.search(r"\d{4}", p)]
    if not name or not any(re.fullmatch(r"\s*\d{4}[年度]?\s*", t) for t in titles[1:]):
        return list(titles)
    rest = [f"{name}_{t.strip()}" if re.fullmatch(r"\s*\d{4}[年度]?\s*", t) else t for t in titles[1:]]
    return [f"{name}_{years[0]}" if years else titles[0], *rest]
