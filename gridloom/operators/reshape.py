"""Reshaping: pivots, unpivots, transposition, and splits of columns and labels.

Unpivots are one narrow `explode` of an array of structs; pivots always have their list of values.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_left
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dicts as D
from ..frame import ROW, col, data_columns, is_text, previous, profile, q
from ..functions import labels as L
from .naming import Namer, axis_name, resolve_generated, unique_columns, unique_name, value_name

PIVOT_LIMIT, SHEET_COLUMNS = 1000, 16384


def common_type(df: DataFrame, names: list[str]) -> T.DataType:
    """What the columns can share: the widest number, or text."""
    kinds = {df.schema[n].dataType.simpleString() for n in names}
    if len(kinds) == 1:
        return df.schema[names[0]].dataType
    if all(isinstance(df.schema[n].dataType, T.IntegralType) for n in names):
        return T.LongType()
    if all(isinstance(df.schema[n].dataType, T.NumericType) for n in names):
        return T.DoubleType()
    return T.StringType()


# --- key-value pivot ------------------------------------------------------------------------------


@dataclass(frozen=True)
class KeyValue:
    keys: tuple[str, ...]
    attribute: str
    value: str
    attributes: tuple[str, ...]  # as first seen
    records: int

    @property
    def warning(self) -> str | None:
        width = len(self.keys) + len(self.attributes)
        return "sheet" if width > SHEET_COLUMNS else "many" if len(self.attributes) > PIVOT_LIMIT else None


def _records(df: DataFrame, keys: list[str], attribute: str, partition: list[str] | None) -> DataFrame:
    """Adds `__record`: where keys change (or, without keys, where the first attribute comes again)."""
    if keys:
        key = F.struct(*[col(k).cast("string") for k in keys])
        base = previous(df.withColumn("__key", key), {"__before": F.struct(F.col("__key").alias("k"))}, partition or [], including=False)
        begins = F.col("__before").isNull() | ~F.col("__before.k").eqNullSafe(F.col("__key"))
    else:
        first = df.agg(F.min_by(col(attribute), ROW)).first()[0]
        base, begins = df, col(attribute) == F.lit(first)
    return previous(base.withColumn("__begins", begins), {"__record": F.when(F.col("__begins"), F.col(ROW))}, partition or [])


def detect_key_value(df: DataFrame, partition: list[str] | None = None) -> KeyValue | None:
    """Whether the last two columns are attribute and value of records in consecutive rows."""
    names = data_columns(df)
    if len(names) < 2 or not is_text(df, names[-2]):
        return None
    keys, attribute, value = names[:-2], names[-2], names[-1]
    seen = df.groupBy(col(attribute).alias("a")).agg(F.min(ROW).alias("r"), F.count("*").alias("n")).orderBy("r").limit(SHEET_COLUMNS + 2).collect()
    attributes = [r["a"] for r in seen]
    if len(attributes) < 2 or any(a is None or not a.strip() for a in attributes):
        return None
    rows = sum(r["n"] for r in seen)
    if not keys and len(attributes) > rows / 2:
        return None
    records = _records(df, keys, attribute, partition).groupBy("__record").agg(F.count("*").alias("n"), F.count_distinct(col(attribute)).alias("d"))
    r = records.agg(F.count("*").alias("records"), F.count_if(F.col("n") != F.col("d")).alias("repeats"), F.count_if(F.col("d") == len(attributes)).alias("complete")).first()
    if r["repeats"] or r["records"] < 2 or r["complete"] < max(1, r["records"] // 2):
        return None
    return KeyValue(tuple(keys), attribute, value, tuple(attributes), r["records"])


def rank_attributes(df: DataFrame, attribute: str) -> DataFrame:
    """(attribute, n, first_row), most frequent first, ties as first seen."""
    return df.groupBy(col(attribute).alias("attribute")).agg(F.count("*").alias("n"), F.min(ROW).alias("first_row")).orderBy(F.desc("n"), "first_row")


def limit_attributes(info: KeyValue, ranked: list[str], n: int) -> KeyValue:
    keep = set(ranked[:n])
    return replace(info, attributes=tuple(a for a in info.attributes if a in keep))


def pivot_key_value(df: DataFrame, info: KeyValue, partition: list[str] | None = None, fill: str | None = "") -> DataFrame:
    """A row a record; missing attributes are `fill` as text (None keeps null and the value's type)."""
    rows = _records(df, list(info.keys), info.attribute, partition)
    rows = rows.where(col(info.attribute).isin(list(info.attributes)))
    cells = rows.groupBy("__record", *[col(k) for k in info.keys]).pivot(q(info.attribute), list(info.attributes)).agg(F.first(col(info.value), ignorenulls=True))
    if fill is not None:
        holes = cells.agg(*[F.count_if(col(a).isNull()).alias(f"h{i}") for i, a in enumerate(info.attributes)]).first()
        cells = cells.withColumns({a: F.coalesce(col(a).cast("string"), F.lit(fill)) for i, a in enumerate(info.attributes) if holes[f"h{i}"]})
    return cells.withColumnRenamed("__record", ROW)


def decide_pivot(df: DataFrame, info: KeyValue, policy: str | tuple[str, int] = "hold") -> DataFrame | None:
    """A wide pivot is held unless told to continue or to keep the n most frequent attributes; cancel returns the input."""
    if info.warning is None or policy == "continue":
        return pivot_key_value(df, info)
    if policy == "cancel":
        return df
    if isinstance(policy, tuple):
        ranked = [r["attribute"] for r in rank_attributes(df, info.attribute).limit(policy[1]).collect()]
        return pivot_key_value(df, limit_attributes(info, ranked, policy[1]))
    return None


# --- unpivots -------------------------------------------------------------------------------------


def unpivot(df: DataFrame, labels: list[str], items: list[tuple[dict[str, object], dict[str, str | None]]], names: list[str], values: list[str]) -> DataFrame:
    """One output row for each input row and item: literals under `names`, cells of columns under `values`.

    Rows come item by item in the order key (`__row`), as stacking column after column gives them.
    """
    kinds = {v: common_type(df, [c for _, cells in items if (c := cells.get(v))] or [data_columns(df)[0]]) for v in values}
    parts = []
    for i, (keys, cells) in enumerate(items):
        parts.append(F.struct(F.lit(i).alias("ord"), *[F.lit(keys[n]).alias(n) for n in names], *[(col(cells[v]).cast(kinds[v]) if cells.get(v) else F.lit(None).cast(kinds[v])).alias(v) for v in values]))
    flat = df.select(ROW, *[col(c) for c in labels], F.explode(F.array(*parts)).alias("__m"))
    m = lambda n: F.col(f"__m.{q(n)}").alias(n)
    return flat.select(F.struct(F.col("__m.ord"), F.col(ROW).alias("row")).alias(ROW), *[col(c) for c in labels], *[m(n) for n in names], *[m(v) for v in values])


@dataclass(frozen=True)
class CrossTable:
    labels: tuple[str, ...]
    times: tuple[str, ...]
    axis: str
    value: str
    year: str | None


def detect_cross_table(names: list[str], title: str | None = None, file: str | None = None, namer: Namer | None = None) -> CrossTable | None:
    """Columns from the first time on, if at least two and four fifths of them are times."""
    kinds = [L.time_kind_name(n) for n in names]
    start = next((i for i, k in enumerate(kinds) if k), None)
    if len(names) < 3 or start is None or start == 0:
        return None
    after = [(n, k) for n, k in zip(names[start:], kinds[start:])]
    times = [n for n, k in after if k]
    if len(times) < 2 or len(times) / len(after) < 0.8:
        return None
    found = [k for _, k in after if k]
    year = None
    if set(found) == {"month"}:
        for text in (title, file):
            if text and (m := re.search(D.YEAR, text)) and 1900 <= int(m[0]) <= 2099:
                year = m[0]
                break
    return CrossTable(tuple(names[:start]) + tuple(n for n, k in after if not k), tuple(times), axis_name(times, namer)[0], value_name(title, namer)[0], year)


def stack_cross_table(df: DataFrame, info: CrossTable, drop_aggregates: bool = True, namer: Namer | None = None) -> DataFrame:
    """(labels[, year], axis, value); aggregate-named times are dropped before they are stacked."""
    renames, (axis, value), _ = resolve_generated(list(info.labels), [info.axis, info.value], namer)
    df = df.withColumnsRenamed(renames)
    labels = [renames.get(c, c) for c in info.labels]
    times = [t for t in info.times if not (drop_aggregates and L.is_agg_name(t))]
    out = unpivot(df, labels, [({axis: t}, {value: t}) for t in times], [axis], [value])
    if info.year is None:
        return out
    return out.select(ROW, *[col(c) for c in labels], F.lit(int(info.year)).alias(unique_name("年", [*labels, axis, value])), col(axis), col(value))


@dataclass(frozen=True)
class WideGrid:
    labels: tuple[str, ...]
    tokens: tuple[str, ...]  # axis values, sorted
    indicators: tuple[str, ...]  # as first seen
    cells: tuple[tuple[str, str, str], ...]  # (token, indicator, column)
    axis: str
    tier: int


def split_time(name: str) -> tuple[str, str] | None:
    """(time, indicator) of a name that begins or ends with a time; the longest time wins."""
    best: tuple[str, str] | None = None
    for cut in range(1, len(name)):
        for time, rest in ((name[:cut], name[cut:]), (name[cut:], name[:cut])):
            time, rest = time.strip("_- 　"), rest.strip("_- 　")
            if rest and L.time_kind_name(time) and (best is None or len(time) > len(best[0])):
                best = (time, rest)
    return best


def _grid(names: list[str], parsed: dict[str, tuple[str, str]], least: float, complete: float, tier: int, namer: Namer | None) -> WideGrid | None:
    """A grid of axis values by indicators, if enough columns parse and enough cells are there."""
    places = [i for i, n in enumerate(names) if n in parsed]
    if not places:
        return None
    after = names[places[0] :]
    tokens, indicators = sorted({t for t, _ in parsed.values()}), list(dict.fromkeys(parsed[n][1] for n in names if n in parsed))
    cells = {parsed[n]: n for n in names if n in parsed}
    if len(parsed) / len(after) < least or len(tokens) < 2 or len(indicators) < 2 or len(cells) / (len(tokens) * len(indicators)) < complete:
        return None
    return WideGrid(tuple(n for n in names if n not in parsed), tuple(tokens), tuple(indicators), tuple((t, i, c) for (t, i), c in cells.items()), axis_name(tokens, namer)[0], tier)


def _recurring(names: list[str], least: int) -> dict[str, tuple[str, str]]:
    """{name: (its longest beginning that recurs, the rest)}.

    A beginning recurs if two names have it with `least` characters or more behind it. In sorted order the names that
    share most with one are its neighbours, so each looks at two on either side: no table of all beginnings is made.
    """
    stems = sorted(n[: len(n) - least] for n in names if len(n) >= 2 * least)
    out = {}
    for n in names:
        at = bisect_left(stems, n)
        shared = sorted((len(os.path.commonprefix([n, s])) for s in stems[max(0, at - 2) : at + 2]), reverse=True)
        if len(shared) > 1 and shared[1] >= least:
            head, rest = n[: shared[1]], n[shared[1] :].strip("_- 　")
            if rest:
                out[n] = (head, rest)
    return out if len(out) >= 2 else {}


def recurring_parts(names: list[str], least: int = 2) -> dict[str, tuple[str, str]] | None:
    """{name: (axis value, indicator)} by beginnings that recur, or by endings if more names have such."""
    bare = {n.strip(): n for n in names}
    heads = _recurring(list(bare), least)
    tails = {n[::-1]: (a[::-1], b[::-1]) for n, (a, b) in _recurring([n[::-1] for n in bare], least).items()}
    best = tails if len(tails) > len(heads) else heads
    return {bare[n]: p for n, p in best.items()} or None


def detect_wide(names: list[str], namer: Namer | None = None, relaxed: bool = False, orientation: str = "axis-first") -> WideGrid | None:
    """Columns that are axis value and indicator at once: by times, by a delimiter, or (with a Namer) by recurring parts."""
    parsed = {n: p for n in names if (p := split_time(n))}
    if parsed and (found := _grid(names, parsed, 0.8, 0.6, 1, namer)):
        return found
    columns, least, complete = (4, 0.8, 0.6) if relaxed else (6, 0.9, 0.75)
    best = None
    for delimiter in D.AXIS_DELIMITERS:
        parsed = {n: (a.strip(), b.strip()) for n in names if n.count(delimiter) == 1 for a, b in [n.split(delimiter)] if a.strip() and b.strip()}
        if orientation != "axis-first":
            parsed = {n: (b, a) for n, (a, b) in parsed.items()}
        if len(parsed) < columns or any(p.isdigit() for pair in parsed.values() for p in pair):
            continue
        found = _grid(names, parsed, least, complete, 2, namer)
        if found and max(len(found.tokens), len(found.indicators)) >= (2 if relaxed else 3) and (best is None or len(found.cells) > len(best.cells)):
            best = found
    if best or namer is None:
        return best
    parsed = recurring_parts([n for n in names if L.time_kind_name(n) is None]) or {}
    found = _grid(names, parsed, 0.8, 0.6, 3, namer) if parsed else None
    return found if found and namer.category_axis(list(found.tokens)) else None


def stack_wide(df: DataFrame, info: WideGrid, drop_aggregates: bool = True, namer: Namer | None = None) -> DataFrame:
    """(labels, axis, an indicator a column), an axis value after the other; missing cells are null. No shuffle."""
    renames, final, _ = resolve_generated(list(info.labels), [info.axis, *info.indicators], namer)
    axis, indicators = final[0], dict(zip(info.indicators, final[1:]))
    df = df.withColumnsRenamed(renames)
    cells = {(t, i): c for t, i, c in info.cells}
    items = [({axis: t}, {indicators[i]: cells.get((t, i)) for i in info.indicators}) for t in info.tokens if not (drop_aggregates and L.is_agg_name(t))]
    return unpivot(df, [renames.get(c, c) for c in info.labels], items, [axis], list(indicators.values()))


def place_axis(columns: list[str], axis: list[str], anchor: str, side: str) -> list[str]:
    """Columns with the axis group before or after an anchor; the first label stays first."""
    rest = [c for c in columns if c not in axis]
    at = rest.index(anchor) + (side == "after") if anchor in rest else len(rest)
    at = max(at, 1)
    return rest[:at] + axis + rest[at:]


def transpose(df: DataFrame, name: str = "項目") -> DataFrame:
    """The first column's values become columns (in row order) and the other headers the first column.

    Empty values get a placeholder and repeated ones a number, as headers do. A table of more rows than a sheet has
    columns can't be turned and raises ValueError.
    """
    first, *others = data_columns(df)
    found = df.select(F.struct(ROW).alias("at"), col(first).cast("string").alias("head")).orderBy("at").limit(SHEET_COLUMNS + 1).collect()
    if len(found) > SHEET_COLUMNS:
        raise ValueError(f"more than {SHEET_COLUMNS} rows to make columns of")
    kind = common_type(df, others)
    heads = [h if h != name else unique_name(name, [r["head"] for r in found]) for h in unique_columns([r["head"] for r in found])]
    numbered = T.StructType([T.StructField("__key", df.schema[ROW].dataType), T.StructField("__at", T.LongType())])
    places = df.sparkSession.createDataFrame([(r["at"][ROW], k) for k, r in enumerate(found, 1)], numbered)  # at most a sheet's columns
    cells = F.array(*[F.struct(F.lit(c).alias("c"), col(c).cast(kind).alias("v")) for c in others])
    long = df.join(F.broadcast(places), F.col(ROW) == F.col("__key")).select("__at", F.posexplode(cells).alias("__pos", "__cell"))
    wide = long.groupBy("__pos", F.col("__cell.c").alias(name)).pivot("__at", list(range(1, len(heads) + 1))).agg(F.first("__cell.v", ignorenulls=True))
    return wide.select(F.col("__pos").alias(ROW), col(name), *[F.col(str(k + 1)).alias(h) for k, h in enumerate(heads)])


# --- header axes ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class HeaderAxes:
    labels: tuple[str, ...]
    axes: tuple[tuple[str, ...], ...]  # per axis, the value over each data column
    columns: tuple[str, ...]
    kinds: tuple[str, ...]
    unit: str | None = None


def stack_header_axes(df: DataFrame, info: HeaderAxes, names: list[str], value: str, indicator: int | None = None, namer: Namer | None = None) -> DataFrame:
    """A multi-key unpivot; with an indicator axis its values become columns instead (no shuffle either).

    A label column that has the name of a new column keeps its values under another name.
    """
    others = [i for i in range(len(names)) if i != indicator]
    measures = [value + (f"[{info.unit}]" if info.unit else "")] if indicator is None else list(dict.fromkeys(info.axes[indicator]))
    renames, final, _ = resolve_generated(list(info.labels), [*[names[i] for i in others], *measures], namer)
    axes, measure = final[: len(others)], dict(zip(measures, final[len(others) :]))
    df = df.withColumnsRenamed({c: new for c, new in renames.items() if c in info.labels})
    groups: dict[tuple, dict[str, str]] = {}
    for k, c in enumerate(info.columns):
        groups.setdefault(tuple(info.axes[i][k] for i in others), {})[measure[measures[0] if indicator is None else info.axes[indicator][k]]] = c
    items = [(dict(zip(axes, key)), cells) for key, cells in groups.items()]
    return unpivot(df, [renames.get(c, c) for c in info.labels], items, axes, list(measure.values()))


# --- splits of names and labels --------------------------------------------------------------------


def _split_name(name: str) -> tuple[str, list[str]] | None:
    for d in D.HIERARCHY_DELIMITERS:
        parts = [p.strip() for p in name.split(d)]
        if len(parts) >= 2 and all(len(p) >= 2 and not p.isnumeric() for p in parts):
            return d, parts
    return None


def _cell_parts(c: Column) -> Column:
    return F.transform(F.split(c, "[" + "".join(re.escape(d) for d in D.HIERARCHY_DELIMITERS) + "]"), L.strip)


def detect_name_splits(df: DataFrame) -> dict[str, list[str]]:
    """Columns whose name and most cells split into the same number of parts."""
    wanted = {c: s[1] for c in data_columns(df) if L.time_kind_name(c) is None and (s := _split_name(c))}
    if not wanted:
        return {}
    aggs = []
    for i, (c, parts) in enumerate(wanted.items()):
        cell = col(c).cast("string")
        filled = ~L.is_blank(cell)
        pieces = _cell_parts(cell)
        aggs += [F.count_if(filled).alias(f"n{i}"), F.count_if(filled & (F.size(pieces) == len(parts)) & F.forall(pieces, lambda x: F.length(x) > 0)).alias(f"k{i}")]
    r = df.agg(*aggs).first()
    return {c: parts for i, (c, parts) in enumerate(wanted.items()) if r[f"n{i}"] >= 2 and r[f"k{i}"] / r[f"n{i}"] >= 0.8}


def split_columns(df: DataFrame, splits: dict[str, list[str]]) -> DataFrame:
    """Each column becomes its parts as text; cells that don't split stay in the first part."""
    out = []
    for c in df.columns:
        if c not in splits:
            out.append(col(c))
            continue
        parts, cell = splits[c], L.strip(col(c).cast("string"))
        pieces = _cell_parts(cell)
        fits = F.size(pieces) == len(parts)
        for i, name in enumerate(parts):
            whole = F.coalesce(cell, F.lit("")) if i == 0 else F.lit("")
            out.append(F.when(cell.isNotNull() & fits, F.get(pieces, F.lit(i))).otherwise(whole).alias(name))
    return df.select(*out)


def detect_annotations(df: DataFrame) -> list[str]:
    """Text columns most of whose cells end in a bracketed note that is no unit, number or footnote."""
    names = [c for c in data_columns(df) if is_text(df, c) and L.time_kind_name(c) is None]
    aggs = []
    for i, c in enumerate(names):
        cell = col(c).cast("string")
        _, note = L.unit_parts(cell)
        real = note.isNotNull() & ~L.is_unit(note) & ~note.rlike(r"(?U)^\d+$") & ~note.rlike(r"(?U)^[※＊*注]\s*\d*$")
        aggs += [F.count_if(~L.is_blank(cell)).alias(f"n{i}"), F.count_if(real).alias(f"k{i}"), F.count_distinct(F.when(real, note)).alias(f"d{i}")]
    if not names:
        return []
    r = df.agg(*aggs).first()
    return [c for i, c in enumerate(names) if r[f"k{i}"] >= 2 and r[f"k{i}"] / r[f"n{i}"] >= 0.6 and r[f"d{i}"] >= 2]


def split_annotations(df: DataFrame, names: dict[str, str], namer: Namer | None = None, log: list[dict] | None = None) -> DataFrame:
    """{column: name of its annotation column, put right after it}; cells without a note get "".

    A column that has a new one's name already is renamed and keeps its data; log, if given, gets what was renamed.
    """
    marked = [c for c in df.columns if c in names]
    renames, final, told = resolve_generated(data_columns(df), [names[c] for c in marked], namer)
    new, out = dict(zip(marked, final)), []
    if log is not None:
        log += told
    for c in df.columns:
        if c not in names:
            out.append(col(c).alias(renames.get(c, c)))
            continue
        label, note = L.unit_parts(col(c).cast("string"))
        real = note.isNotNull() & ~L.is_unit(note)
        out += [F.when(real, L.strip(label)).otherwise(col(c).cast("string")).alias(renames.get(c, c)), F.when(real, note).otherwise("").alias(new[c])]
    return df.select(*out)


@dataclass(frozen=True)
class UnitSplit:
    frame: DataFrame
    master: DataFrame
    column: str


def split_units(df: DataFrame) -> UnitSplit | None:
    """The best column of labels with a unit in brackets: labels cleaned, and a master (label, unit), first unit first."""
    names = [c for c in data_columns(df) if is_text(df, c)]
    if not names:
        return None
    aggs = []
    for i, c in enumerate(names):
        cell = col(c).cast("string")
        _, unit = L.unit_parts(cell)
        ok = unit.isNotNull() & L.is_unit(unit)
        aggs += [F.count_if(~L.is_blank(cell)).alias(f"n{i}"), F.count_if(ok).alias(f"k{i}"), F.count_distinct(F.when(ok, unit)).alias(f"d{i}")]
    r = df.agg(*aggs).first()
    good = [(r[f"k{i}"] / r[f"n{i}"], -i) for i in range(len(names)) if r[f"n{i}"] and r[f"k{i}"] / r[f"n{i}"] >= 0.6 and r[f"d{i}"] >= 2]
    if not good:
        return None
    name = names[-max(good)[1]]
    label, unit = L.unit_parts(col(name).cast("string"))
    ok = unit.isNotNull() & L.is_unit(unit)
    clean = F.when(ok, L.strip(label)).otherwise(col(name).cast("string"))
    master = df.where(ok).groupBy(L.strip(label).alias(name)).agg(F.min_by(unit, ROW).alias("単位"), F.min(ROW).alias(ROW)).select(ROW, col(name), F.col("単位"))
    return UnitSplit(df.withColumn(name, clean), master, name)


# --- hierarchies -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Hierarchy:
    column: str
    mode: str  # indent or delimiter
    depth: int
    widths: tuple[int, ...] = ()
    delimiter: str = ""


def detect_hierarchy(df: DataFrame, excluded: frozenset[str] = frozenset()) -> Hierarchy | None:
    """The deepest column of indented labels or delimited paths, 2 to 5 levels, without aggregate labels."""
    best = None
    names = [c for c in data_columns(df) if is_text(df, c) and c not in excluded and L.time_kind_name(c) is None and not re.match(D.PLACEHOLDER_COLUMN, c, re.I)]
    for c in names:
        cell = col(c).cast("string")
        filled = ~L.is_blank(cell)
        widths = [r[0] for r in df.where(filled).select(L.indent_width(cell)).distinct().limit(7).collect()]
        found = None
        if 2 <= len(widths) <= 5:
            widths = sorted(widths)
            level = reduce(lambda a, b: a + b, [(L.indent_width(cell) > w).cast("int") for w in widths[:-1]])
            base = previous(df.where(filled).withColumn("__level", level), {"__before": F.col("__level")}, [], including=False)
            r = base.agg(F.count_if(F.col("__level") > 0).alias("k"), F.count_if(F.col("__level") > F.coalesce("__before", F.lit(-1)) + 1).alias("jumps"), F.count_if(L.is_agg_label(cell)).alias("agg")).first()
            if r["k"] >= 2 and not r["jumps"] and not r["agg"]:
                found = Hierarchy(c, "indent", len(widths), tuple(widths))
        for d in D.HIERARCHY_DELIMITERS if found is None else []:
            parts = F.transform(F.split(cell, re.escape(d)), L.strip)
            parses = filled & (F.size(parts) >= 2) & F.forall(parts, lambda x: F.length(x) > 0)
            r = df.agg(F.count_if(filled).alias("n"), F.count_if(parses).alias("k"), F.max(F.when(parses, F.size(parts))).alias("deep"), F.count_if(filled & F.exists(parts, L.is_agg_label)).alias("agg")).first()
            if r["n"] and r["k"] / r["n"] >= 0.6 and 2 <= r["deep"] <= 5 and not r["agg"]:
                found = Hierarchy(c, "delimiter", r["deep"], delimiter=d)
                break
        if found and (best is None or found.depth > best.depth):
            best = found
    return best


def level_names(column: str, depth: int) -> list[str]:
    if depth == 2:
        return [f"{column}_大分類", f"{column}_小分類"]
    if depth == 3:
        return [f"{column}_大分類", f"{column}_中分類", f"{column}_小分類"]
    return [f"{column}_レベル{i + 1}" for i in range(depth)]


def expand_hierarchy(df: DataFrame, info: Hierarchy, names: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """The column becomes its levels, "" where a row has none; an ancestor counts until a shallower row comes."""
    renames, names, _ = resolve_generated([c for c in data_columns(df) if c != info.column], names or level_names(info.column, info.depth))
    df = df.withColumnsRenamed(renames)
    cell = col(info.column).cast("string")
    if info.mode == "delimiter":
        parts = F.transform(F.split(cell, re.escape(info.delimiter)), L.strip)
        levels = [F.coalesce(F.get(parts, F.lit(i)), F.lit("")) for i in range(info.depth)]
        base = df
    else:
        level = reduce(lambda a, b: a + b, [(L.indent_width(cell) > w).cast("int") for w in info.widths[:-1]])
        base = df.withColumns({"__level": F.when(~L.is_blank(cell), level), "__name": L.strip(cell)})
        last = {f"__l{k}": F.when(F.col("__level") == k, F.struct(F.col(ROW).alias("r"), F.col("__name").alias("v"))) for k in range(info.depth)}
        base = previous(base, last, keys or [])
        levels = []
        for k in range(info.depth):
            above = reduce(lambda a, b: F.greatest(a, b), [F.coalesce(F.col(f"__l{j}.r"), F.lit(-1)) for j in range(k)], F.lit(-1))
            levels.append(F.when((F.col("__level") >= k) & (F.col(f"__l{k}.r") > above), F.col(f"__l{k}.v")).otherwise(""))
    out = []
    for c in df.columns:
        out += [v.alias(n) for v, n in zip(levels, names)] if c == info.column else [col(c)]
    return base.select(*out)


def sample_paths(df: DataFrame, info: Hierarchy, n: int = 30) -> list[list[str]]:
    """The levels of the first rows that have any, in order: what a Namer sees of a hierarchy."""
    names = [f"__level{i}" for i in range(info.depth)]
    levels = expand_hierarchy(df.select(ROW, col(info.column)), info, names)
    filled = reduce(lambda a, b: a | b, [col(c) != "" for c in names])
    return [[r[c] for c in names if r[c]] for r in levels.where(filled).orderBy(ROW).limit(n).collect()]


def add_constants(df: DataFrame, items: list[dict]) -> DataFrame:
    """Constant columns {name, value, anchor, side} beside their anchors; unknown anchors put them last, never first."""
    order = data_columns(df)
    for item in items:
        df = df.withColumn(item["name"], F.lit(item["value"]))
        at = order.index(item["anchor"]) + (item.get("side", "after") == "after") if item.get("anchor") in order else len(order)
        order.insert(max(at, 1), item["name"])
    return df.select(*([ROW] if ROW in df.columns else []), *[col(c) for c in order])
