"""Subtotals: removal of aggregate rows and columns, reconciliation, and "of which" rows."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dicts as D
from ..frame import ROW, col, data_columns, grouping_columns, is_numeric, is_text, label_columns, number, previous, profile, stored
from ..functions import labels as L
from .naming import Namer, resolve_generated

AUDIT = "array<struct<key:string,context:map<string,string>,sum_column:string,reported_value:double>>"


def close(a: Column, b: Column, relative: float = D.RELATIVE) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(D.TOLERANCE), F.abs(a) * relative)


def group_key(name: str) -> str:
    """What a column name shares with others of its header group; "" for a name of one part."""
    bare = re.sub(r"\s*\[[^\]]*\]\s*$", "", name).strip()
    return bare.split("_")[0] if "_" in bare else ""


def dependencies(df: DataFrame, names: list[str], size: int = 1) -> dict[tuple[str, ...], set[str]]:
    """{determinant: columns that it decides}: determinants are sets of at most `size` columns, none larger than need be.

    A set of columns cuts the rows into groups, a null being a value of its own; it decides a column that has no
    group with two values, nulls aside. Rows are put together by their combination of values first. A level is one
    job: each combination goes once to a group of every column set that is tried, and a group compares the least and
    the greatest value of each column. Sets whose parts decide all other columns aren't tried.
    """
    out: dict[tuple[str, ...], set[str]] = {}
    combined = df.groupBy(*[col(c).cast("string").alias(f"c{i}") for i, c in enumerate(names)]).agg(F.count("*").alias("rows"))
    decided: dict[tuple[int, ...], set[int]] = {}
    below = lambda s: set().union(*(t for d, t in decided.items() if set(d) <= set(s)))
    for level in range(1, size + 1):
        sets = [s for s in combinations(range(len(names)), level) if len(below(s) | set(s)) < len(names)]
        if not sets:
            break
        if level == 2:
            combined = stored(combined)
        # one array with an entry for each set; keys of a set are its values, so equal ones of other sets don't meet
        keys = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.array(*[F.col(f"c{i}") for i in s]).alias("key")) for k, s in enumerate(sets)])).alias("x")
        cells = [f"c{i}" for i in range(len(names))]
        grouped = combined.select("rows", *cells, keys).groupBy("x.k", "x.key").agg(F.sum("rows").alias("rows"), *[(F.min(c) != F.max(c)).alias(c) for c in cells])
        for r in grouped.groupBy("k").agg(F.sum("rows").alias("n"), *[F.count_if(F.col(c)).alias(c) for c in cells]).collect():
            s = sets[r["k"]]
            if r["n"] >= 2:
                decided[s] = {j for j in range(len(names)) if j not in s and not r[f"c{j}"] and j not in below(s)}
    for s, targets in decided.items():
        if targets:
            out[tuple(names[i] for i in s)] = {names[j] for j in targets}
    return out


def dependent_columns(df: DataFrame, names: list[str]) -> dict[str, set[str]]:
    """Columns of which one decides the other, either way."""
    out: dict[str, set[str]] = {c: set() for c in names}
    if len(names) > 1:
        for (a,), targets in dependencies(df, names).items():
            for b in targets:
                out[a].add(b)
                out[b].add(a)
    return out


def sum_columns(df: DataFrame, value_columns: list[str], ratio: float = 0.8) -> list[str]:
    """Value columns with an aggregate name that equal the sum of their group's others in most rows."""
    candidates = [c for c in value_columns if L.is_agg_name(c)]
    tests: list[tuple[str, list[str]]] = []
    for c in candidates:
        tests.append((c, [s for s in value_columns if s != c and s not in candidates and group_key(s) == group_key(c)]))
        if L.agg_residual_name(c) == "":
            tests.append((c, [s for s in candidates if s != c and L.agg_residual_name(s)]))
    tests = [(c, s) for c, s in tests if len(s) >= 2]
    if not tests:
        return []
    aggs = []
    for i, (c, siblings) in enumerate(tests):
        parts = [number(df, s) for s in siblings]
        known = number(df, c).isNotNull() & reduce(lambda a, b: a | b, [p.isNotNull() for p in parts])
        total = reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p in parts])
        aggs += [F.count_if(known).alias(f"n{i}"), F.count_if(known & close(number(df, c), total)).alias(f"ok{i}")]
    r = df.agg(*aggs).first()
    good = {c for i, (c, _) in enumerate(tests) if r[f"n{i}"] and r[f"ok{i}"] / r[f"n{i}"] >= ratio}
    return [c for c in candidates if c in good]


@dataclass
class AggregateRemoval:
    frame: DataFrame
    removed_columns: list[str]
    row_audit: DataFrame
    column_audit: DataFrame
    label_columns: list[str]
    value_columns: list[str]


def remove_aggregates(df: DataFrame, protected: Column | None = None) -> AggregateRemoval:
    """Drops rows and columns that only repeat sums of others, and keeps what they reported.

    Of a row's label columns the first decides whose value is an aggregate label and may go: a bare
    aggregate word goes, so does one in a column that doesn't group rows, and one whose context (the
    other grouping columns, nulls equal) also has rows with other labels. The context test is an
    aggregate by context joined back, not a look through the table for each row.
    """
    names = data_columns(df)
    found = profile(df, names)
    labels = label_columns(df, found)
    all_values = [c for c in names if c not in labels]
    removed_columns = sum_columns(df, all_values)
    values = [c for c in all_values if c not in removed_columns]
    context = grouping_columns(labels, found)
    depends = dependent_columns(df, context)
    out = df
    trigger = F.lit(None).cast("string")
    for i, c in reversed(list(enumerate(labels))):
        if not found[c].others:  # aggregate labels only: nothing would be left
            continue
        is_agg = L.is_agg_label(col(c).cast("string")) & (F.length(L.norm_label(col(c).cast("string"))) > 0)
        if c in context:
            keys = [k for k in context if k != c and k not in depends[c]]
            if keys:
                per = df.groupBy(*[col(k) for k in keys]).agg(F.count("*").alias(f"__n{i}"), F.count_if(col(c).isNotNull() & ~is_agg).alias(f"__o{i}"))
                per = per.select(*[col(k).alias(f"__k{i}_{j}") for j, k in enumerate(keys)], f"__n{i}", f"__o{i}")
                same = reduce(lambda a, b: a & b, [col(k).eqNullSafe(F.col(f"__k{i}_{j}")) for j, k in enumerate(keys)])
                out = out.join(per, same, "left").drop(*[f"__k{i}_{j}" for j in range(len(keys))])
                lone_null = (F.col(f"__n{i}") == 1) & reduce(lambda a, b: a | b, [col(k).isNull() for k in keys])
                redundant = (F.col(f"__o{i}") > 0) | lone_null
            else:
                redundant = F.lit(True)
            may_go = L.is_exact_agg(col(c).cast("string")) | F.coalesce(redundant, F.lit(False))
        else:
            may_go = F.lit(True)
        trigger = F.when(is_agg & may_go, F.lit(c)).otherwise(trigger)
    out = out.withColumn("__trigger", F.when(~protected, trigger) if protected is not None else trigger)
    kept = out.where(F.col("__trigger").isNull()).select(*[col(c) for c in df.columns if c not in removed_columns])

    def labelled(skip: dict[str, set[str]] | None) -> Column:
        entries = []
        for c in labels:
            hidden = F.col("__trigger").isin([t for t in labels if c in (skip or {}).get(t, set())] or [""]) if skip is not None else F.lit(False)
            entries.append(F.when(col(c).isNotNull() & ~F.coalesce(hidden, F.lit(False)), F.struct(F.lit(c).alias("k"), col(c).cast("string").alias("v"))))
        return F.map_from_entries(F.array_compact(F.array(*entries))) if entries else F.create_map().cast("map<string,string>")

    def melted(rows: DataFrame, columns: list[str], key: Column, label: str, ctx: Column) -> DataFrame:
        parts = [F.struct(F.lit(i).alias("ord"), F.lit(c).alias(label), number(rows, c).alias("reported_value")) for i, c in enumerate(columns)]
        if not parts:
            return rows.sparkSession.createDataFrame([], f"key string, context map<string,string>, {label} string, reported_value double, {ROW} long")
        flat = rows.select(ROW, key.alias("key"), ctx.alias("context"), F.explode(F.array(*parts)).alias("m"))
        return flat.select("key", "context", f"m.{label}", "m.reported_value", ROW).where("reported_value is not null")

    gone = out.where(F.col("__trigger").isNotNull())
    row_audit = melted(gone, values, F.col("__trigger"), "sum_column", labelled(depends))
    column_audit = melted(out, removed_columns, F.lit(None).cast("string"), "removed_column", labelled(None)).drop("key")
    return AggregateRemoval(kept, removed_columns, row_audit, column_audit, labels, values)


def integrity(reported: Column, calculated: Column) -> dict[str, Column]:
    """status, diff and cause of a reported against a recomputed sum."""
    ok = close(reported, calculated)
    return {
        "status": F.when(ok, "PASS").otherwise("FAIL"),
        "diff": F.when(~ok, reported - calculated),
        "cause": F.when(~ok, F.when(calculated < reported, "内訳あり（未表示項目）").otherwise("二重計上または単位ミス")),
    }


def check_integrity(details: DataFrame, totals: DataFrame, context: list[str], value: str, reported: str) -> DataFrame:
    """Totals against sums of the details of equal context (nulls equal); totals without details don't show."""
    sums = details.groupBy(*[col(c) for c in context]).agg(F.sum(number(details, value)).alias("calculated")).where("calculated is not null")
    sums = sums.select(*[col(c).alias(f"__{c}") for c in context], "calculated")
    same = reduce(lambda a, b: a & b, [totals[q_] .eqNullSafe(sums[f"__{q_}"]) for q_ in context])
    joined = totals.join(sums, same).drop(*[f"__{c}" for c in context]).where(col(reported).isNotNull())
    return joined.withColumns(integrity(col(reported).cast("double"), F.col("calculated")))


@dataclass
class OfWhich:
    main: DataFrame
    breakdown: DataFrame
    label: str
    checks: DataFrame


def split_of_which(df: DataFrame, keys: list[str] | None = None, namer: Namer | None = None, log: list[dict] | None = None) -> OfWhich | None:
    """Rows such as "of which men" become a table of (parent, child); the parents' rows are marked `__protected`.

    A parent is the nearest row above in the same run of equal other labels whose label is an
    aggregate, or else any label that isn't itself an "of which". Another column that has the name of a new one
    is renamed in the breakdown and keeps its data; log, if given, gets what was renamed.
    """
    names = [c for c in data_columns(df) if is_text(df, c)]
    if not names:
        return None
    hits = df.agg(*[F.count(L.uchi_child(col(c).cast("string"))).alias(f"h{i}") for i, c in enumerate(names)]).first()
    best = max(range(len(names)), key=lambda i: (hits[f"h{i}"], -i))
    if not hits[f"h{best}"]:
        return None
    label = names[best]
    others = [c for c in names if c != label]
    context = F.struct(*[col(c) for c in others]) if others else F.lit(0)
    child = L.uchi_child(col(label).cast("string"))
    base = previous(df.withColumns({"__ctx": context, "__child": child}), {"__before": F.struct(F.col("__ctx").alias("c"), F.col(ROW).alias("r"))}, keys or [], including=False)
    begins = ~F.coalesce(F.col("__before.c").eqNullSafe(F.col("__ctx")), F.lit(False)) | F.col("__before").isNull()
    base = previous(base.withColumn("__begins", begins), {"__run": F.when(F.col("__begins"), F.col(ROW))}, keys or [])
    mark = F.struct(col(label).cast("string").alias("v"), F.col(ROW).alias("r"))
    usable = col(label).isNotNull() & F.col("__child").isNull()
    base = previous(base, {"__agg": F.when(usable & L.is_agg_label(col(label).cast("string")), mark), "__any": F.when(usable, mark)}, keys or [])
    inside = lambda c: F.when(F.col(f"{c}.r") >= F.col("__run"), F.col(c))
    base = base.withColumn("__parent", F.when(F.col("__child").isNotNull(), F.coalesce(inside("__agg"), inside("__any"))))
    taken = F.col("__parent").isNotNull()
    parents = base.where(taken).select(F.col("__parent.r").alias("__pr")).distinct()
    main = base.where(~taken).join(parents, F.col(ROW) == F.col("__pr"), "left").withColumn("__protected", F.col("__pr").isNotNull()).select(*[col(c) for c in df.columns], "__protected")
    numeric = [c for c in data_columns(df) if is_numeric(df, c)]
    renames, (parent_name, child_name), told = resolve_generated([c for c in data_columns(df) if c != label], [f"親{label}", f"子{label}"], namer)
    if log is not None:
        log += told
    columns = []
    for c in df.columns:
        columns += [F.col("__parent.v").alias(parent_name), F.col("__child").alias(child_name)] if c == label else [col(c).alias(renames.get(c, c))]
    breakdown = base.where(taken).select(*columns)
    sums = base.where(taken).groupBy(F.col("__parent.r").alias("__pr")).agg(*[F.sum(col(c)).alias(f"__s{i}") for i, c in enumerate(numeric)])
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("sum_column"), col(c).cast("double").alias("reported"), F.col(f"__s{i}").cast("double").alias("calculated")) for i, c in enumerate(numeric)])) if numeric else None
    checks = df.join(sums, F.col(ROW) == F.col("__pr")).select(*[col(c) for c in data_columns(df) if c not in numeric], parts.alias("m")).select("*", "m.*").drop("m") if numeric else df.limit(0)
    if numeric:
        checks = checks.where("reported is not null and calculated is not null").withColumns(integrity(F.col("reported"), F.col("calculated")))
    return OfWhich(main, breakdown, label, checks)


def rollup_rows(df: DataFrame, levels: list[str], ratio: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(rows without rollups, removed rollups): rows that have direct children whose numbers add up to theirs.

    Levels are "" below a row's own depth. Children are summed by their parent's chain and joined once.
    """
    numeric = [c for c in data_columns(df) if is_numeric(df, c)]
    depth = reduce(lambda a, b: a + b, [(F.coalesce(col(c), F.lit("")) != "").cast("int") for c in levels])
    chain = lambda n: F.concat_ws("\x00", F.slice(F.array(*[F.coalesce(col(c), F.lit("")) for c in levels]), F.lit(1), n))
    base = df.withColumns({"__depth": depth}).withColumns({"__chain": chain(F.col("__depth")), "__up": chain(F.greatest(F.col("__depth") - 1, F.lit(0)))})
    sums = base.where("__depth > 1").groupBy(F.col("__up").alias("__of"), (F.col("__depth") - 1).alias("__d")).agg(F.count("*").alias("__children"), *[F.sum(col(c)).cast("double").alias(f"__s{i}") for i, c in enumerate(numeric)])
    joined = base.join(sums, (F.col("__chain") == F.col("__of")) & (F.col("__depth") == F.col("__d")), "left")
    known = [(col(c).isNotNull() & F.col(f"__s{i}").isNotNull()).cast("int") for i, c in enumerate(numeric)]
    fine = [F.coalesce(close(col(c).cast("double"), F.col(f"__s{i}")), F.lit(False)).cast("int") for i, c in enumerate(numeric)]
    n_known = reduce(lambda a, b: a + b, known, F.lit(0))
    is_rollup = F.coalesce((F.col("__children") > 0) & (n_known > 0) & (reduce(lambda a, b: a + b, fine, F.lit(0)) >= ratio * n_known), F.lit(False))
    joined = joined.withColumn("__rollup", is_rollup)
    return joined.where("not __rollup").select(*[col(c) for c in df.columns]), joined.where("__rollup").select(*[col(c) for c in df.columns], F.col("__children").alias("child_count"))
