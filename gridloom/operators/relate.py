"""Relations between tables: equal schemas, sums across tables and sheets, and what they recommend.

Tables are named in a catalog {id: (sheet, title, DataFrame)}. Their numbers go into one long table
`measures` (table_id, row_pos, col_pos, v), so checking many tables is one job, not one a table. The search
for subsets runs over some cells of each table, and what it finds is verified together.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..frame import ROW, data_columns, is_numeric, number
from .subsets import first_subset, matching_subsets

#: Cells of a table by which sets of children are searched for.
ANCHORS = 40
#: Peers up to which all their sets are compared over all cells at once.
FEW = 7


@dataclass
class Table:
    id: str
    sheet: str
    title: str
    frame: DataFrame
    notes: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class SumRelation:
    parent: str
    children: tuple[str, ...]
    ratio: float


def by_schema(tables: list[Table]) -> list[list[Table]]:
    """Groups of two tables or more with the same column names in the same order."""
    groups: dict[tuple[str, ...], list[Table]] = {}
    for t in tables:
        groups.setdefault(tuple(c.strip() for c in data_columns(t.frame)), []).append(t)
    return [g for g in groups.values() if len(g) >= 2]


def measures(tables: list[Table]) -> DataFrame:
    """(table_id, row_pos, col_pos, v): every number of every table, rows counted from 1 in order."""
    parts = []
    for t in tables:
        columns = [c for c in data_columns(t.frame) if is_numeric(t.frame, c)]
        if not columns:
            continue
        cells = F.posexplode(F.array(*[F.coalesce(number(t.frame, c), F.lit(0.0)) for c in columns])).alias("col_pos", "v")
        parts.append(t.frame.select(F.lit(t.id).alias("table_id"), ROW, cells))
    long = reduce(DataFrame.unionByName, parts)
    position = F.dense_rank().over(Window.partitionBy("table_id").orderBy(ROW))
    return long.select("table_id", position.alias("row_pos"), "col_pos", "v")


def totals(numbers: DataFrame) -> dict[str, float]:
    return {r["table_id"]: r["t"] for r in numbers.groupBy("table_id").agg(F.sum(F.abs("v")).alias("t")).collect()}


def match_ratios(numbers: DataFrame, candidates: list[tuple[str, tuple[str, ...]]], tolerance: float = 0.03) -> dict[int, float]:
    """For each candidate (parent, children) the share of the parent's cells that the children's sum meets; all in one job."""
    if not candidates:
        return {}
    spark = numbers.sparkSession
    members = spark.createDataFrame([(i, c) for i, (_, cs) in enumerate(candidates) for c in cs], "candidate int, table_id string")
    heads = spark.createDataFrame([(i, p, len(cs)) for i, (p, cs) in enumerate(candidates)], "candidate int, table_id string, k int")
    sums = numbers.join(members, "table_id").groupBy("candidate", "row_pos", "col_pos").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    cells = numbers.join(heads, "table_id").join(sums, ["candidate", "row_pos", "col_pos"], "full_outer")
    comparable = F.count_if((F.col("v").isNull()) | F.coalesce(F.col("n") != F.col("k"), F.lit(True))) == 0
    big = F.abs("v") > 0.5
    ok = F.abs(F.col("v") - F.col("s")) <= F.abs("v") * tolerance
    out = cells.groupBy("candidate").agg(F.when(comparable, F.coalesce(F.count_if(big & ok) / F.nullif(F.count_if(big), F.lit(0)), F.lit(-1.0))).otherwise(-1.0).alias("ratio"))
    return {r["candidate"]: r["ratio"] for r in out.collect()}


def anchors(numbers: DataFrame, parents: list[str]) -> dict[str, list[tuple[int, int]]]:
    """Up to ANCHORS cells (row, column) of each table that are large enough to be compared, spread over it by a hash."""
    big = numbers.where(F.col("table_id").isin(parents) & (F.abs("v") > 0.5))
    place = F.row_number().over(Window.partitionBy("table_id").orderBy(F.xxhash64("row_pos", "col_pos"), "row_pos", "col_pos"))
    out: dict[str, list[tuple[int, int]]] = {}
    for r in big.select("table_id", "row_pos", "col_pos", place.alias("k")).where(F.col("k") <= ANCHORS).collect():
        out.setdefault(r["table_id"], []).append((r["row_pos"], r["col_pos"]))
    return out


def _search(key: tuple, pdf: pd.DataFrame, least: float, tolerance: float) -> pd.DataFrame:
    """Sets of a parent's peers that meet its anchor cells; rows are (peer, cell, v), the parent's own have no peer."""
    wide = pdf[pdf["peer"].notna()].pivot_table(index="peer", columns="cell", values="v", aggfunc="first")
    target = pdf[pdf["peer"].isna()].set_index("cell")["v"].sort_index()
    found: list[tuple[int, ...]] = []
    if len(wide):
        values = wide.reindex(columns=target.index).fillna(0.0)
        m = len(target)
        wrong = (1 - least) * m
        misses = int(wrong + 1e-9) if m < ANCHORS else int(wrong + 3 * (wrong * least) ** 0.5)
        found = matching_subsets(values.to_numpy(), target.to_numpy(), tolerance, misses)
    names = list(wide.index)
    return pd.DataFrame([(key[0], sorted(names[i] for i in x)) for x in found], columns=["parent", "children"])


def _sets_by_anchors(spark: SparkSession, numbers: DataFrame, asked: list[tuple[str, str, str]], least: float, tolerance: float) -> list[tuple[str, tuple[str, ...]]]:
    """(parent, children) that meet the parent's anchor cells, from (parent, side, peer): a task a parent and side."""
    cells = [(p, r, c, i) for p, at in anchors(numbers, sorted({p for p, *_ in asked})).items() for i, (r, c) in enumerate(at)]
    if not cells:
        return []
    wanted = spark.createDataFrame(cells, "parent string, row_pos long, col_pos int, cell int")
    peers = spark.createDataFrame(asked, "parent string, side string, peer string")
    at = numbers.join(F.broadcast(wanted), ["row_pos", "col_pos"])  # ANCHORS rows a table of the catalog
    own = at.where("table_id = parent").join(peers.select("parent", "side").distinct(), "parent").select("parent", "side", F.lit(None).cast("string").alias("peer"), "cell", "v")
    theirs = at.join(peers, (at["parent"] == peers["parent"]) & (at["table_id"] == peers["peer"])).select(peers["parent"], "side", "peer", "cell", "v")
    search = lambda key, pdf: _search(key, pdf, least, tolerance)
    sets = own.unionByName(theirs).groupBy("parent", "side").applyInPandas(search, "parent string, children array<string>")
    return [(r["parent"], tuple(r["children"])) for r in sets.collect()]


def sum_relations(tables: list[Table], least: float = 0.88, tolerance: float = 0.03) -> list[SumRelation]:
    """Tables that are sums of others of their schema, by minimal sets of children, whatever the number of either.

    Children are of the parent's own sheet, or of all other sheets. Sets of many peers are searched for by ANCHORS
    cells of the parent, in a task a parent; all are compared over all cells in one job. A parent of more cells than that may
    miss a set only if far more of its anchor cells fail than of the others: three standard deviations.
    """
    out: list[SumRelation] = []
    for group in by_schema(tables):
        if len(group) < 3:
            continue
        spark = group[0].frame.sparkSession
        numbers = measures(group).persist()
        try:
            total = totals(numbers)
            sheet = {t.id: t.sheet for t in group}
            ordered = sorted((t.id for t in group if t.id in total), key=lambda i: total[i])
            asked: list[tuple[str, str, str]] = []
            sets: list[tuple[str, tuple[str, ...]]] = []
            for place, parent in enumerate(ordered):
                if place < 2 or total[parent] < 1:
                    continue
                for same in (True, False):
                    peers = [p for p in ordered[:place] if total[p] > 0.1 and (sheet[p] == sheet[parent]) == same]
                    if len(peers) <= FEW:
                        sets += [(parent, c) for k in range(2, len(peers) + 1) for c in combinations(peers, k)]
                    else:
                        asked += [(parent, str(same), p) for p in peers]
            sets += _sets_by_anchors(spark, numbers, asked, least, tolerance) if asked else []
            candidates = []
            for parent, children in sets:
                sheets = {sheet[c] for c in children}
                share = sum(total[c] for c in children) / total[parent]
                if 0.72 <= share <= 1.15 and (sheets == {sheet[parent]} or sheets == {sheet[p] for p in ordered} - {sheet[parent]}):
                    candidates.append((parent, children))
            ratios = match_ratios(numbers, candidates, tolerance)
        finally:
            numbers.unpersist()
        good = sorted((SumRelation(p, tuple(sorted(cs)), round(ratios[i], 4)) for i, (p, cs) in enumerate(candidates) if ratios.get(i, -1) >= least), key=lambda r: (ordered.index(r.parent), len(r.children), r.children))
        out += [r for r in good if not any(o.parent == r.parent and set(o.children) < set(r.children) for o in good)]
    return out


def aggregate_sheets(tables: list[Table], tolerance: float = 0.03) -> dict[str, tuple[str, ...]]:
    """Sheets whose total is the sum of two or more other sheets of the same schema: the fewest, the largest first."""
    out: dict[str, tuple[str, ...]] = {}
    for group in by_schema(tables):
        numbers = measures(group)
        total: dict[str, float] = {}
        sheet = {t.id: t.sheet for t in group}
        for i, v in totals(numbers).items():
            total[sheet[i]] = total.get(sheet[i], 0.0) + v
        if len(total) < 3:
            continue
        top = max(total, key=lambda s: total[s])
        rest = sorted((s for s in total if s != top), key=lambda s: -total[s])
        found = first_subset([total[s] for s in rest], total[top] * (1 - tolerance), total[top] * (1 + tolerance))
        if found:
            out[top] = tuple(sorted(rest[i] for i in found))
    return out


@dataclass(frozen=True)
class Recommendation:
    sources: tuple[str, ...]
    axes: tuple[str, ...]
    values: tuple[tuple[str, ...], ...]  # per source, a value for each axis
    parent: str | None = None
    origin: str = "rule"


def merge_recommendations(relations: list[SumRelation], tables: list[Table], summary_sheets: set[str]) -> list[Recommendation]:
    """Children of like relations on two sheets or more, over the axes sheet and title."""
    by_id = {t.id: t for t in tables}
    groups: dict[tuple[str, int], list[SumRelation]] = {}
    for r in relations:
        if by_id[r.parent].sheet not in summary_sheets:
            groups.setdefault((by_id[r.parent].title, len(r.children)), []).append(r)
    out = []
    for (title, _), rs in groups.items():
        ids = tuple(c for r in rs for c in r.children)
        if len({by_id[r.parent].sheet for r in rs}) >= 2:
            out.append(Recommendation(ids, ("シート", "種別"), tuple((by_id[i].sheet, by_id[i].title) for i in ids), None, "auto"))
    return out


def combine_recommendations(auto: list[Recommendation], second: list[Recommendation], first: list[Recommendation]) -> list[Recommendation]:
    """Automatic ones, then others that aren't identical to one, then first-phase ones that aren't contained in one."""
    out = list(auto)
    out += [r for r in second if all(set(r.sources) != set(o.sources) for o in auto)]
    out += [r for r in first if not any(set(r.sources) <= set(o.sources) for o in out)]
    return out


def validate(recommendations: list[Recommendation], tables: list[Table]) -> list[Recommendation]:
    """Unknown tables are dropped, so are sets of one and repeats; missing axis values become ""."""
    known, seen, out = {t.id for t in tables}, set(), []
    for r in recommendations:
        keep = [i for i, s in enumerate(r.sources) if s in known]
        key = (r.parent, frozenset(r.sources[i] for i in keep))
        if len(keep) < 2 or key in seen:
            continue
        seen.add(key)
        values = tuple(tuple((*r.values[i], *[""] * len(r.axes))[: len(r.axes)]) for i in keep)
        out.append(Recommendation(tuple(r.sources[i] for i in keep), r.axes, values, r.parent, r.origin))
    return out


def classify(tables: list[Table], relations: list[SumRelation], summary_sheets: set[str]) -> dict[str, tuple[str, bool]]:
    """{id: (granularity, minimum)} by rule: totals and summary sheets are summaries, the rest details."""
    parents = {r.parent for r in relations}
    return {t.id: ("summary", False) if t.sheet in summary_sheets or t.id in parents else ("master", False) if t.id.endswith("_unit_master") else ("detail", True) for t in tables}
