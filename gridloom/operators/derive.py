"""Derived tables: unions with discriminators, masters, parts missing from a total, and notes that hint at them."""

from __future__ import annotations

import re
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import dicts as D
from ..frame import ROW, col, data_columns, is_numeric, order_parts
from .naming import infer_axis_name, strip_common_suffix
from .relate import Recommendation, Table, measures, totals


def integrate(tables: list[Table], axes: list[str], values: list[tuple[str, ...]]) -> DataFrame:
    """UNION ALL by name with discriminator columns in front; the first table's order, extras after it, gaps null."""
    if len({len(v) for v in values} | {len(axes)}) != 1:
        raise ValueError("a value for each axis and table is needed")
    parts, alike = [], len({t.frame.schema[ROW].dataType.simpleString() for t in tables}) == 1
    for k, (t, v) in enumerate(zip(tables, values, strict=True)):
        names = data_columns(t.frame)
        row = F.col(ROW) if alike else F.array(*order_parts(F.col(ROW), t.frame.schema[ROW].dataType))
        parts.append(t.frame.select(F.struct(F.lit(k).alias("source"), row.alias("row")).alias(ROW), *[F.lit(x).alias(a) for a, x in zip(axes, v)], *[col(n) for n in names if n not in axes]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def align(frame: DataFrame, reference: list[str]) -> DataFrame:
    """Columns in the reference's order; those it doesn't have come last."""
    names = data_columns(frame)
    order = [c for c in reference if c in names] + [c for c in names if c not in reference]
    return frame.select(*([ROW] if ROW in frame.columns else []), *[col(c) for c in order])


def redundant_axes(tables: list[Table], axes: list[str], values: list[tuple[str, ...]]) -> list[str]:
    """Axes that the tables hold already: a column of that name, or one that contains the value in half its cells.

    In the second case no value may match in two tables. One aggregate job a table, then one over all their matched values.
    """
    out = []
    for k, axis in enumerate(axes):
        if all(axis in data_columns(t.frame) for t in tables):
            out.append(axis)
            continue
        shared = [c for c in data_columns(tables[0].frame) if all(c in data_columns(t.frame) for t in tables)]
        tests = []
        for t, v in zip(tables, values):
            year = re.search(D.YEAR, v[k])
            tests.append({c: col(c).cast("string").contains(year[0]) if year else col(c).cast("string") == v[k] for c in shared})
            r = t.frame.agg(F.count("*").alias("n"), *[F.count_if(tests[-1][c]).alias(f"k{i}") for i, c in enumerate(shared)]).first()
            shared = [c for i, c in enumerate(shared) if r["n"] and r[f"k{i}"] / r["n"] >= 0.5]
            if not shared:
                break
        if shared and set(shared) - _overlapping(tables, tests, shared):
            out.append(axis)
    return out


def _overlapping(tables: list[Table], tests: list[dict[str, Column]], names: list[str]) -> set[str]:
    """Columns of which a value that passes the test occurs in two tables."""
    parts = []
    for k, (t, test) in enumerate(zip(tables, tests, strict=True)):
        matched = F.array(*[F.struct(F.lit(i).alias("c"), F.when(test[c], col(c).cast("string")).alias("v")) for i, c in enumerate(names)])
        parts.append(t.frame.select(F.explode(matched).alias("m")).select("m.c", "m.v", F.lit(k).alias("t")).where("v is not null"))
    spread = reduce(DataFrame.unionByName, parts).groupBy("c", "v").agg(F.min("t").alias("least"), F.max("t").alias("most"))
    return {names[r["c"]] for r in spread.where("least < most").select("c").distinct().collect()}


def master(spark: SparkSession, axis: str, parents: dict[str, str], parent_axis: str) -> DataFrame:
    """A dimension master (child, parent) from an explicit map; repeated pairs once."""
    rows = sorted(set(parents.items()))
    return spark.createDataFrame(rows, f"`{axis}` string, `{parent_axis}` string")


def master_of(frame: DataFrame, child: str, parent: str) -> DataFrame:
    """A dimension master from the data, children that have one parent only."""
    pairs = frame.where(col(child).isNotNull()).select(col(child), col(parent)).distinct()
    alone = pairs.groupBy(col(child).alias("__c")).agg(F.count("*").alias("__n")).where("__n = 1").select("__c")
    return pairs.join(alone, col(child) == F.col("__c"), "left_semi")


@dataclass(frozen=True)
class MasterSpec:
    """An axis whose values belong under a parent's: mapping has (value, parent's label) pairs, sorted."""

    axis: str
    parent_axis: str
    mapping: tuple[tuple[str, str], ...]
    parent: str

    def frame(self, spark: SparkSession) -> DataFrame:
        return master(spark, self.axis, dict(self.mapping), self.parent_axis)


def axis_kind(values: list[str], members: list[Table]) -> str:
    """Whether an axis tells sheets or titles, by a vote of the members; sheets win a tie, a value that is both counts for them."""
    votes = [("sheet" if v == m.sheet else "title") for v, m in zip(values, members, strict=True) if v and v in (m.sheet, m.title or "")]
    return "title" if votes.count("title") > votes.count("sheet") else "sheet"


def master_specs(found: Recommendation, tables: list[Table], parents: list[str | None] | None = None, parent_axes: list[str | None] | None = None) -> list[MasterSpec]:
    """For each axis that has a parent table, which value belongs to it; without parents the first axis has the recommendation's own.

    A parent on a sheet (or, for titles, with a title) of one of the children is their sibling and no parent. A value
    that a child lacks is its sheet or title. Pairs that lead back to where they began are left out.
    """
    by_id = {t.id: t for t in tables}
    members = [(by_id[s], v) for s, v in zip(found.sources, found.values, strict=True) if s in by_id]
    if len(members) < 2:
        return []
    out = []
    for k, axis in enumerate(found.axes):
        above = by_id.get((parents[k] if parents and k < len(parents) else None) or (found.parent if k == 0 else None) or "")
        if above is None:
            continue
        values = [v[k] if k < len(v) else "" for _, v in members]
        by_sheet = axis_kind(values, [m for m, _ in members]) == "sheet"
        label = above.sheet if by_sheet else above.title or above.sheet
        if label in {m.sheet if by_sheet else m.title or "" for m, _ in members}:
            continue
        names = [v or (m.sheet if by_sheet else m.title or m.sheet) for v, (m, _) in zip(values, members, strict=True)]
        parent_axis = (parent_axes[k] if parent_axes and k < len(parent_axes) else None) or f"上位{axis}"
        out.append(MasterSpec(axis, parent_axis, tuple(sorted({(n, label) for n in names if n})), above.id))
    return without_cycles(out)


def without_cycles(specs: list[MasterSpec]) -> list[MasterSpec]:
    """Specs without pairs of which the parent is, over any number of pairs, under its own child."""
    up: dict[str, set[str]] = {}
    for s in specs:
        for child, label in s.mapping:
            up.setdefault(child, set()).add(label)

    def leads_to(begin: str, end: str) -> bool:
        seen, rest = set(), [begin]
        while rest:
            x = rest.pop()
            if x == end:
                return True
            if x not in seen:
                seen.add(x)
                rest += up.get(x, ())
        return False

    kept = [MasterSpec(s.axis, s.parent_axis, tuple(p for p in s.mapping if not leads_to(p[1], p[0])), s.parent) for s in specs]
    return [s for s in kept if s.mapping]


def group_similar(found: list[Recommendation], tables: list[Table]) -> list[list[Recommendation]]:
    """Recommendations over the same axes whose first known sources have the same columns; groups and members in order."""
    columns = {t.id: frozenset(data_columns(t.frame)) for t in tables}
    groups: dict[frozenset[str], list[Recommendation]] = {}
    for r in found:
        own = next((columns[s] for s in r.sources if s in columns), frozenset())
        groups.setdefault(own | set(r.axes), []).append(r)
    return list(groups.values())


def subtract(parent: Table, children: list[Table]) -> DataFrame | None:
    """parent minus the sum of its children, cell by cell, rows by position; None if shapes or totals don't allow it."""
    numeric = [c for c in data_columns(parent.frame) if is_numeric(parent.frame, c) and all(c in data_columns(t.frame) and is_numeric(t.frame, c) for t in children)]
    if not numeric or not children:
        return None
    everyone = [parent, *children]
    total = totals(measures([Table(t.id, t.sheet, t.title, t.frame.select(ROW, *[col(c) for c in numeric])) for t in everyone]))
    counts = reduce(DataFrame.unionByName, [t.frame.groupBy().agg(F.count("*").alias("n")) for t in everyone]).distinct().count()
    if counts != 1 or total.get(parent.id, 0) < max(total.get(t.id, 0) for t in children) or total.get(parent.id, 0) < 0.8 * sum(total.get(t.id, 0) for t in children):
        return None
    numbered = lambda f: f.withColumn("__pos", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(ROW)))  # noqa: E731  a sheet's table
    parts = reduce(DataFrame.unionByName, [numbered(t.frame).select("__pos", *[col(c) for c in numeric]) for t in children])
    sums = parts.groupBy("__pos").agg(*[F.sum(F.coalesce(col(c), F.lit(0))).alias(f"__s{i}") for i, c in enumerate(numeric)])
    joined = numbered(parent.frame).join(sums, "__pos")
    place = {c: i for i, c in enumerate(numeric)}
    return joined.select(ROW, *[(F.coalesce(col(c), F.lit(0)) - F.col(f"__s{place[c]}")).alias(c) if c in place else col(c) for c in data_columns(parent.frame)])


def subtract_by_key(parent: DataFrame, children: DataFrame, keys: list[str], numeric: list[str]) -> DataFrame:
    """The same by keys instead of positions, for tables of any size."""
    sums = children.groupBy(*[col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(*[F.sum(F.coalesce(col(c), F.lit(0))).alias(f"__s{i}") for i, c in enumerate(numeric)])
    same = reduce(lambda a, b: a & b, [col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    joined = parent.join(sums, same, "left")
    return joined.select(*[(F.coalesce(col(c), F.lit(0)) - F.coalesce(F.col(f"__s{numeric.index(c)}"), F.lit(0))).alias(c) if c in numeric else col(c) for c in parent.columns])


# --- notes that name tables ------------------------------------------------------------------------


def note_type_name(text: str) -> str:
    low = text.lower()
    for kind, words in (("aggregation", D.NOTE_AGGREGATION), ("exclusion", D.NOTE_EXCLUSION), ("reference", D.NOTE_REFERENCE)):
        if any(w.lower() in low for w in words):
            return kind
    return "general"


def entity_names(text: str) -> list[str]:
    """Quoted names, bracketed ones, then what stands between delimiters, 2 to 60 characters."""
    quoted = re.findall("「([^」]+)」", text)
    bare = re.sub(D.NOTE_AGG_SUFFIX, "", re.sub("「[^」]*」", "", text))
    inside = [p for m in re.findall("[（(]([^）)]+)[）)]", bare) for p in re.split(D.ENTITY_SPLIT, m)]
    listed = re.split(D.ENTITY_SPLIT, re.sub("[（(][^）)]*[）)]", "", bare))
    found = [x.strip() for x in (*quoted, *inside, *(listed if len(listed) > 1 else []))]
    return list(dict.fromkeys(x for x in found if 2 <= len(x) <= 60))


def match_name(name: str, tables: list[Table]) -> Table | None:
    """Equal title or id, then a part of one another, then nearly equal."""
    for test in (lambda t: name in (t.title, t.id), lambda t: bool(t.title) and (name in t.title or t.title in name)):
        if found := next((t for t in tables if test(t)), None):
            return found
    close = [(SequenceMatcher(None, name, t.title).ratio(), t) for t in tables]
    best = max(close, key=lambda x: x[0], default=(0, None))
    return best[1] if best[0] >= 0.92 else None


@dataclass(frozen=True)
class Proposal:
    source: str
    note: str
    known: tuple[str, ...]
    missing: tuple[str, ...]
    names: tuple[str, ...] = ()  # of the known ones, as the note has them


def latent_tables(tables: list[Table]) -> list[Proposal]:
    """Notes and titles that add up names of which some are tables and some are not."""
    out = []
    for t in tables:
        for note in [*t.notes, *([t.title] if t.title and re.search(D.ENUMERATED_AGGREGATE, t.title) else [])]:
            names = entity_names(note)
            if len(names) < 2 or note_type_name(note) == "reference":
                continue
            others = sorted((o for o in tables if o.id != t.id), key=lambda o: o.sheet != t.sheet)
            found = {n: match_name(n, others) for n in names}
            known = tuple(f.id for f in found.values() if f)
            missing = tuple(n for n, f in found.items() if not f)
            if known and missing:
                out.append(Proposal(t.id, note, known, missing, tuple(n for n, f in found.items() if f)))
    return out


def group_proposals(proposals: list[Proposal]) -> dict[tuple[str, ...], list[Proposal]]:
    out: dict[tuple[str, ...], list[Proposal]] = {}
    for p in proposals:
        out.setdefault(tuple(sorted(p.missing)), []).append(p)
    return out


def without_summary(proposals: list[Proposal], total: dict[str, float], tolerance: float = 0.05) -> list[Proposal]:
    """Proposals without those whose source adds up the sources of all others; all, if fewer than two would be left."""
    if len(proposals) < 3:
        return proposals
    everything = sum(total.get(p.source, 0.0) for p in proposals)

    def sums_up(p: Proposal) -> bool:
        own = total.get(p.source, 0.0)
        others = everything - own
        return own > 1e-9 and others > 1e-9 and abs(own - others) < tolerance * max(own, others)

    kept = [p for p in proposals if not sums_up(p)]
    return kept if len(kept) >= 2 else proposals


def automatic_integrations(derived: dict[Proposal, Table], tables: list[Table], two_axes: bool = True, both: bool = False) -> list[Recommendation]:
    """Unions of known tables with derived ones, for each group of proposals that lack the same.

    derived has the table made for a proposal. Two proposals or more with four tables or more give one union over two axes, the
    name of the part and where it comes from: the sheet, or on one sheet what tells the titles apart. A
    proposal whose source adds up the others' is left out of it. Without such a union, or with two_axes off, each
    proposal has one over the names alone; with both they come behind it.
    """
    by_id = {t.id: t for t in tables}
    groups = [found for g in group_proposals(list(derived)).values() if (found := [p for p in g if p.source in by_id])]
    known = {p.source: by_id[p.source] for g in groups if len(g) >= 3 for p in g}
    numeric = [t for t in known.values() if any(is_numeric(t.frame, c) for c in data_columns(t.frame))]
    total = totals(measures(numeric)) if numeric else {}
    out = []
    for group in groups:
        parts = {p: [*zip(p.known, p.names, strict=True), (derived[p].id, derived[p].title)] for p in group}
        single = [_over_names(p.source, parts[p]) for p in group]
        members = without_summary(group, total)
        sheets = [by_id[p.source].sheet for p in members]
        many = len(set(sheets)) > 1
        origin = sheets if many else strip_common_suffix([by_id[p.source].title or p.source for p in members])
        rows = [(i, (name, o)) for p, o in zip(members, origin, strict=True) for i, name in parts[p]]
        if len(members) < 2 or len(rows) < 4:
            out += single
            continue
        names = list(dict.fromkeys(v[0] for _, v in rows))
        axis, other = infer_axis_name(names), infer_axis_name(list(dict.fromkeys(origin)))
        other = ("シート" if many else "区分") if other in ("種別", axis) else other
        pair = Recommendation(tuple(i for i, _ in rows), (axis, other), tuple(v for _, v in rows), members[0].source, "latent")
        out += [pair] if two_axes else []
        out += single if both or not two_axes else []
    return out


def _over_names(source: str, parts: list[tuple[str, str]]) -> Recommendation:
    return Recommendation(tuple(i for i, _ in parts), (infer_axis_name([n for _, n in parts]),), tuple((n,) for _, n in parts), source, "latent")


def clip(recommendations: list[Recommendation], siblings: list[frozenset[str]], tables: list[Table]) -> list[Recommendation]:
    """Recommendations without tables that a total's known parts tell against.

    The first set of siblings that a recommendation contains, with others from the siblings' sheets only, is all that stays
    of it. Otherwise tables that are in no set go, if two or more are left.
    """
    siblings = [s for s in siblings if len(s) >= 2]
    everyone, sheet = frozenset().union(*siblings), {t.id: t.sheet for t in tables}

    def kept(r: Recommendation) -> frozenset[str]:
        own = frozenset(r.sources)
        for s in siblings:
            homes = {sheet[i] for i in s if i in sheet}
            if s < own and homes and {sheet[i] for i in own - s if i in sheet} <= homes:
                return s
        return own & everyone if len(own & everyone) >= 2 else own

    out = []
    for r in recommendations:
        keep = kept(r)
        at = [k for k, i in enumerate(r.sources) if i in keep]
        out.append(Recommendation(tuple(r.sources[k] for k in at), r.axes, tuple(r.values[k] for k in at), r.parent, r.origin))
    return out
