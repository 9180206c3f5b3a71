"""Formulas: sums of ranges by prefix sums, and evaluation in the order of what depends on what.

A range is cut into its columns, and a column's sum is the difference of two prefix sums: cells and the ranges' ends
stand in one order and a window adds up, in blocks whose totals are carried on, so a range costs two rows a column,
however many cells it covers, and a long column is no single task.

A formula is ready once no formula cell in its ranges is open. Ranges' sums over plain cells are found once; from then
on only values that became known are added. A sheet whose cells, formulas and links are few, by a bound that needs no
parsing, goes to a task whole, which takes one sheet after the other. For the others links are counted, and their
formulas go to one task where those allow; else they are evaluated in rounds, each a job over all that are ready. What is
left when nothing is ready any more is on a cycle, or needs one, and is reported as such.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict, deque
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frame import stored

#: Rows of a block of a column; formulas, links between them and other cells of a sheet that one task takes.
BLOCK, TASK_FORMULAS, TASK_LINKS, TASK_CELLS = 1 << 16, 100_000, 2_000_000, 1_000_000
#: Cells up to which a column's part of a range is added up, not taken from prefix sums; rows that a task hands on at once.
SHORT, BATCH = 64, 10_000
PLACE = ["file", "sheet"]
BOX = "struct<r0: int, c0: int, r1: int, c1: int>"
PARSED = f"file string, sheet string, r int, c int, op string, args array<{BOX}>"
VALUES = "file string, sheet string, r int, c int, value double, state string"
Box = tuple[int, int, int, int]


def column_number(letters: str) -> int:
    n = 0
    for ch in letters.upper():
        n = n * 26 + ord(ch) - 64
    return n


def reference(ref: str) -> tuple[int, int] | None:
    """(row, column) of a reference such as $B$7."""
    m = re.fullmatch(r"\$?([A-Za-z]+)\$?(\d+)", ref.strip())
    return (int(m[2]), column_number(m[1])) if m else None


def parse(formula: str | None) -> tuple[str, list[Box]] | None:
    """(operation, its ranges): sum, ref, + - or *; None for any other formula. Parts of a SUM that are no range are left out."""
    text = (formula or "").strip().lstrip("=").strip()
    if m := re.fullmatch(r"SUM\((.*)\)", text, re.I):
        boxes = []
        for part in m[1].split(","):
            ends = [reference(x) for x in part.split(":")]
            if None not in ends and len(ends) <= 2:
                (r0, c0), (r1, c1) = ends[0], ends[-1]
                boxes.append((min(r0, r1), min(c0, c1), max(r0, r1), max(c0, c1)))
        return "sum", boxes
    if at := reference(text):
        return "ref", [(*at, *at)]
    if m := re.fullmatch(r"(\$?[A-Z]+\$?\d+)\s*([-+*])\s*(\$?[A-Z]+\$?\d+)", text, re.I):
        a, b = reference(m[1]), reference(m[3])
        return m[2], [(*a, *a), (*b, *b)]
    return None


def result(op: str, totals: list[float], found: list[int]) -> float | None:
    """A formula's value from sums and counts of the numbers in its ranges; None if it can't be told."""
    if op == "sum" or op == "ref":
        return sum(totals) if any(found) else None
    if not all(found):
        return None
    a, b = totals
    return a + b if op == "+" else a - b if op == "-" else a * b


class Strips:
    """Places by column, to find those in a box."""

    def __init__(self, places: Iterable[tuple[int, int]]) -> None:
        self.by_column: dict[int, list[int]] = defaultdict(list)
        for r, c in sorted(places):
            self.by_column[c].append(r)
        self.columns = sorted(self.by_column)

    def within(self, box: Box) -> Iterator[tuple[int, int]]:
        r0, c0, r1, c1 = box
        for c in self.columns[bisect_left(self.columns, c0) : bisect_right(self.columns, c1)]:
            rows = self.by_column[c]
            for r in rows[bisect_left(rows, r0) : bisect_right(rows, r1)]:
                yield r, c


class Sums:
    """Numbers by place and by column, to add up those in a box."""

    def __init__(self, numbers: dict[tuple[int, int], float]) -> None:
        self.numbers, self.strips = numbers, None

    def columns(self) -> list[int]:
        if self.strips is None:
            by_column: dict[int, list[tuple[int, float]]] = defaultdict(list)
            for (r, c), d in sorted(self.numbers.items(), key=itemgetter(0)):
                by_column[c].append((r, d))
            self.strips = {c: ([r for r, _ in x], v := [d for _, d in x], list(accumulate(v, initial=0.0))) for c, x in sorted(by_column.items())}
            self.order = list(self.strips)
        return self.order

    def within(self, box: Box) -> tuple[float, int]:
        """(sum, count)"""
        r0, c0, r1, c1 = box
        if r0 == r1 and c0 == c1:
            d = self.numbers.get((r0, c0))
            return (0.0, 0) if d is None else (d, 1)
        total, found, order = 0.0, 0, self.columns()
        for c in order[bisect_left(order, c0) : bisect_right(order, c1)]:
            rows, values, upto = self.strips[c]
            i, j = bisect_left(rows, r0), bisect_right(rows, r1)
            total += upto[j] - upto[i] if j - i > SHORT else sum(values[i:j])
            found += j - i
        return total, found


def solve(places: list[tuple[int, int]], parsed: list[tuple[str, list[Box]]], totals: list[list[float]], found: list[list[int]]) -> list[tuple[float | None, str]]:
    """(value, state) of a sheet's open formulas, each after those in its ranges. totals and found: of plain cells, a range each."""
    number = {at: i for i, at in enumerate(places)}
    strips, feeds, waits = Strips(places), defaultdict(list), [0] * len(places)
    for i, (_, boxes) in enumerate(parsed):
        for k, box in enumerate(boxes):
            one = box[:2]
            for at in ((one,) if one in number else ()) if one == box[2:] else strips.within(box):
                feeds[number[at]].append((i, k))
                waits[i] += 1
    out: list[tuple[float | None, str]] = [(None, "cycle")] * len(places)
    ready = deque(i for i, n in enumerate(waits) if not n)
    while ready:
        i = ready.popleft()
        value = result(parsed[i][0], totals[i], found[i])
        out[i] = (value, "empty" if value is None else "value")
        for j, k in feeds[i]:
            if value is not None:
                totals[j][k] += value
                found[j][k] += 1
            waits[j] -= 1
            if not waits[j]:
                ready.append(j)
    return out


def fill(grid: dict[tuple[int, int], object], formulas: dict[tuple[int, int], str]) -> list[tuple[int, int]]:
    """Values for a small sheet's cells that have a formula but no value; returns the places that are on or behind a cycle."""
    known = {at: p for at, f in formulas.items() if grid.get(at) is None and (p := parse(f))}
    numbers = {at: float(v) for at, v in grid.items() if isinstance(v, (int, float)) and not isinstance(v, bool)}
    strips = Strips(numbers)
    inside = [[[numbers[at] for at in strips.within(box)] for box in boxes] for _, boxes in known.values()]
    solved = solve(list(known), list(known.values()), [[sum(v) for v in x] for x in inside], [[len(v) for v in x] for x in inside])
    grid.update({at: v for at, (v, _) in zip(known, solved, strict=True) if v is not None})
    return [at for at, (_, state) in zip(known, solved, strict=True) if state == "cycle"]


# --- on Spark -----------------------------------------------------------------------------------


def range_totals(numbers: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, total, found) of ranges (keys, file, sheet, r0, c0, r1, c1) that hold a number (file, sheet, r, c, d)."""
    strip = [*PLACE, "c"]
    last, first = F.struct(F.col("r1").alias("r"), F.lit(1).alias("sign")), F.struct((F.col("r0") - 1).alias("r"), F.lit(-1).alias("sign"))
    ends = F.explode(F.when(F.col("r0") > 1, F.array(last, first)).otherwise(F.array(last))).alias("e")  # nothing stands above row 1
    asked = ranges.select(*keys, *PLACE, "r0", "r1", F.explode(F.sequence("c0", "c1")).alias("c")).select(*keys, *strip, ends).select(*keys, *strip, "e.*", F.lit(0.0).alias("d"), F.lit(0).alias("n"))
    cells = numbers.select(*strip, "r", F.lit(0).alias("sign"), F.col("d").cast("double").alias("d"), F.lit(1).alias("n"))
    marks = cells.unionByName(asked, allowMissingColumns=True).withColumn("block", F.floor(F.col("r") / BLOCK))
    upto = Window.partitionBy(*strip, "block").orderBy("r", F.abs("sign")).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*strip).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    carried = marks.groupBy(*strip, "block").agg(F.sum("d").alias("d"), F.sum("n").alias("n")).select(*strip, "block", F.sum("d").over(before).alias("d0"), F.sum("n").over(before).alias("n0")).where("n0 > 0")
    summed = marks.withColumns({"d": F.sum("d").over(upto), "n": F.sum("n").over(upto)}).where("sign <> 0").join(carried, [*strip, "block"], "left")
    plus = lambda a, b: F.sum(F.col("sign") * (F.col(a) + F.coalesce(b, F.lit(0))))
    return summed.groupBy(*keys).agg(plus("d", "d0").alias("total"), plus("n", "n0").alias("found")).where("found > 0")


def range_sums(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """(id, total) of ranges (id, file, sheet, r0, c0, r1, c1) that hold a number: the sum of their numeric cells."""
    return range_totals(cells.where("kind = 'n' and d is not null").select(*PLACE, "r", "c", "d"), ranges, ["id"]).select("id", "total")


def _parse_all(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        found = [(x.file, x.sheet, x.r, x.c, p[0], [dict(zip(("r0", "c0", "r1", "c1"), b)) for b in p[1]]) for x in pdf.itertuples(index=False) if (p := parse(x.formula))]
        yield pd.DataFrame(found, columns=["file", "sheet", "r", "c", "op", "args"])


def _solve_sheet(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    places = list(zip(pdf["r"].tolist(), pdf["c"].tolist()))
    parsed = [(op, [(a["r0"], a["c0"], a["r1"], a["c1"]) for a in args]) for op, args in zip(pdf["op"], pdf["args"], strict=True)]
    solved = solve(places, parsed, [list(t) for t in pdf["totals"]], [list(n) for n in pdf["found"]])
    return pd.DataFrame([(*key, *at, *s) for at, s in zip(places, solved, strict=True)], columns=["file", "sheet", "r", "c", "value", "state"])


def _solve_whole(rows: Iterable[tuple], parse=parse) -> list[tuple]:
    """(r, c, value, state) of a sheet's formulas, from rows (file, sheet, r, c, d, number, formula, dealt) of all it holds."""
    filled, numbers, texts = set(), {}, []
    for _, _, r, c, d, number, formula, _ in rows:
        if formula is not None:
            texts.append(((r, c), formula))
        elif number:
            numbers[r, c] = numbers.get((r, c), 0.0) + d
        else:
            filled.add((r, c))
    places, parsed, totals, found, within = [], [], [], [], Sums(numbers).within
    for at, text in texts:
        if at not in numbers and at not in filled and (p := parse(text)):
            sums = [within(box) for box in p[1]]
            places.append(at)
            parsed.append(p)
            totals.append([t for t, _ in sums])
            found.append([n for _, n in sums])
    return [(*at, *s) for at, s in zip(places, solve(places, parsed, totals, found), strict=True)]


def _solve_sheets(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All sheets of a partition, whose rows come sheet by sheet."""
    names, out = ["file", "sheet", "r", "c", "value", "state"], []
    again = lru_cache(1 << 13)(parse)  # sheets of one form have the same formulas
    rows = (row for pdf in parts for row in zip(*[pdf[c].tolist() for c in pdf.columns], strict=True))
    for key, own in groupby(rows, itemgetter(0, 1)):
        out += [(*key, *x) for x in _solve_whole(own, again)]
        if len(out) >= BATCH:
            yield pd.DataFrame(out, columns=names)
            out = []
    yield pd.DataFrame(out, columns=names)


def evaluate(cells: DataFrame, formulas: DataFrame, task_formulas: int = TASK_FORMULAS, task_links: int = TASK_LINKS, task_cells: int = TASK_CELLS) -> DataFrame:
    """(file, sheet, r, c, value, state) of formulas (file, sheet, r, c, formula) whose cells hold nothing yet.

    state: value; empty, where no number was found; cycle. Formulas of another kind than `parse` knows have no row.
    """
    place, number = [*PLACE, "r", "c"], (F.col("kind") == "n") & F.col("d").isNotNull()
    plain = cells.where("kind is not null and (s is not null or d is not null)").select(*place, F.col("d").cast("double").alias("d"), number.alias("number"), F.lit(None).cast("string").alias("formula"))
    rows = plain.unionByName(formulas.where("formula is not null").select(*place, F.lit(None).cast("double").alias("d"), F.lit(False).alias("number"), "formula"))
    is_formula, parts, ranged = F.col("formula").isNotNull(), F.length("formula") - F.length(F.replace("formula", F.lit(","))) + 2, F.contains("formula", F.lit(":"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sizes = rows.groupBy(*PLACE).agg(
        F.count_if(is_formula).alias("formulas"), F.count_if(~is_formula).alias("cells"), zero(F.when(is_formula & ~ranged, parts)).alias("single"), zero(F.when(is_formula & ranged, parts)).alias("ranges"),
        (F.max("c") - F.min("c") + 1).alias("width"),
    )
    links = F.col("single") + F.col("ranges") * F.greatest("formulas", "width")  # at most
    too_large = (F.col("formulas") > task_formulas) | (F.col("cells") > task_cells) | (links > task_links)
    others = stored(sizes.where((F.col("formulas") == 0) | too_large).select(*PLACE, "formulas"))
    small = rows if others.isEmpty() else rows.join(others, PLACE, "left_anti")
    # By a column of its own: where rows happen to be dealt by sheet already, repartition is left out, and adaptive joins may then undo that.
    dealt = small.withColumn("dealt", F.xxhash64(*PLACE)).repartition("dealt").sortWithinPartitions("dealt", *PLACE)
    out = dealt.mapInPandas(_solve_sheets, VALUES)
    large = others.where("formulas > 0").select(*PLACE)
    if large.isEmpty():
        return out
    return out.unionByName(_evaluate_large(cells.join(large, PLACE, "left_semi"), formulas.join(large, PLACE, "left_semi"), task_formulas, task_links))


def _evaluate_large(cells: DataFrame, formulas: DataFrame, task_formulas: int, task_links: int) -> DataFrame:
    """The same with ranges' sums and links found by jobs over all sheets."""
    place = [*PLACE, "r", "c"]
    filled = cells.where("kind is not null and (s is not null or d is not null)").select(*place)
    parsed = stored(formulas.select(*place, "formula").mapInPandas(_parse_all, PARSED).join(filled, place, "left_anti").withColumn("id", F.monotonically_increasing_id()))
    args = parsed.select("id", *PLACE, F.posexplode("args").alias("arg", "box")).select("id", "arg", *PLACE, "box.*")
    numbers = cells.where("kind = 'n' and d is not null").select(*place, "d")
    keys = ["id", "arg"]
    sums = args.select(*keys).join(range_totals(numbers, args, keys), keys, "left").join(range_totals(parsed.select(*place, F.lit(1.0).alias("d")), args, keys).select(*keys, F.col("found").alias("waits")), keys, "left")
    sums = stored(sums.select(*keys, *[F.coalesce(c, F.lit(0)).cast(kind).alias(c) for c, kind in (("total", "double"), ("found", "long"), ("waits", "long"))]))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("arg", c))), lambda x: x[c])
    open_ = parsed.join(sums.groupBy("id").agg(ordered("total").alias("totals"), ordered("found").alias("found"), F.sum("waits").alias("waits")), "id", "left")
    none = lambda kind: F.array().cast(f"array<{kind}>")  # noqa: E731  a SUM of no range
    open_ = stored(open_.withColumns({"totals": F.coalesce("totals", none("double")), "found": F.coalesce("found", none("bigint")), "waits": F.coalesce("waits", F.lit(0))}))
    large = open_.groupBy(*PLACE).agg(F.count("*").alias("n"), F.sum("waits").alias("links")).where((F.col("n") > task_formulas) | (F.col("links") > task_links)).select(*PLACE)
    done = open_.join(large, PLACE, "left_anti").groupBy(*PLACE).applyInPandas(_solve_sheet, VALUES)
    return done.unionByName(_rounds(open_.join(large, PLACE, "left_semi").drop("totals", "found", "waits"), sums))


def _rounds(open_: DataFrame, sums: DataFrame) -> DataFrame:
    """The same by jobs over all sheets: a round evaluates what is ready and adds it to the ranges that hold it."""
    keys, place, done = ["id", "arg"], [*PLACE, "r", "c"], []
    open_ = stored(open_)
    while not open_.isEmpty():
        per = sums.groupBy("id").agg(F.sum("waits").alias("waits"), F.array_sort(F.collect_list(F.struct("arg", "total", "found"))).alias("x"))
        told = open_.join(per, "id", "left").where("coalesce(waits, 0) = 0")
        total, found = (lambda i: F.get("x", F.lit(i))["total"]), (lambda i: F.get("x", F.lit(i))["found"] > 0)
        whole = F.when(F.exists("x", lambda a: a["found"] > 0), F.aggregate("x", F.lit(0.0), lambda s, a: s + a["total"]))
        pair = F.when(F.col("op") == "+", total(0) + total(1)).when(F.col("op") == "-", total(0) - total(1)).otherwise(total(0) * total(1))
        value = F.when(F.col("op").isin("sum", "ref"), whole).when(found(0) & found(1), pair)
        ready = stored(told.select("id", *place, value.alias("value")))
        if ready.isEmpty():
            break
        done.append(ready.select(*place, "value", F.when(F.col("value").isNull(), "empty").otherwise("value").alias("state")))
        open_ = stored(open_.join(ready.select("id"), "id", "left_anti"))
        args = open_.select("id", *PLACE, F.posexplode("args").alias("arg", "box")).select("id", "arg", *PLACE, "box.*")
        new = range_totals(ready.where("value is not null").select(*place, F.col("value").alias("d")), args, keys).select(*keys, F.col("total").alias("t"), F.col("found").alias("f"))
        gone = range_totals(ready.select(*place, F.lit(1.0).alias("d")), args, keys).select(*keys, F.col("found").alias("g"))
        left = sums.join(open_.select("id"), "id", "left_semi").join(new, keys, "left").join(gone, keys, "left")
        zero = lambda c: F.coalesce(c, F.lit(0))
        sums = stored(left.select(*keys, (F.col("total") + zero("t")).alias("total"), (F.col("found") + zero("f")).alias("found"), (F.col("waits") - zero("g")).alias("waits")))
    out = open_.select(*place, F.lit(None).cast("double").alias("value"), F.lit("cycle").alias("state"))
    for part in done:
        out = out.unionByName(part)
    return out
