"""Line deduplication: a suffix order of line-ID sequences by prefix doubling, read by LCP intervals (operator 6).

The corpus is the sequence of its documents' non-blank lines, in order of document id. A run of
lines is repeated if the same lines stand in a row elsewhere, and a run counts when it has at least
``min_chars`` characters. Every run that counts and has an earlier copy is deleted; the first stays.

* A line's id is the 64-bit hash of its bytes. Lines have places in the corpus (``at``), and each document ends
  in a mark of its own, below all lines and in order of documents, so no two suffixes are equal.
* Doubling: suffixes that share their first h lines are a group, ranked by the place of its first in the order;
  sorted by (rank at i, rank at i + h) they fall into groups for 2h. Sorted ranges are numbered in themselves, and a row
  a range tells where its first groups began, so a group of any size is spread over tasks. Groups of one are
  done; rounds go on until every suffix is.
* Common prefixes of neighbours: where a group for h falls apart, the neighbours on either side share h lines and
  what the suffixes h further on share, found by comparing their ranks for h/2, h/4, .. 1.
* LCP intervals: the longest start of a suffix that stands earlier in the corpus too is the depth of the deepest
  interval in which the suffix isn't the first of the corpus. It is the greater one of the common prefixes with the nearest
  suffixes on either side, in the order, that stand earlier in the corpus. A stack finds them within
  blocks of the order; what is open at a block's ends asks the one block that has its answer. These starts
  are the maximal repeated runs; those of ``min_chars`` go.

Results: one row a document with the text that is left, lines in all and removed, and the maximal
deleted runs as pairs of line numbers. Blank lines never count and stay, but go with a document
whose other lines are all deleted. Null and empty texts have no line to lose. Rows equal in id and
text are one document and are treated alike; null ids come first; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NULL_ID, free_name, small_batches, stage, texts_of

LISTS = "doc_id long, doc long, names array<long>, ws array<int>"
SORTED = "at long, i int, rest int, w int, g long, s long, in_g long, in_s long, first_g boolean, first_s boolean, more boolean, before long, part int, k long, last boolean"
CARRY = "part int, from_g long, from_s long, from_at long, goes_on boolean"
FOUND = "block long, at long, i int, w int, best int, left int, right int, link int, least boolean"
KEPT = "n_lines int, n_removed int, runs array<struct<first:int,last:int>>, text string"
#: Places of the suffix order in a block, and rows of a sorted range: what a task holds at once.
PLACES = 1 << 17
#: More lines than any common prefix has.
MANY = (1 << 31) - 1


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return texts_of(docs, id_col, text_col).withColumn("doc", F.xxhash64("doc_id", "text"))


def lines_of(docs: DataFrame, min_chars: int) -> DataFrame:
    """A document's non-blank lines: their hashes, and how many from each on make a run that counts (0: too few follow)."""

    def split(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_64_intdigest

        for pdf in parts:
            out: list[tuple] = []
            for key, doc, text in zip(pdf["doc_id"], pdf["doc"], pdf["text"], strict=True):
                lines = [line for line in text.split("\n") if line.strip()]
                if not lines:
                    continue
                sums = np.concatenate([[0], np.cumsum([len(line) for line in lines])])
                reach = np.searchsorted(sums, np.maximum(sums[:-1] + min_chars, sums[1:]))  # first end at which the run counts
                names = np.array([xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) for line in lines], np.uint64).view(np.int64)
                out.append((key, doc, names, np.where(reach < len(sums), reach - np.arange(len(lines)), 0).astype(np.int32)))
            yield pd.DataFrame(out, columns=["doc_id", "doc", "names", "ws"])

    return docs.mapInPandas(split, LISTS)


def numbered(lists: DataFrame) -> DataFrame:
    """(doc, start): where each distinct document's lines begin, in order of documents; a document's mark takes a place after them."""

    def number(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = TaskContext.get().partitionId() << 40
        for pdf in parts:
            ends = base + np.cumsum(pdf["n"].to_numpy(np.int64) + 1)
            yield pd.DataFrame({"doc": pdf["doc"], "start": np.concatenate([[base], ends[:-1]])})
            base = int(ends[-1]) if len(ends) else base

    heads = lists.select("doc_id", "doc", F.size("names").alias("n")).distinct()
    return heads.repartitionByRange("doc_id", "doc").sortWithinPartitions("doc_id", "doc").mapInPandas(number, "doc long, start long")


def in_order(rows: DataFrame, h: int, n: int, places: int) -> DataFrame:
    """A round: n rows with groups g for h lines and ranks s of what follows these, in order.

    place: in the order as far as it is known; rank: place of the first of the row's new group; open: the group has
    others; apart: another group, or a suffix that ends here, stands just before in the old group, at ``before``.
    """

    def mark(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat([*parts, pd.DataFrame({"at": np.empty(0, np.int64)})], ignore_index=True)
        if not len(pdf):
            return
        at, g, s = (pdf[c].to_numpy(np.int64) for c in ("at", "g", "s"))
        k = np.arange(len(pdf))
        new_g = np.concatenate([[True], g[1:] != g[:-1]])
        new_s = new_g | np.concatenate([[True], s[1:] != s[:-1]])
        start_g, start_s = (np.maximum.accumulate(np.where(new, k, 0)) for new in (new_g, new_s))
        edge = (k == 0) | (k == len(k) - 1)
        out = {c: pdf[c].to_numpy() for c in ("i", "rest", "w")} | {"at": at, "g": g, "s": np.where(edge, s, 0), "in_g": k - start_g, "in_s": k - start_s, "first_g": start_g == 0, "first_s": start_s == 0}
        out |= {"more": np.append(~new_s[1:], False), "before": np.append(-1, at[:-1]), "part": np.full(len(k), TaskContext.get().partitionId(), np.int32), "k": k, "last": k == len(k) - 1}
        whole = pd.DataFrame(out)[[f.split()[0] for f in SORTED.split(", ")]]
        for a in range(0, len(whole), 50_000):
            yield whole.iloc[a : a + 50_000]

    spread = rows.select("at", "i", "rest", "w", "g", "s").repartitionByRange(n // places + 1, "g", "s", "at").sortWithinPartitions("g", "s", "at")
    table = stage(spread.mapInPandas(mark, SORTED), f"line-order-{h}")
    carry, last = [], None  # of the range before: its last row with the carried counts
    for row in sorted(table.where("k = 0 or last").select("part", "k", "g", "s", "at", "in_g", "in_s", "first_g", "first_s").collect(), key=lambda r: (r["part"], r["k"])):
        if row["k"] == 0:
            same_g = last is not None and last[0] == row["g"]
            same_s = same_g and last[1] == row["s"]
            if carry:
                carry[-1][-1] = same_s
            carry.append([row["part"], last[3] + 1 if same_g else 0, last[4] + 1 if same_s else 0, last[2] if last else -1, False])
        last = (row["g"], row["s"], row["at"], row["in_g"] + carry[-1][1] * row["first_g"], row["in_s"] + carry[-1][2] * row["first_s"])
    known = table.join(F.broadcast(table.sparkSession.createDataFrame(carry, CARRY)), "part")
    in_g = F.col("in_g") + F.when(F.col("first_g"), F.col("from_g")).otherwise(0)
    in_s = F.col("in_s") + F.when(F.col("first_s"), F.col("from_s")).otherwise(0)
    ended, goes_on = F.col("rest") == h, F.col("last") & F.col("goes_on")
    done = known.select(
        "at", "i", "rest", "w", (F.col("g") + in_g).alias("place"), F.when(ended, F.col("g") + in_g).otherwise(F.col("g") + in_g - in_s).alias("rank"),
        F.when(F.col("k") == 0, F.col("from_at")).otherwise(F.col("before")).alias("before"),
        ((in_g > 0) & ((in_s == 0) | ended)).alias("apart"), (~ended & ((in_s > 0) | F.col("more") | goes_on)).alias("open"),
    )
    return stage(done, f"line-round-{h}")


def suffix_order(lines: DataFrame, n: int, places: int) -> list[tuple[int, DataFrame]]:
    """(h, table) of each round: a suffix is in the tables of all rounds until its place is known, where it isn't open any more."""
    rounds: list[tuple[int, DataFrame]] = []
    rows, h = lines.withColumn("g", F.lit(0).cast("long")).withColumnRenamed("name", "s"), 0
    while n:
        rounds.append((h, in_order(rows, h, n, places)))
        h = 2 * h or 1
        tables = [t for _, t in rounds]
        opened = tables[-1].where("open")
        n = opened.count()
        ranks = opened.select("at", "i", "rank")
        for t in tables:
            ranks = ranks.union(t.where("not open").select("at", "i", "rank"))
        after = ranks.where(F.col("i") >= h).select((F.col("at") - h).alias("at"), F.col("rank").alias("s"))
        rows = opened.select("at", "i", "rest", "w", F.col("rank").alias("g")).join(after, "at", "left").fillna(-1, ["s"])
    return rounds


def common_prefixes(rounds: list[tuple[int, DataFrame]]) -> DataFrame:
    """(place, lcp): lines that the suffix at a place of the order shares with the one before; places that share none are left out."""
    pairs = None
    for r in range(len(rounds) - 1, 0, -1):
        h, table = rounds[r]
        new = table.where("apart").select("place", (F.col("before") + h).alias("x"), (F.col("at") + h).alias("y"), F.lit(h).alias("lcp"))
        pairs = new if pairs is None else pairs.unionByName(new)
        if h > 1:
            k, groups = h // 2, rounds[r - 2][1].where("open")  # groups for k lines; suffixes in none share k lines with no other
            one, other = (groups.select(F.col("at").alias(c), F.col("rank").alias("of_" + c)) for c in ("x", "y"))
            step = F.when(F.col("of_x") == F.col("of_y"), k).otherwise(0)
            pairs = stage(pairs.join(one, "x", "left").join(other, "y", "left").select("place", (F.col("x") + step).alias("x"), (F.col("y") + step).alias("y"), (F.col("lcp") + step).alias("lcp")), f"line-prefixes-{k}")
    return pairs.select("place", "lcp")


def _nearest(own: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
    """A block of the order. best: lines shared with the nearest suffixes on either side that stand earlier in the corpus.

    left, right: for suffixes with no such one before them, or after them, in the block, lines shared with all up to its end there.
    """
    own = own.sort_values("place")
    n, at, lcp = len(own), own["at"].tolist(), np.zeros(len(own), np.int64)
    lcp[np.searchsorted(own["place"].to_numpy(), shared["place"].to_numpy())] = shared["lcp"].to_numpy()
    lcp, best, left, right = lcp.tolist(), [0] * n, [0] * n, [0] * n
    stack: list[int] = []
    low: list[int] = []  # lines that all share from the one beneath in the stack
    for r in range(n):
        least = lcp[r]
        while stack and at[stack[-1]] > at[r]:
            t = stack.pop()
            best[t] = max(best[t], least)
            least = min(least, low.pop())
        if stack:
            best[r] = least
        else:
            left[r] = least
        stack.append(r)
        low.append(least)
    least = MANY
    while stack:
        right[stack.pop()] = least
        least = min(least, low.pop())
    out = own[["block", "at", "i", "w"]].assign(best=best, left=left, right=right, link=lcp[:1] * n)
    return out.assign(least=out["at"] == min(at, default=0))[[f.split()[0] for f in FOUND.split(", ")]]


def longest_earlier(suffixes: DataFrame, prefixes: DataFrame, places: int) -> DataFrame:
    """(at, i, w, best): lines with which a suffix begins that stand earlier in the corpus too; a suffix's greatest row holds."""
    block = F.floor(F.col("place") / places).alias("block")
    cut = suffixes.select(block, "*").groupBy("block").cogroup(prefixes.select(block, "*").groupBy("block")).applyInPandas(_nearest, FOUND)
    found = stage(cut, "line-intervals")
    spans = {r["block"]: (r["at"], min(r["left"], r["right"]), r["link"]) for r in found.where("least").collect()}
    spans = {b: v for b, v in spans.items() if v[2] or spans.get(b + 1, v)[2]}  # an interval goes on from one block to the next

    def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out: list[tuple] = []
            for b, at, i, w, left, right in zip(*(pdf[c].tolist() for c in ("block", "at", "i", "w", "left", "right"))):
                for side, cap, b in ((0, left, b - 1), (1, min(right, spans[b + 1][2]) if b + 1 in spans else 0, b + 1)):
                    while cap and spans[b][0] > at:  # nothing in this block stands earlier
                        on = spans.get(b + 1, (0, 0, 0))[2] if side else MANY
                        cap, b = min(cap, spans[b][1], on), b + 2 * side - 1
                    if cap:
                        out.append((b, side, at, i, w, cap, None))
            yield pd.DataFrame(out, columns=["block", "side", "at", "i", "w", "cap", "value"]).astype({"value": "Int32"})

    every = found.select("at", "i", "w", "best")
    if not spans:
        return every
    ends = found.where(F.greatest("left", "right") > 0)
    both = ends.mapInPandas(ask, "block long, side int, at long, i int, w int, cap int, value int")
    for side, value in ((0, "right"), (1, "left")):  # what can be nearest to a suffix of a later block, and to one of an earlier block
        both = both.unionByName(ends.where(F.col(value) > 0).select("block", F.lit(side).alias("side"), "at", F.col(value).alias("value")), allowMissingColumns=True)
    nearest = F.last("value", True).over(Window.partitionBy("block", "side").orderBy("at"))
    answers = both.withColumn("value", nearest).where("cap is not null and value is not null")
    return every.unionByName(answers.select("at", "i", "w", F.least("cap", "value").alias("best")))


def placed(docs: DataFrame, min_chars: int) -> tuple[DataFrame, DataFrame, int]:
    """All lines with their places in the corpus, where each document starts, and how many lines there are."""
    lists = stage(lines_of(docs, min_chars).dropDuplicates(["doc_id", "doc"]), "line-lists")
    starts = stage(numbered(lists), "line-starts")
    each = lists.select("doc", F.size("names").alias("n"), F.posexplode(F.arrays_zip("names", "ws")).alias("i", "line")).join(starts, "doc")
    lines = each.select((F.col("start") + F.col("i")).alias("at"), "i", (F.col("n") - F.col("i")).alias("rest"), F.col("line.ws").alias("w"), F.col("line.names").alias("name"))
    return lines, starts, lists.agg(F.sum(F.size("names"))).first()[0] or 0


def repeated_runs(docs: DataFrame, min_chars: int, places: int = PLACES) -> DataFrame:
    """(doc, runs): for each line from which on a run that counts has an earlier copy, its number and the longest such run's length, as number << 32 | length."""
    lines, starts, n = placed(docs, min_chars)
    rounds = suffix_order(lines, n, places)
    if len(rounds) < 2:  # no line occurs twice
        return starts.limit(0).select("doc", F.array("start").alias("runs"))
    suffixes = None  # lines that occur once share nothing with their neighbours in the order
    for _, table in rounds[1:]:
        known = table.where("not open").select("place", "at", "i", "w")
        suffixes = known if suffixes is None else suffixes.unionByName(known)
    runs = longest_earlier(suffixes, common_prefixes(rounds), places).where("w > 0 and best >= w")
    packed = F.shiftleft(F.col("i").cast("long"), 32).bitwiseOR(F.col("best").cast("long"))
    return runs.groupBy((F.col("at") - F.col("i")).alias("start")).agg(F.collect_list(packed).alias("runs")).join(starts, "start").select("doc", "runs")


def _cut(texts: pd.Series, copies: pd.Series) -> pd.DataFrame:
    rows = []
    for text, found in zip(texts, copies, strict=True):
        text = text or ""
        lines, gone = text.split("\n"), set()
        runs: list[dict] = []
        filled = [k for k, line in enumerate(lines) if line.strip()]
        upto = 0
        for run in [] if found is None else sorted(int(r) for r in found):
            first, end = run >> 32, (run >> 32) + (run & MANY)
            gone.update(filled[max(first, upto) : end])
            upto = max(upto, end)
        for before, k in zip([-1, *filled], filled):
            if k in gone:
                if runs and runs[-1]["last"] == before:
                    runs[-1]["last"] = k
                else:
                    runs.append({"first": k, "last": k})
        kept = "" if gone and len(gone) == len(filled) else "\n".join(line for k, line in enumerate(lines) if k not in gone)
        rows.append((len(filled), len(gone), runs, kept if gone else text))
    return pd.DataFrame(rows, columns=["n_lines", "n_removed", "runs", "text"])


def with_kept_lines(docs: DataFrame, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text", out_col: str = "kept", places: int = PLACES) -> DataFrame:
    """All rows and columns of docs with a struct column (n_lines, n_removed, runs, text), whose name must be free."""
    doc, runs = free_name(docs, "doc_key"), free_name(docs, "line_runs")
    found = repeated_runs(keyed(docs, id_col, text_col), min_chars, places).withColumnsRenamed({"doc": doc, "runs": runs})
    key = F.xxhash64(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    small_batches(docs.sparkSession)
    cut = F.pandas_udf(_cut, KEPT)
    joined = docs.withColumn(doc, key).join(found, doc, "left")
    return joined.withColumn(out_col, cut(F.col(f"`{text_col}`").cast("string"), F.col(runs))).drop(doc, runs)


def dedup_lines(docs: DataFrame, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text", places: int = PLACES) -> DataFrame:
    """(doc_id, n_lines, n_removed, runs, text) of every document."""
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return with_kept_lines(plain, min_chars, places=places).select("doc_id", "kept.*")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
