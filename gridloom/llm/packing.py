"""Best-fit packing of token sequences by a configuration linear program (operator 10).

1. Texts become ids plus an end id; documents above the capacity are cut into full pieces, the
   first piece taking what is left over. Spark counts the pieces by length: at most ``capacity``
   numbers, whatever the input's size.
2. Over this histogram the configuration LP (least number of sequences such that each length is
   covered as often as it occurs) is solved by multiplicative weights. Weights stand for the
   lengths' prices; a knapsack dynamic program over the capacity prices the best configuration
   through every length, all nearly best ones are used in the round, and prices of what they cover
   fall.
3. The fractional solution is rounded down; what stays over is packed by best fit, longest first,
   over the histogram again.
4. Each piece takes the slot of its rank among the pieces of its length. Ranks come from counts by
   (length, salt), with a salt for every ``RANKED`` pieces of a length, so a length that a third of
   all rows share is numbered in many tasks.

Full pieces fill a sequence alone: they take a number of their own and enter neither the program nor a
window. Defined results: null or empty
text is the end id alone; repeated rows are packed as often as they occur; an empty table has no
pieces; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, mix, restored, stage, texts_of, tokenizer

#: Pieces of one length that are numbered in one task.
RANKED = 50_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, salt int"


def pieces_of(docs: DataFrame, vocabulary: str, kind: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, salt[, ids])."""

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = tokenizer(vocabulary, kind)
        for pdf in parts:
            texts, keys = pdf["text"].tolist(), pdf["doc_id"].to_numpy()
            for a, b in batches(texts):
                ids, ends = t.encode_ended(texts[a:b], end_id)
                ids, size = ids.astype("<u4", copy=False), np.diff(ends, prepend=0)
                n = -(-size // capacity)  # the first piece takes what the full ones leave
                doc = np.repeat(np.arange(len(n)), n)
                k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                stop = ends[doc] - (n[doc] - 1 - k) * capacity
                start = np.where(k == 0, ends[doc] - size[doc], stop - capacity)
                spans = list(zip(start.tolist(), stop.tolist()))
                out = {"doc_id": keys[a:b][doc], "piece": k, "start": start - (ends - size)[doc], "length": stop - start}
                out["ids_crc32"] = [zlib.crc32(ids[x:y]) for x, y in spans]
                out["salt"] = (mix(out["doc_id"].view(np.uint64) * np.uint64(3) + k.astype(np.uint64)) >> np.uint64(33)).astype(np.int64)
                if with_ids:
                    out["ids"] = [ids[x:y].astype(np.int64) for x, y in spans]
                yield pd.DataFrame(out)
        t.rest()

    return texts_of(docs, id_col, text_col).mapInPandas(cut, PIECES + (", ids array<long>" if with_ids else ""))


# --- the program over the histogram ---------------------------------------------------------------


def knapsack(price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """best[w]: the dearest multiset of lengths of total at most w; last[w]: a length in it, 0 if w - 1 does as well."""
    lengths = np.flatnonzero(price)
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    cost = price[lengths]
    fit = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for w in range(1, capacity + 1):
        best[w] = best[w - 1]
        if n := fit[w]:
            total = best[w - lengths[:n]] + cost[:n]
            k = int(np.argmax(total))
            if total[k] > best[w]:
                best[w], last[w] = total[k], lengths[k]
    return best, last


def solve(counts: np.ndarray, capacity: int, rounds: int = 240, step: float = 0.25, near: float = 0.06) -> dict[tuple[int, ...], float]:
    """Fractional use of configurations, by multiplicative weights with knapsack pricing.

    counts[l] pieces have length l < capacity. In a round every length's best configuration whose
    price is within ``near`` of the best is used a little: so much that no length is covered by
    more than ``step`` of its count. Returned uses are scaled to cover each length once on average.
    """
    lengths = np.flatnonzero(counts)
    if not len(lengths):
        return {}
    covered, use = np.zeros(capacity + 1), {}
    for _ in range(rounds):
        low = covered[lengths].min()
        price = np.zeros(capacity + 1)
        price[lengths] = lengths / capacity * np.exp(-(covered[lengths] - low))
        best, last = knapsack(price, capacity)
        through = np.zeros(capacity + 1)
        through[lengths] = price[lengths] + best[capacity - lengths]
        chosen: dict[tuple[int, ...], None] = {}
        for l in lengths[through[lengths] >= (1 - near) * best[capacity]].tolist():
            got, w = [l], capacity - l
            while w > 0:
                if last[w]:
                    got.append(int(last[w]))
                    w -= int(last[w])
                else:
                    w -= 1
            chosen[tuple(sorted(got, reverse=True))] = None
        demand = np.zeros(capacity + 1)
        for c in chosen:
            np.add.at(demand, list(c), 1.0)
        for c in chosen:
            amount = step * min(counts[l] / demand[l] for l in c)
            use[c] = use.get(c, 0.0) + amount
            for l in c:
                covered[l] += amount / counts[l]
    scale = float((covered[lengths] * counts[lengths] * lengths).sum() / (counts[lengths] * lengths).sum())
    return {c: x / scale for c, x in use.items()}


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, over a histogram: alike sequences are one entry (lengths, times)."""
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for l in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[l])
        for r in sorted(r for r in room if r >= l):
            moved: list[tuple[tuple[int, ...], int]] = []
            while left and room[r]:
                c, n = room[r].pop()
                fit = min(r // l, left)
                if full := min(n, left // fit):
                    moved.append((c + (l,) * fit, full, r - l * fit))
                    left -= full * fit
                    n -= full
                if n and left and left < fit:
                    moved.append((c + (l,) * left, 1, r - l * left))
                    left, n = 0, n - 1
                if n:
                    room[r].append((c, n))
            for c, n, rest in moved:
                room.setdefault(rest, []).append((c, n))
            if not left:
                break
        if left:
            each = capacity // l
            if full := left // each:
                room.setdefault(capacity - each * l, []).append(((l,) * each, full))
            if rest := left % each:
                room.setdefault(capacity - rest * l, []).append(((l,) * rest, 1))
    return [entry for entries in room.values() for entry in entries]


def pack(counts: np.ndarray, capacity: int, **how) -> list[tuple[tuple[int, ...], int]]:
    """Configurations and how often each is used; together they hold every piece exactly once.

    The fractional uses are rounded down at several scales, each completed by best fit; the least
    number of sequences wins.
    """
    use, least = solve(counts, capacity, **how), None
    for scale in (1.0, 0.97, 0.9, 0.75, 0.5):
        left, plan = counts.copy(), []
        for c, x in sorted(use.items(), key=lambda cx: (capacity - sum(cx[0]), -cx[1], cx[0])):
            need: dict[int, int] = {}
            for l in c:
                need[l] = need.get(l, 0) + 1
            if n := min(int(x * scale), *(int(left[l]) // k for l, k in need.items())):
                for l, k in need.items():
                    left[l] -= n * k
                plan.append((c, n))
        plan += best_fit(left, capacity)
        if least is None or sum(n for _, n in plan) < sum(n for _, n in least):
            least = plan
    return least or []


def slots(plan: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[str, np.ndarray]:
    """Runs of slots by length: the run's first rank within the length, sequence and offset.

    A run of a configuration used n times holds ranks base .. base + n - 1 in n sequences.
    """
    runs, taken, sequence = [], {}, 0
    for c, n in plan:
        offset = 0
        for l in c:
            base = taken.get(l, 0)
            runs.append((l, base, sequence, offset))
            taken[l] = base + n
            offset += l
        sequence += n
    a = np.array(sorted(runs), np.int64).reshape(-1, 4)
    return {"key": a[:, 0] * (1 << 40) + a[:, 1], "base": a[:, 1], "sequence": a[:, 2], "offset": a[:, 3], "n": sequence}


def place(pieces: DataFrame, capacity: int, **how) -> DataFrame:
    """Adds sequence_id and offset; pieces must be a stored table with the columns of PIECES."""
    spark = pieces.sparkSession
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most capacity rows
        counts[r["length"]] = r["n"]
    counts[capacity] = 0
    table = slots(pack(counts, capacity, **how), capacity)
    shared = spark.sparkContext.broadcast(table)  # bounded by the configurations over 1..capacity
    parts_of = spark.createDataFrame([(int(l), int(-(-counts[l] // RANKED))) for l in np.flatnonzero(counts)], "length long, salts long")  # at most capacity rows

    kept = [c for c in pieces.columns if c != "salt"]
    some = pieces.where(F.col("length") < capacity).join(F.broadcast(parts_of), "length").withColumn("salt", F.pmod("salt", "salts"))
    by_salt = some.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = by_salt.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "start")) - 1
    ranked = some.withColumn("within", within).join(before, ["length", "salt"]).select(*kept, (F.col("before") + F.col("within")).alias("rank"))

    def assign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = shared.value
        for pdf in parts:
            length, rank = pdf["length"].to_numpy(), pdf["rank"].to_numpy()
            k = np.maximum(np.searchsorted(t["key"], length * (1 << 40) + rank, side="right") - 1, 0)
            yield pdf.drop(columns=["rank"]).assign(sequence_id=t["sequence"][k] + rank - t["base"][k], offset=t["offset"][k])

    fields = {f.name: f.dataType.simpleString() for f in pieces.schema.fields}
    placed = ranked.mapInPandas(assign, ", ".join(f"{c} {fields[c]}" for c in kept) + ", sequence_id long, offset long")
    full = pieces.where(F.col("length") == capacity).select(*kept, (F.monotonically_increasing_id() + table["n"]).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(full)


def pack_documents(docs: DataFrame, vocabulary: str, kind: str = "bytes", end_id: int = 2, capacity: int = 1024, with_ids: bool = False, **how) -> DataFrame:
    """Pieces of all documents with their sequence and place; with_ids adds the pieces' token ids."""
    return restored(place(stage(pieces_of(docs, vocabulary, kind, end_id, capacity, with_ids=with_ids), "pieces"), capacity, **how))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
