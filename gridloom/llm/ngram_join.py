"""N-gram Jaccard join by filters under several global token orders (operator 7).

A document's set is its distinct 5-word shingles (64-bit hashes). Sets link when their Jaccard similarity is at
least 0.8. If two sets of sizes a and b link, then under any one global order of all shingles their prefixes of
a - ceil(0.8 a) + 1 and b - ceil(0.8 b) + 1 shingles share one. That holds for each order by itself, so candidates
must share a prefix shingle under every one of them:

* How often each shingle occurs in the corpus is counted first (chunks.py). Every order puts rarer shingles before
  more frequent ones, by classes of counts, and orders equals by a hash of its own. So a document whose prefix is
  all shingles that occur once has no link, whatever passages it shares, and goes no further.
* Documents with equal sets are one class. Classes meet where they share a prefix shingle under the first order.
* The filters are intersected before any text moves: pairs go whose sizes, counts of shingles that occur once, or
  sketches (counts of shingles by leading bits, whose minima bound an intersection from above) rule a link out, and pairs
  whose prefixes under any of the other orders share nothing. What is left is verified on the texts.

Only components are asked for, so not all pairs of a large group are made: first each shared shingle's classes meet the
class among them with the least share of shingles that occur once (the text that others were copied from), and the
links are joined into components. Then only shingles whose classes are in several components are open: one class
outside the largest component meets the others there; and what is still open meets in blocks of bounded size, those
outside the largest component with all of other components. So no link between components is lost, and a group
that is one component costs a row a class.

Defined results: null, empty and word-free texts have no shingles and stand alone; repeated rows have equal sets and so
one component; a null id never names a component with other members; an empty table has no rows; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import OFTEN, Chunk, Corpus, answered, question
from .common import LOWER, NULL_ID, mix, prefix_hash, restored, shingle_hashes, stage, window_hash, word_hashes, word_spans, lowered
from .components import components

ORDERS = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)
#: A set's sketch: how many of its shingles begin with each pattern of leading bits. Sums of minima bound an
#: intersection from above; there are at least BINS bins, and four times as many until 16 shingles share one.
BINS = 128
BLOCK = 512
#: How many of its least prefix shingles a row carries where rows meet.
LEAST = 8
TOKENS = [f"t{o}" for o in range(len(ORDERS))]
DOCS = "doc_id long, sig long, n int, rare int, chunk long, file string, d int, sketch binary, " + ", ".join(f"{t} array<long>" for t in TOKENS)


def shingles(text: str, k: int = 5) -> np.ndarray:
    return shingle_hashes(word_hashes(lowered(text)), k)


def sets_of(chunk: Chunk, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of all documents in a row, and where each document's end."""
    data = np.frombuffer(b" ".join(chunk.texts).translate(LOWER), np.uint8)
    start, end = word_spans(data)
    if not len(start):
        return np.empty(0, np.uint64), np.zeros(len(chunk.texts), np.int64)
    words = window_hash(prefix_hash(data), start, end)
    doc = np.searchsorted(chunk.end + np.arange(len(chunk.end)), start, side="right")  # a blank stands after each text
    whole = np.flatnonzero(doc[: max(0, len(doc) - k + 1)] == doc[k - 1 :])
    out = np.full(len(whole), np.uint64(k), np.uint64)
    for j in range(k):
        out = mix(out * np.uint64(0x100000001B3) + words[whole + j])
    of, count = doc[whole], np.bincount(doc, minlength=len(chunk.texts))
    upto = np.cumsum(count)
    few = np.flatnonzero((count > 0) & (count < k)).tolist()
    out = np.concatenate([out, *(shingle_hashes(words[upto[d] - count[d] : upto[d]], k) for d in few)])
    of = np.concatenate([of, np.array(few, of.dtype)])
    order = np.lexsort((out, of))
    out, of = out[order], of[order]
    new = np.concatenate([[True], (out[1:] != out[:-1]) | (of[1:] != of[:-1])])
    return out[new], np.cumsum(np.bincount(of[new], minlength=len(chunk.texts)))


def first_of_equals(chunk: Chunk, sets: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's signature, and which documents are the chunk's first with theirs."""
    from xxhash import xxh3_64_intdigest

    raw = sets.tobytes()
    sig = np.array([xxh3_64_intdigest(raw[8 * a : 8 * b]) - (1 << 63) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())], np.int64)
    lead = np.zeros(len(sig), bool)
    lead[np.unique(sig, return_index=True)[1]] = True
    return sig, lead


def sketch(s: np.ndarray) -> bytes:
    bits = BINS.bit_length() - 1
    while len(s) > 16 << bits:
        bits += 2
    while (count := np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)).max() > 255:
        bits += 1
    return count.astype(np.uint8).tobytes()


def prefix(s: np.ndarray, often: np.ndarray, order: int, percent: int) -> np.ndarray:
    """Where the shingles of a set's prefix stand in it, under an order: rarer classes first, equals by hash."""
    n = len(s)
    size = n - -(-percent * n // 100) + 1
    key = (mix(s ^ np.uint64(order)) >> np.uint64(2)) | (often.astype(np.uint64) << np.uint64(62))
    return np.argpartition(key, size - 1)[:size] if size < n else np.arange(n)


def documents(corpus: Corpus, k: int, percent: int) -> DataFrame:
    """A row a document; the first of each set in a chunk, if it can have links, with its prefixes under all orders."""
    entries = corpus.bytes / 6 + 1
    buckets, bits = corpus.buckets(entries), max(32, min(64, int(np.log2(entries)) + 10))

    def asked(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        sets, ends = sets_of(chunk, k)
        sig, lead = first_of_equals(chunk, sets, ends)
        return sets, ends, sig, lead

    def ask(number: int, chunk: Chunk) -> pd.DataFrame:
        sets, ends, _, lead = asked(chunk)
        return question(number, sets[np.repeat(lead, np.diff(ends, prepend=0))], buckets, bits)

    def rows(number: int, file: str, kept: bytes | None, reply: np.ndarray) -> Iterator[pd.DataFrame]:
        chunk = Chunk.load(file)
        sets, ends, sig, lead = asked(chunk)
        n = np.diff(ends, prepend=0)
        mine = np.repeat(lead, n)
        often = np.zeros(len(sets), np.uint8)
        often[mine] = answered(sets[mine], reply, bits)[0] & OFTEN
        once = np.concatenate([[0], np.cumsum(often == 0)])
        rare = once[ends] - once[ends - n]
        open_ = lead & (n > 0) & (rare < n - -(-percent * n // 100) + 1)
        out = {"doc_id": chunk.ids, "sig": sig, "n": n, "rare": np.where(lead, rare, 0), "chunk": number, "file": file, "d": np.arange(len(n)), "sketch": np.full(len(n), None, object)}
        out |= {t: np.full(len(n), None, object) for t in TOKENS}
        for d in np.flatnonzero(open_).tolist():
            s, c = sets[ends[d] - n[d] : ends[d]], often[ends[d] - n[d] : ends[d]]
            out["sketch"][d] = sketch(s)
            for t, order in zip(TOKENS, ORDERS):
                at = prefix(s, c, order, percent)
                out[t][d] = np.sort(s[at[c[at] > 0]].view(np.int64))
        yield pd.DataFrame(out)

    return stage(corpus.each(corpus.answers(corpus.begin(ask), buckets), rows, DOCS), "ngram-documents")


def sharing(classes: DataFrame) -> DataFrame:
    """(token, sig, n, rare, and the group's picked class) of first-order prefix shingles that several classes share.

    A shingle's picked class has the least share of shingles that occur once: the text that others were copied from.
    """
    rows = classes.select(F.explode(TOKENS[0]).alias("token"), "sig", "n", "rare")
    return rows.join(_picked(rows), "token")


def _can_link(a: str, b: str, percent: int):
    """Sizes, and shingles that occur once and so in no other set, allow a link of two classes."""
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    least = F.least(n - F.col(f"{a}rare"), m - F.col(f"{b}rare"))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (least * (100 + percent) >= (n + m) * percent)


def under_other_orders(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (u, v) whose prefixes share a shingle under every order after the first."""
    side = lambda x: classes.select(F.col("sig").alias(x), *[F.col(t).alias(x + t) for t in TOKENS[1:]])
    both = pairs.join(side("u"), "u").join(side("v"), "v")
    for t in TOKENS[1:]:
        both = both.where(F.arrays_overlap("u" + t, "v" + t))
    return both.select("u", "v")


def _pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of each group's rows with the group's picked class, as far as they can link."""
    rows = rows.where(F.col("sig") != F.col("p_sig")).where(_can_link("", "p_", percent))
    return rows.select(F.least("sig", "p_sig").alias("u"), F.greatest("sig", "p_sig").alias("v"))


def _picked(rows: DataFrame, *more: str) -> DataFrame:
    fields = ["sig", "n", "rare", *more]
    pick = rows.groupBy("token").agg(F.min(F.struct((F.col("rare") / F.col("n")).alias("share"), *fields)).alias("p"), F.count("*").alias("c"))
    return pick.where("c > 1" if not more else "c > 0").select("token", *[F.col(f"p.{f}").alias(f"p_{f}") for f in fields])


def open_groups(shared: DataFrame, label: DataFrame) -> DataFrame:
    """Rows of shared shingles whose classes are in several components, with the largest one marked."""
    now = shared.select("token", "sig", "n", "rare").join(label.withColumnRenamed("node", "sig"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    sizes = now.groupBy("token", "label").agg(F.count("*").alias("c"))
    mixed = sizes.groupBy("token").agg(F.count("*").alias("labels"), F.sum("c").alias("c"), F.max(F.struct("c", F.col("label").alias("l"))).alias("top")).where("labels > 1")
    return now.join(mixed.select("token", F.col("top.l").alias("top"), F.ceil(F.col("c") / BLOCK).alias("blocks")), "token").withColumn("is_top", F.col("label") == F.col("top"))


def second_star_pairs(open_: DataFrame, percent: int) -> DataFrame:
    """In each open shingle, one class outside the largest component with those of other components."""
    return _pairs(open_.join(_picked(open_.where("not is_top"), "label"), "token").where("label <> p_label"), percent)


def _meeting(pdf: pd.DataFrame, percent: int, at_once: int = 500_000) -> Iterator[pd.DataFrame]:
    """Pairs within whole groups (token, block): rows that meet with rows that are met, of other labels.

    A pair that shares many shingles would come from each of their groups: where the rows' least shingles have one in
    common that is less than the group's, the pair comes from that one's group, so this one needn't give it.
    """
    table = Sketches(pdf["sketch"].tolist())
    lists = np.full((len(pdf), LEAST), np.iinfo(np.int64).max)
    for i, x in enumerate(pdf["least"]):
        lists[i, : len(x)] = x
    token, block, role, sig, n, rare, label, top = (pdf[c].to_numpy() for c in ("token", "block", "role", "sig", "n", "rare", "label", "is_top"))
    n, rare = n.astype(np.int64), rare.astype(np.int64)
    group = np.concatenate([[0], np.cumsum((token[1:] != token[:-1]) | (block[1:] != block[:-1]))])
    zero, one = np.flatnonzero(role != 1), np.flatnonzero(role != 0)
    size = np.bincount(group[zero], minlength=group[-1] + 1)
    first = np.cumsum(size) - size
    for lo, hi in _runs(size[group[one]], at_once):
        mine = one[lo:hi]
        times = size[group[mine]]
        a = np.repeat(mine, times)
        b = zero[np.repeat(first[group[mine]] - (np.cumsum(times) - times), times) + np.arange(len(a))]
        ok = (label[a] != label[b]) & (top[b] | (sig[a] < sig[b])) & (np.minimum(n[a], n[b]) * 100 >= np.maximum(n[a], n[b]) * percent)
        ok &= np.minimum(n[a] - rare[a], n[b] - rare[b]) * (100 + percent) >= (n[a] + n[b]) * percent
        a, b = a[ok], b[ok]
        known = np.zeros(len(a), bool)
        for j in range(LEAST):
            other = lists[b, j]
            known |= (other < token[a]) & (lists[a] == other[:, None]).any(axis=1)
        a, b = a[~known], b[~known]
        good = _possible(table, a, table, b, n[a] + n[b], percent)
        a, b = a[good], b[good]
        if len(a):
            pairs = np.unique(np.column_stack([np.minimum(sig[a], sig[b]), np.maximum(sig[a], sig[b])]), axis=0)
            yield pd.DataFrame({"u": pairs[:, 0], "v": pairs[:, 1]})


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of items whose sizes add up to about so much."""
    total, start = np.cumsum(sizes), 0
    while start < len(sizes):
        end = int(np.searchsorted(total, (total[start - 1] if start else 0) + most, side="right"))
        end = max(end, start + 1)
        yield start, end
        start = end


def cross_pairs(open_: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of different components that share a first-order prefix shingle, as far as sketches allow."""

    def meet(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for pdf in parts:
            pdf = pdf if rest is None else pd.concat([rest, pdf])
            token, block = pdf["token"].to_numpy(), pdf["block"].to_numpy()
            cut = np.flatnonzero((token[1:] != token[:-1]) | (block[1:] != block[:-1]))
            end = int(cut[-1]) + 1 if len(cut) else 0  # the last group may go on
            if end:
                yield from _meeting(pdf.iloc[:end], percent)
            rest = pdf.iloc[end:]
        if rest is not None and len(rest):
            yield from _meeting(rest, percent)

    rows = open_.join(classes.select("sig", "sketch", F.slice(TOKENS[0], 1, LEAST).alias("least")), "sig")
    # Role 0 is met, 1 meets, 2 does both; in blocks other than its own a row outside the largest component only meets.
    own = F.pmod(F.xxhash64("sig"), F.col("blocks"))
    here = rows.withColumns({"block": own, "role": F.when(F.col("is_top"), 0).otherwise(2)})
    there = rows.where("not is_top and blocks > 1").withColumns({"block": F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)), "role": F.lit(1)}).where(F.col("block") != own)
    columns = ["token", "block", "role", "sig", "n", "rare", "label", "is_top", "least", "sketch"]
    both = here.select(*columns).unionByName(there.select(*columns))
    return both.repartition("token", "block").sortWithinPartitions("token", "block").mapInPandas(meet, "u long, v long")


class Sketches:
    """Sketches of rows; pairs are compared at the coarser one's bins."""

    def __init__(self, blobs) -> None:
        self.bins = np.array([len(b) for b in blobs])
        self.at, self.tables = np.zeros(len(self.bins), np.int64), {}
        for k in np.unique(self.bins).tolist():
            rows = np.flatnonzero(self.bins == k)
            self.at[rows] = np.arange(len(rows))
            self.tables[k] = np.frombuffer(b"".join(blobs[i] for i in rows.tolist()), np.uint8).reshape(len(rows), k)

    def rows(self, index: np.ndarray, bins: int) -> np.ndarray:
        out = np.empty((len(index), bins), np.int32)
        for k in np.unique(self.bins[index]).tolist():
            mine = self.bins[index] == k
            out[mine] = self.tables[k][self.at[index[mine]]].reshape(-1, bins, k // bins).sum(axis=2, dtype=np.int32)
        return out


def _possible(a: Sketches, x: np.ndarray, b: Sketches, y: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Whether rows x of a and y of b, of n shingles together, have a bound large enough for the similarity."""
    out = np.zeros(len(x), bool)
    bins = np.minimum(a.bins[x], b.bins[y])
    for k in np.unique(bins).tolist():
        which = np.flatnonzero(bins == k)
        for i in range(0, len(which), step := max(1, 1_000_000 // k)):
            w = which[i : i + step]
            out[w] = np.minimum(a.rows(x[w], k), b.rows(y[w], k)).sum(axis=1, dtype=np.int64) * (100 + percent) >= percent * n[w]
    return out


def possible_pairs(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (u, v) as far as sketches allow."""

    def keep(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if len(pdf):
                row = np.arange(len(pdf))
                ok = _possible(Sketches(pdf["us"].tolist()), row, Sketches(pdf["vs"].tolist()), row, (pdf["un"].astype("int64") + pdf["vn"]).to_numpy(), percent)
                yield pdf.loc[ok, ["u", "v"]]

    side = lambda x: sketches.select(F.col("sig").alias(x), F.col("n").alias(f"{x}n"), F.col("sketch").alias(f"{x}s"))
    return pairs.distinct().join(side("u"), "u").join(side("v"), "v").select("u", "v", "un", "vn", "us", "vs").mapInPandas(keep, "u long, v long")


def verified(pairs: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (u, v) among candidate pairs (u, v); sets has (sig, text). A u with very many v is salted."""

    def check(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        u, mine = None, None
        for pdf in parts:
            out = []
            for a, b, head, text in zip(pdf["u"], pdf["v"], pdf["head"], pdf["text"], strict=True):
                s = shingle_hashes(word_hashes(text), k)
                if head:
                    u, mine = a, s
                    continue
                assert a == u, "a class without its set"
                both = len(np.intersect1d(mine, s, assume_unique=True))
                if both * 100 >= percent * (len(mine) + len(s) - both):
                    out.append((a, int(b)))
            yield pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    pieces = pairs.groupBy("u").agg(F.ceil(F.count("*") / 256).alias("pieces"))
    members = pairs.join(pieces, "u").withColumn("piece", F.pmod(F.xxhash64("v"), F.col("pieces"))).join(sets.withColumnRenamed("sig", "v"), "v").select("u", "piece", F.lit(False).alias("head"), "v", "text")
    heads = pieces.join(sets.withColumnRenamed("sig", "u"), "u").select("u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"), F.lit(True).alias("head"), F.col("u").alias("v"), "text")
    rows = members.unionByName(heads).repartition("u", "piece").sortWithinPartitions("u", "piece", F.desc("head"))
    return rows.select("u", "v", "head", "text").mapInPandas(check, "u long, v long")


def texts_by_class(needed: DataFrame) -> DataFrame:
    """(sig, text) of classes (sig, chunk, file, d), read from their chunk files; lower case."""

    def load(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, chunk = None, None
        for pdf in parts:
            out = []
            for sig, file, d in zip(pdf["sig"], pdf["file"], pdf["d"], strict=True):
                if file != now:
                    now, chunk = file, Chunk.load(file)
                out.append((sig, chunk.texts[d].translate(LOWER)))
            yield pd.DataFrame(out, columns=["sig", "text"])

    return needed.repartition("chunk").sortWithinPartitions("chunk", "d").select("sig", "file", "d").mapInPandas(load, "sig long, text binary")


def join_components(docs: DataFrame, percent: int = 80, k: int = 5, chunk_bytes: int = 1_500_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; component_id is the least id of its component."""
    table = documents(Corpus(docs, "ngram", chunk_bytes, id_col, text_col), k, percent)
    classes = stage(table.where("sketch is not null").dropDuplicates(["sig"]), "ngram-classes")
    shared = stage(sharing(classes), "ngram-shared")

    def links_of(pairs: DataFrame) -> DataFrame:
        pairs = stage(under_other_orders(possible_pairs(pairs, classes, percent), classes), "ngram-pairs")
        needed = pairs.select(F.col("u").alias("sig")).union(pairs.select(F.col("v").alias("sig"))).distinct()
        sets = stage(texts_by_class(classes.select("sig", "chunk", "file", "d").join(needed, "sig", "left_semi")), "ngram-sets")
        return stage(verified(pairs, sets, k, percent), "ngram-links")

    label = components(links_of(_pairs(shared, percent)))
    for last in (False, True):
        shared = stage(open_groups(shared, label), "ngram-open")
        if not shared.head(1):
            break
        more = links_of(cross_pairs(shared, classes, percent) if last else second_star_pairs(shared, percent))
        if more.head(1):
            label = components(more.union(label.select(F.col("node").alias("u"), F.col("label").alias("v"))))
    of = table.select("doc_id", "sig", "n").join(label.withColumnRenamed("node", "sig"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    least = of.where("n > 0").groupBy("label").agg(F.min(F.nullif("doc_id", F.lit(NULL_ID))).alias("least"))
    return restored(of.join(least, "label", "left")).select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
