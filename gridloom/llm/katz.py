"""Language-model scoring by Katz backoff (operator 8).

Model: bigrams over unigrams. Counts up to ``K`` are discounted by Good-Turing ratios; unigram
mass left over belongs to the unknown word; a history's mass left over is spread over the words not
seen after it, in proportion to their unigram probability:

    P(w | h) = d(c(h w)) c(h w) / c(h)                         if h w was seen
             = alpha(h) P(w),  alpha(h) = (1 - sum of the above) / (1 - sum of P(w) of w seen after h)

so every history's probabilities sum to 1 exactly. An unseen history has alpha 1; one that would
leave nothing over is counted once more than it occurs.

Execution: texts are cut into chunks of about ``tokens`` tokens, each written once as a file of the
shared folder (a retried task writes another name; only names that come back are used). A chunk asks
for the counts of its distinct words, packed by hash bucket; reducers add up the training counts of
all chunks and answer in the order of each question. With word counts at hand it asks for its
distinct bigrams, bucketed by history; a history that alone would exceed a bucket is salted by word
over as many buckets as its count needs, and its sums (at most one row a salted history and
bucket) are added afterwards. Nothing but these counts is shuffled, and nothing of corpus size is
broadcast.

Defined results: null and empty texts are the end token alone; null ids are training rows; rows that
repeat count as often as they occur; with no training rows every word is unknown.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, lowered, mix, restored, scratch, stage, texts_of, word_hashes
from .token_frames import _open

K = 5
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
#: Questions that a bucket takes, about; their number grows with the corpus.
QUESTIONS = 2_000_000
KINDS = ["<u8", "<i8", "<f8", "<u4", "|u1"]
ASK = "kind int, chunk long, file string, bucket int, ask binary, stats array<double>"
ANSWER = "kind int, chunk long, bucket int, answer binary, history long, stats array<double>"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
COLUMNS = ["kind", "chunk", "file", "bucket", "ask", "stats"]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string, bytes of like weight together."""
    import zstandard

    head = np.array([len(arrays)] + [x for a in arrays for x in (len(a), KINDS.index(a.dtype.str))], "<i8").tobytes()
    body = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() if len(a) else b"" for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head + body)


def unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    head, at, out = np.frombuffer(raw, "<i8", 2 * n, 8).reshape(n, 2).tolist(), 8 + 16 * n, []
    for size, kind in head:
        dtype = np.dtype(KINDS[kind])
        w = dtype.itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, size * w, at).reshape(w, size).T).view(dtype).ravel() if size else np.empty(0, dtype))
        at += size * w
    return out


def gaps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=np.uint64(0))


def discounts(of_count: np.ndarray) -> np.ndarray:
    """d[r] for r = 0..K+1 from numbers of types seen 1..K+1 times; d of any count above K is 1."""
    n = np.concatenate([[0.0], np.asarray(of_count, float)])
    d = np.ones(K + 2)
    if n[1] > 0 and (n[1:] > 0).all():
        cut = (K + 1) * n[K + 1] / n[1]
        r = np.arange(1, K + 1)
        with np.errstate(all="ignore"):
            d[1 : K + 1] = ((r + 1) * n[2:] / n[1 : K + 1] / r - cut) / (1 - cut)
    if not (np.isfinite(d).all() and (d[1 : K + 1] > 0).all() and (d[1 : K + 1] < 1).all()):  # too few types: absolute discounting
        cut = n[1] / (n[1] + 2 * n[2]) if n[1] > 0 and n[2] > 0 else 0.5
        d[1 : K + 1] = 1 - cut / np.arange(1, K + 1)
    return d


class Unigrams:
    """Discounted unigram probabilities from the table's totals."""

    def __init__(self, total: float, types: float, of_count: list[float]) -> None:
        self.total, self.types, self.d = total, types, discounts(np.array(of_count))
        n = np.asarray(of_count, float)[:K]
        left = (n * np.arange(1, K + 1) * (1 - self.d[1 : K + 1])).sum()
        self.unknown = float(left / total) if total and left > 0 else 1.0

    def p(self, c: np.ndarray) -> np.ndarray:
        if not self.total:
            return np.ones(len(c))
        return np.where(c > 0, self.d[np.minimum(c, K + 1).astype(np.int64)] * c / self.total, self.unknown)


class Chunk:
    """Texts of one chunk file as token streams."""

    def __init__(self, ids: np.ndarray, train: np.ndarray, texts: list[bytes], buckets: int) -> None:
        self.ids, self.train, self.buckets = ids, train, buckets
        parts = []
        for t in texts:
            parts += [word_hashes(t), np.array([END])]
        tokens = np.concatenate(parts)
        self.sizes = np.array([len(p) + 1 for p in parts[::2]])
        self.words, at = np.unique(tokens, return_inverse=True)
        self.token = at.astype(np.int64)
        self.doc = np.repeat(np.arange(len(ids)), self.sizes)
        self.weight = train[self.doc]

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.token, weights=self.weight, minlength=len(self.words)).astype(np.int64)

    def bigrams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (history, word) as numbers of words (len(words): a text's start), train counts, place of each token's."""
        first = np.cumsum(self.sizes) - self.sizes
        history = np.concatenate([[0], self.token[:-1]])
        history[first] = len(self.words)
        pair, at = np.unique(history * (len(self.words) + 1) + self.token, return_inverse=True)
        count = np.bincount(at, weights=self.weight, minlength=len(pair)).astype(np.int64)
        return pair // (len(self.words) + 1), pair % (len(self.words) + 1), count, at

    def save(self, uri: str, texts: list[bytes]) -> None:
        import zstandard

        system, path = _open(uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        sizes = np.array([len(t) for t in texts], "<i8")
        with system.open_output_stream(path, compression=None) as out:
            out.write(zstandard.ZstdCompressor(level=3).compress(np.array([len(texts)], "<i8").tobytes() + self.ids.astype("<i8").tobytes() + self.train.astype("<i8").tobytes() + sizes.tobytes() + b"".join(texts)))

    @staticmethod
    def load(uri: str, buckets: int) -> Chunk:
        import zstandard

        system, path = _open(uri)
        with system.open_input_file(path) as f:
            raw = zstandard.ZstdDecompressor().decompress(f.read())
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        ids, train, sizes = (np.frombuffer(raw, "<i8", n, 8 + 8 * n * k) for k in range(3))
        at, ends = 8 + 24 * n, np.cumsum(sizes)
        return Chunk(ids, train, [raw[at + e - s : at + e] for s, e in zip(sizes.tolist(), ends.tolist())], buckets)

    def ask_words(self) -> Iterator[tuple[int, bytes]]:
        bucket = (mix(self.words ^ np.uint64(0xC2B2AE3D27D4EB4F)) % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        count = self.word_counts()
        for b in range(self.buckets):
            k = order[ends[b] : ends[b + 1]]
            if len(k):
                yield b, pack(gaps(self.words[k]), count[k].astype("<u4"))

    def word_answers(self, answers: dict[int, bytes]) -> np.ndarray:
        """Corpus counts of self.words."""
        bucket = (mix(self.words ^ np.uint64(0xC2B2AE3D27D4EB4F)) % np.uint64(self.buckets)).astype(np.int64)
        out = np.zeros(len(self.words), np.int64)
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        for b, blob in answers.items():
            out[order[ends[b] : ends[b + 1]]] = unpack(blob)[0]
        return out

    def bigram_buckets(self, count: np.ndarray, starts: int, total: float) -> tuple:
        """The distinct bigrams, in the order of asking: (h, w, train count, place, bucket, salted)."""
        h, w, c, at = self.bigrams()
        names = np.append(self.words, START)
        often = np.append(count, starts)[h]
        pieces = np.maximum(1, -(-often * self.buckets // max(1, int(total)))).astype(np.uint64)
        piece = mix(names[w] ^ np.uint64(0x165667B19E3779F9)) % pieces
        bucket = (mix(names[h] + piece * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.buckets)).astype(np.int64)
        return h, w, c, at, bucket, pieces > 1, names

    def ask_bigrams(self, count: np.ndarray, starts: int, total: float) -> Iterator[tuple[int, bytes]]:
        h, w, c, _, bucket, salted, names = self.bigram_buckets(count, starts, total)
        order = np.lexsort((w, h, bucket))
        ends = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        for b in range(self.buckets):
            k = order[ends[b] : ends[b + 1]]
            if len(k):
                head, size = np.unique(h[k], return_counts=True)
                used, place = np.unique(w[k], return_inverse=True)  # names ascend with their numbers
                yield b, pack(names[head], size.astype("<u4"), salted[k][np.cumsum(size) - 1].astype("<u4"), gaps(self.words[used]), count[used].astype("<u4"), place.astype("<u4"), c[k].astype("<u4"))


def _grouped(parts: Iterator[pd.DataFrame], key: str) -> Iterator[tuple[int, list]]:
    """Rows by key, of partitions sorted by it."""
    now, rows = None, []
    for pdf in parts:
        for row in pdf.itertuples(index=False):
            k = getattr(row, key)
            if rows and k != now:
                yield now, rows
                rows = []
            now = k
            rows.append(row)
    if rows:
        yield now, rows


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns)


def _add_words(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b, rows in _grouped(parts, "bucket"):
        asked = [unpack(r.ask) for r in rows]
        keys = [np.cumsum(k, dtype=np.uint64) for k, _ in asked]
        name, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate([c for _, c in asked]).astype(float), minlength=len(name)).astype(np.int64)
        stats = [float(total.sum()), float((total > 0).sum()), *(float((total == r).sum()) for r in range(1, K + 2))]
        end = np.cumsum([len(k) for k in keys])
        out = [(1, r.chunk, b, pack(total[at[e - len(k) : e]]), 0, None) for r, k, e in zip(rows, keys, end)]
        yield _frame([*out, (2, 0, b, None, 0, stats)], ["kind", "chunk", "bucket", "answer", "history", "stats"])


def _add_bigrams(parts: Iterator[pd.DataFrame], unigrams: Unigrams) -> Iterator[pd.DataFrame]:
    for b, rows in _grouped(parts, "bucket"):
        asked = []
        for row in rows:
            head, size, hot, used, of, place, c = unpack(row.ask)
            asked.append((head, size, hot, np.cumsum(used, dtype=np.uint64)[place], c, of[place]))
        heads, at_h = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
        sizes, words = np.concatenate([a[1] for a in asked]), np.concatenate([a[3] for a in asked])
        count, of_word = np.concatenate([a[4] for a in asked]).astype(np.int64), np.concatenate([a[5] for a in asked]).astype(np.int64)
        h = np.repeat(at_h, sizes)
        salted = np.zeros(len(heads), bool)
        salted[at_h] = np.concatenate([a[2] for a in asked]) > 0
        order = np.lexsort((words, h))
        new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (words[order][1:] != words[order][:-1])])
        group = np.empty(len(h), np.int64)
        group[order] = np.cumsum(new) - 1
        total = np.bincount(group, weights=count).astype(np.int64)
        one = order[new]  # a row of each distinct bigram
        seen = total > 0
        owner, r = h[one][seen], total[seen]
        table = np.zeros((len(heads), K + 2))  # types seen 1..K times, tokens of the others, unigram mass
        for k in range(1, K + 1):
            table[:, k - 1] = np.bincount(owner[r == k], minlength=len(heads))
        table[:, K] = np.bincount(owner[r > K], weights=r[r > K], minlength=len(heads))
        table[:, K + 1] = np.bincount(owner, weights=unigrams.p(of_word[one][seen]), minlength=len(heads))
        out = [(2, 0, b, None, 0, [float((r == k).sum()) for k in range(1, K + 2)])]
        out += [(3, 0, b, None, int(heads[i].view(np.int64)), table[i].tolist()) for i in np.flatnonzero(salted)]
        x = y = 0
        for row, a in zip(rows, asked):
            mine = at_h[x : x + len(a[0])]
            out.append((1, row.chunk, b, pack(total[group[y : y + len(a[3])]].astype("<u4"), *(table[mine, k].astype("<u4") for k in range(K + 1)), table[mine, K + 1]), 0, None))
            x, y = x + len(a[0]), y + len(a[3])
        yield _frame(out, ["kind", "chunk", "bucket", "answer", "history", "stats"])


def _scores(chunk: Chunk, word_answers: dict[int, bytes], bigram_answers: dict[int, bytes], unigrams: Unigrams, d: np.ndarray, starts: int, hot: dict[int, list[float]]) -> pd.DataFrame:
    count = chunk.word_answers(word_answers)
    h, w, _, at, bucket, salted, names = chunk.bigram_buckets(count, starts, unigrams.total)
    order = np.lexsort((w, h, bucket))
    ends = np.searchsorted(bucket[order], np.arange(chunk.buckets + 1))
    seen, table = np.zeros(len(h), np.int64), np.zeros((len(names), K + 2))
    for b, blob in bigram_answers.items():
        k = order[ends[b] : ends[b + 1]]
        parts = unpack(blob)
        seen[k] = parts[0]
        table[np.unique(h[k])] = np.column_stack([p.astype(float) for p in parts[1:]])
    for i in np.unique(h[salted]):
        table[i] = hot.get(int(names[i].view(np.int64)), [0.0] * (K + 2))
    r = np.arange(1, K + 1)
    c_h = (table[:, :K] * r).sum(axis=1) + table[:, K]
    kept = (table[:, :K] * r * d[1 : K + 1]).sum(axis=1) + table[:, K]
    full = (c_h > 0) & (kept > c_h * (1 - 1e-9))  # nothing would be left over
    below = np.maximum(c_h + full, 1)
    mass = np.maximum(1 - table[:, K + 1], 1e-12)
    alpha = np.where(c_h > 0, (1 - kept / below) / mass, 1.0)
    p_w = unigrams.p(count)
    p = np.where(seen > 0, d[np.minimum(seen, K + 1)] * seen / below[h], alpha[h] * p_w[w])
    doc, n = chunk.doc, len(chunk.ids)
    base = np.log10((count + 1) / (unigrams.total + unigrams.types + 1))
    add = lambda x: np.bincount(doc, weights=x, minlength=n)
    return pd.DataFrame({
        "doc_id": chunk.ids, "held_out": chunk.train == 0, "n_tokens": chunk.sizes.astype(np.int64), "n_known": add((count > 0)[chunk.token].astype(float)).astype(np.int64),
        "train_tokens": np.full(n, int(unigrams.total)), "base_score": add(base[chunk.token]), "score": add(np.log10(p)[at]),
    })


def score(docs: DataFrame, hold_out: tuple[int, int] = (7, 2), tokens: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Log10 probabilities of all texts under a model of those whose crc32(id as text) modulo hold_out[0] isn't hold_out[1]."""
    spark = docs.sparkSession
    folder = scratch(spark, "katz-chunks")
    remainder = F.crc32(F.nullif("doc_id", F.lit(NULL_ID)).cast("string").cast("binary")) % hold_out[0]
    size = texts_of(docs, id_col, text_col).agg(F.sum(F.octet_length("text").cast("double"))).first()[0] or 0
    buckets = max(16, int(size / 9 / QUESTIONS) + 1)
    rows = texts_of(docs, id_col, text_col).withColumn("train", F.coalesce(remainder != hold_out[1], F.lit(True)).cast("long"))

    def split(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def out() -> pd.DataFrame:
            name, number = f"{folder}/{uuid.uuid4().hex}", uuid.uuid4().int >> 65
            chunk = Chunk(np.array(ids, np.int64), np.array(train, np.int64), texts, buckets)
            chunk.save(name, texts)
            return _frame([(0, number, name, 0, None, [float(chunk.train.sum())])] + [(1, number, None, b, blob, None) for b, blob in chunk.ask_words()], COLUMNS)

        ids, train, texts, held = [], [], [], 0
        for pdf in parts:
            for i, t, text in zip(pdf["doc_id"], pdf["train"], pdf["text"], strict=True):
                ids.append(i)
                train.append(t)
                texts.append(lowered(text))
                held += len(texts[-1])
                if held > 6 * tokens:
                    yield out()
                    ids, train, texts, held = [], [], [], 0
        if ids:
            yield out()

    asked = stage(rows.mapInPandas(split, ASK), "katz-ask")
    chunks = asked.where("kind = 0").select("chunk", "file")
    n_chunks, starts = chunks.count(), int(asked.where("kind = 0").agg(F.sum(F.element_at("stats", 1))).first()[0] or 0)
    # task counts of their own: rows are few and small, what they stand for isn't, so none may be put together by size
    by_bucket = lambda df: df.where("kind = 1").select("chunk", "bucket", "ask").repartition(2 * buckets, "bucket").sortWithinPartitions("bucket")
    words = stage(by_bucket(asked).mapInPandas(_add_words, ANSWER), "katz-words")
    sums = words.where("kind = 2").select(*[F.sum(F.element_at("stats", i + 1)) for i in range(K + 3)]).first()
    unigrams = Unigrams(*(float(sums[i] or 0) for i in range(2)), [float(s or 0) for s in sums[2:]])

    def together(answers: DataFrame) -> DataFrame:
        """Chunk rows first, then their answers, a chunk's rows in one task."""
        files = chunks.select("chunk", "file", F.lit(0).alias("kind"), F.lit(0).alias("bucket"), F.lit(None).cast("binary").alias("answer"))
        return files.unionByName(answers.select("chunk", F.lit(None).cast("string").alias("file"), "kind", "bucket", "answer")).repartition(max(1, n_chunks), "chunk").sortWithinPartitions("chunk", "kind")

    total = unigrams.total

    def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for number, got in _grouped(parts, "chunk"):
            chunk = Chunk.load(got[0].file, buckets)
            count = chunk.word_answers({r.bucket: r.answer for r in got[1:]})
            yield _frame([(1, number, None, b, blob, None) for b, blob in chunk.ask_bigrams(count, starts, total)], COLUMNS)

    questions = together(words.where("kind = 1")).mapInPandas(ask, ASK)
    pairs = stage(by_bucket(questions).mapInPandas(lambda parts: _add_bigrams(parts, unigrams), ANSWER), "katz-bigrams")
    sums = pairs.where("kind = 2").select(*[F.sum(F.element_at("stats", i + 1)) for i in range(K + 1)]).first()
    d = discounts(np.array([float(s or 0) for s in sums]))
    hot_rows = pairs.where("kind = 3").groupBy("history").agg(*[F.sum(F.element_at("stats", i + 1)).alias(f"s{i}") for i in range(K + 2)]).collect()  # histories above a bucket's share: at most one a bucket
    shared = spark.sparkContext.broadcast({r["history"]: [r[f"s{i}"] for i in range(K + 2)] for r in hot_rows})

    def rate(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, got in _grouped(parts, "chunk"):
            yield _scores(Chunk.load(got[0].file, buckets), {r.bucket: r.answer for r in got if r.kind == 1}, {r.bucket: r.answer for r in got if r.kind == 4}, unigrams, d, starts, shared.value)

    answers = words.where("kind = 1").select("chunk", "kind", "bucket", "answer").unionByName(pairs.where("kind = 1").select("chunk", F.lit(4).alias("kind"), "bucket", "answer"))
    return restored(together(answers).mapInPandas(rate, SCORES))


def op8_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
