"""What several operators share: scratch tables, tokenizing, and hashing of whole texts with numpy."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper case A-Z to lower case, bytewise; no other character changes.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: What ends a word: blank and \t \n \v \f \r.
SPACES = (32, 9, 10, 11, 12, 13)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
#: ASCII letters 1, digits 2, what else is printed but no apostrophe 3.
KIND = np.array([1 if chr(c).isalpha() else 2 if chr(c).isdigit() else 3 if 32 < c < 127 and c != 39 else 0 for c in range(128)] + [0] * 128, np.uint8)
WORD = re.compile(r"[^\x20\x09-\x0D]+")

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1


_OWN: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's URI below spark.checkpoint.dir, which driver and executors share.

    Only where that is unset and all runs in one process, as in tests, a temporary folder stands in.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="spark-ckpt-"))
        base = _OWN[0]
    if "://" not in base and base.startswith("/"):
        base = spark.conf.get("spark.hadoop.fs.defaultFS", "file://").rstrip("/") + base
    return f"{base.rstrip('/')}/llm/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes a table to the shared folder and reads it again, which cuts lineage safely."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of long texts that go to a Python worker at once, whatever the session's batch size for narrow rows.
ROWS_AT_ONCE = 1000


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of whole texts small, so that workers' memory stays bounded."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ROWS_AT_ONCE:
        spark.conf.set(key, str(ROWS_AT_ONCE))


#: Stands for a null id inside operators, as pandas has no null in a column of integers; it sorts first.
NULL_ID = -(1 << 63)


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with null texts as empty ones; other columns, whatever their names, don't pass."""
    small_batches(docs.sparkSession)
    return docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores after it as long as the table has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def restored(df: DataFrame, column: str = "doc_id") -> DataFrame:
    """Null ids again."""
    return df.withColumn(column, F.nullif(F.col(column), F.lit(NULL_ID)))


def discard(df: DataFrame) -> None:
    """Deletes a staged table that no later plan reads."""
    files = df.inputFiles()
    if files:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(files[0].rpartition("/")[0])
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


# --- hashing ------------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 over an array of uint64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the polynomial base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n + n // 8, 1 << 16)
            inverse = pow(_BASE, -1, 1 << 64)
            for name, base in (("up", _BASE), ("down", inverse)):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        return self.up[:n], self.down[:n]


POWERS = _Powers()


def rest() -> None:
    """Gives memory back at a task's end, as the worker may have other work next, and a neighbour in the same executor."""
    import ctypes

    import pyarrow as pa

    if len(POWERS.up) > 1 << 18:
        POWERS.__init__()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h with h[j] - h[i] = hash of data[i:j] times base**i (modulo 2**64); len(data) + 1 entries."""
    up, _ = POWERS.get(len(data) + 1)
    h = np.zeros(len(data) + 1, np.uint64)
    h[1:] = data
    h[1:] += np.uint64(1)
    h[1:] *= up[: len(data)]
    return np.cumsum(h, out=h)


def window_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for many windows at once."""
    _, down = POWERS.get(len(h))
    return mix((h[end] - h[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in an array of bytes."""
    space = np.empty(len(data) + 2, bool)
    space[0] = space[-1] = True
    space[1:-1] = IS_SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1])
    return edge[::2], edge[1::2]


def lowered(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(LOWER)


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text."""
    data = np.frombuffer(raw, np.uint8)
    s, e = word_spans(data)
    return window_hash(prefix_hash(data), s, e) if len(s) else np.empty(0, np.uint64)


def shingle_hashes(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words make one, none make none."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    k = min(k, n)
    out = np.full(n - k + 1, np.uint64(k), np.uint64)
    for j in range(k):
        out = mix(out * np.uint64(0x100000001B3) + words[j : n - k + 1 + j])
    return np.unique(out)


# --- tokenizing ---------------------------------------------------------------------------------


class WordwiseTokenizer:
    """A tokenizer file's own ids for whole texts, each distinct piece between blanks encoded once and kept.

    Both kinds of vocabulary split at white space before they merge, so the ids of a text are those of
    its pieces in turn: for ``"words"`` pieces between white space, for ``"bytes"`` a piece with the one
    blank before it, and runs of white space. Both also split where ASCII letters, digits and marks other
    than apostrophes meet, so a word with a comma is two pieces. Pieces are found, hashed (64 bits) and looked up for a
    whole batch at once; only distinct new ones go to the library. Texts with other white space than
    ASCII's, control characters or a special token's string are encoded by the library whole.
    """

    #: Pieces kept a worker: about 25 bytes each.
    LIMIT = 1_500_000
    #: White space of more than a byte, in UTF-8: the lead, and what may follow it.
    WIDE = {0xC2: (b"\x85", b"\xa0"), 0xE1: (b"\x9a\x80", b"\xa0\x8e"), 0xE3: (b"\x80\x80",), 0xE2: (*(bytes([0x80, c]) for c in (*range(0x80, 0x8C), 0xA8, 0xA9, 0xAF)), b"\x81\x9f")}
    #: What stands between new pieces that are encoded in one call; pieces that hold it go alone.
    BETWEEN = {"words": (" | ", "|"), "bytes": ("\n", "\n")}
    END = 0xFF

    def __init__(self, path: str, kind: str) -> None:
        from tokenizers import Tokenizer

        self.lib, self.kind = Tokenizer.from_file(path), kind
        self.lib.no_padding()
        self.lib.no_truncation()
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.glue, self.mark = self.BETWEEN[kind]
        (self.mark_id,) = self.lib.encode(self.glue, add_special_tokens=False).ids
        self.dtype = np.dtype("<u2") if self.lib.get_vocab_size() <= 65_536 else np.dtype("<u4")
        self._empty()

    def _empty(self) -> None:
        self.keys, self.at, self.size = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.met, self.pool, self.used = np.empty(0, bool), np.empty(1 << 16, self.dtype), 0

    def _plain(self, text: str) -> bytes | None:
        """The bytes to cut into pieces, or None for a text that goes to the library whole."""
        low = text.lower() if self.kind == "words" and text.isascii() else text  # as the vocabulary does
        if any(s in text or s in low for s in self.special):
            return None
        return low.encode("utf-8", "surrogatepass")

    def _odd(self, data: np.ndarray) -> np.ndarray:
        """Positions of control characters that some call white space, and of wide white space."""
        found = [np.flatnonzero((data >= 0x1C) & (data < 0x20))]
        for lead, tails in self.WIDE.items():
            at = np.flatnonzero(data == lead)
            if len(at):
                one, two = data[at + 1], data[np.minimum(at + 2, len(data) - 1)]
                hit = np.zeros(len(at), bool)
                for t in tails:
                    hit |= (one == t[0]) if len(t) == 1 else (one == t[0]) & (two == t[1])
                found.append(at[hit])
        return np.concatenate(found)

    def _spans(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pieces of texts that each end with END."""
        if not len(data):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        space, end, kind = IS_SPACE[data], data == self.END, KIND[data]
        cut = end.copy()  # texts begin after an END
        cut[0] = True
        cut[1:] |= end[:-1] | (space[1:] & ~space[:-1])
        cut[1:] |= (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
        if self.kind == "words":
            cut[1:] |= space[:-1] & ~space[1:]
            real = ~(space | end)
        else:
            cut[:-1] |= space[:-1] & ~space[1:] & ~end[1:]  # the last of a run stands with the word or alone
            cut[1:] |= ~space[1:] & space[:-1] & (data[:-1] != 32)
            real = ~end
        start = np.flatnonzero(cut)
        stop, real = np.append(start[1:], len(data)), real[start]
        return start[real], stop[real]

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, self.dtype) for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        """Encodes new distinct pieces, most of them glued together, and files their ids."""
        size, parts = np.zeros(len(pieces), np.int64), []
        alone = [i for i, p in enumerate(pieces) if self.mark in p or p.isspace()]
        apart = set(alone)
        rest = [i for i in range(len(pieces)) if i not in apart] if apart else list(range(len(pieces)))
        order = np.array(alone + rest, np.int64)
        if alone:
            got = self._library([pieces[i] for i in alone])
            size[alone] = [len(g) for g in got]
            parts += got
        for a in range(0, len(rest), 2048):
            mine = rest[a : a + 2048]
            ids = np.asarray(self.lib.encode_batch_fast([self.glue.join([pieces[i] for i in mine])], add_special_tokens=False)[0].ids, self.dtype)
            cut = np.flatnonzero(ids == self.mark_id)
            if len(cut) != len(mine) - 1:
                raise ValueError("pieces that don't come apart again")
            size[mine] = np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1
            parts.append(np.delete(ids, cut))
        new = np.concatenate(parts)
        while self.used + len(new) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        self.pool[self.used : self.used + len(new)] = new
        at = np.empty(len(pieces), np.int64)
        at[order] = self.used + np.cumsum(size[order]) - size[order]
        self.used += len(new)
        where = np.searchsorted(self.keys, keys)
        for name, value in (("keys", keys), ("at", at), ("size", size), ("met", False)):
            setattr(self, name, np.insert(getattr(self, name), where, value))

    def _shrink(self) -> None:
        """Only pieces that several batches held stay."""
        keep = np.flatnonzero(self.met)
        if len(keep) > self.LIMIT // 2:
            return self._empty()
        ids, size = self._gather(keep), self.size[keep]
        self.keys, self.size, self.at = self.keys[keep], size, np.cumsum(size) - size
        self.met, self.pool, self.used = np.zeros(len(keep), bool), np.concatenate([ids, np.empty(1 << 16, self.dtype)]), len(ids)

    def _gather(self, k: np.ndarray) -> np.ndarray:
        size = self.size[k]
        end = np.cumsum(size)
        return self.pool[np.repeat(self.at[k] - (end - size), size) + np.arange(end[-1] if len(end) else 0)]

    def rest(self) -> None:
        """Between tasks fewer pieces stay."""
        if len(self.keys) > self.LIMIT // 2:
            self._shrink()
        rest()

    def encode_ended(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As encode_flat, with an end id after each text's own."""
        if not texts:
            return np.empty(0, self.dtype), np.empty(0, np.int64)
        ids, ends = self.encode_flat(texts)
        return np.insert(ids, ends, np.array(end_id, self.dtype)), ends + np.arange(1, len(ends) + 1)

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's end."""
        raw = [self._plain(t) for t in texts]
        data = np.frombuffer(b"".join(r + b"\xff" for r in raw if r is not None), np.uint8)
        close = np.flatnonzero(data == self.END)
        plain = [i for i, r in enumerate(raw) if r is not None]
        odd = {plain[i] for i in np.unique(np.searchsorted(close, self._odd(data))).tolist()}
        if odd:  # once more without them
            plain = [i for i in plain if i not in odd]
            data = np.frombuffer(b"".join(raw[i] + b"\xff" for i in plain), np.uint8)
            close = np.flatnonzero(data == self.END)
        start, stop = self._spans(data)
        hashed = window_hash(prefix_hash(data), start, stop) if len(start) else np.empty(0, np.uint64)
        distinct, first, inverse = np.unique(hashed, return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > self.LIMIT:
            self._shrink()
        k = np.minimum(np.searchsorted(self.keys, distinct), max(len(self.keys) - 1, 0))
        new = self.keys[k] != distinct if len(self.keys) else np.ones(len(distinct), bool)
        self.met[k[~new]] = True
        if new.any():
            whole = data.tobytes()
            self._learn(distinct[new], [whole[a:b].decode("utf-8", "surrogatepass") for a, b in zip(start[first[new]].tolist(), stop[first[new]].tolist())])
            k = np.searchsorted(self.keys, distinct)
        k = k[inverse]
        ids = self._gather(k)
        upto = np.concatenate([[0], np.cumsum(self.size[k])])[np.searchsorted(start, close)]
        if len(plain) == len(texts):
            return ids, upto
        others = [i for i in range(len(texts)) if raw[i] is None or i in odd]
        got: dict[int, np.ndarray] = dict(zip(others, self._library([texts[i] for i in others])))
        got |= {i: ids[a:b] for i, a, b in zip(plain, [0, *upto[:-1].tolist()], upto.tolist())}
        parts = [got[i] for i in range(len(texts))]
        return np.concatenate(parts), np.cumsum([len(p) for p in parts])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        ids, ends = self.encode_flat(texts)
        return np.split(ids, ends[:-1])


_TOKENIZERS: dict[tuple[str, str], WordwiseTokenizer] = {}


def tokenizer(path: str, kind: str) -> WordwiseTokenizer:
    """One per Python worker."""
    if (path, kind) not in _TOKENIZERS:
        _TOKENIZERS[path, kind] = WordwiseTokenizer(path, kind)
    return _TOKENIZERS[path, kind]


def batches(texts, chars: int = 600_000):
    """Index ranges of about so many characters; a longer text stands alone."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > chars:
            yield start, i
            start, size = i, 0
        size += len(t)
    if len(texts) > start:
        yield start, len(texts)
