"""Chunk files of texts, and questions about which hashes occur again anywhere in the corpus.

Some operators must know of a great many hashes whether they occur once in the corpus or more often. As rows
they would outweigh the texts, so they travel packed: texts are written once in chunk files of the shared
folder; a chunk's distinct hashes, sorted, go as gaps to buckets that are ranges of hashes; a bucket's task
sorts what it got, so equal hashes of all chunks are neighbours, and answers each chunk with a byte a hash.
A hash that a third of all rows share is one entry a chunk. Answers come back in the order asked, and are
joined with the chunk's file by the chunk's number.

A chunk's number and file name are drawn by the task that writes it; only those that came back with a
finished task are used, so a lost executor leaves at most an unused file. A document is in one chunk.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, rest, scratch, stage, texts_of
from .katz import gaps, pack, unpack
from .token_frames import _open

#: kind 0: a chunk's file, with what an operator keeps of it; kind 1: a question; kind 2: its answer.
ROWS = "kind int, chunk long, file string, bucket int, blob binary"
COLUMNS = ["kind", "chunk", "file", "bucket", "blob"]
#: Hashes that a bucket's task is to hold, about.
ENTRIES = 500_000
#: An answer's bits: how often the hash occurs (0: once, 1: up to 8 times, 2: up to 64, 3: more), whether the asking chunk
#: is the first with it, and whether anyone asked with a flag.
OFTEN, FIRST, FLAGGED = 3, 4, 8


class Chunk:
    """Documents of a chunk file: ids, and the bytes of their texts in a row."""

    def __init__(self, ids: np.ndarray, texts: list[bytes]) -> None:
        self.ids, self.texts = ids, texts
        self.size = np.array([len(t) for t in texts], np.int64)
        self.end = np.cumsum(self.size)
        self.start = self.end - self.size
        self.data = np.frombuffer(b"".join(texts), np.uint8)

    def save(self, uri: str) -> None:
        import zstandard

        system, path = _open(uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        head = pack(self.ids.astype("<i8"), self.size.astype("<i8"))
        with system.open_output_stream(path, compression=None) as out:
            out.write(len(head).to_bytes(8, "little") + head + zstandard.ZstdCompressor(level=3).compress(self.data.tobytes()))

    @staticmethod
    def load(uri: str) -> Chunk:
        import zstandard

        system, path = _open(uri)
        with system.open_input_file(path) as f:
            raw = f.read()
        n = int.from_bytes(raw[:8], "little")
        ids, sizes = unpack(raw[8 : 8 + n])
        body = zstandard.ZstdDecompressor().decompress(raw[8 + n :]) if sizes.sum() else b""
        ends = np.cumsum(sizes).tolist()
        return Chunk(ids, [body[a:b] for a, b in pairwise([0, *ends])])


def question(number: int, keys: np.ndarray, buckets: int, bits: int = 64, flags: np.ndarray | None = None) -> pd.DataFrame:
    """Rows that ask how often hashes occur; hashes count by their leading bits and as often as they are given."""
    distinct, inverse, count = np.unique(keys >> np.uint64(64 - bits), return_inverse=True, return_counts=True)
    flagged = np.zeros(len(distinct), np.uint8)
    if flags is not None:
        flagged[inverse[flags]] = 1
    bucket = ((distinct >> np.uint64(bits - 32)) * np.uint64(buckets)) >> np.uint64(32)
    ends = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
    rows = []
    for b in np.flatnonzero(np.diff(ends)).tolist():
        x, y = ends[b], ends[b + 1]
        rows.append((1, number, None, b, pack(gaps(distinct[x:y]), np.minimum(count[x:y], 100).astype(np.uint8), flagged[x:y])))
    return pd.DataFrame(rows, columns=COLUMNS)


def answered(keys: np.ndarray, reply: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(answer of each hash as it was asked, whether it is the chunk's first of its kind)."""
    _, first, inverse = np.unique(keys >> np.uint64(64 - bits), return_index=True, return_inverse=True)
    lead = np.zeros(len(keys), bool)
    lead[first] = True
    return reply[inverse] if len(keys) else np.empty(0, np.uint8), lead


def _answer(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    now, rows = None, []

    def answers() -> pd.DataFrame:
        asked = [unpack(blob) for _, blob in rows]
        keys = np.concatenate([np.cumsum(k, dtype=np.uint64) for k, _, _ in asked])
        order = np.argsort(keys, kind="stable")  # chunks in order of their number within equal hashes
        ordered = keys[order]
        head = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        group = np.cumsum(head) - 1
        total = np.bincount(group, weights=np.concatenate([c for _, c, _ in asked])[order])
        flagged = np.bincount(group, weights=np.concatenate([f for _, _, f in asked])[order]) > 0
        value = (np.searchsorted([1, 8, 64], total) + FLAGGED * flagged).astype(np.uint8)
        out = np.empty(len(keys), np.uint8)
        out[order] = value[group] + FIRST * head.astype(np.uint8)
        ends = np.cumsum([len(k) for k, _, _ in asked])
        return pd.DataFrame({"kind": 2, "chunk": [c for c, _ in rows], "file": None, "bucket": now, "blob": [pack(out[e - len(k) : e]) for (k, _, _), e in zip(asked, ends)]})

    for pdf in parts:
        for chunk, bucket, blob in zip(pdf["chunk"], pdf["bucket"], pdf["blob"], strict=True):
            if rows and bucket != now:
                yield answers()
                rows = []
            now = bucket
            rows.append((chunk, blob))
    if rows:
        yield answers()
    rest()


def _by_chunk(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[int, str, bytes | None, np.ndarray]]:
    """(number, file, what is kept, answers in the order asked) of chunks whose rows come sorted by chunk, kind and bucket."""
    number, file, kept, replies = None, None, None, []
    for pdf in parts:
        for kind, chunk, name, blob in zip(pdf["kind"], pdf["chunk"], pdf["file"], pdf["blob"], strict=True):
            if chunk != number:
                if number is not None:
                    yield number, file, kept, np.concatenate([np.empty(0, np.uint8), *replies])
                number, replies = chunk, []
            if kind == 0:
                file, kept = name, blob
            else:
                replies.append(unpack(blob)[0])
    if number is not None:
        yield number, file, kept, np.concatenate([np.empty(0, np.uint8), *replies])


class Corpus:
    """Texts in chunk files, and rounds of questions about them."""

    def __init__(self, docs: DataFrame, name: str, chunk_bytes: int, id_col: str, text_col: str) -> None:
        self.spark, self.name, self.chunk_bytes = docs.sparkSession, name, chunk_bytes
        self.texts, self.folder = texts_of(docs, id_col, text_col), scratch(docs.sparkSession, f"{name}-chunks")
        self.bytes = int(self.texts.agg(F.sum(F.octet_length("text").cast("double"))).first()[0] or 0)
        self.tasks = max(1, min(self.bytes // (2 * chunk_bytes) + 1, 20_000))  # the rows are few, the files behind them are not

    def buckets(self, entries: float) -> int:
        return max(16, int(entries / ENTRIES) + 1)

    def begin(self, ask: Callable[[int, Chunk], pd.DataFrame]) -> DataFrame:
        """Writes the chunk files; the stored table has a row a file and the first questions."""
        folder, chunk_bytes = self.folder, self.chunk_bytes

        def split(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            def out() -> Iterator[pd.DataFrame]:
                name, number = f"{folder}/{uuid.uuid4().hex}", uuid.uuid4().int >> 65
                chunk = Chunk(np.array(ids, np.int64), held)
                chunk.save(name)
                yield pd.DataFrame([(0, number, name, 0, None)], columns=COLUMNS)
                yield ask(number, chunk)

            ids, held, total = [], [], 0
            for pdf in parts:
                for i, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                    ids.append(i)
                    held.append(text.encode("utf-8", "surrogatepass"))
                    total += len(held[-1])
                    if total > chunk_bytes:
                        yield from out()
                        ids, held, total = [], [], 0
            if ids:
                yield from out()
            rest()

        return stage(self.texts.mapInPandas(split, ROWS), f"{self.name}-asked")

    def answers(self, asked: DataFrame, buckets: int) -> DataFrame:
        """The stored table with files (kind 0) and answers (kind 2) instead of questions, which are deleted."""
        replies = asked.where("kind = 1").repartition(max(8, min(buckets // 2, 20_000)), "bucket").sortWithinPartitions("bucket", "chunk").mapInPandas(_answer, ROWS)
        table = stage(asked.where("kind = 0").unionByName(replies), f"{self.name}-answers")
        discard(asked)
        return table

    def each(self, table: DataFrame, run: Callable[[int, str, bytes | None, np.ndarray], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
        """A job over chunks: run(number, file, kept, answers)."""

        def go(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for item in _by_chunk(parts):
                yield from run(*item)
            rest()

        return table.repartition(self.tasks, "chunk").sortWithinPartitions("chunk", "kind", "bucket").mapInPandas(go, schema)

    def again(self, table: DataFrame, run: Callable[[int, str, bytes | None, np.ndarray], Iterator[pd.DataFrame]]) -> DataFrame:
        """The next round's questions, stored; the last round's answers are deleted."""
        asked = stage(self.each(table, run, ROWS), f"{self.name}-asked")
        discard(table)
        return asked
