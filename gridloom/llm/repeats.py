"""Removal of repeated byte strings by a distributed difference-cover algorithm (operator 4).

Every byte that a string of ``length`` bytes covers goes if that string also starts anywhere else. Positions of a
document whose remainder is in a perfect difference set are sampled (12 of 133 remainders for 200 bytes): any two
positions i and j have one offset l < 133 at which i + l and j + l are both sampled, so of two equal strings at least
68 equal bytes follow sampled positions of both.

1. Sampled suffixes are named by their first ``gram`` = length - 132 bytes. Names are sorted by ranges of names over
   the whole corpus and neighbours compared; a suffix whose name has no equal neighbour shares no string and goes.
2. Recursion on names: what is left is named by all that its strings can hold, from 133 bytes before it (the sampled
   suffix before it in its class) to ``length`` after it. Again sorted; where a name has an equal neighbour all strings
   around the suffix repeat, and one suffix stands for them all from here on.
3. Remaining suffixes, those that aren't sampled: the string l bytes before a sampled suffix is (l bytes, that suffix).
   Those with l <= 66 share the suffix's first 134 bytes, the others the 134 bytes from 66 before it, so these two
   names, sorted, tell which of them can repeat, and which of the suffixes that stand for others they could meet.
4. These strings (at the edges of repeats) are named whole, sorted, and adjacent names compared.

So no pairs are made, and a group of any size costs a name a member. Names are 64-bit hashes of the bytes that they
stand for (filters use their leading bits), hence sorted order is that of the hashes: that changes which names are
neighbours of unequal ones, not which are equal. Names of 64 bits are taken for the strings. They travel packed (chunks.py).

Defined results: null and empty texts have no bytes; texts below ``length`` lose nothing; repeated rows are documents
that repeat each other; matches never cross documents; null ids are kept; extra columns are ignored; an empty table
has no rows. A document is held in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import COLUMNS, FIRST, FLAGGED, OFTEN, Chunk, Corpus, answered, question
from .common import mix, prefix_hash, restored, window_hash
from .katz import pack, unpack

#: Perfect difference sets, modulus and residues; every difference but 0 occurs once.
COVERS = {133: (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109), 57: (0, 1, 3, 13, 32, 36, 43, 52), 31: (0, 1, 3, 8, 12, 18), 13: (0, 1, 3, 9)}
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:long,end:long>>"


def _runs(mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of a mask."""
    step = np.diff(mark.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _marked(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the ranges."""
    ok = start < end
    edge = np.bincount(start[ok], minlength=n + 1) - np.bincount(end[ok], minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


class Suffixes:
    """Sampled suffixes of a chunk's documents, and names of strings around them."""

    def __init__(self, chunk: Chunk, length: int) -> None:
        self.chunk, self.length, self.n = chunk, length, len(chunk.data)
        self.modulus = max(v for v in COVERS if 3 * v <= 2 * length)
        self.gram, self.mid = length - self.modulus + 1, (self.modulus - 1) // 2
        in_cover = np.zeros(self.modulus, bool)
        in_cover[list(COVERS[self.modulus])] = True
        size = np.where(chunk.size < length, 0, chunk.size)
        doc = np.repeat(np.arange(len(size), dtype=np.int32), size)
        within = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
        keep = in_cover[within % self.modulus] & (within + self.gram <= chunk.size[doc])
        doc, within = doc[keep], within[keep]
        self.low, self.high = chunk.start[doc], chunk.end[doc]
        self.at = self.low + within
        self.h = prefix_hash(chunk.data)

    def only(self, keep: np.ndarray) -> None:
        self.at, self.low, self.high = self.at[keep], self.low[keep], self.high[keep]

    def names(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return window_hash(self.h, start, end)

    def grams(self) -> np.ndarray:
        return self.names(self.at, self.at + self.gram)

    def around(self) -> np.ndarray:
        """Names of suffixes with what stands before them; where a document's ends cut them short, the suffix's place in them counts."""
        begin = np.maximum(self.low, self.at - self.modulus)
        return mix(self.names(begin, np.minimum(self.high, self.at + self.length)) + (self.at - begin).astype(np.uint64))

    def windows_around(self) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the strings that lie within what ``around`` names."""
        return np.maximum(self.low, self.at - self.modulus), np.minimum(self.at, self.high - self.length) + 1

    def halves(self) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Ranges of the strings that begin at most ``mid`` bytes before a suffix, and of those from there on."""
        last = self.high - self.length
        return (np.maximum(self.low, self.at - self.mid), np.minimum(self.at, last) + 1), (np.maximum(self.low, self.at - self.modulus + 1), np.minimum(self.at - self.mid, last) + 1)

    def half_names(self, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Names of the first halves of suffixes ``near`` and then of the others of suffixes ``far``."""
        a, b = self.at[near], self.at[far]
        return np.concatenate([self.names(a, a + self.length - self.mid), self.names(b - self.mid, b + self.gram) ^ np.uint64(0x9E3779B97F4A7C15)])


def _bits(mask: np.ndarray) -> np.ndarray:
    return np.packbits(mask)


def _mask(bits: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(bits, count=n).astype(bool)


def _frames(number: int, file: str, kept: bytes, asked: pd.DataFrame) -> Iterator[pd.DataFrame]:
    yield pd.DataFrame([(0, number, file, 0, kept)], columns=COLUMNS)
    yield asked


def remove_repeats(docs: DataFrame, length: int = 200, chunk_bytes: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, spans) of every row."""
    if 2 * length < 3 * min(COVERS):
        raise ValueError(f"strings of at least {-(-3 * min(COVERS) // 2)} bytes")
    corpus = Corpus(docs, "repeats", chunk_bytes, id_col, text_col)
    entries = corpus.bytes * 0.1 + 1
    buckets, short = corpus.buckets(entries), max(32, min(64, int(np.log2(entries)) + 10))

    def grams(number: int, chunk: Chunk) -> pd.DataFrame:
        return question(number, Suffixes(chunk, length).grams(), buckets, short)

    def surroundings(number: int, file: str, kept: bytes | None, reply: np.ndarray) -> Iterator[pd.DataFrame]:
        s = Suffixes(Chunk.load(file), length)
        again = (answered(s.grams(), reply, short)[0] & OFTEN) > 0
        s.only(again)
        yield from _frames(number, file, pack(_bits(again)), question(number, s.around(), buckets))

    def halves(number: int, file: str, kept: bytes | None, reply: np.ndarray) -> Iterator[pd.DataFrame]:
        s = Suffixes(Chunk.load(file), length)
        s.only(_mask(unpack(kept)[0], len(s.at)))
        value, lead = answered(s.around(), reply)
        shared = (value & OFTEN) > 0
        begin, end = s.windows_around()
        settled = _marked(s.n, begin[shared], end[shared])
        stands = ~shared | (lead & ((value & FIRST) > 0))
        s.only(stands)
        open_ = np.concatenate([[0], np.cumsum(~settled)])
        flags, which = [], []
        for begin, end in s.halves():
            k = np.flatnonzero(begin < end)
            which.append(k)
            flags.append(open_[end[k]] > open_[begin[k]])
        state = pack(unpack(kept)[0], _bits(stands), *(x.astype("<i8") for x in _runs(settled)))
        yield from _frames(number, file, state, question(number, s.half_names(*which), buckets, short, np.concatenate(flags)))

    def edges(number: int, file: str, kept: bytes | None, reply: np.ndarray) -> Iterator[pd.DataFrame]:
        s = Suffixes(Chunk.load(file), length)
        survivors, stands, *settled = unpack(kept)
        s.only(_mask(survivors, len(s.at)))
        s.only(_mask(stands, len(s.at)))
        ranges = s.halves()
        which = [np.flatnonzero(begin < end) for begin, end in ranges]
        value = answered(s.half_names(*which), reply, short)[0]
        meets = ((value & OFTEN) > 0) & ((value & FLAGGED) > 0)
        cut = len(which[0])
        chosen = [(begin[k][m], end[k][m]) for (begin, end), k, m in zip(ranges, which, (meets[:cut], meets[cut:]))]
        open_ = _marked(s.n, np.concatenate([b for b, _ in chosen]), np.concatenate([e for _, e in chosen]))
        at = np.flatnonzero(open_)
        yield from _frames(number, file, pack(*(x.astype("<i8") for x in (*settled, *_runs(open_)))), question(number, s.names(at, at + length), buckets))

    def finish(number: int, file: str, kept: bytes | None, reply: np.ndarray) -> Iterator[pd.DataFrame]:
        chunk = Chunk.load(file)
        n, (begin, end, first, last) = len(chunk.data), unpack(kept)
        at = np.flatnonzero(_marked(n, first, last))
        if len(at):
            value, _ = answered(window_hash(prefix_hash(chunk.data), at, at + length), reply)
            at = at[(value & OFTEN) > 0]
        gone = _marked(n, np.concatenate([begin, at]), np.concatenate([end - 1, at]) + length)
        rows = []
        for key, text, a, b in zip(chunk.ids.tolist(), chunk.texts, chunk.start.tolist(), chunk.end.tolist()):
            mine = gone[a:b]
            removed = int(np.count_nonzero(mine))
            spans = [{"start": x, "end": y} for x, y in zip(*(z.tolist() for z in _runs(mine)))] if removed else []
            rows.append((key, len(text), removed, len(spans), chunk.data[a:b][~mine].tobytes() if removed else text, spans))
        yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"])

    table = corpus.answers(corpus.begin(grams), buckets)
    for step in (surroundings, halves, edges):
        table = corpus.answers(corpus.again(table, step), buckets)
    return restored(corpus.each(table, finish, OUT))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
