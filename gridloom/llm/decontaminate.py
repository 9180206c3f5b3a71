"""Benchmark decontamination by CGK embedding and bit-sampling LSH (operator 9).

Texts are sequences of words in lower case. A document is contaminated by an item if some window of
it, about as long as the item, is within ``rate`` times the item's words of it in edit distance
(insert, delete or replace a word).

* The CGK walk embeds a sequence: at step t it puts out the word under its pointer and moves on if a
  random bit of (t, word) says so. Equal stretches walk alike and edits shift the walk only until it
  falls in step again, so edit distance becomes Hamming distance between embeddings.
* Each repetition draws a walk, a few steps to sample (the LSH key), and a place in the item where the
  window begins (0, 1/4, 1/2, 0.7 of its words), so edits near an item's start don't hide it.
  Windows begin at every word of every document. All are walked at once, and those whose sampled
  word isn't any item's at that step drop out, so most take two steps.
* Candidates are verified exactly by a banded edit-distance table over words.

``repetitions`` x ``samples`` reach a recall above 0.95 for edits in up to a tenth of the words (see the
tests). Items go to the tasks in blocks of ``block`` rows, so their number isn't bounded.

Defined results: null, empty and word-free texts match nothing; items of fewer than ``min_words``
words (null ones too) are too short to tell and match nothing; rows that repeat match each; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, mix, prefix_hash, restored, small_batches, texts_of, window_hash, word_hashes, word_spans

FOUND = "doc_id long, item_id long, first_word long, n_words long, distance long"
PLACES = (0.0, 0.25, 0.5, 0.7)
STEPS = 16


def _bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def _bits(words: np.ndarray, seed: int) -> np.ndarray:
    """64 random bits of each word: bit t says whether the walk moves on at step t."""
    return mix(words ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))


def embed(words: np.ndarray, seed: int, steps: int) -> np.ndarray:
    """The CGK embedding of one sequence; words after its end are 0."""
    bits, i, out = _bits(words, seed), 0, np.zeros(steps, np.uint64)
    for t in range(steps):
        if i >= len(words):
            break
        out[t] = words[i]
        i += int(bits[i] >> np.uint64(t)) & 1
    return out


class Plan:
    """Keys of a block of items under every repetition."""

    def __init__(self, items: list[tuple[int, str]], rate: float, repetitions: int, samples: int, min_words: int) -> None:
        self.items = [(i, word_hashes(_bytes(t))) for i, t in items]
        self.items = [(i, w) for i, w in self.items if len(w) >= min_words]
        self.vocabulary = np.unique(np.concatenate([w for _, w in self.items] or [np.empty(0, np.uint64)]))
        self.coded = [np.searchsorted(self.vocabulary, w) + 1 for _, w in self.items]
        self.allowed = [int(rate * len(w)) for _, w in self.items]
        rng = np.random.default_rng(12345)
        self.repetitions = []
        for r in range(repetitions):
            place = PLACES[r % len(PLACES)]
            steps = np.sort(np.concatenate([rng.integers(0, 2, 1), rng.choice(np.arange(2, STEPS), samples - 1, replace=False)]))
            wanted = [np.zeros(len(self.vocabulary) + 1, bool) for _ in steps]
            keys: dict[tuple, list[tuple[int, int]]] = {}
            for k, (_, words) in enumerate(self.items):
                start = int(place * len(words))
                if len(words) - start < 4:
                    start = max(0, len(words) - 4)
                code = np.searchsorted(self.vocabulary, embed(words[start:], r + 1, STEPS)) + 1
                shown = embed(words[start:], r + 1, STEPS)
                key = tuple(int(code[t]) if shown[t] else 0 for t in steps)
                for level, c in zip(wanted, key):
                    level[c] = True
                keys.setdefault(key, []).append((k, start))
            for level in wanted:
                level[0] &= any(0 in key for key in keys)
            self.repetitions.append((r + 1, steps.tolist(), wanted, keys))

    def search(self, words: np.ndarray, codes: np.ndarray) -> set[tuple[int, int, int, int]]:
        """Candidates (item, first word of its window, first and last word of the hit); words ends in STEPS words of padding.

        A window may begin before its document: there it has lost its first words.
        """
        out: set[tuple[int, int, int, int]] = set()
        n = len(words) - STEPS - 1
        for seed, steps, wanted, keys in self.repetitions:
            bits = None
            start = at = None
            t, seen = 0, []
            for step, level in zip(steps, wanted):
                if start is None:
                    if step == 0:
                        start = np.flatnonzero(level[codes[:n]])
                        at = start.copy()
                        bits = _bits(words, seed) if len(start) else None
                    else:
                        bits = _bits(words, seed)
                        at = np.arange(n)
                        for t in range(step):
                            at = at + (bits[at] >> np.uint64(t) & np.uint64(1)).astype(np.int64)
                        start = np.flatnonzero(level[codes[at]])
                        at = at[start]
                    t = step
                else:
                    for t in range(t, step):
                        at = at + (bits[at] >> np.uint64(t) & np.uint64(1)).astype(np.int64)
                    t = step
                    keep = level[codes[at]]
                    start, at, seen = start[keep], at[keep], [s[keep] for s in seen]
                seen.append(codes[at])
                if not len(start):
                    break
            if start is None or not len(start):
                continue
            for s, e, key in zip(start.tolist(), at.tolist(), zip(*(x.tolist() for x in seen))):
                for k, offset in keys.get(key, ()):
                    out.add((k, s - offset, s, e))
        return out


def edit_window(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the nearest stretch of text, if within most; free ends in text."""
    n = len(text)
    cost, origin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    ramp = np.arange(n + 1)
    for k, w in enumerate(item, 1):
        diagonal = cost[:-1] + (text != w)
        new, come = np.empty(n + 1, np.int64), np.empty(n + 1, np.int64)
        new[0], come[0] = k, 0
        up = cost[1:] + 1
        new[1:], come[1:] = np.minimum(diagonal, up), np.where(diagonal <= up, origin[:-1], origin[1:])
        best = np.minimum.accumulate(new - ramp)  # inserted words of the text
        source = np.maximum.accumulate(np.where(new - ramp == best, ramp, 0))
        cost, origin = best + ramp, come[source]
        if cost.min() > most:
            return None
    end = int(np.argmin(cost))
    return (int(cost[end]), int(origin[end]), end) if cost[end] <= most else None


def matches(texts: list[str], plan: Plan) -> Iterator[tuple[int, int, int, int, int]]:
    """(number of the text, item_id, first_word, n_words, distance) of each match."""
    if plan.items:
        for a, b in batches(texts, 1_500_000):
            raw = [_bytes(t) for t in texts[a:b]]
            data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
            s, e = word_spans(data)
            words = window_hash(prefix_hash(data), s, e)
            ends = np.searchsorted(s, np.cumsum([len(r) + 1 for r in raw]))  # words up to each document's end
            shift = np.repeat(np.arange(len(raw)), np.diff(ends, prepend=0))
            stream = np.zeros(len(words) + len(raw) + STEPS + 1, np.uint64)  # a 0 after each document
            stream[np.arange(len(words)) + shift] = words
            at = np.minimum(np.searchsorted(plan.vocabulary, stream), len(plan.vocabulary) - 1)
            codes = np.where(plan.vocabulary[at] == stream, at + 1, 0)
            begin = np.concatenate([[0], ends[:-1] + np.arange(1, len(raw))]) if len(raw) else np.empty(0, int)
            size = np.diff(ends, prepend=0)
            best: dict[tuple[int, int, int], tuple[int, int]] = {}
            done: set[tuple[int, int, int]] = set()
            hits = np.array(sorted(plan.search(stream, codes)), np.int64).reshape(-1, 4)
            places: set[tuple[int, int, int]] = set()
            for k, start, d, last in zip(hits[:, 0].tolist(), hits[:, 1].tolist(), *((np.searchsorted(begin, hits[:, c], side="right") - 1).tolist() for c in (2, 3))):
                # A walk that starts on the 0 before a document, or on the words before that, hits the document it goes on in.
                places.update((k, x, max(start, int(begin[x]))) for x in range(d, last + 1) if start >= begin[x] - plan.allowed[k])
            for k, d, start in sorted(places):
                item, most = plan.coded[k], plan.allowed[k]
                if (k, d, start // (most + 1)) in done:
                    continue
                low, high = max(start - 2 * most - 1, int(begin[d])), min(start + len(item) + 2 * most + 1, int(begin[d] + size[d]))
                if high - low < len(item) - most:
                    continue
                window = codes[low:high]
                if np.isin(item, window).sum() < len(item) - most:
                    continue
                done.add((k, d, start // (most + 1)))
                found = edit_window(item, window, most)
                if found:
                    distance, x, y = found
                    key = (d, k, low + x - int(begin[d]))
                    if key not in best or best[key][0] > distance:
                        best[key] = (distance, y - x)
            for (d, k, first), (distance, n) in best.items():
                yield a + d, plan.items[k][0], first, n, distance


def _search_documents(parts: Iterator[pd.DataFrame], plan: Plan) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        ids = pdf["doc_id"].tolist()
        rows = [(ids[d], *found) for d, *found in matches(pdf["text"].tolist(), plan)]
        yield pd.DataFrame(rows, columns=["doc_id", "item_id", "first_word", "n_words", "distance"])


def plans(items: DataFrame, rate: float, repetitions: int, samples: int, min_words: int, block: int, item_col: str, item_text: str) -> Iterator[Plan]:
    """Search plans of the items, block rows at a time."""
    rows = items.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), F.col(f"`{item_text}`").cast("string").alias("text")).where("text is not null and item_id is not null").distinct()
    held: list[tuple[int, str]] = []
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        held.append((row["item_id"], row["text"]))
        if len(held) == block:
            yield Plan(held, rate, repetitions, samples, min_words)
            held = []
    yield Plan(held, rate, repetitions, samples, min_words)




def contaminations(docs: DataFrame, items: DataFrame, rate: float = 0.2, repetitions: int = 12, samples: int = 4, min_words: int = 8, block: int = 2000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, first_word, n_words, distance): each matched window, words counted from 0."""
    spark, texts, out = docs.sparkSession, texts_of(docs, id_col, text_col), None
    for plan in plans(items, rate, repetitions, samples, min_words, block, item_col, item_text):
        shared = spark.sparkContext.broadcast(plan)  # at most block items
        found = texts.mapInPandas(lambda parts, shared=shared: _search_documents(parts, shared.value), FOUND)
        out = found if out is None else out.union(found)
    return restored(out)


def _hit(shared):
    def hit(texts: pd.Series) -> pd.Series:
        out = np.zeros(len(texts), bool)
        out[[d for d, *_ in matches(texts.fillna("").tolist(), shared.value)]] = True
        return pd.Series(out)

    return F.pandas_udf(hit, "boolean")


def clean(docs: DataFrame, items: DataFrame, rate: float = 0.2, repetitions: int = 12, samples: int = 4, min_words: int = 8, block: int = 2000, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that no item contaminates."""
    small_batches(docs.sparkSession)
    for plan in plans(items, rate, repetitions, samples, min_words, block, item_col, item_text):
        docs = docs.where(~_hit(docs.sparkSession.sparkContext.broadcast(plan))(F.col(f"`{text_col}`").cast("string")))
    return docs


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document window that matches a benchmark item."""
    return contaminations(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
