"""Ranked lexical search by scanning texts for the terms of all items at once.

No index of documents is written. The distinct terms of all items make one Aho-Corasick automaton, each with a
blank on either side; a text, with blanks for all that is no part of a term, is then run through it, and what it
reports are exactly the whole terms that items ask for. A term's number leads to the items that hold it.

Two scans: the first counts documents, terms and in how many documents each term is; the second scores, and
keeps of each partition no more than the best k of an item, so what is shuffled doesn't grow with the texts.
Items go in blocks of a checked size; a block's automaton is what is broadcast. Counts and scores are
integers, so the result doesn't depend on how texts are dealt out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NULL_ID, batches, discard, rest, restored, small_batches, stage

#: Items of a block: so many bytes of their texts (an item of more stands alone), and so many items.
BLOCK_BYTES, BLOCK_ITEMS = 1_000_000, 5_000
#: Scores that are held at once, and candidates before they are cut to the best.
CELLS, KEPT = 2_000_000, 200_000
#: Letters and digits, and every byte that isn't ASCII, are part of a term; only A-Z change.
TABLE = bytes(c if c > 127 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256))
HIT = np.dtype([("end", "<i8"), ("term", "<i4")])


def plain(text: str) -> str:
    """A text's bytes as characters, with blanks between terms and at both ends."""
    return " " + text.encode("utf-8", "surrogatepass").translate(TABLE).decode("latin-1") + " "


def terms_of(text: str) -> list[str]:
    """The terms of a text in order, with their repeats."""
    return [t for t in plain(text).split(" ") if t]


def count_terms(texts: list[str]) -> np.ndarray:
    """How many terms each of some plain texts has; together they must be no empty list."""
    blank = np.frombuffer("".join(texts).encode("latin-1"), np.uint8) == 32
    starts = np.zeros(len(blank), np.int64)
    starts[1:] = blank[:-1] & ~blank[1:]
    ends = np.cumsum([len(t) for t in texts])
    return np.diff(np.concatenate([[0], np.cumsum(starts)[ends - 1]]))


@dataclass
class Searcher:
    """The automaton of a block of items, and which items hold a term: those at items[first[t]:first[t + 1]]."""

    automaton: object
    terms: int
    items: np.ndarray
    first: np.ndarray
    n_items: int

    @staticmethod
    def of(texts: list[str | None]) -> Searcher:
        import ahocorasick

        found, pairs = {}, []
        for i, text in enumerate(texts):
            for t in dict.fromkeys(terms_of(text or "")):
                pairs.append((found.setdefault(t, len(found)), i))
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for t, k in found.items():
            automaton.add_word(f" {t} ", k)
        automaton.make_automaton()
        pairs.sort()
        return Searcher(automaton, len(found), np.array([i for _, i in pairs], np.int64), np.searchsorted([t for t, _ in pairs], np.arange(len(found) + 1)), len(texts))

    def hits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, times) for each term of the block that a text holds, sorted by text and term."""
        ends = np.cumsum([len(t) for t in texts])
        found = np.fromiter(self.automaton.iter("".join(texts)), HIT)
        key, times = np.unique(np.searchsorted(ends, found["end"], side="right") * self.terms + found["term"], return_counts=True)
        return key // max(self.terms, 1), key % max(self.terms, 1), times


@dataclass(frozen=True)
class Weights:
    """What the whole corpus says: a weight for each term, documents with terms, and all their terms."""

    term: np.ndarray
    documents: int
    length: int

    @staticmethod
    def of(df: np.ndarray, documents: int, length: int) -> Weights:
        return Weights(np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * x + 1))) for x in df.tolist()], np.int64), documents, length)


def _blocks(items: DataFrame, level: int = 0) -> Iterator[list]:
    """Rows (item, item_id, text) by blocks; each is measured before it comes to the driver."""
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    if size["n"] <= 1 or (size["bytes"] <= BLOCK_BYTES and size["n"] <= BLOCK_ITEMS):
        if size["n"]:
            yield sorted(items.collect(), key=lambda r: r["item"])
        return
    parts = 1 + max(size["bytes"] // BLOCK_BYTES, size["n"] // BLOCK_ITEMS)
    for k in range(parts):
        yield from _blocks(items.where(F.pmod(F.xxhash64("item", F.lit(level)), F.lit(parts)) == k), level + 1)


def _texts(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, list[str], np.ndarray]]:
    """(ids, plain texts, counts of terms) of documents that have terms, some MB at a time."""
    for a, b in batches(pdf["text"].tolist(), 2_000_000):
        texts = [plain(t) for t in pdf["text"].iloc[a:b]]
        n = count_terms(texts)
        some = np.flatnonzero(n)
        if len(some):
            yield pdf["doc_id"].to_numpy()[a:b][some], [texts[i] for i in some.tolist()], n[some]


def statistics(docs: DataFrame, search) -> tuple[np.ndarray, int, int]:
    """(documents of each term, documents with terms, their terms) over all rows; search is a broadcast Searcher."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = search.value
        df, documents, length = np.zeros(own.terms, np.int64), 0, 0
        for pdf in parts:
            for _, texts, n in _texts(pdf):
                df += np.bincount(own.hits(texts)[1], minlength=own.terms)
                documents += len(texts)
                length += int(n.sum())
        some = np.flatnonzero(df)
        yield pd.DataFrame({"term": np.concatenate([[-1, -2], some]), "n": np.concatenate([[documents, length], df[some]])})
        rest()

    total = {r["term"]: r["n"] for r in docs.mapInPandas(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    df = np.zeros(search.value.terms, np.int64)
    for t, n in total.items():
        if t >= 0:
            df[t] = n
    return df, total.get(-1, 0), total.get(-2, 0)


class _Best:
    """The k best documents of each item so far: higher scores first, then lower ids."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.least = k, np.ones(items, np.int64)
        self.parts, self.size = [np.empty((3, 0), np.int64)], 0

    def add(self, item: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        self.parts.append(np.stack([item, doc, score]))
        self.size += len(item)
        if self.size > KEPT:
            self.cut()

    def cut(self) -> np.ndarray:
        item, doc, score = np.concatenate(self.parts, axis=1)
        order = np.lexsort((doc, -score, item))
        ordered = item[order]
        place = np.arange(len(order)) - np.searchsorted(ordered, ordered)
        kept = np.stack([item, doc, score])[:, order[place < self.k]]
        last = order[place == self.k - 1]
        self.least[item[last]] = score[last]
        self.parts, self.size = [kept], 0
        return kept


def scores(search: Searcher, weights: Weights, texts: list[str], n: np.ndarray, k1: int, b: int) -> np.ndarray:
    """(text, item) scores."""
    text, term, times = search.hits(texts)
    m = np.array([100 - b + (b * x * weights.documents) // weights.length for x in n.tolist()], np.int64)
    part = weights.term[term] * ((1_000_000_000 * times) // (1000 * times + k1 * m[text]))
    out = np.zeros(len(texts) * search.n_items, np.int64)
    many = search.first[term + 1] - search.first[term]
    ends = np.cumsum(many)
    at = 0
    while at < len(term):  # what items a term leads to, some million at a time
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 2 * CELLS)))
        size = many[at:to]
        into = np.repeat(search.first[term[at:to]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        np.add.at(out, np.repeat(text[at:to] * search.n_items, size) + search.items[into], np.repeat(part[at:to], size))
        at = to
    return out.reshape(len(texts), search.n_items)


def search(docs: DataFrame, items: DataFrame, k: int = 50, k1: int = 20, b: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k documents of the highest scores above 0, equal ones by id.

    k1 is in tenths, b per cent, scores are integers (see `Weights` and `scores`). Null and term-less texts have no
    score and count for nothing; term-less items have no rows. Each row of items is an item, so a repeated row has
    its ranks twice, and each row of documents is a document; a null id comes before all others among equal scores.
    Empty tables give an empty result; further columns of either table don't matter.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.where(F.col(f"`{text_col}`").isNotNull()).select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    asked = stage(items.select(F.monotonically_increasing_id().alias("item"), F.coalesce(F.col(f"`{item_col}`").cast("long"), F.lit(NULL_ID)).alias("item_id"), F.col(f"`{item_text_col}`").cast("string").alias("text")), "items")
    found = None
    for block in _blocks(asked):
        own = Searcher.of([r["text"] for r in block])
        if not own.terms:
            continue
        shared = spark.sparkContext.broadcast(own)
        df, documents, length = statistics(rows, shared)
        if not documents:
            break
        weights = Weights.of(df, documents, length)  # a number a term of the block
        numbers, ids = (np.array([r[c] for r in block], np.int64) for c in ("item", "item_id"))

        def best(parts: Iterator[pd.DataFrame], shared=shared, weights=weights, numbers=numbers, ids=ids) -> Iterator[pd.DataFrame]:
            own = shared.value
            top, most = _Best(own.n_items, k), max(1, CELLS // own.n_items)
            for pdf in parts:
                for doc, texts, n in _texts(pdf):
                    for at in range(0, len(texts), most):
                        score = scores(own, weights, texts[at : at + most], n[at : at + most], k1, b)
                        text, item = np.nonzero(score >= top.least)
                        top.add(item, doc[at + text], score[text, item])
            item, doc, score = top.cut()
            yield pd.DataFrame({"item": numbers[item], "item_id": ids[item], "doc_id": doc, "score": score})
            rest()

        part = rows.mapInPandas(best, "item long, item_id long, doc_id long, score long")
        found = part if found is None else found.unionByName(part)
    discard(asked)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = [F.desc("score"), F.asc("doc_id")]
    salted = found.withColumn("salt", F.spark_partition_id() % 32)  # partitions' best meet in two steps
    some = salted.withColumn("place", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("place") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return restored(restored(ranked.select("item_id", "rank", "doc_id", "score")), "item_id")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""WITH d AS (SELECT doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL), held AS (SELECT doc_id, terms, len(terms) AS n FROM d WHERE len(terms) > 0),
  total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM held), tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM held) GROUP BY ALL),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), items AS (SELECT item_id, unnest(list_distinct({_TERMS})) AS term FROM benchmark),
  w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM df, total),
  part AS (SELECT item_id, doc_id, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // length))) AS part FROM items JOIN w USING (term) JOIN tf USING (term), total),
  scored AS (SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM part GROUP BY ALL HAVING sum(part) > 0),
  ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 50"""
