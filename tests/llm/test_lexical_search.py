"""Lexical search against a plain version over all pairs of items and documents."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from gridloom.llm import lexical_search as L

RNG = random.Random(4)
WORDS = ["".join(RNG.choice("abcé1") for _ in range(RNG.randint(1, 5))) for _ in range(60)]


def prose(n):
    return RNG.choice([" ", ", ", "\n"]).join(RNG.choice(WORDS) for _ in range(n))


DOCS = [(i, prose(RNG.randint(1, 80))) for i in range(150)] + [
    (200, None), (201, ""), (202, " ,.\t\0 "), (None, "abc only one"), (None, prose(9)), (203, "foo-foo_FOO  foofoo foo"), (204, "xfoo foox"), (205, "日本語 ABC abc"), (206, "same words here"), (207, "same words here"), (207, "same words here"),
    (208, "long " * 60_000 + "end"), (-5, "same words here"),
]
ITEMS = [(i, prose(RNG.randint(1, 12))) for i in range(12)] + [(50, None), (51, ""), (52, "..."), (53, "FOO foo, foo!"), (54, "日本語"), (55, "same here"), (55, "same here"), (None, "end of a long one"), (56, "nowhere_to be-found1x")]


def brute(docs, items, k=50):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(x)) for i, t in docs if (x := terms(t))]
    total, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in held:
            m = 50 + (50 * sum(c.values()) * total) // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                found.append((-s, i is not None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in DOCS], "doc_id long, text string, score int, item string").repartition(5)
    items = spark.createDataFrame([(i, t, 2, 3) for i, t in ITEMS], "item_id long, text string, rank int, doc_id int").repartition(2)
    return docs, items


@pytest.mark.parametrize("k", [50, 3, 1])
def test_search(tables, k):
    assert sorted((tuple(r) for r in L.search(*tables, k=k).collect()), key=repr) == brute(DOCS, ITEMS, k)


def test_items_in_many_blocks(tables, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_BYTES", 60)
    blocks = list(L._blocks(tables[1].selectExpr("monotonically_increasing_id() as item", "item_id", "text").cache()))
    assert len(blocks) > 4 and sorted((r["item_id"], r["text"]) for b in blocks for r in b if r["item_id"]) == sorted((i, t) for i, t in ITEMS if i)
    assert sorted((tuple(r) for r in L.search(*tables).collect()), key=repr) == brute(DOCS, ITEMS)


def test_empty_tables(tables):
    docs, items = tables
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.where("text is null"), items), (docs, items.where("item_id in (50, 51, 52)"))):
        out = L.search(d, i)
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0


def test_many_equal_documents(spark):
    """A third of all rows are one text: ties go by id, through both cuts."""
    rows = [(i, "same text" if i % 3 == 0 else f"other text {i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    items = spark.createDataFrame([(1, "same text"), (2, "text")], "item_id long, text string")
    assert sorted((tuple(r) for r in L.search(docs, items).collect()), key=repr) == brute(rows, [(1, "same text"), (2, "text")])


def test_best_is_cut_as_it_grows(monkeypatch):
    monkeypatch.setattr(L, "KEPT", 40)
    rng = np.random.default_rng(2)
    top, seen = L._Best(3, 5), []
    for _ in range(30):
        item, doc, score = rng.integers(0, 3, 20), rng.integers(0, 50, 20), rng.integers(1, 9, 20)
        seen += list(zip(item.tolist(), doc.tolist(), score.tolist()))
        kept = score >= top.least[item]
        top.add(item[kept], doc[kept], score[kept])
    want = [x for i in range(3) for x in sorted((x for x in seen if x[0] == i), key=lambda x: (-x[2], x[1]))[:5]]
    assert [tuple(x) for x in top.cut().T.tolist()] == want


def test_scores_in_small_parts(monkeypatch):
    search = L.Searcher.of([t for _, t in ITEMS])
    texts = [L.plain(t) for _, t in DOCS if t and L.terms_of(t)]
    n = L.count_terms(texts)
    assert n.tolist() == [len(L.terms_of(t)) for _, t in DOCS if t and L.terms_of(t)]
    weights = L.Weights.of(np.bincount(search.hits(texts)[1], minlength=search.terms), len(texts), int(n.sum()))
    whole = L.scores(search, weights, texts, n, 20, 50)
    monkeypatch.setattr(L, "CELLS", 3)
    assert (L.scores(search, weights, texts, n, 20, 50) == whole).all() and whole.any()


def test_query_and_sql(spark):
    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = L.op12_lexical_search(spark, sf).toPandas(), con.execute(L.SQL).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got)
    assert sorted(got[want.columns].itertuples(index=False, name=None)) == sorted(want.itertuples(index=False, name=None))
