"""Rounds over stored tables: components that end on stars and go on from labels."""

from __future__ import annotations

import random

from gridloom.llm import components as C
from gridloom.llm import ngram_join

RNG = random.Random(8)


def labels(links):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for u, v in links:
        if u != v:
            a, b = sorted((root(u), root(v)))
            up[b] = a
    return {x: root(x) for x in list(up)}


def test_components_from_labels(spark, monkeypatch):
    """Chains, rings, repeated links and links to itself; and stars are known as such without one more step."""
    chain = list(range(0, 40))
    RNG.shuffle(chain)
    links = list(zip(chain, chain[1:])) + [(100, 101), (101, 102), (102, 100), (100, 101), (7, 7), (200, 200), (-5, 300)]
    frame = lambda x: spark.createDataFrame(x, "u long, v long")
    first = C.components(frame(links))
    assert dict(map(tuple, first.collect())) == labels(links)
    more = [(102, 39), (300, 400)]
    steps, stage = [], C.stage
    monkeypatch.setattr(C, "stage", lambda df, name: steps.append(name) or stage(df, name))
    both = C.components(frame(more).union(first.select("node", "label")))
    assert dict(map(tuple, both.collect())) == labels(links + more)
    steps.clear()
    assert dict(map(tuple, C.components(frame([(1, 2), (1, 3)])).collect())) == {1: 1, 2: 1, 3: 1} and len(steps) == 1
    assert C.components(frame([])).count() == 0


def test_no_rounds_without_open_groups(spark, monkeypatch):
    """Where the first links leave no group open, there is nothing to verify again."""
    rounds, verified = [], ngram_join.verified
    monkeypatch.setattr(ngram_join, "verified", lambda *a: rounds.append(1) or verified(*a))
    words = [f"w{i}" for i in range(60)]
    texts = [(i, " ".join(words[:59] + [f"end{i}"])) for i in range(6)]
    got = ngram_join.join_components(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {0} and len(rounds) == 1
