"""Subset sums against all subsets, and sum relations among many tables."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np

from gridloom.frame import ROW
from gridloom.operators import relate as X
from gridloom.operators import subsets as S


def test_matching_subsets(monkeypatch):
    monkeypatch.setattr(S, "PAIRS", 7)
    rng = np.random.default_rng(3)
    for i in range(150):
        n, m, misses = int(rng.integers(2, 9)), int(rng.integers(1, 7)), int(rng.integers(0, 3))
        values = rng.integers(-3 if i % 3 == 0 else 0, 12, (n, m)).astype(float)
        pick = rng.random(n) < 0.5
        target = values[pick].sum(axis=0) * rng.choice([1.0, 1.0, 1.02, 1.5], m)
        low, high = target - 0.03 * abs(target), target + 0.03 * abs(target)
        fit = []
        for k in range(2, n + 1):
            for c in combinations(range(n), k):
                s = values[list(c)].sum(axis=0)
                if ((s < low) | (s > high)).sum() <= misses and not any(set(f) <= set(c) for f in fit):
                    fit.append(c)
        got = S.matching_subsets(values, target, 0.03, misses)
        assert all(((values[list(c)].sum(axis=0) < low) | (values[list(c)].sum(axis=0) > high)).sum() <= misses for c in got)
        if misses < m:
            assert sorted(got) == sorted(fit)


def test_first_subset():
    rng = random.Random(4)
    for _ in range(200):
        values = sorted((float(rng.randint(1, 40)) for _ in range(rng.randint(2, 9))), reverse=True)
        low = rng.uniform(0, sum(values))
        high = low + rng.uniform(0, 3)
        want = next((c for k in range(2, len(values) + 1) for c in combinations(range(len(values)), k) if low <= sum(values[i] for i in c) <= high), None)
        assert S.first_subset(values, low, high) == want
    assert S.first_subset([1.0] * 40, 19.5, 20.5) == tuple(range(20))


def table(spark, name, sheet, values):
    rows = [(i, f"k{i}", *map(float, r)) for i, r in enumerate(values)]
    return X.Table(name, sheet, name, spark.createDataFrame(rows, f"{ROW} long, k string, a double, b double, c double"))


def test_thirty_peers_and_fifteen_children(spark):
    rng = np.random.default_rng(9)
    parts = [rng.integers(10, 900, (4, 3)) for _ in range(30)]
    chosen = sorted(rng.choice(30, 15, replace=False).tolist())
    tables = [table(spark, f"t{i:02}", "s", p) for i, p in enumerate(parts)]
    tables.append(table(spark, "sum", "s", sum(parts[i] for i in chosen)))
    found = [r for r in X.sum_relations(tables) if r.parent == "sum"]
    assert tuple(f"t{i:02}" for i in chosen) in [r.children for r in found]
    for r in found:  # minimal, and right in enough cells
        whole, own = sum(parts[i] for i in chosen), sum(parts[int(c[1:])] for c in r.children)
        assert (abs(whole - own) <= 0.03 * whole).mean() >= 0.88 and not any(set(o.children) < set(r.children) for o in found)


def test_children_on_other_sheets_and_sheets_that_add_up(spark):
    rng = np.random.default_rng(2)
    parts = [rng.integers(5, 90, (3, 3)) for _ in range(16)]
    tables = [table(spark, f"t{i:02}", f"s{i:02}", p) for i, p in enumerate(parts)] + [table(spark, "all", "all", sum(parts))]
    (found,) = [r for r in X.sum_relations(tables) if r.parent == "all"]
    assert found.children == tuple(f"t{i:02}" for i in range(16)) and found.ratio == 1.0
    assert set(X.aggregate_sheets(tables)) == {"all"}
