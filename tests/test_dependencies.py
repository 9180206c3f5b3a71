"""Functional dependencies against all pairs of rows, and with many columns."""

from __future__ import annotations

import random
import time
from itertools import combinations

from gridloom.operators import aggregates as A


def decides(rows, a, b):
    seen = {}
    for r in rows:
        if r[b] is not None:
            seen.setdefault(tuple(r[i] for i in a), set()).add(r[b])
    return all(len(v) == 1 for v in seen.values())


def minimal(rows, n, size):
    found = {}
    for k in range(1, size + 1):
        for s in combinations(range(n), k):
            held = lambda x, t: any(decides(rows, d, t) for m in range(1, len(x) + 1) for d in combinations(x, m))
            targets = {j for j in range(n) if j not in s and decides(rows, s, j) and not any(held([x for x in s if x != i], j) for i in s)}
            if targets:
                found[s] = targets
    return found


def test_against_all_rows(spark):
    rng = random.Random(6)
    for _ in range(8):
        n = rng.randint(2, 4)
        rows = [tuple(rng.choice(["a", "b", "c", None]) for _ in range(n)) for _ in range(rng.randint(2, 9))]
        rows = [(*r, (r[0] or "") + (r[1] or "")) for r in rows]
        names = [f"k{i}" for i in range(n + 1)]
        df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in names))
        got = A.dependencies(df, names, 2)
        want = minimal(rows, n + 1, 2)
        assert got == {tuple(names[i] for i in s): {names[j] for j in t} for s, t in want.items()}
        pairs = A.dependent_columns(df, names)
        assert pairs == {a: {b for b in names if b != a and (decides(rows, (names.index(a),), names.index(b)) or decides(rows, (names.index(b),), names.index(a)))} for a in names}


def test_thirty_columns(spark):
    rng = random.Random(1)
    base = [tuple(rng.choice("abcdef") for _ in range(15)) for _ in range(400)]
    rows = [(*r, *(x.upper() * 2 for x in r)) for r in base]
    names = [f"c{i}" for i in range(30)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in names))
    begin = time.monotonic()
    found = A.dependent_columns(df, names)
    assert found == {f"c{i}": {f"c{(i + 15) % 30}"} for i in range(30)} and time.monotonic() - begin < 60


def test_few_rows_and_all_null(spark):
    one = spark.createDataFrame([("a", "b")], "x string, y string")
    assert A.dependent_columns(one, ["x", "y"]) == {"x": set(), "y": set()} and A.dependent_columns(one, ["x"]) == {"x": set()}
    null = spark.createDataFrame([("a", None), ("b", None)], "x string, y string")
    assert A.dependent_columns(null, ["x", "y"]) == {"x": {"y"}, "y": {"x"}}
    assert A.dependent_columns(one.limit(0), ["x", "y"]) == {"x": set(), "y": set()}
