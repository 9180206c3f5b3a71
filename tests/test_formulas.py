"""Formulas against a plain evaluation by recursion."""

from __future__ import annotations

import random
import time

import pytest

from gridloom.operators import formulas as M
from gridloom.operators.grid import CELLS


def name(r, c):
    return chr(64 + c) + str(r)


def plain(numbers, formulas):
    """{place: (value, state)} by recursion over ranges, cell by cell."""
    done, busy = {}, set()

    def value(at):
        if at in numbers:
            return numbers[at]
        if at not in formulas:
            return None
        if at in done:
            if done[at][1] == "cycle":
                raise RecursionError
            return done[at][0]
        if at in busy:
            raise RecursionError
        busy.add(at)
        try:
            op, boxes = M.parse(formulas[at])
            inside, cyclic = [], False
            for r0, c0, r1, c1 in boxes:
                found = []
                for r in range(r0, r1 + 1):
                    for c in range(c0, c1 + 1):
                        try:
                            found.append(value((r, c)))
                        except RecursionError:
                            cyclic = True
                inside.append([v for v in found if v is not None])
            if cyclic:
                done[at] = (None, "cycle")
                raise RecursionError
            v = M.result(op, [sum(x) for x in inside], [len(x) for x in inside])
            done[at] = (v, "empty" if v is None else "value")
            return v
        finally:
            busy.discard(at)

    for at in formulas:
        try:
            value(at)
        except RecursionError:
            done[at] = (None, "cycle")
    return done


def sheet(rng, n, cycles):
    numbers = {(rng.randint(1, 12), rng.randint(1, 6)): float(rng.randint(-9, 9)) for _ in range(25)}
    free = [(r, c) for r in range(1, 16) for c in range(1, 8) if (r, c) not in numbers]
    rng.shuffle(free)
    formulas = {}
    for k, at in enumerate(free[:n]):
        other = lambda: rng.choice(free[:n] if cycles else free[:k] or list(numbers)) if rng.random() < 0.6 else rng.choice(list(numbers))
        a, b = other(), other()
        formulas[at] = rng.choice([f"={name(*a)}", f"{name(*a)}+{name(*b)}", f"{name(*a)} * $A$3", f"={name(*a)}-{name(*b)}", f"=SUM({name(*a)},{name(*b)})", f"=sum({name(min(a[0], b[0]), min(a[1], b[1]))}:{name(max(a[0], b[0]), max(a[1], b[1]))})"])
    return numbers, formulas


def acyclic_order_only(numbers, formulas):
    """The recursion finds all cells behind a cycle only where it meets them; cells that reach one are marked here."""
    reach = {at: [(r, c) for r0, c0, r1, c1 in M.parse(f)[1] for r in range(r0, r1 + 1) for c in range(c0, c1 + 1) if (r, c) in formulas and (r, c) not in numbers] for at, f in formulas.items()}
    waits = {at: len(v) for at, v in reach.items()}
    order = [at for at, n in waits.items() if not n]
    for at in order:
        for other, needs in reach.items():
            if at in needs:
                waits[other] -= needs.count(at)
                if not waits[other]:
                    order.append(other)
    return set(order)


def test_solve():
    rng = random.Random(1)
    for i in range(200):
        numbers, formulas = sheet(rng, rng.randint(1, 25), i % 2)
        grid = dict(numbers)
        cyclic = set(M.fill(grid, formulas))
        fine = acyclic_order_only(numbers, formulas)
        assert cyclic == set(formulas) - fine
        want = plain(numbers, {at: f for at, f in formulas.items() if at in fine})
        assert {at: grid.get(at) for at in fine} == {at: want[at][0] for at in fine}


def test_depth_and_other_formulas():
    grid = {(1, 1): 1.0, (1, 2): "x"}
    formulas = {(r, 1): f"A{r - 1}+A1" for r in range(2, 2001)} | {(1, 3): "B1", (1, 4): "A1/A1", (1, 5): "SUM(A1:A3, junk, C1)", (1, 6): "SUM()"}
    assert M.fill(grid, formulas) == [] and grid[2000, 1] == 2000 and grid[1, 5] == 6 and not {(1, 3), (1, 4), (1, 6)} & set(grid)
    assert M.fill({}, {(1, 1): "B1", (1, 2): "A1", (1, 3): "SUM(A1:A9)", (1, 4): "E1"}) == [(1, 1), (1, 2), (1, 3)]


@pytest.mark.parametrize("task_formulas", [1000, 3])
def test_evaluate(spark, task_formulas):
    rng = random.Random(5)
    cells, formulas, want = [], [], {}
    for i in range(12):
        numbers, own = sheet(rng, rng.randint(1, 14), i % 3 == 0)
        s = f"s{i}"
        cells += [("f", s, *at, "n", None, v) for at, v in numbers.items()] + [("f", s, 20, 1, "s", "text", None)]
        formulas += [("f", s, *at, f) for at, f in own.items()] + [("f", s, 30, 1, "A1/A2"), ("f", s, 20, 1, "A1"), ("f", s, 31, 1, None)]
        fine = acyclic_order_only(numbers, own)
        done = plain(numbers, {at: f for at, f in own.items() if at in fine})
        want |= {(s, *at): done[at] if at in fine else (None, "cycle") for at in own}
    out = M.evaluate(spark.createDataFrame(cells, CELLS), spark.createDataFrame(formulas, "file string, sheet string, r int, c int, formula string"), task_formulas).collect()
    assert {(r["sheet"], r["r"], r["c"]): (r["value"], r["state"]) for r in out} == want and len(out) == len(want)


def test_deep_chain_on_spark(spark):
    cells = spark.createDataFrame([("f", "s", 1, 1, "n", None, 1.0)], CELLS)
    formulas = spark.createDataFrame([("f", "s", r, 1, f"SUM(A1:A{r - 1})") for r in range(2, 52)], "file string, sheet string, r int, c int, formula string")
    out = {r["r"]: r["value"] for r in M.evaluate(cells, formulas).collect()}
    assert out == {r: float(2 ** (r - 2)) for r in range(2, 52)}


def test_range_sums(spark, monkeypatch):
    rng = random.Random(7)
    monkeypatch.setattr(M, "BLOCK", 16)  # ranges over many blocks
    cells = {(rng.randint(1, 90), rng.randint(1, 40)): rng.randint(-50, 50) for _ in range(900)}
    boxes = [(i, *(a := (rng.randint(1, 95), rng.randint(1, 42))), a[0] + rng.choice([0, 1, 60]), a[1] + rng.choice([0, 2, 30])) for i in range(200)]
    df = spark.createDataFrame([("f", "s", r, c, "n", None, float(v)) for (r, c), v in cells.items()] + [("f", "s", 200, 1, "s", "x", None), ("f", "t", 1, 1, "n", None, 1000.0)], CELLS)
    ranges = spark.createDataFrame([(i, "f", "s", r0, c0, r1, c1) for i, r0, c0, r1, c1 in boxes], "id int, file string, sheet string, r0 int, c0 int, r1 int, c1 int")
    got = {r["id"]: r["total"] for r in M.range_sums(df, ranges).collect()}
    want = {i: v for i, r0, c0, r1, c1 in boxes if (v := [x for (r, c), x in cells.items() if r0 <= r <= r1 and c0 <= c <= c1])}
    assert got == {i: float(sum(v)) for i, v in want.items()}


def test_many_small_sheets(spark):
    """Sheets cost what their cells cost: 60,000 of them took minutes when each was a group of its own."""
    n = 60_000
    rows = spark.range(n).selectExpr("'f' as file", "concat('s', id) as sheet", "cast(id as double) as d")
    cells = rows.selectExpr("file", "sheet", "explode(array(1, 2, 3)) as r", "1 as c", "'n' as kind", "cast(null as string) as s", "d")
    formulas = rows.selectExpr("file", "sheet", "explode(array(1, 2, 3)) as r", "2 as c").selectExpr("*", "if(r = 1, '=A1', concat('=B', r - 1, '+A', r)) as formula")
    began = time.monotonic()
    out = M.evaluate(cells, formulas).selectExpr("sum(value)", "count_if(state = 'value')", "count(*)").first()
    assert tuple(out) == (6.0 * sum(range(n)), 3 * n, 3 * n)
    assert time.monotonic() - began < 75


@pytest.mark.parametrize("bounds", [{}, {"task_cells": 100}, {"task_links": 150}, {"task_formulas": 60}])
def test_bounds(spark, bounds):
    """Long sheets, columns of text and sheets without formulas, whichever way they go."""
    cells = [("f", "long", r, c, "n", None, float(r * c)) for r in range(1, 201) for c in (1, 2)] + [("f", "long", 300, 1, "s", "x", None), ("f", "none", 1, 1, "n", None, 1.0), ("f", "few", 1, 1, "n", None, 5.0)]
    formulas = [("f", "long", r, 3, f"SUM(A{r}:B$200)") for r in range(1, 101)] + [("f", "long", 300, 1, "A1"), ("f", "long", 1, 4, "SUM(C1:C100, A5)"), ("f", "few", 2, 1, "A1*A1"), ("f", "few", 3, 1, "A2-A1"), ("f", "few", 4, 1, "Z9")]
    out = {(x["sheet"], x["r"], x["c"]): (x["value"], x["state"]) for x in M.evaluate(spark.createDataFrame(cells, CELLS), spark.createDataFrame(formulas, "file string, sheet string, r int, c int, formula string"), **bounds).collect()}
    tail = {r: 3.0 * sum(range(r, 201)) for r in range(1, 101)}
    want = {("long", r, 3): (v, "value") for r, v in tail.items()} | {("long", 1, 4): (sum(tail.values()) + 5, "value"), ("few", 2, 1): (25.0, "value"), ("few", 3, 1): (20.0, "value"), ("few", 4, 1): (None, "empty")}
    assert out == want
