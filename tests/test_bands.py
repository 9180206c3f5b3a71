"""Bands read in blocks against a plain reading of the rows in order."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import bands as B
from gridloom.operators import grid as G

KINDS = ["title", "col_hdr", "data", "mixed", "note", "empty"]


def plain(rows):
    """The rules, read one row at a time with whole lists: (start, end, c0, c1, title, header rows, data rows, notes)."""
    by_row, out = {x[0]: x for x in rows}, []
    new = lambda: {"titles": [], "headers": [], "data": [], "start": None, "low": 1 << 30, "high": 0}
    band, pending, empties, last = new(), [], 0, 0

    def widen(x):
        band["low"], band["high"] = min(band["low"], x[2]), max(band["high"], x[3])

    def opened(r):
        if band["start"] is None:
            band["titles"] = list(pending)
            for t, _ in pending:
                widen(by_row[t])
            pending.clear()
            band["start"] = band["titles"][0][0] if band["titles"] else r

    full = lambda: band["data"] or len(band["headers"]) >= 2

    def close(end):
        nonlocal band
        if full():
            out.append([band["start"], end, band["low"], band["high"], " ".join(t for _, t in band["titles"]), band["headers"], band["data"], []])
        band = new()

    for r in range(1, max(by_row, default=0) + 1):
        x = by_row.get(r)
        if x is None or x[1] == "empty":
            empties += 1
            if full() and empties >= 2:
                close(last)
                pending.clear()
            elif empties > 4:
                pending.clear()
            continue
        empties, last, kind = 0, r, x[1]
        if kind == "title":
            if full():
                close(r - 1)
                pending.clear()
            pending.append((r, x[4]))
        elif kind == "col_hdr":
            if band["data"]:
                if B.like_data(band["low"], band["high"], x[2], x[3], x[5]):
                    band["data"].append(r)
                    widen(x)
                    continue
                close(r - 1)
            opened(r)
            band["headers"].append(r)
            widen(x)
        elif kind == "note":
            if band["data"]:
                close(r - 1)
                pending.clear()
                out[-1][7].append(x[4])
            elif pending:
                pending.append((r, x[4]))
            elif band["start"] is None and out:
                out[-1][7].append(x[4])
        else:
            opened(r)
            band["data"].append(r)
            widen(x)
    if band["start"] is not None:
        close(last)
    return out


def sheet(rng, n, kinds):
    rows, r = [], 0
    for _ in range(n):
        r += rng.choice([1, 1, 1, 1, 1, 2, 3, 7])
        kind = rng.choice(kinds)
        a = rng.randint(1, 4)
        b = a + rng.randint(0, 5)
        values = [{"c": c, "v": rng.choice("abcdefg")} for c in range(a, b + 1) if rng.random() < 0.9 or c in (a, b)] if kind == "col_hdr" else None
        rows.append((r, kind, a, b, f"t{r}" if kind in ("title", "note") else None, values))
    return rows


def frame(spark, sheets):
    flat = [("f", name, *x[:5], [(v["c"], v["v"]) for v in x[5]] if x[5] is not None else None) for name, rows in sheets.items() for x in rows]
    return spark.createDataFrame(flat, B.ROWS)


def machine(rows, block):
    """Blocks by hand: rounds of runs and walks as the jobs do them, and the events of the last."""
    parts = {}
    for x in rows:
        if x[1] != "empty":
            parts.setdefault((x[0] - 1) // block, []).append(x)

    def run(b, s):
        m = B.Machine(s if s.last >= 0 else B.replace(s, last=parts[b][0][0] - 1))
        for r, kind, c_min, c_max, text, values in parts[b]:
            m.read(r, kind, c_min, c_max, text, values)
        return m

    known = {b: [run(b, B.State() if b == 0 else B.State(band=3, last=-1)).summary()] for b in parts}
    for turn in range(len(parts) + 2):
        states = list(B.walk(known))
        todo = [(b, s) for b, s, t in states if t]
        if not todo:
            break
        for b, s in todo:
            known[b].append(run(b, s).summary())
    assert not todo
    return turn, [run(b, s) for b, s, _ in states]


@pytest.mark.parametrize("block", [1, 3, 10, 64])
def test_any_cut_gives_the_same_states(block):
    rng = random.Random(block)
    for _ in range(150):
        rows = sheet(rng, rng.randint(1, 60), rng.sample(KINDS, rng.randint(2, 6)) + ["data"] * rng.randint(0, 6))
        _, runs = machine(rows, block)
        whole = B.Machine(B.State())
        for x in rows:
            if x[1] != "empty":
                whole.read(*x)
        if runs:
            assert runs[-1].s == whole.s
            joined = [tuple(e) for m in runs for e in m.events]
            count = lambda events, what: sum(e[4] for e in events if e[0] == what)
            assert [e for e in joined if e[0] not in ("header", "data")] == [tuple(e) for e in whole.events if e[0] not in ("header", "data")]
            assert all(count(joined, w) == count(whole.events, w) for w in ("header", "data"))


def test_a_long_band_settles_in_two_rounds():
    """Data with header-like rows amid it, over 200 blocks: each test needs the band's extents, which don't grow."""
    rows = [(1, "title", 1, 1, "t", None), (2, "col_hdr", 1, 6, None, [{"c": c, "v": str(c)} for c in range(1, 7)])]
    rows += [(r, "col_hdr" if r % 3 == 0 else "data", 1, 6, None, [{"c": c, "v": f"{r}-{c}"} for c in range(1, 7)]) for r in range(3, 4001)]
    turns, runs = machine(rows, 20)
    assert turns <= 2 and runs[-1].s.opened == 1 and runs[-1].s.band == 3


def spans(found):
    return [r for x in found for r in range(x["first"], x["last"] + 1)]


def test_short_sheets_make_the_bands():
    rng = random.Random(11)
    for _ in range(300):
        rows = sheet(rng, rng.randint(1, 60), KINDS + ["data"] * 3)
        machine_ = B.Machine(B.State())
        for x in rows:
            if x[1] != "empty":
                machine_.read(*x)
        machine_._event("end", machine_.s.opened if machine_.s.band else 0, machine_.s.last)
        n = lambda spans: sum(x["n"] for x in spans)
        got = [[x["band_start"], x["band_end"], x["c0"], x["c1"], x["title"], n(x["header_rows"]), n(x["data_rows"]), x["notes"]] for x in B.assembled(machine_.events)]
        assert got == [[*x[:5], len(x[5]), len(x[6]), x[7]] for x in plain(rows)]


@pytest.mark.parametrize("block", [7, 1 << 15])
def test_events_make_the_bands(spark, block):
    rng = random.Random(3)
    sheets = {f"s{i}": sheet(rng, rng.randint(1, 90), KINDS + ["data"] * 3) for i in range(25)}
    got = {}
    for e in B.events(frame(spark, sheets), block).collect():
        got.setdefault(e["sheet"], []).append(e)
    for name, rows in sheets.items():
        events = got.get(name, [])
        found = []
        for b in range(1, max([e["band"] for e in events if e["what"] == "open"], default=0) + 1):
            own = [e for e in events if e["band"] == b and e["what"] not in ("title", "note")]
            (start,) = (e for e in own if e["what"] == "open")
            titles = sorted((e["r0"], e["text"]) for e in events if e["what"] == "title" and start["text"] == str(e["band"]))
            rows_of = lambda what: sum(e["n"] for e in own if e["what"] == what)
            end = [e["r0"] for e in own if e["what"] == "close"] or [max(e["r0"] for e in own if e["what"] == "end")]
            c0, c1 = min(e["c0"] for e in own if e["c0"] is not None), max(e["c1"] for e in own if e["c1"] is not None)
            if rows_of("data") or rows_of("header") >= 2:
                found.append([titles[0][0] if titles else start["r0"], end[0], c0, c1, " ".join(t for _, t in titles), rows_of("header"), rows_of("data"), [t for _, t in sorted((e["r0"], e["text"]) for e in events if e["what"] == "note" and e["band"] == b)]])
        assert found == [[*x[:5], len(x[5]), len(x[6]), x[7]] for x in plain(rows)]


def test_regions_of_a_long_sheet(spark):
    """Rescued rows, gaps, notes and a second table, with blocks far shorter than the bands; cells as ranges."""
    cells = [(1, 1, "s", "head", None), (3, 1, "s", "name", None), (3, 2, "s", "kind", None), (3, 3, "s", "note", None), (3, 4, "s", "n", None)]
    for r in range(4, 300):
        text = r % 10 == 0
        cells += [(r, 1, "s", f"a{r}", None), (r, 2, "s", f"b{r}", None), (r, 3, "s" if text else "n", f"c{r}" if text else None, None if text else 1.0), (r, 4, "s" if text else "n", f"d{r}" if text else None, None if text else float(r))]
    cells += [(301, 1, "s", "※出典：x", None), (305, 2, "s", "p", None), (305, 3, "s", "q", None), (306, 2, "n", None, 1.0), (306, 3, "n", None, 2.0), (307, 2, "n", None, 3.0), (307, 3, "n", None, 4.0)]
    df = spark.createDataFrame([("f", "s", *c) for c in cells], G.CELLS)
    for block in (16, 1000):
        a, b = G.detect_tables(df, block_rows=block).orderBy("table_id").collect()
        assert (a["title"], a["band_start"], a["band_end"], a["c0"], a["c1"], a["notes"]) == ("head", 1, 300, 1, 4, ["※出典：x"])
        assert spans(a["header_rows"]) == [3] and spans(a["data_rows"]) == list(range(4, 300)) and sum(x["n"] for x in a["data_rows"]) == 296
        assert (b["c0"], b["c1"], spans(b["header_rows"]), spans(b["data_rows"])) == (2, 3, [305], [306, 307])
        out = G.extract(df, a.asDict())
        assert out.columns == ["__row", "name", "kind", "note", "n"] and out.count() == 296
        assert G.extract(df, b.asDict()).select(F.sum("q")).first()[0] == 6
