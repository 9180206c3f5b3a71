"""Unions that notes imply: over two axes, over one, summaries left out, and recommendations clipped by siblings."""

from __future__ import annotations

import pytest

from gridloom.operators import derive as U
from gridloom.operators.relate import Recommendation, Table
from gridloom.plans.propose import propose

from .conftest import rows


@pytest.fixture
def sheets(frame):
    """A total, two of its three parts and what the third is, on a sheet a branch; 全社 adds up the branches."""

    def make(numbers):
        tables, derived = [], {}
        for s, (a, b, c) in numbers.items():
            own = lambda v: frame([("x", v), ("y", v * 2)], "k string, n long")
            note = "法人、個人、その他の合計"
            tables += [Table(f"{s}0", s, "契約", own(a + b + c), [note]), Table(f"{s}1", s, "法人", own(a)), Table(f"{s}2", s, "個人", own(b))]
            derived[U.Proposal(f"{s}0", note, (f"{s}1", f"{s}2"), ("その他",), ("法人", "個人"))] = Table(f"{s}3", s, "その他", own(c))
        return tables, derived

    return make


def test_two_axes(sheets):
    tables, derived = sheets({"東京": (1, 2, 3), "大阪": (4, 5, 6)})
    (both,) = U.automatic_integrations(derived, tables)
    assert both.sources == ("東京1", "東京2", "東京3", "大阪1", "大阪2", "大阪3") and both.parent == "東京0" and both.origin == "latent"
    assert both.axes == ("種別", "シート") and both.values[2] == ("その他", "東京") and both.values[3] == ("法人", "大阪")
    single = U.automatic_integrations(derived, tables, two_axes=False)
    assert [(r.sources, r.axes) for r in single] == [(("東京1", "東京2", "東京3"), ("種別",)), (("大阪1", "大阪2", "大阪3"), ("種別",))]
    assert U.automatic_integrations(derived, tables, both=True) == [both, *single]


def test_one_member_and_groups(sheets):
    tables, derived = sheets({"東京": (1, 2, 3)})
    (only,) = U.automatic_integrations(derived, tables)
    assert only.axes == ("種別",) and only.values == (("法人",), ("個人",), ("その他",)) and only.parent == "東京0"
    assert U.automatic_integrations({}, tables) == [] and U.automatic_integrations(derived, []) == []
    more, other = sheets({"東京": (1, 2, 3), "大阪": (4, 5, 6)})
    p, q = other
    apart = {p: other[p], U.Proposal(q.source, q.note, q.known, ("別",), q.names): other[q]}
    assert [r.axes for r in U.automatic_integrations(apart, more)] == [("種別",), ("種別",)]  # they don't lack the same


def test_a_sheet_that_adds_up_the_others(sheets):
    tables, derived = sheets({"東京": (1, 2, 3), "大阪": (4, 5, 6), "全社": (5, 7, 9)})
    (both,) = U.automatic_integrations(derived, tables)
    assert {v[1] for v in both.values} == {"東京", "大阪"} and len(both.sources) == 6
    (all_,) = U.automatic_integrations(*reversed(sheets({"東京": (1, 2, 3), "大阪": (4, 5, 6), "京都": (5, 7, 30)})))
    assert len(all_.sources) == 9
    assert len(U.automatic_integrations(derived, tables, two_axes=False)) == 3  # each sheet's own stays


def test_sums_within_five_percent():
    ps = [U.Proposal(s, "", (), ()) for s in "abc"]
    left = lambda a, b, c: [p.source for p in U.without_summary(ps, {"a": a, "b": b, "c": c})]
    assert left(10, 20, 30) == left(10, 20, 31.5) == ["a", "b"] and left(10, 20, 32) == left(0, 0, 0) == ["a", "b", "c"]
    assert left(0, 20, 20) == ["a", "b", "c"]  # two add up the rest, fewer than two would stay
    assert U.without_summary(ps[:2], {"a": 1, "b": 1}) == ps[:2]


def test_clipped_by_siblings(spark):
    df = spark.createDataFrame([(0, 1)], "__row long, n long")
    ts = [Table(i, i[0], i, df) for i in ("A1", "A2", "AD", "B1", "B2", "BD")]
    ask = lambda *ids: Recommendation(ids, ("a",), tuple((i,) for i in ids))
    siblings = [frozenset({"A1", "A2"}), frozenset({"B1", "B2"})]
    got = U.clip([ask("A1", "AD", "A2"), ask("A1", "A2", "AD", "B1", "B2", "BD"), ask("AD", "BD"), ask("A1", "AD"), ask("A1", "A2")], siblings, ts)
    assert [r.sources for r in got] == [("A1", "A2"), ("A1", "A2", "B1", "B2"), ("AD", "BD"), ("A1", "AD"), ("A1", "A2")]
    assert got[0].values == (("A1",), ("A2",))
    assert U.clip([ask("A1", "AD")], [frozenset({"A1"})], ts) == [ask("A1", "AD")] and U.clip([], [], ts) == []


def test_proposed_with_the_rest(spark, sheets):
    tables, _ = sheets({"東京": (10, 20, 30), "大阪": (40, 50, 60)})
    out = propose(spark, tables)
    (union,) = [f for f in out.values() if f.is_integrated and "シート" in f.frame.columns and "latent_0" in f.sources]
    assert len(rows(union.frame)) == 12
    assert sorted(r[3] for r in rows(union.frame) if r[0] == "その他") == [30, 60, 60, 120]
