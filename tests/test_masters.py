"""Masters of axes by votes, their siblings and cycles, and groups of like recommendations."""

from __future__ import annotations

import random

from gridloom.operators import derive as U
from gridloom.operators.relate import Recommendation, Table


def tables(spark, *names):
    df = spark.createDataFrame([(0, 1)], "__row long, n long")
    return [Table(f"t{i}", sheet, title, df) for i, (sheet, title) in enumerate(names)]


def test_votes(spark):
    ts = tables(spark, ("東京", "売上"), ("大阪", "売上"), ("京都", "原価"))
    assert U.axis_kind(["東京", "大阪", "原価"], ts) == "sheet"  # two to one
    assert U.axis_kind(["売上", "大阪", "原価"], ts) == "title"
    assert U.axis_kind(["東京", "売上", ""], ts) == "sheet" and U.axis_kind(["x", "", "y"], ts) == "sheet"


def test_specs(spark):
    ts = tables(spark, ("東京", "売上"), ("大阪", "売上"), ("全社", "売上"), ("東京", "総計"))
    asked = Recommendation(("t0", "t1"), ("支店", "種別"), (("東京", "売上"), ("", "売上")), "t2")
    (spec,) = U.master_specs(asked, ts)
    assert spec == U.MasterSpec("支店", "上位支店", (("大阪", "全社"), ("東京", "全社")), "t2")
    assert sorted(map(tuple, spec.frame(spark).collect())) == [("大阪", "全社"), ("東京", "全社")]
    assert U.master_specs(Recommendation(("t0", "t1"), ("支店",), (("東京",), ("大阪",)), "t3"), ts) == []  # on a child's sheet
    (titles,) = U.master_specs(asked, ts, [None, "t3"], [None, "全体"])[1:]
    assert titles == U.MasterSpec("種別", "全体", (("売上", "総計"),), "t3")
    assert [s.axis for s in U.master_specs(asked, ts, ["t2", "t2"])] == ["支店"]  # the parent has the children's title
    assert U.master_specs(Recommendation(("t0", "gone"), ("支店",), (("東京",), ("x",)), "t2"), ts) == []
    assert U.master_specs(Recommendation(("t0", "t1"), ("支店",), (("東京",), ("大阪",)), None), ts) == []


def test_cycles():
    a = U.MasterSpec("x", "y", (("p", "q"), ("s", "q")), "t")
    b = U.MasterSpec("y", "z", (("q", "r"),), "u")
    back = U.MasterSpec("z", "x", (("r", "p"),), "v")
    assert U.without_cycles([a, b]) == [a, b]
    assert U.without_cycles([a, b, back]) == [U.MasterSpec("x", "y", (("s", "q"),), "t")]
    assert U.without_cycles([U.MasterSpec("x", "y", (("p", "p"),), "t")]) == []


def test_groups_of_500_tables(spark):
    rng = random.Random(3)
    schemas = [["a", "b"], ["b", "a"], ["a", "b", "c"], ["c"]]
    frames = [spark.createDataFrame([(0, *range(len(s)))], ", ".join(["__row long", *(f"{c} long" for c in s)])) for s in schemas]
    pick = [rng.randrange(4) for _ in range(500)]
    ts = [Table(f"t{i}", "s", "t", frames[k]) for i, k in enumerate(pick)]
    found = [Recommendation((f"t{i}", f"t{i + 1}") if i % 9 else ("gone", f"t{i}"), tuple(rng.choice([["x"], ["y"], ["x", "y"]])), ((), ())) for i in range(499)]
    groups = U.group_similar(found, ts)
    like = lambda r: (sorted({*r.axes, *schemas[pick[int(next(s for s in r.sources if s != "gone")[1:])]]}))
    for g in groups:
        assert all(like(r) == like(g[0]) for r in g) and [found.index(r) for r in g] == sorted(found.index(r) for r in g)
    assert sum(map(len, groups)) == 499 and len({str(like(g[0])) for g in groups}) == len(groups)
    assert U.group_similar([], ts) == []
