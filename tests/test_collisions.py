"""Columns that an operator adds under a name that the table has already."""

from __future__ import annotations

from .conftest import rows

from gridloom.operators import aggregates as A
from gridloom.operators import reshape as R


def test_annotations(frame):
    df = frame([("東京（速報）", "x", 1), ("大阪（確報）", "y", 2), ("計", "z", 3)], "支店 string, 注釈 string, n long")
    log = []
    out = R.split_annotations(df, {"支店": "注釈"}, log=log)
    assert out.columns[1:] == ["支店", "注釈", "注釈_1", "n"] and rows(out) == [("東京", "速報", "x", 1), ("大阪", "確報", "y", 2), ("計", "", "z", 3)]
    assert log[0]["original_name"] == "注釈" and log[0]["existing_new_name"] == "注釈_1" and log[0]["naming_source"] == "fallback"
    assert R.split_annotations(df, {"支店": "支店"}).columns[1:] == ["支店_1", "支店", "注釈", "n"]
    both = frame([("a（p）", "b（q）")], "x string, y string")
    assert rows(R.split_annotations(both, {"x": "note", "y": "note"})) == [("a", "p", "b", "q")] and len(set(R.split_annotations(both, {"x": "note", "y": "note"}).columns)) == 5


def test_of_which(frame):
    df = frame([("東京", "社員", 10), ("東京", "うち男", 6), ("東京", "うち女", 4), ("大阪", "社員", 5), ("大阪", "うち男", 2), ("大阪", "うち女", 3)], "親区分 string, 区分 string, 人数 long")
    log = []
    split = A.split_of_which(df, log=log)
    assert log[0]["original_name"] == "親区分" and log[0]["existing_new_name"] == "親区分_1"
    assert set(split.breakdown.columns) - {"__row"} == {"親区分_1", "親区分", "子区分", "人数"}
    assert {r["親区分_1"] for r in split.breakdown.collect()} == {"東京", "大阪"} and {r["親区分"] for r in split.breakdown.collect()} == {"社員"}
    assert split.main.count() == 2 and {r["status"] for r in split.checks.collect()} == {"PASS"}


def test_a_namer_sees_paths(frame):
    from gridloom.operators.naming import Namer
    from gridloom.operators.relate import Table
    from gridloom.plans import normalize as P

    class Asked(Namer):
        def level_names(self, paths):
            self.paths = paths
            return ["地方", "県"]

    df = frame([("関東", 0), ("  東京", 3), ("  千葉", 4), ("関西", 0), ("  大阪", 5), ("  京都", 6)], "地域 string, n long")
    namer = Asked()
    out = P.normalize(Table("t", "s", "t", df), P.Options(namer=namer)).frame
    assert namer.paths[:2] == [["関東"], ["関東", "東京"]] and {"地方", "県"} <= set(out.columns)
