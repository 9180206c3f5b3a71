"""Steps switched off and on, chosen anew and undone; parts that recur in names."""

from __future__ import annotations

import random

from .conftest import rows

from gridloom.operators import reshape as R
from gridloom.plans.steps import Plan, Step


def test_drop_and_restore_keep_the_order(frame):
    df = frame([("a", "x", None, 1), ("b", "y", None, 2)], "k string, note string, empty string, n long")
    plan = Plan(df, (Step("drop"),))
    assert plan.frame.columns == ["__row", "k", "note", "n"] and plan.original is df
    more = plan.choose(0, names=["note"])
    assert more.frame.columns == ["__row", "k", "empty", "n"] and more.version == 2
    back = more.toggle(0)
    assert back.frame.columns == df.columns and back.replay()[1] == ("off",) and back.toggle(0).frame.columns == ["__row", "k", "empty", "n"]
    assert back.undo().undo().frame.columns == plan.frame.columns and plan.undo() is plan
    assert Plan(df, (Step("drop", '{"names": ["k", "note", "empty", "n"]}'),)).replay()[1] == ("skipped",)


def test_a_split_can_be_taken_back(frame):
    df = frame([("東京 / 千代田", 1), ("大阪 / 北", 2), ("京都 / 中京", 3)], "都道府県 / 市区名 string, n long")
    plan = Plan(df, (Step("split"), Step("fill"), Step("drop", '{"names": ["市区名"]}')))
    assert plan.frame.columns == ["__row", "都道府県", "n"]
    off = plan.toggle(0, False)
    assert off.frame.columns == df.columns and off.replay()[1][0] == "off" and off.replay()[1][2] == "skipped"
    assert off.toggle(0, True).frame.columns == ["__row", "都道府県", "n"]
    assert plan.choose(0, columns=[]).frame.columns == df.columns


def test_pivot_choices_and_what_follows(frame):
    data = [(k, a, i) for i, k in enumerate("pqr") for a in ("x", "y", "z")] + [("s", a, 9) for a in ("x", "y")]
    df = frame(data, "key string, attr string, v long")
    plan = Plan(df, (Step("pivot"), Step("drop", '{"names": ["y"]}')))
    assert plan.frame.columns == ["__row", "key", "x", "z"]
    top = plan.choose(0, decision=["limit", 2])
    assert top.frame.columns == ["__row", "key", "x"] and top.replay(1)[0].columns == ["__row", "key", "x", "y"]
    assert plan.choose(0, decision="cancel").frame.columns == df.columns and plan.choose(0, decision="cancel").replay()[1] == ("skipped", "skipped")
    assert len(rows(top.frame)) == 4


def test_held_pivots_wait(frame, monkeypatch):
    monkeypatch.setattr(R, "PIVOT_LIMIT", 1)
    df = frame([(k, a, 1) for k in "pq" for a in ("x", "y")], "key string, attr string, v long")
    plan = Plan(df, (Step("pivot"), Step("drop", '{"names": ["key"]}')))
    assert plan.replay()[1] == ("held", "waits") and plan.frame.columns == df.columns
    assert plan.choose(0, decision="continue").frame.columns == ["__row", "x", "y"]


def test_only_what_follows_is_made_again(frame):
    df = frame([("a", 1), ("b", 2)], "k string, n long")
    plan = Plan(df, (Step("fill"), Step("drop", '{"names": ["n"]}')))
    plan.frame
    first = plan._made[plan.steps[:1]][0]
    other = plan.toggle(1)
    assert other.frame.columns == df.columns and other._made[other.steps[:1]][0] is first


def test_saved_steps(frame):
    df = frame([("東京", 1, 2), ("大阪", 3, 4), ("合計", 4, 6)], "支店 string, 2023年 long, 2024年 long")
    plan = Plan(df).toggle(Plan(df).place("stack"), False)
    again = Plan.load(df, plan.save())
    assert again.steps == plan.steps and again.version == 2 and rows(again.frame) == rows(plan.frame) == [("東京", 1, 2), ("大阪", 3, 4)]
    stacked = again.toggle(again.place("stack"))
    assert stacked.frame.columns[-2] == "年" and sorted(rows(stacked.frame)) == [("大阪", "2023年", 3), ("大阪", "2024年", 4), ("東京", "2023年", 1), ("東京", "2024年", 2)]


def slow(names, side):
    cut = (lambda s, k: s[:k]) if side == "head" else (lambda s, k: s[k:])
    counts = {}
    for s in names:
        for part in {cut(s, k) for k in range(2, len(s) - 1)}:
            counts[part] = counts.get(part, 0) + 1
    out = {}
    for s in names:
        fit = [p for p, n in counts.items() if n >= 2 and (s.startswith(p) if side == "head" else s.endswith(p))]
        if fit:
            best = max(fit, key=len)
            rest = (s[len(best) :] if side == "head" else s[: len(s) - len(best)]).strip("_- 　")
            if rest:
                out[s] = (best, rest)
    return out if len(out) >= 2 else {}


def test_recurring_parts():
    names = [p + q for p in ("ゴールド", "シルバー", "ブロンズ") for q in ("会員数", "売上高")]
    assert {a for a, _ in R.recurring_parts(names).values()} == {"ゴールド", "シルバー", "ブロンズ"}
    ends = R.recurring_parts(["ab会員", "cd会員", "ef売上", "gh売上"])
    assert ends == {"ab会員": ("会員", "ab"), "cd会員": ("会員", "cd"), "ef売上": ("売上", "ef"), "gh売上": ("売上", "gh")}
    assert R.recurring_parts([]) is None and R.recurring_parts(["abcd", "efgh"]) is None
    rng = random.Random(4)
    for _ in range(400):
        names = list({"".join(rng.choice("ab_") for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(1, 12))})
        heads, tails = slow(names, "head"), slow(names, "tail")
        assert (R.recurring_parts(names) or {}) == (tails if len(tails) > len(heads) else heads)
