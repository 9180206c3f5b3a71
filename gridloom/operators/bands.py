"""Rows of a sheet to bands of titles, headers, data and notes, by a state machine that runs in parallel.

The machine reads a sheet's rows in order, but a sheet of any length is cut into blocks of rows, and every block
runs at once. What a block needs of the rows before it is a small `State`. A first run assumes that nothing came
before; it gives a `Summary`: where the block leads from that state, and whether that holds for other column
extents too. A walk over a sheet's summaries (one row a block, not its rows) then composes them, and asks for
another run of those blocks whose state turned out otherwise, all in one job, with composed guesses for
what isn't known yet. This repeats until every block ran from the state that it has. Each round settles at least
one more block, and as a rule all: a band's extents stop growing within its first block.

Blocks report events, small rows that name a band by its number in the sheet. Header or data rows of a band that
follow one another, but for empty rows, make one event, so a band has few, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, fields, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import stored

#: Rows of a block.
BLOCK = 1 << 15
KEYS = ["file", "sheet"]
ROWS = "file string, sheet string, r int, kind string, c_min int, c_max int, text string, values array<struct<c: int, v: string>>"
#: open: a band, with the columns and number of its titles' group; title: a row of a group of titles, whose number is in
#: band; header, data: n rows of a band from r0 to r1; note: of the band; close: a band's last row; end: of a block.
EVENTS = "file string, sheet string, what string, band long, r0 int, r1 int, n int, c0 int, c1 int, text string"
_SPANS = "array<struct<first: int, last: int, n: int>>"
_REGION = ["file string", "sheet string", "region int", "band_start int", "band_end int", "c0 int", "c1 int", "title string", f"header_rows {_SPANS}", f"data_rows {_SPANS}", "notes array<string>"]
REGIONS = ", ".join(_REGION)
FAR = 1 << 30


@dataclass(frozen=True)
class State:
    """What rows so far leave behind.

    band: 0 none, 1 with one header row, 2 with more, 3 with data; low and high are its columns, as those of titles
    that wait for a band are p_low and p_high. last is the last row that isn't empty; opened and groups count bands,
    and groups of titles that are done with.
    """

    band: int = 0
    low: int = FAR
    high: int = 0
    pending: bool = False
    p_low: int = FAR
    p_high: int = 0
    last: int = 0
    opened: int = 0
    groups: int = 0

    def control(self, first: int) -> tuple:
        """What decides how rows from the given one on are read; counts don't."""
        return (self.band, self.low, self.high, self.pending, self.p_low, self.p_high, min(first - self.last, 6))

    def shape(self, first: int) -> tuple:
        return (self.band, self.pending, min(first - self.last, 6))


@dataclass(frozen=True)
class Summary:
    """From `before` a block leads to `after`, whose column extents are those of the block's own rows.

    fixed: a test of column extents took part of `before`'s, so this holds for no other extents; else it does.
    keeps_band, takes_pending and keeps_pending say which of them go into the band and titles at the end.
    """

    first: int
    before: State
    after: State
    fixed: bool
    keeps_band: bool
    takes_pending: bool
    keeps_pending: bool

    def follow(self, state: State) -> State:
        """Where another state of the same shape leads, exactly if not fixed."""
        low, high, p_low, p_high = self.after.low, self.after.high, self.after.p_low, self.after.p_high
        for used, a, b in ((self.keeps_band, state.low, state.high), (self.takes_pending, state.p_low, state.p_high)):
            if used and self.after.band:
                low, high = min(low, a), max(high, b)
        if self.keeps_pending and self.after.pending:
            p_low, p_high = min(p_low, state.p_low), max(p_high, state.p_high)
        opened, groups = (getattr(state, k) + getattr(self.after, k) - getattr(self.before, k) for k in ("opened", "groups"))
        return replace(self.after, low=low, high=high, p_low=p_low, p_high=p_high, opened=opened, groups=groups)


def like_data(low: int, high: int, c_min: int, c_max: int, values: Iterable) -> bool:
    """A header-like row amid data that is data after all: narrow, sparse, or full with varied values."""
    width = high - low + 1
    inside = [str(v["v"]) for v in values if low <= v["c"] <= high]
    density = len(inside) / width
    return (c_max - c_min + 1) / width < 0.5 or density < 0.3 or (density >= 0.9 and (width <= 4 or len(set(inside)) / len(inside) >= 0.5))


class Machine:
    """Reads rows that aren't empty, in order."""

    def __init__(self, state: State) -> None:
        self.before, self.s, self.events = state, state, []
        self.fixed, self.keeps_band, self.takes_pending, self.keeps_pending = False, state.band > 0, False, state.pending
        self.own, self.own_p = (FAR, 0), (FAR, 0)  # extents without what was there before
        self.first: int | None = None

    def _set(self, **new) -> None:
        self.s = replace(self.s, **new)

    def _event(self, what: str, band: int, r: int, c0: int | None = None, c1: int | None = None, text: str | None = None) -> None:
        e = self.events[-1] if self.events else None
        if what in ("header", "data") and e and e[0] == what and e[1] == band:
            e[3:7] = r, e[4] + 1, min(e[5], c0), max(e[6], c1)
        else:
            self.events.append([what, band, r, r, 1, c0, c1, text])

    def _forget(self) -> None:
        if self.s.pending:
            self._set(pending=False, p_low=FAR, p_high=0, groups=self.s.groups + 1)
            self.keeps_pending, self.own_p = False, (FAR, 0)

    def _close(self, end: int) -> None:
        self._event("close", self.s.opened, end)
        self._set(band=0, low=FAR, high=0)
        self.keeps_band = self.takes_pending = False
        self.own = (FAR, 0)

    def _widen(self, c_min: int, c_max: int) -> None:
        self._set(low=min(self.s.low, c_min), high=max(self.s.high, c_max))
        self.own = (min(self.own[0], c_min), max(self.own[1], c_max))

    def _wait(self, r: int, c_min: int, c_max: int, text: str) -> None:
        self._event("title", self.s.groups, r, c_min, c_max, text)
        self._set(pending=True, p_low=min(self.s.p_low, c_min), p_high=max(self.s.p_high, c_max))
        self.own_p = (min(self.own_p[0], c_min), max(self.own_p[1], c_max))

    def _open(self, r: int) -> None:
        if self.s.band == 0:
            self._set(opened=self.s.opened + 1)
            self._event("open", self.s.opened, r, self.s.p_low if self.s.pending else None, self.s.p_high if self.s.pending else None, str(self.s.groups) if self.s.pending else None)
            if self.s.pending:
                self.takes_pending = self.keeps_pending
                self._set(low=min(self.s.low, self.s.p_low), high=max(self.s.high, self.s.p_high))
                self.own = (min(self.own[0], self.own_p[0]), max(self.own[1], self.own_p[1]))
                self._forget()

    def read(self, r: int, kind: str, c_min: int, c_max: int, text: str | None, values: Iterable | None) -> None:
        self.first = r if self.first is None else self.first
        gap = r - self.s.last - 1
        if gap >= 2 and self.s.band >= 2:
            self._close(self.s.last)
            self._forget()
        elif gap >= 5:
            self._forget()
        self._set(last=r)
        if kind == "title":
            if self.s.band >= 2:
                self._close(r - 1)
                self._forget()
            self._wait(r, c_min, c_max, text)
        elif kind == "col_hdr":
            if self.s.band == 3:
                self.fixed |= self.keeps_band or self.takes_pending
                if like_data(self.s.low, self.s.high, c_min, c_max, values):
                    self._event("data", self.s.opened, r, c_min, c_max)
                    self._widen(c_min, c_max)
                    return
                self._close(r - 1)
            self._open(r)
            self._event("header", self.s.opened, r, c_min, c_max)
            self._set(band=min(self.s.band + 1, 2))
            self._widen(c_min, c_max)
        elif kind == "note":
            if self.s.band == 3:
                self._close(r - 1)
                self._forget()
                self._event("note", self.s.opened, r, text=text)
            elif self.s.pending:
                self._wait(r, c_min, c_max, text)
            elif self.s.band == 0 and self.s.opened:
                self._event("note", self.s.opened, r, text=text)
        else:
            self._open(r)
            self._event("data", self.s.opened, r, c_min, c_max)
            self._set(band=3)
            self._widen(c_min, c_max)

    def read_all(self, pdf: pd.DataFrame) -> Machine:
        for x in pdf.sort_values("r").itertuples(index=False):
            self.read(int(x.r), x.kind, int(x.c_min), int(x.c_max), x.text, x.values)
        self._event("end", self.s.opened if self.s.band else 0, self.s.last)
        return self

    def summary(self) -> Summary:
        after = replace(self.s, low=self.own[0], high=self.own[1], p_low=self.own_p[0], p_high=self.own_p[1])
        return Summary(self.first, self.before, after, self.fixed, self.keeps_band, self.takes_pending, self.keeps_pending)


_NAMES = [f.name for f in fields(State)]
_STATE = [f"{n} {'boolean' if n == 'pending' else 'long'}" for n in _NAMES]
_FLAGS = ["fixed", "keeps_band", "takes_pending", "keeps_pending"]
SUMMARIES = ", ".join(["file string, sheet string, block int, first int", *(f"{side}_{x}" for side in ("before", "after") for x in _STATE), *(f"{x} boolean" for x in _FLAGS)])
STATES = ", ".join(["file string, sheet string, block int, todo boolean", *_STATE])


def _row(s: Summary) -> dict:
    return {"first": s.first, **{f"{side}_{k}": v for side in ("before", "after") for k, v in asdict(getattr(s, side)).items()}, **{x: getattr(s, x) for x in _FLAGS}}


def _summary(x) -> Summary:
    before, after = (State(*[(bool if n == "pending" else int)(getattr(x, f"{side}_{n}")) for n in _NAMES]) for side in ("before", "after"))
    return Summary(int(x.first), before, after, *[bool(getattr(x, f)) for f in _FLAGS])


def walk(blocks: dict[int, list[Summary]]) -> Iterator[tuple[int, State, bool]]:
    """(block, the state before it, whether it has yet to run from there) over a sheet's blocks in order.

    Until the first that has yet to run all states are right; from there on they are guesses.
    """
    state = State()
    for number in sorted(blocks):
        known = blocks[number]
        first = known[0].first
        right = next((s for s in known if s.before.control(first) == state.control(first) or (not s.fixed and s.before.shape(first) == state.shape(first))), None)
        yield number, state, right is None
        # else the latest run of the same shape, or the latest, as a guess
        guess = right or next((s for s in reversed(known) if s.before.shape(first) == state.shape(first)), known[-1])
        after = guess.follow(state)
        if right is None and guess.before.shape(first) != state.shape(first) and state.band and guess.after.band:
            after = replace(after, low=min(after.low, state.low), high=max(after.high, state.high))
        state = after


def assembled(found: list[list]) -> list[dict]:
    """The candidate tables that a short sheet's events make."""
    titles, notes, bands = {}, {}, {}
    for what, band, r0, r1, n, c0, c1, text in found:
        if what in ("title", "note"):
            (titles if what == "title" else notes).setdefault(band, []).append((r0, text))
        elif band:
            b = bands.setdefault(band, {"columns": [], "header": [], "data": [], "close": None, "end": None, "start": r0, "titles": None})
            b["columns"] += [c for c in (c0, c1) if c is not None]
            if what in ("header", "data"):
                b[what].append({"first": r0, "last": r1, "n": n})
            elif what == "open":
                b["titles"] = text
            else:
                b[what] = r0
    out = []
    for k, b in bands.items():
        if b["data"] or sum(x["n"] for x in b["header"]) >= 2:
            own = titles[int(b["titles"])] if b["titles"] else []
            out.append({"region": k - 1, "band_start": own[0][0] if own else b["start"], "band_end": b["close"] or b["end"], "c0": min(b["columns"]), "c1": max(b["columns"]), "title": " ".join(t for _, t in own), "header_rows": b["header"], "data_rows": b["data"], "notes": [t for _, t in notes.get(k, [])]})
    return out


def short_regions(rows: DataFrame) -> DataFrame:
    """Candidate tables of sheets that are read in one piece each."""

    def whole(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = assembled(Machine(State()).read_all(pdf).events)
        return pd.DataFrame([{"file": key[0], "sheet": key[1], **x} for x in found], columns=[c.split()[0] for c in _REGION])

    return rows.where("kind <> 'empty'").groupBy(*KEYS).applyInPandas(whole, REGIONS)


def events(rows: DataFrame, block_rows: int = BLOCK) -> DataFrame:
    """Events of every sheet, from rows as ROWS says; empty rows needn't be there. The rounds run at once."""
    rows = rows.where("kind <> 'empty'")
    cut = stored(rows.withColumn("block", F.floor((F.col("r") - 1) / block_rows).cast("int")))

    def run(key: tuple, pdf: pd.DataFrame, state: pd.DataFrame) -> Machine | None:
        if not len(state) or not len(pdf):
            return None
        x = next(state.itertuples(index=False))
        before = State(*[(bool if n == "pending" else int)(getattr(x, n)) for n in _NAMES])
        return Machine(replace(before, last=int(pdf["r"].min()) - 1) if before.last < 0 else before).read_all(pdf)

    def summarise(key: tuple, pdf: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        done = run(key, pdf, state)
        found = [{"file": key[0], "sheet": key[1], "block": key[2], **_row(done.summary())}] if done else []
        return pd.DataFrame(found, columns=[c.split()[0] for c in SUMMARIES.split(", ")])

    def report(key: tuple, pdf: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        done = run(key, pdf, state)
        return _named(key[0], key[1], done.events if done else [])

    def compose(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        known: dict[int, list[Summary]] = {}
        for x in pdf.sort_values(["block", "round"]).itertuples(index=False):
            known.setdefault(int(x.block), []).append(_summary(x))
        out = [{"file": key[0], "sheet": key[1], "block": b, "todo": todo, **asdict(s)} for b, s, todo in walk(known)]
        return pd.DataFrame(out, columns=[c.split()[0] for c in STATES.split(", ")])

    place = [*KEYS, "block"]
    start, midst = State(), State(band=3, last=-1)  # but for the first, blocks are taken to begin amid data
    first = {n: F.when(F.col("block") == 0, F.lit(getattr(start, n))).otherwise(F.lit(getattr(midst, n))).cast("boolean" if n == "pending" else "long") for n in _NAMES}
    todo, known, turn = stored(cut.select(*place).distinct().withColumns(first)), None, 0
    while True:
        new = cut.join(todo.select(*place), place, "left_semi").groupBy(*place).cogroup(todo.select(*place, *_NAMES).groupBy(*place)).applyInPandas(summarise, SUMMARIES).withColumn("round", F.lit(turn))
        known = stored(new if known is None else known.unionByName(new))
        states = stored(known.groupBy(*KEYS).applyInPandas(compose, STATES))
        todo, turn = states.where("todo"), turn + 1
        if todo.isEmpty():
            return cut.groupBy(*place).cogroup(states.groupBy(*place)).applyInPandas(report, EVENTS)


def _named(file: str, sheet: str, found: list[list]) -> pd.DataFrame:
    out = pd.DataFrame(found, columns=["what", "band", "r0", "r1", "n", "c0", "c1", "text"])
    out.insert(0, "sheet", sheet)
    out.insert(0, "file", file)
    return out.astype({k: "Int32" for k in ("r0", "r1", "n", "c0", "c1")})
