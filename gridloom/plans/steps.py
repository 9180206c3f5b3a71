"""A table's plan as a log of steps that can be switched off and on, chosen anew and undone.

A `Plan` holds the original frame and a tuple of `Step`s, data that can be written as JSON. Nothing is undone in
place: any change makes a new version, and what a version gives is a replay of its steps from the original, so
a column comes back where it was, and steps behind a changed one find what they apply to anew. Frames before a
changed step are kept and not made again. A step that finds nothing to do is skipped and says so.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import col, data_columns
from ..operators import aggregates, fill, reshape
from ..operators.naming import Namer


@dataclass(frozen=True)
class Step:
    """kind: a key of KINDS; choice: JSON text of what the user chose for it, {} for the step's own judgement."""

    kind: str
    choice: str = "{}"
    on: bool = True

    @property
    def chosen(self) -> dict:
        return json.loads(self.choice)


@dataclass(frozen=True)
class Context:
    namer: Namer
    title: str | None
    file: str | None


Work = Callable[[DataFrame, dict, Context], "DataFrame | str"]
KINDS: dict[str, Work] = {}


def kind(name: str) -> Callable[[Work], Work]:
    def add(f: Work) -> Work:
        KINDS[name] = f
        return f

    return add


@kind("pivot")
def _pivot(df: DataFrame, chosen: dict, context: Context) -> DataFrame | str:
    """decision: hold (of wide pivots), continue, cancel, or ["limit", n]."""
    info = reshape.detect_key_value(df)
    if info is None:
        return "skipped"
    decision = chosen.get("decision", "hold")
    if decision == "cancel":
        return "skipped"
    if isinstance(decision, list):  # a limit is a choice at any width
        ranked = [r["attribute"] for r in reshape.rank_attributes(df, info.attribute).limit(decision[1]).collect()]
        return reshape.pivot_key_value(df, reshape.limit_attributes(info, ranked, decision[1]))
    out = reshape.decide_pivot(df, info, decision)
    return "held" if out is None else out


@kind("drop")
def _drop(df: DataFrame, chosen: dict, context: Context) -> DataFrame | str:
    """names: columns to drop; without, those that are empty."""
    if "names" not in chosen:
        doomed = {x.name for x in fill.detect_invalid_columns(df) if x.selected}
    else:
        doomed = set(chosen["names"]) & set(data_columns(df))
    if not doomed or doomed >= set(data_columns(df)):
        return "skipped"
    return df.select(*[col(c) for c in df.columns if c not in doomed])


@kind("split")
def _split(df: DataFrame, chosen: dict, context: Context) -> DataFrame | str:
    """columns: those to split at their name's delimiter, of those that can be; without, all."""
    found = {c: parts for c, parts in reshape.detect_name_splits(df).items() if c in chosen.get("columns", [c])}
    return reshape.split_columns(df, found) if found else "skipped"


@kind("annotations")
def _annotations(df: DataFrame, chosen: dict, context: Context) -> DataFrame | str:
    """names: {column: name of its notes}; without, the Namer's."""
    found = reshape.detect_annotations(df)
    names = chosen.get("names") or (context.namer.annotation_names(found) if found else None) or {}
    names = {c: n for c, n in names.items() if c in found}
    return reshape.split_annotations(df, names, context.namer) if names else "skipped"


@kind("hierarchy")
def _hierarchy(df: DataFrame, chosen: dict, context: Context) -> DataFrame | str:
    """names: of the levels."""
    found = reshape.detect_hierarchy(df)
    if found is None:
        return "skipped"
    names = chosen.get("names") or reshape.level_names(found.column, found.depth)
    return aggregates.rollup_rows(reshape.expand_hierarchy(df, found, names), names)[0]


@kind("fill")
def _fill(df: DataFrame, chosen: dict, context: Context) -> DataFrame | str:
    out, filled = fill.fill_grouping_columns(df)
    return out if filled else "skipped"


@kind("of which")
def _of_which(df: DataFrame, chosen: dict, context: Context) -> DataFrame | str:
    found = aggregates.split_of_which(df)
    return found.main if found else "skipped"


@kind("aggregates")
def _aggregates(df: DataFrame, chosen: dict, context: Context) -> DataFrame | str:
    protected = F.col("__protected") if "__protected" in df.columns else None
    return aggregates.remove_aggregates(df, protected).frame.drop("__protected")


@kind("units")
def _units(df: DataFrame, chosen: dict, context: Context) -> DataFrame | str:
    found = reshape.split_units(df)
    return found.frame if found else "skipped"


@kind("stack")
def _stack(df: DataFrame, chosen: dict, context: Context) -> DataFrame | str:
    names = data_columns(df)
    if grid := reshape.detect_wide(names, context.namer):
        return reshape.stack_wide(df, grid, namer=context.namer)
    if cross := reshape.detect_cross_table(names, context.title, context.file, context.namer):
        return reshape.stack_cross_table(df, cross, namer=context.namer)
    return "skipped"


@kind("transpose")
def _transpose(df: DataFrame, chosen: dict, context: Context) -> DataFrame | str:
    """name: of the column that gets the columns' names."""
    return reshape.transpose(df, chosen["name"]) if chosen.get("name") else "skipped"


#: The plan's own steps in their order.
STANDARD = ("pivot", "split", "annotations", "hierarchy", "fill", "of which", "aggregates", "units", "drop", "stack")


@dataclass(frozen=True)
class Plan:
    original: DataFrame
    steps: tuple[Step, ...] = tuple(Step(k) for k in STANDARD)
    namer: Namer = field(default_factory=Namer)
    title: str | None = None
    file: str | None = None
    version: int = 1
    before: Plan | None = None
    _made: dict[tuple[Step, ...], tuple[DataFrame, tuple[str, ...]]] = field(default_factory=dict, repr=False, compare=False)

    def _with(self, steps: tuple[Step, ...]) -> Plan:
        return replace(self, steps=steps, version=self.version + 1, before=self)

    def add(self, kind: str, at: int | None = None, **choice: object) -> Plan:
        """One more step, last or before the step at a place."""
        if kind not in KINDS:
            raise ValueError(f"no step {kind}")
        at = len(self.steps) if at is None else at
        return self._with((*self.steps[:at], Step(kind, json.dumps(choice, ensure_ascii=False, sort_keys=True)), *self.steps[at:]))

    def place(self, kind: str) -> int:
        return next(i for i, s in enumerate(self.steps) if s.kind == kind)

    def toggle(self, at: int, on: bool | None = None) -> Plan:
        step = self.steps[at]
        return self._with((*self.steps[:at], replace(step, on=not step.on if on is None else on), *self.steps[at + 1 :]))

    def choose(self, at: int, **choice: object) -> Plan:
        """Another choice for a step, which is thereby on."""
        return self._with((*self.steps[:at], Step(self.steps[at].kind, json.dumps(choice, ensure_ascii=False, sort_keys=True)), *self.steps[at + 1 :]))

    def undo(self) -> Plan:
        return self.before or self

    def replay(self, upto: int | None = None) -> tuple[DataFrame, tuple[str, ...]]:
        """(frame, what became of each step): applied, off, skipped, or held, after which nothing is done."""
        steps = self.steps[:upto]
        known = max((n for n in range(len(steps) + 1) if steps[:n] in self._made), default=0)
        df, told = self._made.get(steps[:known], (self.original, ()))
        for n in range(known, len(steps)):
            out: DataFrame | str = "off"
            if told and told[-1] in ("held", "waits"):
                out = "waits"
            elif steps[n].on:
                out = KINDS[steps[n].kind](df, steps[n].chosen, Context(self.namer, self.title, self.file))
            df, told = (df, (*told, out)) if isinstance(out, str) else (out, (*told, "applied"))
            self._made[steps[: n + 1]] = df, told
        return df, told

    @property
    def frame(self) -> DataFrame:
        return self.replay()[0]

    def save(self) -> str:
        return json.dumps({"version": self.version, "steps": [{"kind": s.kind, "choice": s.chosen, "on": s.on} for s in self.steps]}, ensure_ascii=False)

    @staticmethod
    def load(original: DataFrame, text: str, **more: object) -> Plan:
        saved = json.loads(text)
        steps = tuple(Step(s["kind"], json.dumps(s["choice"], ensure_ascii=False, sort_keys=True), s["on"]) for s in saved["steps"])
        return Plan(original, steps, version=saved["version"], **more)
