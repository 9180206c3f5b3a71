"""Names of columns and tables: uniqueness, axis and value names, collisions, and the Namer.

A Namer answers questions that need judgement. The default answers none, so every operator has a
result without one.
"""

from __future__ import annotations

import os
from collections.abc import Iterable
from difflib import SequenceMatcher

from .. import dicts as D
from ..functions import labels as L


class Namer:
    """Judgements a caller may plug in; None means "no opinion"."""

    def transpose(self, sample: list[dict]) -> str | None:
        return None

    def dimension_axes(self, values: list[list[str]]) -> dict | None:
        return None

    def category_axis(self, tokens: list[str]) -> str | None:
        return None

    def value_name(self, title: str | None) -> str | None:
        return None

    def collision(self, name: str) -> tuple[str, str] | None:
        return None

    def external_metadata(self, file: str, sheet: str) -> list[dict]:
        return []

    def axis_position(self, labels: list[str]) -> tuple[str, str] | None:
        return None

    def annotation_names(self, candidates: list[str]) -> dict[str, str] | None:
        return None

    def level_names(self, paths: list[list[str]]) -> list[str] | None:
        return None


def unique_name(name: str, existing: Iterable[str], exclude: str | None = None) -> str:
    """name, or name_1, name_2, ... if it is taken."""
    taken = set(existing) - {exclude}
    if name not in taken:
        return name
    k = 1
    while f"{name}_{k}" in taken:
        k += 1
    return f"{name}_{k}"


def unique_columns(names: list[str | None]) -> list[str]:
    """Empty headers get a placeholder, repeated ones a number."""
    seen: dict[str, int] = {}
    out = []
    for raw in names:
        name = D.EMPTY_HEADER if raw is None or not str(raw).strip() else str(raw)
        k = seen.get(name, 0)
        seen[name] = k + 1
        out.append(name if not k else f"{name}_{k}")
    return out


def common_affix(tokens: list[str]) -> str | None:
    """The longest ending or else beginning that all tokens share; of equal length the ending."""
    if len(tokens) < 2:
        return None
    ahead = os.path.commonprefix(tokens)
    behind = os.path.commonprefix([t[::-1] for t in tokens])[::-1]
    best = behind if len(behind) >= len(ahead) else ahead
    best = best.strip(" _-　")
    return best if len(best) >= 2 and any(best != t for t in tokens) else None


def axis_name(tokens: list[str], namer: Namer | None = None) -> tuple[str, str]:
    """(name, where it came from) of an axis with these values."""
    kinds = [k for k in map(L.time_kind_name, tokens) if k]
    if kinds and len(kinds) == len(tokens):
        return L.time_axis_name(kinds) or D.TIME_FALLBACK, "dictionary"
    if affix := common_affix(tokens):
        return affix, "affix"
    if namer and (name := namer.category_axis(tokens)):
        return name, "namer"
    return (D.TIME_FALLBACK if kinds else "区分"), "fallback"


def value_name(title: str | None, namer: Namer | None = None) -> tuple[str, str]:
    for word in D.VALUE_KEYWORDS:
        if title and word in title:
            return word, "title"
    if namer and (name := namer.value_name(title)):
        return name, "namer"
    return D.VALUE_COLUMN, "fallback"


def resolve_collision(name: str, existing: Iterable[str], namer: Namer | None = None) -> tuple[str | None, str, str]:
    """(new name of the existing column or None, final name of the new one, source)."""
    if name not in set(existing):
        return None, name, "none"
    if namer and (pair := namer.collision(name)):
        return pair[0], pair[1], "namer"
    return unique_name(f"{name}_1", set(existing) | {name}), name, "fallback"


def resolve_generated(existing: list[str], names: list[str], namer: Namer | None = None) -> tuple[dict[str, str], list[str], list[dict]]:
    """(renames of existing columns, final new names, log) for columns an operator is about to add."""
    renames: dict[str, str] = {}
    final, log, taken = [], [], list(existing)
    for name in names:
        old, new, source = resolve_collision(name, taken, namer)
        if old:
            if name in final:  # of two new columns with one name the first gives way
                final[final.index(name)] = old
            else:
                renames[name] = old
            taken = [old if t == name else t for t in taken]
        if source != "none":
            log.append({"original_name": name, "existing_new_name": old, "new_col_final_name": new, "naming_source": source, "naming_reason": "a generated column has the name of an existing one"})
        final.append(new)
        taken.append(new)
    return renames, final, log


def infer_axis_name(values: list[str]) -> str:
    """Common beginning of names, else their longest common part, else a general word."""
    if len(values) >= 2:
        ahead = os.path.commonprefix(values).strip(" _-／/　")
        if len(ahead) >= 2:
            return ahead
        m = SequenceMatcher(None, values[0], values[1], autojunk=False).find_longest_match()
        part = values[0][m.a : m.a + m.size].strip(" _-／/　")
        if len(part) >= 2 and all(part in v for v in values):
            return part
    return "種別"


def strip_common_suffix(values: list[str]) -> list[str]:
    tail = os.path.commonprefix([v[::-1] for v in values])[::-1] if len(values) > 1 else ""
    return [v[: len(v) - len(tail)] if tail and len(tail) < len(v) else v for v in values]


def disambiguate(display: dict[str, tuple[str, str]]) -> dict[str, str]:
    """{id: (sheet, name)} to {id: name}, the sheet put before only where names collide and don't begin with it."""
    count: dict[str, int] = {}
    for _, name in display.values():
        count[name] = count.get(name, 0) + 1
    out = {}
    for key, (sheet, name) in display.items():
        if count[name] == 1:
            out[key] = name
        else:
            rest = name.split()
            out[key] = " ".join([sheet, *[t for i, t in enumerate(rest) if not (i == 0 and t == sheet)]]).strip()
    return out
