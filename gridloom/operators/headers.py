"""Header rows: what each is, how they merge into names, and axes that they spell out. Lists of a few rows."""

from __future__ import annotations

import re

from .. import dicts as D
from ..functions import labels as L
from .reshape import HeaderAxes

Row = list
_JA, _EN = re.compile(r"[぀-ヿ㐀-鿿]"), re.compile(r"[A-Za-z]")
_UNITS = {u.lower() for u in D.UNIT_VOCAB}


def _filled(v: object) -> bool:
    return v is not None and str(v).strip() != ""


def is_unit_row(row: Row) -> bool:
    """Short texts, mostly units, or some units among few distinct values."""
    texts = [str(v).strip() for v in row if _filled(v)]
    if not texts or any(len(t) > 25 for t in texts):
        return False
    hits = sum(re.sub(D.UNIT_PERIOD_SUFFIX, "", t.lower(), flags=re.I) in _UNITS for t in texts)
    return hits / len(texts) >= 0.5 or (hits >= 1 and len(set(texts)) / len(texts) <= 0.4 and all(len(t) <= 15 for t in texts))


def header_roles(rows: list[Row], most: int = 12) -> tuple[int, list[str]]:
    """(title rows on top, role of each header row): unit or name."""
    present = [[v for v in row if v is not None] for row in rows]
    titles = 0
    while titles < len(rows) - 1:
        here = present[titles]
        if here and not (len(here) == 1 and isinstance(here[0], str)):
            break
        if not any(len(p) >= 2 for p in present[titles + 1 :]):
            break
        titles += 1
    body = present[titles:]
    if not body or not body[0] or sum(isinstance(v, str) for v in body[0]) / len(body[0]) < 0.5:
        return titles, []
    repeats = len(set(map(str, body[0]))) < len(body[0])
    roles: list[str] = []
    for row, here in zip(rows[titles : titles + most], body):
        numbers = sum(isinstance(v, (int, float)) and not isinstance(v, bool) for v in here)
        if not here or numbers / len(here) >= 0.4:
            break
        role = "unit" if is_unit_row(row) else "name"
        if roles and role == "name" and roles[-1] != "unit" and not repeats:
            break
        roles.append(role)
    return titles, roles if roles and roles[0] == "name" else []


def row_language(row: Row) -> str:
    texts = [str(v) for v in row if _filled(v)]
    for lang, pattern in (("ja", _JA), ("en", _EN)):
        if texts and sum(bool(pattern.search(t)) for t in texts) / len(texts) >= 0.5:
            return lang
    return "other"


def fill_header(row: Row) -> Row:
    out, last = [], None
    for v in row:
        last = v if _filled(v) else last
        out.append(last)
    return out


def row_kind(row: Row, positions: list[int]) -> str:
    values = [str(row[i]).strip() for i in positions if i < len(row) and _filled(row[i])]
    if not values:
        return "empty"
    if len(set(values)) == 1:
        return "constant"
    if sum(L.time_kind_name(v) is not None for v in values) / len(values) >= 0.8:
        return "time"
    return "irregular" if len(set(values)) > len(values) / 2 else "candidate"


def merge_headers(rows: list[Row], roles: list[str], width: int) -> tuple[list[str], list[int]]:
    """(names, rows used): a column's parts joined by _, each with the unit of the row right below it as `name [unit]`.

    Where units are given and languages mix, rows in another language than the first are left out; rows
    in none, such as years, stay. A unit under an empty cell goes to the next part, or else the last.
    """
    def cell(k: int, i: int) -> str:
        text = str(rows[k][i]).strip() if i < len(rows[k]) and _filled(rows[k][i]) else ""
        return "" if text.lower() == "nan" else text

    owned = {k for k in range(1, len(roles)) if roles[k] == "unit" and roles[k - 1] == "name"}
    heads = [k for k in range(len(roles)) if k not in owned]
    if "unit" in roles:
        language = {k: row_language(rows[k]) for k in heads}
        if clear := [x for x in language.values() if x != "other"]:
            heads = [k for k in heads if language[k] in (clear[0], "other")]
    names = []
    for i in range(width):
        parts, spare = [], ""
        for k in heads:
            name, unit = cell(k, i), cell(k + 1, i) if k + 1 in owned else ""
            if name:
                mark, spare = unit or spare, ""
                parts.append(f"{name} [{mark}]" if mark else name)
            else:
                spare = unit or spare
        if spare and parts and " [" not in parts[-1]:
            parts[-1] += f" [{spare}]"
        names.append("_".join(parts) or f"{D.EMPTY_HEADER}{i + 1}")
    return names, sorted(heads + [k + 1 for k in heads if k + 1 in owned])


def detect_axes(rows: list[Row], roles: list[str], names: list[str]) -> HeaderAxes | None:
    """Two axes or more that header rows spell over the data columns; None if any row is irregular."""
    kept = [fill_header(r) for r, role in zip(rows, roles) if role != "unit"]
    raw = [r for r, role in zip(rows, roles) if role != "unit"]
    if len(kept) < 2:
        return None
    labels = [i for i in range(len(names)) if not any(i < len(r) and _filled(r[i]) for r in raw)]
    data = [i for i in range(len(names)) if i not in labels]
    kinds = [row_kind(r, data) for r in kept]
    if not data or any(k == "irregular" for k in kinds):
        return None
    times = [k for k, kind in enumerate(kinds) if kind == "time"]
    rows_in = [k for k, kind in enumerate(kinds) if kind == "candidate" or (times and k == times[-1])]
    values = {k: [str(kept[k][i]).strip() for i in data] for k in rows_in}
    if times:
        leaf = len(set(values[times[-1]]))
        rows_in = [k for k in rows_in if k == times[-1] or len(set(values[k])) >= min(leaf, 2)]
    if len(rows_in) < 2 or len({tuple(values[k][j] for k in rows_in) for j in range(len(data))}) != len(data):
        return None
    unit_rows = [r for r, role in zip(rows, roles) if role == "unit"]
    units = {str(r[i]).strip() for r in unit_rows for i in data if i < len(r) and _filled(r[i])}
    return HeaderAxes(tuple(names[i] for i in labels), tuple(tuple(values[k]) for k in rows_in), tuple(names[i] for i in data), tuple(kinds[k] for k in rows_in), units.pop() if len(units) == 1 else None)


def redundant_rows(rows: list[Row], roles: list[str]) -> list[int]:
    """Header rows that say nothing of their own: constant or empty ones, and those coarser than the lowest row of times.

    Columns count over which a row above the last has something. None are given where a row is irregular, or where an
    axis stands beside times, as what is left then would not name columns.
    """
    if len(rows) < 2:
        return []
    filled = [fill_header(r) for r in rows]
    places = [i for i in range(len(rows[0])) if any(_filled(r[i]) for r in filled[:-1])] or list(range(len(rows[0])))
    kinds = {k: row_kind(filled[k], places) for k in range(len(rows)) if roles[k] != "unit"}
    if "irregular" in kinds.values():
        return []
    leaf = max((k for k, kind in kinds.items() if kind == "time"), default=None)
    distinct = {k: len({str(filled[k][i]).strip() for i in places if _filled(filled[k][i])}) for k in kinds}
    out = [k for k, kind in kinds.items() if kind in ("constant", "empty") or (leaf is not None and k != leaf and (kind == "time" or distinct[k] < distinct[leaf]))]
    return [] if leaf is not None and any(kind == "candidate" and k not in out for k, kind in kinds.items()) else out


def names_without(rows: list[Row], roles: list[str], dropped: list[int]) -> list[str] | None:
    """Names that the other header rows give, filled to the right; None if none are left."""
    left = [k for k in range(len(rows)) if k not in dropped]
    return merge_headers([fill_header(rows[k]) for k in left], [roles[k] for k in left], len(rows[0]))[0] if left else None
