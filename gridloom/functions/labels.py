"""Labels, units, times and notes as column expressions; `*_name` are the twins for column names.

Patterns carry the (?U) flag, so white space and digits are Unicode's; everything stays in the JVM.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dicts as D

WS = r"[\s\x{200B}\x{200C}\x{200D}\x{FEFF}]+"
_WS_PY = re.compile(r"[\s​‌‍﻿]+")
_NAMES_PY = {k: re.compile(p.replace("(?<", "(?P<")) for k, p in (("unit", D.UNIT_SUFFIX), ("brackets", D.TRAILING_BRACKETS))}
_JOINED = sorted({_WS_PY.sub("", k.lower()) for k in D.AGG_KEYWORDS}, key=lambda k: (-len(k), k))
_ENDS_AGG = "(" + "|".join(re.escape(k) for k in _JOINED) + ")$"
_OPEN, _CLOSE, _PUNCT = "(（", ")）", r"[\s、,，:：・\-－–―]*"


def one_of(words: list[str]) -> str:
    return "(" + "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w))) + ")"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    return c.isNull() | (F.length(strip(c.cast("string"))) == 0)


def norm_label(c: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(c, f"(?U){WS}", "")


def is_agg_label(c: Column) -> Column:
    """Whether a label is, or ends with, an aggregate word, trailing brackets aside."""
    plain, bare = norm_label(F.lower(c)), norm_label(F.lower(F.regexp_replace(c, f"(?U){D.TRAILING_BRACKETS}", "")))
    return F.coalesce(plain.rlike(_ENDS_AGG) | bare.rlike(_ENDS_AGG), F.lit(False))


def is_exact_agg(c: Column) -> Column:
    return F.coalesce(norm_label(F.lower(c)).isin([k.lower() for k in D.AGG_KEYWORDS]), F.lit(False))


def is_agg_name(name: str) -> bool:
    plain = _WS_PY.sub("", name.lower())
    bare = _WS_PY.sub("", _NAMES_PY["brackets"].sub("", name).lower())
    return bool(re.search(_ENDS_AGG, plain) or re.search(_ENDS_AGG, bare))


def agg_residual_name(name: str) -> str | None:
    """What stands before the aggregate word; "" for the bare word, None without one."""
    for text in (_WS_PY.sub("", name), _WS_PY.sub("", _NAMES_PY["brackets"].sub("", name))):
        for word in _JOINED:
            if text.lower().endswith(word):
                return text[: len(text) - len(word)]
    return None


def numeric_clean(c: Column) -> Column:
    """The number in a cell, thousands marks and triangles removed (their sign is not kept)."""
    return F.translate(c, ",、△▲", "").try_cast("double")


def is_numeric_cell(c: Column) -> Column:
    return F.coalesce(strip(c).isin(D.STAT_PLACEHOLDERS) | numeric_clean(strip(c)).isNotNull(), F.lit(False))


def is_na_marker(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c)).isin(D.STAT_NA_MARKERS), F.lit(False))


def time_kind(c: Column) -> Column:
    out = F.lit(None).cast("string")
    for pattern, kind, _ in reversed(D.TIME_PATTERNS):
        out = F.when(strip(c).rlike(f"(?Ui){pattern}"), F.lit(kind)).otherwise(out)
    return out


def time_kind_name(name: str) -> str | None:
    text = str(name).strip()
    return next((kind for pattern, kind, _ in D.TIME_PATTERNS if re.search(pattern, text, re.I)), None)


def time_axis_name(kinds: list[str]) -> str | None:
    names = {axis for _, kind, axis in D.TIME_PATTERNS if kind in kinds}
    return names.pop() if len(names) == 1 else None


def unit_parts(c: Column) -> tuple[Column, Column]:
    """(label, unit) of `label(unit)`; both null where there is no such suffix."""
    pattern = f"(?U){D.UNIT_SUFFIX}"
    hit = c.rlike(pattern)
    return F.when(hit, F.regexp_extract(c, pattern, 1)), F.when(hit, strip(F.regexp_extract(c, pattern, 2)))


def is_unit(c: Column) -> Column:
    bare = F.regexp_replace(F.lower(strip(c)), f"(?Ui){D.UNIT_PERIOD_SUFFIX}", "")
    return F.coalesce(bare.isin([u.lower() for u in D.UNIT_VOCAB]), F.lit(False))


def uchi_child(c: Column) -> Column:
    """The child of an "of which" label: prefix, prefix in brackets, or prefix and child in brackets; else null."""
    words, text = one_of(D.UCHI_PREFIXES), strip(c)
    forms = [rf"(?U)^{words}{_PUNCT}(.*\S)\s*$", rf"(?U)^[{_OPEN}]\s*{words}\s*[{_CLOSE}]{_PUNCT}(.*\S)\s*$", rf"(?U)^[{_OPEN}]\s*{words}{_PUNCT}([^{_CLOSE}]*[^\s{_CLOSE}])\s*[{_CLOSE}].*$"]
    return F.coalesce(*[F.when(text.rlike(p), F.nullif(F.regexp_replace(F.regexp_extract(text, p, 2), f"(?U){_PUNCT}$", ""), F.lit(""))) for p in forms])


def note_type(c: Column) -> Column:
    has = lambda words: F.coalesce(F.lower(c).rlike(one_of([w.lower() for w in words])), F.lit(False))
    return F.when(has(D.NOTE_AGGREGATION), "aggregation").when(has(D.NOTE_EXCLUSION), "exclusion").when(has(D.NOTE_REFERENCE), "reference").otherwise("general")


def entities(c: Column) -> Column:
    """Names in a note: quoted ones, bracketed ones, then what stands between delimiters; 2 to 60 characters, first ones first."""
    quoted = F.regexp_extract_all(c, F.lit("「([^」]+)」"), 1)
    bare = F.regexp_replace(F.regexp_replace(c, "「[^」]*」", ""), f"(?U){D.NOTE_AGG_SUFFIX}", "")
    inside = F.flatten(F.transform(F.regexp_extract_all(bare, F.lit("[（(]([^）)]+)[）)]"), 1), lambda x: F.split(x, D.ENTITY_SPLIT)))
    listed = F.split(F.regexp_replace(bare, "[（(][^）)]*[）)]", ""), D.ENTITY_SPLIT)
    trimmed = F.transform(F.concat(quoted, inside, F.when(F.size(listed) > 1, listed).otherwise(F.array().cast("array<string>"))), strip)
    return F.array_distinct(F.filter(trimmed, lambda x: F.length(x).between(2, 60)))


def year_in(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, f"({D.YEAR})", 1), F.lit(""))


def safe_filename(c: Column) -> Column:
    return F.translate(c, "/\\ ", "___")


def indent_width(c: Column) -> Column:
    """Leading white space, a full-width blank counting two."""
    lead = F.regexp_extract(c, r"(?U)^(\s*)", 1)
    return F.length(lead) + F.length(F.regexp_replace(lead, "[^　]", ""))
