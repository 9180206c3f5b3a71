"""Forward fill of grouping columns and removal of columns that hold nothing."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dicts as D
from ..frame import ROW, col, data_columns, is_text, previous, profile
from ..functions import labels as L


def fill_grouping_columns(df: DataFrame, keys: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Fills text columns with an interior null downwards; aggregate labels don't flow into nulls.

    A column is filled only if fewer than half as many values as rows are distinct afterwards.
    """
    names = [c for c in data_columns(df) if is_text(df, c)]
    found = profile(df, names)
    wanted = [c for c in names if found[c].first_valid is not None and found[c].last_null is not None and found[c].last_null > found[c].first_valid]
    if not wanted:
        return df, []
    filled = previous(df, {f"__f{i}": col(c) for i, c in enumerate(wanted)}, keys or [])
    value = [F.when(col(c).isNull() & L.is_agg_label(F.col(f"__f{i}").cast("string")), F.lit(None)).otherwise(F.col(f"__f{i}")) for i, c in enumerate(wanted)]
    counts = filled.agg(F.count("*").alias("n"), *[F.count_distinct(v).alias(f"d{i}") for i, v in enumerate(value)]).first()
    kept = [i for i in range(len(wanted)) if counts[f"d{i}"] / max(1, counts["n"]) < 0.5]
    out = filled.withColumns({wanted[i]: value[i] for i in kept}) if kept else filled
    return out.select(*[col(c) for c in df.columns]), [wanted[i] for i in kept]


@dataclass(frozen=True)
class InvalidColumn:
    name: str
    reasons: tuple[str, ...]
    selected: bool


def detect_invalid_columns(df: DataFrame) -> list[InvalidColumn]:
    """Columns that are empty or have a placeholder name; empty ones are selected, the last of all is spared."""
    names = data_columns(df)
    found = profile(df, names)
    out = []
    for c in names:
        reasons = [r for r, yes in (("empty", found[c].blanks == found[c].rows), ("placeholder", bool(re.match(D.PLACEHOLDER_COLUMN, c.strip(), re.I)) or c.strip().lower() == "nan")) if yes]
        if reasons:
            out.append(InvalidColumn(c, tuple(reasons), "empty" in reasons))
    if out and len(out) == len(names) and all(x.selected for x in out):
        out[-1] = InvalidColumn(out[-1].name, out[-1].reasons, False)
    return out


def drop_invalid_columns(df: DataFrame, invalid: list[InvalidColumn] | None = None) -> DataFrame:
    doomed = {x.name for x in (detect_invalid_columns(df) if invalid is None else invalid) if x.selected}
    return df.select(*[col(c) for c in df.columns if c not in doomed])


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.na.drop(how="all", subset=[c for c in df.columns if c != ROW])
