"""Choosing among final tables: groups, badges and previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import ROW, data_columns


def selection_group() -> Column:
    """integrated, minimum, master, recommended or other: the first that holds."""
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    return F.when(on("is_integrated"), "integrated").when(on("is_minimum"), "minimum").when(on("is_master"), "master").when(on("recommended"), "recommended").otherwise("other")


def granularity_badge() -> Column:
    return F.when(F.coalesce(F.col("is_master"), F.lit(False)), "master").otherwise(F.coalesce(F.col("granularity"), F.lit("unknown")))


def by_column_set(frames: dict[str, DataFrame]) -> dict[frozenset[str], list[str]]:
    """Tables by their set of columns, whatever their order."""
    out: dict[frozenset[str], list[str]] = {}
    for name, frame in frames.items():
        out.setdefault(frozenset(data_columns(frame)), []).append(name)
    return out


def head(df: DataFrame, n: int, columns: int = 20) -> DataFrame:
    """The first rows as text."""
    return df.orderBy(ROW).limit(n).select(*[F.col(f"`{c}`").cast("string").alias(c) for c in data_columns(df)[:columns]])


def tail(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(F.desc(ROW)).limit(n).orderBy(ROW).drop(ROW)
