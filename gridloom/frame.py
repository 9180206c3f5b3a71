"""Tables as DataFrames with a hidden row number, and one-pass column profiles.

A table's order of rows means something here (fills, records, parents), so each carries `__row`. A
window over it is partitioned by the table's key or, for one large table, by blocks of rows whose
results are carried over in a second, small step.
"""

from __future__ import annotations

import tempfile
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import labels as L

ROW = "__row"
BLOCK_ROWS = 1 << 18


def q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(q(name))


def with_rows(df: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """Numbers rows by the given columns, range-sorted, or else as they come; numbers may have gaps.

    The table is stored with them: another sort or shuffle would give the same rows other numbers.
    """
    if ROW in df.columns:
        return df
    if order_by:
        df = df.orderBy(*[col(c) for c in order_by])
    return stored(df.withColumn(ROW, F.monotonically_increasing_id()))


def stored(df: DataFrame) -> DataFrame:
    """The table, computed once: a checkpoint in the folder that spark.checkpoint.dir names, which executors share.

    Only where none is set and all runs in one process, as in tests, a temporary folder stands in.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-ckpt-"))
    return df.checkpoint().toDF(*df.columns)  # with columns of its own, so that it can be joined with what it came from


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("__")]


def is_text(df: DataFrame, name: str) -> bool:
    """Neither numeric nor boolean nor a time."""
    kind = df.schema[name].dataType
    return not isinstance(kind, (T.NumericType, T.BooleanType, T.TimestampType, T.TimestampNTZType, T.DateType))


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def number(df: DataFrame, name: str) -> Column:
    """A column's value as a double, null where it has none."""
    return col(name).cast("double") if is_numeric(df, name) else col(name).cast("string").try_cast("double")


@dataclass(frozen=True)
class Profile:
    rows: int
    nulls: int
    distinct: int
    numbers: int
    markers: int
    aggregates: int
    others: int
    blanks: int
    first_valid: int | None
    last_null: int | None


def profile(df: DataFrame, names: list[str]) -> dict[str, Profile]:
    """Exact profiles of the columns, in one aggregate job."""
    aggs: list[Column] = [F.count("*").alias("n")]
    for i, name in enumerate(names):
        c, s = col(name), col(name).cast("string")
        text = is_text(df, name)
        agg = L.is_agg_label(s) if text else F.lit(False)
        filled = c.isNotNull()
        aggs += [
            F.count_if(c.isNull()).alias(f"null{i}"), F.count_distinct(c).alias(f"distinct{i}"), F.count_if(s.try_cast("double").isNotNull() if text else filled).alias(f"number{i}"),
            F.count_if(L.is_na_marker(s) if text else F.lit(False)).alias(f"marker{i}"), F.count_if(agg & filled).alias(f"agg{i}"), F.count_if(filled & ~agg).alias(f"other{i}"),
            F.count_if(L.is_blank(c) if text else c.isNull()).alias(f"blank{i}"), F.min(F.when(filled, F.col(ROW))).alias(f"first{i}"), F.max(F.when(~filled, F.col(ROW))).alias(f"lastnull{i}"),
        ]
    r = df.agg(*aggs).first()
    return {name: Profile(r["n"], r[f"null{i}"], r[f"distinct{i}"], r[f"number{i}"], r[f"marker{i}"], r[f"agg{i}"], r[f"other{i}"], r[f"blank{i}"], r[f"first{i}"], r[f"lastnull{i}"]) for i, name in enumerate(names)}


def label_columns(df: DataFrame, found: dict[str, Profile]) -> list[str]:
    """Text columns of which less than half of the cells, markers aside, are numbers.

    Text that is all digits is a code: a column of nothing but numbers wouldn't have been read as text.
    """
    out = []
    for c in data_columns(df):
        p = found[c]
        real = p.rows - p.nulls - p.markers
        if is_text(df, c) and not (real > 0 and p.numbers / real >= 0.5 and p.numbers < p.rows - p.nulls):
            out.append(c)
    return out


def grouping_columns(names: list[str], found: dict[str, Profile]) -> list[str]:
    return [c for c in names if found[c].distinct / max(1, found[c].rows) < 0.5]


def order_parts(c: Column, kind) -> list[Column]:
    """The numbers of an order key, most significant first: after unpivots and unions it is nested (item, row)."""
    if kind.typeName() != "struct":
        return [c.cast("long")]
    return [x for f in kind.fields for x in order_parts(c[f.name], f.dataType)]


def row_block(df: DataFrame) -> Column:
    """The block of BLOCK_ROWS rows that a row is in; blocks sort as their rows do."""
    kind = df.schema[ROW].dataType
    if kind.typeName() == "array":
        kept, last = F.slice(ROW, 1, F.size(ROW) - 1), F.element_at(ROW, -1)
        return F.concat(kept, F.array(F.floor(last / BLOCK_ROWS)))
    if kind.typeName() == "struct" and kind.fields[-1].dataType.typeName() == "array":
        rows = F.col(f"{ROW}.{kind.fields[-1].name}")
        return F.struct(*[F.col(f"{ROW}.{f.name}") for f in kind.fields[:-1]], F.concat(F.slice(rows, 1, F.size(rows) - 1), F.array(F.floor(F.element_at(rows, -1) / BLOCK_ROWS))).alias("block"))
    *before, last = order_parts(F.col(ROW), kind)
    if not before:
        return F.floor(last / BLOCK_ROWS)
    return F.struct(*[b.alias(f"b{i}") for i, b in enumerate(before)], F.floor(last / BLOCK_ROWS).alias("block"))


def previous(df: DataFrame, values: dict[str, Column], keys: list[str], including: bool = True) -> DataFrame:
    """Adds, for each alias, the last non-null value up to (or before) each row within its keys.

    With keys, one window. Without, rows go by blocks of BLOCK_ROWS and what a block ends with is
    carried on over one row a block, so no task sees the whole table.
    """
    end = 0 if including else -1
    if keys:
        w = Window.partitionBy(*[col(k) for k in keys]).orderBy(ROW).rowsBetween(Window.unboundedPreceding, end)
        return df.withColumns({a: F.last(v, ignorenulls=True).over(w) for a, v in values.items()})
    marked = df.withColumns({"__block": row_block(df), **{f"__v_{a}": v for a, v in values.items()}})
    inner = Window.partitionBy("__block").orderBy(ROW).rowsBetween(Window.unboundedPreceding, end)
    ends = marked.groupBy("__block").agg(*[F.max_by(F.col(f"__v_{a}"), F.when(F.col(f"__v_{a}").isNotNull(), F.col(ROW))).alias(f"__e_{a}") for a in values])
    over = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    carried = ends.select("__block", *[F.last(f"__e_{a}", ignorenulls=True).over(over).alias(f"__c_{a}") for a in values])
    joined = marked.withColumns({a: F.last(f"__v_{a}", ignorenulls=True).over(inner) for a in values}).join(carried, "__block", "left")
    return joined.withColumns({a: F.coalesce(F.col(a), F.col(f"__c_{a}")) for a in values}).drop("__block", *[f"__v_{a}" for a in values], *[f"__c_{a}" for a in values])
