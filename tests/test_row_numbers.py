"""Rows keep their numbers however often and in which columns a table is computed."""

from __future__ import annotations

import pytest

from gridloom.frame import ROW, with_rows
from gridloom.queries import QUERIES

#: Many ranges with bounds from few rows, so that each sort has its own, as on large tables.
RANGES = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.rangeExchange.sampleSizePerPartition": "5"}


@pytest.fixture
def ranges(spark):
    before = {k: spark.conf.get(k) for k in RANGES}
    for k, v in RANGES.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_with_rows(spark, ranges):
    df = spark.range(20000).selectExpr("id * 7919 % 20000 as id", "cast(id as string) as other").repartition(16)
    numbered = with_rows(df, ["id"])
    assert {r["id"]: r[ROW] for r in numbered.collect()} == {r["id"]: r[ROW] for r in numbered.select("id", ROW).where("id >= 0").collect()}


def test_grouping_ffill(spark, ranges, tmp_path):
    spark.range(20000).selectExpr("concat(id * 7919 % 5, '-P') as o_orderpriority", "id as o_orderkey", "cast(id as double) as o_totalprice").repartition(16).write.parquet(f"{tmp_path}/orders.parquet")
    got = {r["orderkey"]: (r["priority"], r["price"]) for r in QUERIES["grouping_ffill"](spark, str(tmp_path)).collect()}
    assert got == {i: (f"{i * 7919 % 5}-P", float(i)) for i in range(20000)}


def test_kv_pivot(spark, ranges, tmp_path):
    spark.range(60000).selectExpr("id * 7919 % 60000 div 3 as user_id", "element_at(array('click', 'view'), cast(1 + id % 2 as int)) as event_type").repartition(16).write.parquet(f"{tmp_path}/events.parquet")
    want = {}
    for i in range(60000):
        counts = want.setdefault(i * 7919 % 60000 // 3, {"click": None, "view": None})
        kind = ("click", "view")[i % 2]
        counts[kind] = (counts[kind] or 0) + 1
    got = QUERIES["kv_pivot"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {r["user_id"]: {"click": r["click"], "view": r["view"]} for r in got} == want
