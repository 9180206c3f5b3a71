"""Registered queries: each first makes a messy table from the given ones, then applies an operator to all of it.

ORACLE_SQL states the results independently. Floating sums are rounded to cents on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import dicts as D
from .frame import ROW, col, stored
from .functions import labels as L
from .operators import aggregates as A
from .operators import derive as U
from .operators import fill as FL
from .operators import formulas as FM
from .operators import grid as G
from .operators import relate as X
from .operators import reshape as R
from .operators import select as S
from .plans import normalize as P

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(df: DataFrame, *order: str | Column) -> DataFrame:
    """Rows in this order, numbered once: another sort draws other bounds, hence other numbers for the same rows."""
    return stored(df.orderBy(*order).withColumn(ROW, F.monotonically_increasing_id()))


def cents(c: Column) -> Column:
    return F.round(c, 2)


def _amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey)
    return joined.groupBy(F.col("o_orderpriority").alias("priority"), F.col("c_mktsegment").alias("segment")).agg(F.sum("o_totalprice").alias("amount"))


_AMOUNTS = "SELECT o_orderpriority AS priority, c_mktsegment AS segment, round(sum(o_totalprice), 2) AS amount FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL"


def _with_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _amounts(spark, sf_dir)
    totals = cells.groupBy("priority").agg(F.sum("amount").alias("amount")).select("priority", F.lit("合 計").alias("segment"), "amount")
    grand = cells.agg(F.sum("amount").alias("amount")).select(F.lit("総合計").alias("priority"), F.lit("Grand Total").alias("segment"), "amount")
    return grid(cells.unionByName(totals).unionByName(grand), "priority", "segment")


@query("agg_row_removal", _AMOUNTS)
def agg_row_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.remove_aggregates(_with_totals(spark, sf_dir)).frame
    return out.select("priority", "segment", cents(F.col("amount")).alias("amount"))


@query(
    "agg_row_audit",
    """WITH c AS (SELECT o_orderpriority AS p, sum(o_totalprice) AS a FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
    SELECT 'segment' AS trigger_column, p AS priority, '合 計' AS segment, round(a, 2) AS reported FROM c
    UNION ALL SELECT 'priority', '総合計', 'Grand Total', round(sum(a), 2) FROM c""",
)
def agg_row_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    audit = A.remove_aggregates(_with_totals(spark, sf_dir)).row_audit
    return audit.select(F.col("key").alias("trigger_column"), F.col("context")["priority"].alias("priority"), F.col("context")["segment"].alias("segment"), cents(F.col("reported_value")).alias("reported"))


@query(
    "integrity_check",
    """WITH d AS (SELECT c_mktsegment AS segment, sum(o_totalprice) AS s FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
    t AS (SELECT segment, s, s * CASE segment WHEN 'BUILDING' THEN 1.2 WHEN 'AUTOMOBILE' THEN 0.8 ELSE 1.0 END AS r FROM d)
    SELECT segment, round(r, 2) AS reported, round(s, 2) AS calculated, CASE WHEN abs(r - s) <= greatest(1e-6, abs(r) * 0.01) THEN 'PASS' ELSE 'FAIL' END AS status,
      CASE WHEN abs(r - s) <= greatest(1e-6, abs(r) * 0.01) THEN NULL WHEN s < r THEN '内訳あり（未表示項目）' ELSE '二重計上または単位ミス' END AS cause FROM t""",
)
def integrity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    details = _amounts(spark, sf_dir)
    factor = F.when(F.col("segment") == "BUILDING", 1.2).when(F.col("segment") == "AUTOMOBILE", 0.8).otherwise(1.0)
    totals = details.groupBy("segment").agg(F.sum("amount").alias("t")).select("segment", (F.col("t") * factor).alias("reported"))
    out = A.check_integrity(details, totals, ["segment"], "amount", "reported")
    return out.select("segment", cents(F.col("reported")).alias("reported"), cents(F.col("calculated")).alias("calculated"), "status", "cause")


def _by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, customer.c_nationkey == nation.n_nationkey)
    part = lambda s: F.coalesce(F.sum(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice"))), F.lit(0.0))
    return joined.groupBy(F.col("n_name").alias("nation")).agg(part("F").alias("F"), part("O").alias("O"), part("P").alias("P"), F.sum("o_totalprice").alias("合計"))


@query(
    "agg_col_removal",
    """SELECT n_name AS nation, round(coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 0), 2) AS f, round(coalesce(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 0), 2) AS o,
    round(coalesce(sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END), 0), 2) AS p FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""",
)
def agg_col_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.remove_aggregates(grid(_by_status(spark, sf_dir), "nation")).frame.drop(ROW)
    return out.select("nation", *[cents(F.col(c)).alias(c.lower()) for c in out.columns if c != "nation"])


@query("rollup_row_removal", "SELECT r_name AS region, n_name AS nation, CAST(count(*) AS BIGINT) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def rollup_row_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation, region = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = customer.join(nation, customer.c_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey)
    rolled = joined.rollup("r_name", "n_name").agg(F.count("*").alias("n")).where("r_name is not null")
    messy = grid(rolled.select(F.col("r_name").alias("region"), F.coalesce("n_name", F.lit("")).alias("nation"), "n"), "region", "nation")
    return A.rollup_rows(messy, ["region", "nation"])[0].drop(ROW)


@query("grouping_ffill", "SELECT o_orderpriority AS priority, o_orderkey AS orderkey, CAST(o_totalprice AS DOUBLE) AS price FROM orders")
def grouping_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A priority stands only in the first row of its run, over all orders."""
    orders = grid(table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice"), "o_orderpriority", "o_orderkey")
    first = orders.groupBy("o_orderpriority").agg(F.min(ROW).alias("__first")).withColumnRenamed("o_orderpriority", "__p")
    messy = orders.join(first, F.col(ROW) == F.col("__first"), "left").select(F.col("__p").alias("priority"), F.col("o_orderkey").alias("orderkey"), F.col("o_totalprice").cast("double").alias("price"), ROW)
    return FL.fill_grouping_columns(messy)[0].drop(ROW)


@query("of_which_split", "SELECT c_mktsegment AS parent, o_orderstatus AS child, CAST(count(*) AS BIGINT) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def of_which_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = A.split_of_which(_of_which(spark, sf_dir))
    return split.breakdown.select(F.col("親区分").alias("parent"), F.col("子区分").alias("child"), F.col("件数").alias("n"))


def _of_which(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey)
    rolled = joined.rollup("c_mktsegment", "o_orderstatus").agg(F.count("*").alias("件数")).where("c_mktsegment is not null")
    label = F.coalesce(F.concat(F.lit("（うち"), "o_orderstatus", F.lit("）")), F.col("c_mktsegment")).alias("区分")
    return grid(rolled, "c_mktsegment", F.col("o_orderstatus").asc_nulls_first()).select(label, "件数", ROW)


@query("of_which_main", "SELECT c_mktsegment AS label, CAST(count(*) AS BIGINT) AS n, TRUE AS is_parent FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def of_which_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.split_of_which(_of_which(spark, sf_dir)).main.select(F.col("区分").alias("label"), F.col("件数").alias("n"), F.col("__protected").alias("is_parent"))


@query("of_which_checks", "SELECT c_mktsegment AS label, CAST(count(*) AS DOUBLE) AS reported, CAST(count(*) AS DOUBLE) AS calculated, 'PASS' AS status FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def of_which_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.split_of_which(_of_which(spark, sf_dir)).checks.select(F.col("区分").alias("label"), "reported", "calculated", "status")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return grid(counts, "user_id", "event_type")


_TYPES = ("click", "error", "purchase", "signup", "view")
_EVENT_TYPES = "SELECT user_id, " + ", ".join(f"CAST(nullif(count(*) FILTER (event_type = '{t}'), 0) AS BIGINT) AS \"{t}\"" for t in _TYPES) + " FROM events GROUP BY 1"


@query("kv_pivot", _EVENT_TYPES)
def kv_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event type found, over all events."""
    rows = _events(spark, sf_dir)
    found = tuple(r["attribute"] for r in R.rank_attributes(rows, "event_type").collect())
    return R.pivot_key_value(rows, R.KeyValue(("user_id",), "event_type", "n", found, 0), fill=None).drop(ROW)


@query("kv_attr_rank", "SELECT event_type AS attribute, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1")
def kv_attr_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rank_attributes(_events(spark, sf_dir), "event_type").select("attribute", "n")


@query("kv_pivot_topn", "WITH t AS (SELECT event_type FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1 ORDER BY count(*) DESC, min(user_id), 1 LIMIT 2) SELECT user_id, CAST(count(DISTINCT event_type) AS BIGINT) AS kept, CAST(count(*) AS BIGINT) AS total FROM events WHERE event_type IN (SELECT event_type FROM t) GROUP BY 1")
def kv_pivot_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    info = R.detect_key_value(rows)
    ranked = [r["attribute"] for r in R.rank_attributes(rows, "event_type").limit(2).collect()]
    wide = R.pivot_key_value(rows, R.limit_attributes(info, ranked, 2), fill=None)
    cells = [F.col(a) for a in ranked]
    kept = cells[0].isNotNull().cast("long") + cells[1].isNotNull().cast("long")
    return wide.select("user_id", kept.alias("kept"), (F.coalesce(cells[0], F.lit(0)) + F.coalesce(cells[1], F.lit(0))).alias("total"))


@query("crosstab_stack", "SELECT o_orderstatus AS status, CAST(year(o_orderdate) AS VARCHAR) || '年' AS year, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY ALL")
def crosstab_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("y", F.concat(F.year("o_orderdate").cast("string"), F.lit("年")))
    years = [r[0] for r in orders.select("y").distinct().orderBy("y").collect()]
    wide = grid(orders.groupBy(F.col("o_orderstatus").alias("status")).pivot("y", years).agg(F.count(F.lit(1))), "status")
    wide = wide.withColumn("合計", sum((F.coalesce(col(y), F.lit(0)) for y in years), F.lit(0)))
    wide = A.remove_aggregates(wide).frame
    info = R.detect_cross_table([c for c in wide.columns if c != ROW])
    out = R.stack_cross_table(wide, info)
    return out.select("status", F.col("年").alias("year"), F.col("値").alias("n")).where("n is not null")


def _yearly(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    lines = table(spark, sf_dir, "lineitem").withColumn("y", F.year("l_shipdate").cast("string"))
    years = [r[0] for r in lines.select("y").distinct().orderBy("y").collect()]
    aggs = [x for y in years for x in (F.sum(F.when(F.col("y") == y, F.col("l_quantity"))).alias(f"{y}_qty"), F.sum(F.when(F.col("y") == y, F.col("l_extendedprice"))).alias(f"{y}_price"))]
    return grid(lines.groupBy(F.col("l_returnflag").alias("flag")).agg(*aggs), "flag"), years


@query("wide_to_long", "SELECT l_returnflag AS flag, CAST(year(l_shipdate) AS VARCHAR) AS year, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY ALL")
def wide_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide, _ = _yearly(spark, sf_dir)
    out = R.stack_wide(wide, R.detect_wide([c for c in wide.columns if c != ROW]))
    return out.select("flag", F.col("年").alias("year"), cents(F.col("qty")).alias("qty"), cents(F.col("price")).alias("price")).where("qty is not null")




@query("multi_axis_unpivot", "SELECT l_returnflag AS flag, l_linestatus AS status, CAST(year(l_shipdate) AS BIGINT) AS year, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY ALL")
def multi_axis_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    cells = [(f, s, m) for m in ("l_quantity", "l_extendedprice") for f in ("A", "N", "R") for s in ("F", "O")]
    aggs = [F.sum(F.when((F.col("l_returnflag") == f) & (F.col("l_linestatus") == s), F.col(m))).alias(f"c{i}") for i, (f, s, m) in enumerate(cells)]
    wide = grid(lines.groupBy(F.year("l_shipdate").cast("long").alias("year")).agg(*aggs), "year")
    measure = {"l_quantity": "qty", "l_extendedprice": "price"}
    info = R.HeaderAxes(("year",), (tuple(measure[m] for *_, m in cells), tuple(f for f, *_ in cells), tuple(s for _, s, _ in cells)), tuple(f"c{i}" for i in range(len(cells))), ("candidate",) * 3)
    out = R.stack_header_axes(wide, info, ["measure", "flag", "status"], "値", indicator=0)
    return out.select("flag", "status", "year", cents(F.col("qty")).alias("qty"), cents(F.col("price")).alias("price")).where("qty is not null")


_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query("transpose", " UNION ALL ".join(f"SELECT '{m}' AS metric, " + ", ".join(f"round(CAST({f} FILTER (c_mktsegment = '{s}') AS DOUBLE), 2) AS {s.lower()}" for s in _SEGMENTS) + " FROM customer" for m, f in (("n", "count(*)"), ("balance", "sum(c_acctbal)"))))
def transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = grid(table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").cast("double").alias("n"), F.sum("c_acctbal").alias("balance")), "segment")
    out = R.transpose(wide, "metric")
    return out.select("metric", *[cents(col(c)).alias(c.lower()) for c in out.columns if c not in (ROW, "metric")])


@query("col_split", "SELECT p_partkey AS partkey, p_brand AS brand, p_type AS kind FROM part")
def col_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    messy = grid(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("partkey"), F.concat_ws(" / ", "p_brand", "p_type").alias("brand / kind")), "partkey")
    return R.split_columns(messy, R.detect_name_splits(messy)).drop(ROW)


@query("paren_split", "SELECT c_custkey AS custkey, c_name AS name, c_mktsegment AS note FROM customer")
def paren_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    messy = grid(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), F.concat("c_name", F.lit("（"), "c_mktsegment", F.lit("）")).alias("name")), "custkey")
    return R.split_annotations(messy, {c: "note" for c in R.detect_annotations(messy)}).drop(ROW)


@query("hier_expand_delim", "SELECT r_name AS level1, n_name AS level2, s_name AS level3, CAST(s_acctbal AS DOUBLE) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def hier_expand_delim(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier, nation, region = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey)
    messy = grid(joined.select(F.concat_ws("＞", "r_name", "n_name", "s_name").alias("path"), F.col("s_acctbal").cast("double").alias("balance")), "path")
    return R.expand_hierarchy(messy, R.detect_hierarchy(messy), ["level1", "level2", "level3"]).drop(ROW)


@query(
    "hier_expand_indent",
    """SELECT r_name AS level1, '' AS level2, '' AS level3, CAST(0 AS DOUBLE) AS balance FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation JOIN supplier ON s_nationkey = n_nationkey)
    UNION ALL SELECT r_name, n_name, '', 0 FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)
    UNION ALL SELECT r_name, n_name, s_name, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def hier_expand_indent(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier, nation, region = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey)
    rolled = joined.rollup("r_name", "n_name", "s_name").agg(F.sum("s_acctbal").alias("b")).where("r_name is not null")
    label = F.coalesce(F.concat(F.lit("　　"), "s_name"), F.concat(F.lit("  "), "n_name"), F.col("r_name")).alias("name")
    messy = grid(rolled, "r_name", F.col("n_name").asc_nulls_first(), F.col("s_name").asc_nulls_first()).select(label, F.when(F.col("s_name").isNotNull(), F.col("b")).otherwise(0.0).cast("double").alias("balance"), ROW)
    return R.expand_hierarchy(messy, R.detect_hierarchy(messy), ["level1", "level2", "level3"]).drop(ROW)


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q"), F.sum("l_extendedprice").alias("p"), F.count("*").cast("double").alias("n"))
    parts = F.explode(F.array(*[F.struct(F.lit(k).alias("label"), cents(F.col(c)).alias("value")) for k, c in (("数量 (kg)", "q"), ("金額（円）", "p"), ("行数 [件]", "n"))])).alias("m")
    return grid(lines.select(F.col("l_suppkey").alias("suppkey"), parts).select("suppkey", "m.*"), "suppkey", "label")


@query("unit_split", "WITH t AS (SELECT l_suppkey AS suppkey, round(sum(l_quantity), 2) AS q, round(sum(l_extendedprice), 2) AS p, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1) SELECT suppkey, '数量' AS label, q AS value FROM t UNION ALL SELECT suppkey, '金額', p FROM t UNION ALL SELECT suppkey, '行数', n FROM t")
def unit_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.split_units(_metrics(spark, sf_dir)).frame.drop(ROW)


@query("unit_master", "SELECT * FROM (VALUES ('数量', 'kg'), ('金額', '円'), ('行数', '件')) AS t(label, unit)")
def unit_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.split_units(_metrics(spark, sf_dir)).master.select("label", F.col("単位").alias("unit"))


@query("invalid_cols", "SELECT o_orderkey AS orderkey, '' AS \"Unnamed: 3\", o_orderstatus AS status FROM orders WHERE FALSE UNION ALL SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders")
def invalid_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty columns go; a placeholder name alone is only reported."""
    messy = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"), F.lit(None).cast("string").alias("列"), F.lit("  ").alias("列_1"), F.col("o_orderpriority").alias("Unnamed: 3"), F.col("o_orderstatus").alias("status"))
    return FL.drop_invalid_columns(messy.withColumn(ROW, F.monotonically_increasing_id())).drop(ROW)


@query("fd_pairs", "SELECT 'code' AS a, 'name' AS b UNION ALL SELECT 'name', 'code' UNION ALL SELECT 'code', 'region' UNION ALL SELECT 'region', 'code' UNION ALL SELECT 'name', 'region' UNION ALL SELECT 'region', 'name'")
def fd_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation, region = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = customer.join(nation, customer.c_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey)
    messy = joined.select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"), F.col("r_name").alias("region"), F.col("c_mktsegment").alias("segment"))
    pairs = A.dependent_columns(messy, ["code", "name", "region", "segment"])
    return spark.createDataFrame([(a, b) for a, bs in pairs.items() for b in bs], "a string, b string")


@query("numeric_clean", "SELECT o_orderkey AS orderkey, CAST(round(abs(o_totalprice), 2) AS DOUBLE) AS price, TRUE AS is_number FROM orders")
def numeric_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices written with thousands marks and triangles are numbers; the mark isn't a sign."""
    text = F.concat(F.lit("△"), F.format_number(F.abs("o_totalprice"), 2))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"), cents(L.numeric_clean(text)).alias("price"), L.is_numeric_cell(text).alias("is_number"))


@query("time_kind", "SELECT o_orderkey AS orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'year_month' WHEN 1 THEN 'year' WHEN 2 THEN 'fiscal_quarter' END AS kind FROM orders")
def time_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, m = F.year("o_orderdate").cast("string"), F.month("o_orderdate").cast("string")
    name = F.when(F.col("o_orderkey") % 4 == 0, F.concat(y, F.lit("年"), m, F.lit("月"))).when(F.col("o_orderkey") % 4 == 1, F.concat(y, F.lit("年"))).when(F.col("o_orderkey") % 4 == 2, F.concat(y, F.lit("-q"), F.quarter("o_orderdate").cast("string"))).otherwise(F.concat(y, F.lit("/"), m))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"), L.time_kind(name).alias("kind"))


_BLANKS = "[\\s\\x0B\\x1C-\\x1F\\x85\\xA0\\x{1680}\\x{2000}-\\x{200D}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+"
_ENDS = "(" + "|".join(sorted(k.replace(" ", "") for k in D.AGG_KEYWORDS)) + ")$"
_BARE = f"regexp_replace(text, '{D.TRAILING_BRACKETS}', '')"


@query("agg_label", "SELECT doc_id, coalesce(" + " OR ".join(f"regexp_matches(regexp_replace(lower({t}), '{_BLANKS}', '', 'g'), '{_ENDS}')" for t in ("text", _BARE)) + ", false) AS is_agg FROM documents")
def agg_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of all documents as labels."""
    return table(spark, sf_dir, "documents").select("doc_id", L.is_agg_label(F.col("text")).alias("is_agg"))


@query("of_which_label", "SELECT o_orderkey AS orderkey, o_orderstatus AS child FROM orders")
def of_which_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("o_orderkey") % 3, F.col("o_orderstatus")
    label = F.when(k == 0, F.concat(F.lit("うち、"), s)).when(k == 1, F.concat(F.lit("（再掲）"), s)).otherwise(F.concat(F.lit(" (内数："), s, F.lit(") ")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"), L.uchi_child(label).alias("child"))


@query("note_type", "SELECT c_custkey AS custkey, CASE c_custkey % 4 WHEN 0 THEN 'aggregation' WHEN 1 THEN 'exclusion' WHEN 2 THEN 'reference' ELSE 'general' END AS kind FROM customer")
def note_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    note = F.concat("c_name", F.when(k == 0, "の合計").when(k == 1, "を除く値").when(k == 2, "を参照").otherwise("について"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), L.note_type(note).alias("kind"))


# --- relations and derived tables ------------------------------------------------------------------


def _company(spark: SparkSession, sf_dir: str) -> list[X.Table]:
    """A table a region (nation by order status), and their total, each on a sheet of its own."""
    orders, customer, nation, region = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, customer.c_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey)
    part = lambda s: F.coalesce(F.sum(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice"))), F.lit(0.0)).alias(s.lower())
    cells = joined.groupBy("r_name", "o_orderpriority").agg(part("F"), part("O"), part("P")).persist()
    names = [r[0] for r in cells.select("r_name").distinct().orderBy("r_name").collect()]
    tables = [X.Table(n, n, n, grid(cells.where(F.col("r_name") == n).select(F.col("o_orderpriority").alias("priority"), "f", "o", "p"), "priority")) for n in names]
    whole = cells.groupBy(F.col("o_orderpriority").alias("priority")).agg(*[F.sum(c).alias(c) for c in ("f", "o", "p")])
    return [X.Table("company", "company", "company", grid(whole, "priority")), *tables]


@query("sum_relations", "SELECT 'company' AS parent, CAST(count(*) AS BIGINT) AS children, string_agg(r_name, ',' ORDER BY r_name) AS names FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey)")
def sum_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.sum_relations(_company(spark, sf_dir))
    return spark.createDataFrame([(r.parent, len(r.children), ",".join(r.children)) for r in found], "parent string, children long, names string")


@query("sheet_levels", "SELECT 'company' AS sheet, CAST(count(*) AS BIGINT) AS parts FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey)")
def sheet_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.aggregate_sheets(_company(spark, sf_dir))
    return spark.createDataFrame([(s, len(cs)) for s, cs in found.items()], "sheet string, parts long")


_REGION_CELLS = """SELECT r_name AS region, o_orderpriority AS priority, round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 0), 2) AS f, round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 0), 2) AS o,
 round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 0), 2) AS p FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL"""


@query("integrate_tables", _REGION_CELLS)
def integrate_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, *parts = _company(spark, sf_dir)
    out = U.integrate(parts, ["region"], [(t.sheet,) for t in parts])
    return out.select("region", "priority", *[cents(F.col(c)).alias(c) for c in ("f", "o", "p")])


@query("latent_derive", f"SELECT priority, f, o, p FROM ({_REGION_CELLS}) WHERE region = (SELECT min(r_name) FROM region)")
def latent_derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first region's table from the company's and the others'."""
    whole, _, *others = _company(spark, sf_dir)
    out = U.subtract(whole, others)
    return out.select("priority", *[cents(F.col(c)).alias(c) for c in ("f", "o", "p")])


_PARTS = "SELECT o_orderstatus AS status, c_mktsegment AS segment, o_orderpriority AS priority, round(sum(o_totalprice), 2) AS amount FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL"


@query("latent_union", f"SELECT s.status AS sheet, g.segment AS part, p.priority, coalesce(x.amount, 0) AS amount FROM (SELECT DISTINCT status FROM ({_PARTS})) s CROSS JOIN (SELECT DISTINCT segment FROM ({_PARTS})) g CROSS JOIN (SELECT DISTINCT priority FROM ({_PARTS})) p LEFT JOIN ({_PARTS}) x ON x.status = s.status AND x.segment = g.segment AND x.priority = p.priority")
def latent_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet a status with all segments' tables but the last, and a total whose note names them all: one union over both axes."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey)
    long = stored(joined.groupBy("o_orderstatus", "c_mktsegment", "o_orderpriority").agg(F.sum("o_totalprice").alias("amount")))  # a row a cell
    statuses, segments = ([r[0] for r in long.select(c).distinct().orderBy(c).collect()] for c in ("o_orderstatus", "c_mktsegment"))
    wide = long.withColumn("both", F.concat_ws("|", "o_orderstatus", "c_mktsegment")).groupBy(F.col("o_orderpriority").alias("priority")).pivot("both", [f"{s}|{g}" for s in statuses for g in segments]).agg(F.sum("amount")).na.fill(0.0)
    cells = grid(wide, "priority")
    note = "、".join(segments) + "の合計"
    tables = []
    for s in statuses:
        whole = reduce(lambda a, b: a + b, [col(f"{s}|{g}") for g in segments])
        tables.append(X.Table(f"{s}_T0", s, "全区分", cells.select(ROW, "priority", whole.alias("amount")), [note]))
        tables += [X.Table(f"{s}_T{k}", s, g, cells.select(ROW, "priority", col(f"{s}|{g}").alias("amount"))) for k, g in enumerate(segments[:-1], 1)]
    by_id = {t.id: t for t in tables}
    derived = {p: X.Table(f"{p.source}_rest", by_id[p.source].sheet, p.missing[0], U.subtract(by_id[p.source], [by_id[k] for k in p.known])) for p in U.latent_tables(tables)}
    (found,) = U.automatic_integrations(derived, tables)
    by_id |= {t.id: t for t in derived.values()}
    out = U.integrate([by_id[i] for i in found.sources], list(found.axes), list(found.values))
    part, sheet = found.axes
    return out.select(col(sheet).alias("sheet"), col(part).alias("part"), "priority", cents(F.col("amount")).alias("amount"))


@query("latent_derive_keyed", "SELECT o_orderkey AS orderkey, round(sum(l_extendedprice) FILTER (l_returnflag = 'R'), 2) AS amount FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1 HAVING count(*) FILTER (l_returnflag = 'R') > 0")
def latent_derive_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of each order when the other flags' sums are taken off, over all line items."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("orderkey"), "l_returnflag", F.col("l_extendedprice").cast("decimal(20,4)").alias("amount"))
    total = lines.groupBy("orderkey").agg(F.sum("amount").alias("amount"), F.count_if(F.col("l_returnflag") == "R").alias("n")).where("n > 0").drop("n")
    out = U.subtract_by_key(total, lines.where("l_returnflag <> 'R'").select("orderkey", "amount"), ["orderkey"], ["amount"])
    return out.select("orderkey", F.round(F.col("amount").cast("double"), 2).alias("amount"))


@query("master_map", "SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey IN (SELECT c_nationkey FROM customer)")
def master_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation, region = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = customer.join(nation, customer.c_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey)
    return U.master_of(joined.select(F.col("n_name").alias("nation"), F.col("r_name").alias("region")), "nation", "region")


@query("master_specs", "SELECT r_name AS region, 'company' AS \"group\" FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey)")
def master_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What belongs under the company's table, from the sums that are found among all tables."""
    tables = _company(spark, sf_dir)
    (found,) = X.sum_relations(tables)
    asked = X.Recommendation(found.children, ("region",), tuple((c,) for c in found.children), found.parent)
    (spec,) = U.master_specs(asked, tables, parent_axes=["group"])
    return spec.frame(spark)


@query("redundant_axis", "SELECT 'year' AS axis")
def redundant_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables by year hold their year in the date's text, and don't hold who made them."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("string").alias("date"), F.col("o_totalprice").alias("price"))
    years = [r[0] for r in orders.select(F.substring("date", 1, 4)).distinct().orderBy(F.substring("date", 1, 4)).collect()]
    tables = [X.Table(y, y, y, orders.where(F.col("date").startswith(y)).withColumn(ROW, F.monotonically_increasing_id())) for y in years]
    found = U.redundant_axes(tables, ["year", "maker"], [(f"FY{y}", "someone") for y in years])
    return spark.createDataFrame([(a,) for a in found], "axis string")


@query(
    "select_groups",
    """SELECT c_custkey AS custkey, CASE WHEN c_custkey % 2 = 0 THEN 'integrated' WHEN c_custkey % 3 = 0 THEN 'minimum' WHEN c_custkey % 5 = 0 THEN 'master' WHEN c_acctbal > 0 THEN 'recommended' ELSE 'other' END AS grp,
    CASE WHEN c_custkey % 5 = 0 THEN 'master' ELSE c_mktsegment END AS badge FROM customer""",
)
def select_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    catalog = table(spark, sf_dir, "customer").select(k.alias("custkey"), (k % 2 == 0).alias("is_integrated"), (k % 3 == 0).alias("is_minimum"), (k % 5 == 0).alias("is_master"), (F.col("c_acctbal") > 0).alias("recommended"), F.col("c_mktsegment").alias("granularity"))
    return catalog.select("custkey", S.selection_group().alias("grp"), S.granularity_badge().alias("badge"))


# --- grids -----------------------------------------------------------------------------------------


def _sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet a nation: title, header, its customers, an empty row, then a note; cells in long form."""
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    rank = F.row_number().over(W.partitionBy("c_nationkey").orderBy("c_custkey"))
    base = customer.join(nation, customer.c_nationkey == nation.n_nationkey).withColumn("k", rank)
    text = lambda v: F.struct(F.lit("s").alias("kind"), v.cast("string").alias("s"), F.lit(None).cast("double").alias("d"))
    num = lambda v: F.struct(F.lit("n").alias("kind"), F.lit(None).cast("string").alias("s"), v.cast("double").alias("d"))
    sheet = lambda r, c, v: (F.col("n_name").alias("sheet"), r.cast("int").alias("r"), F.lit(c).alias("c"), v.alias("v"))
    body = [base.select(*sheet(F.col("k") + 3, 1, text(F.col("c_name")))), base.select(*sheet(F.col("k") + 3, 2, text(F.col("c_mktsegment")))), base.select(*sheet(F.col("k") + 3, 3, num(F.col("c_acctbal")))), base.select(*sheet(F.col("k") + 3, 4, num(F.col("c_custkey"))))]
    ends = base.groupBy("n_name").agg(F.max("k").alias("n"))
    head = [ends.select(*sheet(F.lit(1), 1, text(F.lit("顧客一覧"))))] + [ends.select(*sheet(F.lit(3), i + 1, text(F.lit(h)))) for i, h in enumerate(("name", "segment", "balance", "key"))]
    foot = [ends.select(*sheet(F.col("n") + 5, 1, text(F.lit("※出典：自社調査"))))]
    cells = reduce(DataFrame.unionByName, body + head + foot)
    return cells.select(F.lit("f").alias("file"), "sheet", "r", "c", "v.kind", "v.s", "v.d")


@query("row_classify", "SELECT n_name AS sheet, 'data' AS kind, CAST(count(*) AS BIGINT) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 UNION ALL SELECT DISTINCT n_name, k, CAST(1 AS BIGINT) FROM customer JOIN nation ON c_nationkey = n_nationkey CROSS JOIN (VALUES ('title'), ('col_hdr'), ('note')) AS t(k)")
def row_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _sheets(spark, sf_dir)
    extra = cells.where("c = 4").withColumns({"c": F.lit(5), "s": F.when(F.col("kind") == "s", F.concat("s", F.lit("2"))), "d": F.col("d")})
    rows = G.row_profiles(cells.unionByName(extra)).select("sheet", G.row_kind().alias("kind"))
    return rows.groupBy("sheet", "kind").agg(F.count("*").alias("n"))


@query("detect_tables", "SELECT n_name AS sheet, n_name || '_T1' AS table_id, '顧客一覧' AS title, CAST(1 AS BIGINT) AS c0, CAST(4 AS BIGINT) AS c1, CAST(count(*) AS BIGINT) AS n_rows, '※出典：自社調査' AS note FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def detect_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = G.detect_tables(_sheets(spark, sf_dir))
    return found.select("sheet", "table_id", "title", F.col("c0").cast("long").alias("c0"), F.col("c1").cast("long").alias("c1"), F.aggregate("data_rows", F.lit(0).cast("long"), lambda n, x: n + x["n"]).alias("n_rows"), F.get("notes", F.lit(0)).alias("note"))


def _long_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sheet of all customers: a title, a header, a row each, every seventh of them text only, and two notes."""
    customer = table(spark, sf_dir, "customer")
    text = lambda c, v: F.struct(F.lit(c).alias("c"), F.lit("s").alias("kind"), v.cast("string").alias("s"), F.lit(None).cast("double").alias("d"))
    num = lambda c, v: F.struct(F.lit(c).alias("c"), F.lit("n").alias("kind"), F.lit(None).cast("string").alias("s"), v.cast("double").alias("d"))
    withheld = F.col("c_custkey") % 7 == 3
    cells = [text(1, F.col("c_name")), text(2, F.col("c_mktsegment")), F.when(withheld, text(3, F.concat(F.lit("see "), "c_custkey"))).otherwise(num(3, F.col("c_acctbal"))), F.when(withheld, text(4, F.concat(F.lit("withheld "), "c_custkey"))).otherwise(num(4, F.col("c_custkey")))]
    last = customer.agg(F.max("c_custkey").alias("c_custkey"))
    row = lambda df, r, vs: df.select(F.lit("f").alias("file"), F.lit("all").alias("sheet"), r.cast("int").alias("r"), F.explode(F.array(*vs)).alias("v"))
    names = [text(i, F.lit(n)) for i, n in enumerate(("name", "segment", "balance", "key"), 1)]
    parts = [row(last, F.lit(1), [text(1, F.lit("顧客一覧"))]), row(last, F.lit(3), names), row(customer, F.col("c_custkey") + 4, cells), row(last, F.col("c_custkey") + 5, [text(1, F.lit("※出典：自社調査"))]), row(last, F.col("c_custkey") + 7, [text(1, F.lit("注）速報"))])]
    return reduce(DataFrame.unionByName, parts).select("file", "sheet", "r", "v.c", "v.kind", "v.s", "v.d")


@query("detect_long_sheet", "SELECT 'all_T1' AS table_id, '顧客一覧' AS title, CAST(3 AS BIGINT) AS header_row, CAST(1 AS BIGINT) AS c0, CAST(4 AS BIGINT) AS c1, CAST(count(*) AS BIGINT) AS n_rows, CAST(min(c_custkey) + 4 AS BIGINT) AS first_row, CAST(max(c_custkey) + 4 AS BIGINT) AS last_row, '※出典：自社調査|注）速報' AS notes FROM customer")
def detect_long_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sheet, read in blocks of 512 rows at once."""
    found = G.detect_tables(_long_sheet(spark, sf_dir), block_rows=512)
    n, spans = F.aggregate("data_rows", F.lit(0).cast("long"), lambda n, x: n + x["n"]), F.col("data_rows")
    ends = F.array_min(spans["first"]).cast("long").alias("first_row"), F.array_max(spans["last"]).cast("long").alias("last_row")
    return found.select("table_id", "title", F.col("header_rows")[0]["first"].cast("long").alias("header_row"), F.col("c0").cast("long").alias("c0"), F.col("c1").cast("long").alias("c1"), n.alias("n_rows"), *ends, F.array_join("notes", "|").alias("notes"))


@query("extract_table", "SELECT c_name AS name, c_mktsegment AS segment, CAST(c_acctbal AS DOUBLE) AS balance, c_custkey AS key FROM customer WHERE c_nationkey = (SELECT n_nationkey FROM nation ORDER BY n_name LIMIT 1)")
def extract_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _sheets(spark, sf_dir)
    place = G.detect_tables(cells).orderBy("sheet").first().asDict()
    return G.extract(cells, place).drop(ROW)


@query("extract_tables", "SELECT replace(n_name, ' ', '_') || '_T1' AS table_id, c_name AS name, c_mktsegment AS segment, CAST(c_acctbal AS DOUBLE) AS balance, c_custkey AS key FROM customer JOIN nation ON c_nationkey = n_nationkey")
def extract_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of all sheets, a plan a form; cells are stored, as those that are read from files."""
    cells = stored(_sheets(spark, sf_dir))
    forms = G.extract_forms(cells, G.detect_tables(cells))
    table_id = F.from_json("__table", "array<string>")[1].alias("table_id")
    parts = [f.frame.select(table_id, "name", "segment", F.col("balance").cast("double").alias("balance"), "key") for f in forms]
    return reduce(DataFrame.unionByName, parts)


@query("formula_sum", "SELECT l_orderkey AS id, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY 1")
def formula_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SUM over the rectangle of each order's lines, as a join of ranges with cells."""
    lines = table(spark, sf_dir, "lineitem")
    sheet = F.col("l_orderkey").cast("string").alias("sheet")
    cells = lines.select(F.lit("f").alias("file"), sheet, F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).alias("r"), F.lit(2).alias("c"), F.lit("n").alias("kind"), F.lit(None).cast("string").alias("s"), F.col("l_quantity").alias("d"))
    ranges = lines.groupBy("l_orderkey").agg(F.count("*").cast("int").alias("r1")).select(F.col("l_orderkey").alias("id"), F.lit("f").alias("file"), sheet, F.lit(1).alias("r0"), F.lit(1).alias("c0"), "r1", F.lit(3).alias("c1"))
    return FM.range_sums(cells, ranges).select("id", cents(F.col("total")).alias("total"))


@query("formula_balance", "SELECT o_custkey AS custkey, o_orderkey AS orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 2) AS balance, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS total FROM orders")
def formula_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet a customer: prices in A, in B the balance so far by the one above, and the sum of A in C1, as formulas."""
    orders = table(spark, sf_dir, "orders")
    sheet, r = F.col("o_custkey").cast("string").alias("sheet"), F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = stored(orders.select(F.lit("f").alias("file"), sheet, r.alias("r"), "o_custkey", "o_orderkey", "o_totalprice"))
    cells = rows.select("file", "sheet", "r", F.lit(1).alias("c"), F.lit("n").alias("kind"), F.lit(None).cast("string").alias("s"), F.col("o_totalprice").cast("double").alias("d"))
    line = F.when(F.col("r") == 1, "=A1").otherwise(F.concat(F.lit("=B"), F.col("r") - 1, F.lit("+A"), "r"))
    last = rows.groupBy("file", "sheet").agg(F.max("r").alias("n"))
    formulas = rows.select("file", "sheet", "r", F.lit(2).alias("c"), line.alias("formula")).unionByName(last.select("file", "sheet", F.lit(1).alias("r"), F.lit(3).alias("c"), F.concat(F.lit("=SUM($A$1:$A$"), "n", F.lit(")")).alias("formula")))
    values = stored(FM.evaluate(cells, formulas))
    total = values.where("c = 3").select("sheet", cents(F.col("value")).alias("total"))
    return rows.join(values.where("c = 2").select("sheet", "r", cents(F.col("value")).alias("balance")), ["sheet", "r"]).join(total, "sheet").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"), "balance", "total")


@query("normalize_plan", "SELECT c_mktsegment AS segment, CAST(year(o_orderdate) AS VARCHAR) || '年' AS year, round(sum(o_totalprice), 2) AS amount FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def normalize_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole plan: subtotal row and column removed, empty column dropped, years stacked."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).withColumn("y", F.concat(F.year("o_orderdate").cast("string"), F.lit("年")))
    years = [r[0] for r in joined.select("y").distinct().orderBy("y").collect()]
    wide = joined.groupBy(F.col("c_mktsegment").alias("segment")).pivot("y", years).agg(F.sum("o_totalprice"))
    total = wide.groupBy().agg(*[F.sum(col(y)).alias(y) for y in years]).select(F.lit("合計").alias("segment"), *[col(y) for y in years])
    both = wide.unionByName(total).withColumn("合計", reduce(lambda a, b: a + b, [F.coalesce(col(y), F.lit(0.0)) for y in years])).withColumn("列", F.lit(None).cast("string"))
    out = P.normalize(X.Table("t", "s", "売上", grid(both, "segment"))).frame
    return out.select("segment", F.col("年").alias("year"), cents(F.col("売上")).alias("amount")).where("amount is not null")
