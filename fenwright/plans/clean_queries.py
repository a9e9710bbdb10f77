"""Scopes, reconciliation, grids and exports over order rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fenwright.operators import clean
from fenwright.plans import domain as D
from fenwright.registry import query

ORDERS = f"WITH {D.ORDER_ROWS_SQL}"
EXCLUDED = ("4-NOT SPECIFIED",)


def _excluded(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("4-NOTSPECIFIED",)], "category string")


DASHBOARD = "department = '사업부' AND NOT cancelled"


@query(f"{ORDERS} SELECT order_number, order_date, person, business, subcategory, is_error FROM order_rows WHERE {DASHBOARD}", dates=("order_date",))
def dashboard_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.scopes(D.order_rows(spark, sf_dir), _excluded(spark))[1].drop("department", "cancelled")


@query(f"{ORDERS} SELECT order_number, order_date, person, business, subcategory, is_error FROM order_rows WHERE {DASHBOARD} AND replace(subcategory, ' ', '') <> '4-NOTSPECIFIED'", dates=("order_date",))
def analysis_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.scopes(D.order_rows(spark, sf_dir), _excluded(spark))[0].drop("department", "cancelled")


@query(f"""{ORDERS} SELECT count(*) AS "rows", count(*) FILTER ({DASHBOARD}) AS dashboard, count(*) FILTER ({DASHBOARD} AND subcategory <> '4-NOT SPECIFIED') AS analysis,
  count(*) FILTER (department <> '사업부') AS other_department, count(*) FILTER (department = '사업부' AND cancelled) AS cancelled, count(*) FILTER ({DASHBOARD} AND subcategory = '4-NOT SPECIFIED') AS excluded FROM order_rows""")
def preprocess_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.counters(D.order_rows(spark, sf_dir), EXCLUDED)


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order numbers and dates as someone else has them: from line items, every third order, some of them unknown."""
    l = D.table(spark, sf_dir, "lineitem").where("l_orderkey % 3 = 0")  # noqa: E741
    return l.groupBy((F.col("l_orderkey") + F.when(F.col("l_orderkey") % 99 == 0, 10**9).otherwise(0)).cast("string").alias("order_number")).agg(F.to_date(F.min("l_shipdate")).alias("order_date"))


TRUTH = f"{ORDERS}, truth AS (SELECT (l_orderkey + CASE WHEN l_orderkey % 99 = 0 THEN 1000000000 ELSE 0 END)::VARCHAR AS order_number, min(l_shipdate)::DATE AS order_date FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY 1)"


@query(f"{TRUTH} SELECT order_number, 0::BIGINT AS matches FROM truth WHERE order_number NOT IN (SELECT order_number FROM order_rows)")
def truth_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.reconcile(D.order_rows(spark, sf_dir), _truth(spark, sf_dir), "order_number")


@query(f"{TRUTH} SELECT o.order_number, o.order_date, t.order_date AS truth_date FROM order_rows o JOIN truth t USING (order_number) WHERE o.order_date IS DISTINCT FROM t.order_date", dates=("order_date", "truth_date"))
def truth_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = _truth(spark, sf_dir).withColumnRenamed("order_date", "truth_date")
    both = D.order_rows(spark, sf_dir).join(truth, "order_number")
    return both.where(~F.col("order_date").eqNullSafe(F.col("truth_date"))).select("order_number", "order_date", "truth_date")


@query(f"{ORDERS} SELECT order_number FROM order_rows WHERE is_error AND order_number NOT IN (SELECT l_orderkey::VARCHAR FROM lineitem WHERE l_returnflag = 'R')")
def active_minus_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    excluded = D.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").cast("string").alias("order_number"))
    return D.order_rows(spark, sf_dir).where("is_error").join(excluded, "order_number", "left_anti").select("order_number")


@query("SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) = 1")
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = D.table(spark, sf_dir, "lineitem")  # noqa: E741
    return clean.keep_first(l, ["l_orderkey"], [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]).select("l_orderkey", "l_partkey", "l_linenumber")


@query("SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id FROM events WHERE event_type = 'signup' GROUP BY user_id")
def latest_active_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = D.table(spark, sf_dir, "events").where("event_type = 'signup'")
    return e.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query(f"{ORDERS}, {D.EVENT_ROWS_SQL} SELECT business, count(*) AS n, min(order_date) AS first_date, max(order_date) AS last_date FROM (SELECT business, order_date FROM order_rows WHERE is_error UNION ALL SELECT business, order_date FROM event_rows WHERE is_error) GROUP BY business", dates=("first_date", "last_date"))
def union_monitoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda df: df.where("is_error").select("business", "order_date")
    both = part(D.order_rows(spark, sf_dir)).unionByName(part(D.event_rows(spark, sf_dir)))
    return both.groupBy("business").agg(F.count("*").alias("n"), F.min("order_date").alias("first_date"), F.max("order_date").alias("last_date"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_brand), 'red') OR contains(lower(p_type), 'red')")
def grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.search(D.table(spark, sf_dir, "part"), "RED", ["p_name", "p_brand", "p_type"]).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_brand, p_type FROM part WHERE p_brand IN ('Brand#2', 'Brand#17') AND contains(lower(p_type), 'eco')")
def grid_filter_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.column_filters(D.table(spark, sf_dir, "part"), {"p_brand": ["brand#2", "BRAND#17"], "p_type": "ECO"}).select("p_partkey", "p_brand", "p_type")


@query("SELECT value, n > 5 AS truncated FROM (SELECT DISTINCT p_name AS value, (SELECT count(DISTINCT p_name) FROM part WHERE contains(p_name, 'ring')) AS n FROM part WHERE contains(p_name, 'ring') ORDER BY lower(value), value LIMIT 5)")
def grid_distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.distinct_values(D.table(spark, sf_dir, "part"), "p_name", "RING", 5)


@query("SELECT p_partkey, p_name, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 40 OFFSET 80")
def grid_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.page(D.table(spark, sf_dir, "part"), [F.desc("p_size"), F.asc("p_partkey")], 3, 40).select("p_partkey", "p_name", "p_size")


@query("SELECT p_partkey, CASE WHEN regexp_matches(regexp_replace(v, '^\\s+', ''), '^[=+@-]') THEN '''' || v ELSE v END AS v FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '=' WHEN 1 THEN ' +' WHEN 2 THEN '-' WHEN 3 THEN '@' ELSE '' END || p_name AS v FROM part)")
def formula_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead = F.element_at(F.array(*map(F.lit, ("=", " +", "-", "@", ""))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return clean.escape_formulas(D.table(spark, sf_dir, "part").select("p_partkey", F.concat(lead, "p_name").alias("v")))


@query("SELECT o_orderkey, 1000000000 + o_orderkey AS shifted FROM (SELECT o_orderkey FROM orders)")
def order_number_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that came through a float come back as they were, in both forms."""
    shown = F.concat(F.lit(" "), F.col("o_orderkey").cast("string"), F.lit(".0 "))
    older = F.concat(F.format_number(F.lit(1_000_000_000) + F.col("o_orderkey"), 0), F.lit(".00"))
    return D.table(spark, sf_dir, "orders").select(clean.order_number(shown).cast("long").alias("o_orderkey"), clean.order_number_historical(older).cast("long").alias("shifted"))


@query("""WITH r AS (SELECT s_name AS scope, 'a' || (l_partkey % 3) AS address, l_shipdate, l_returnflag AS use, 'd' || (l_partkey % 4) AS district, l_orderkey % 50 AS household, l_orderkey * 10 + l_linenumber AS position FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
u AS (SELECT scope, address, string_agg(use || ':' || n, ',' ORDER BY use) AS uses FROM (SELECT scope, address, use, count(*) AS n FROM r GROUP BY ALL) GROUP BY ALL),
m AS (SELECT scope, address, district FROM (SELECT scope, address, district, count(*) AS n, min(position) AS seen FROM r GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY scope, address ORDER BY n DESC, seen) = 1)
SELECT scope, address, count(*) AS orders, count(DISTINCT household) AS households, any_value(uses) AS uses, any_value(m.district) AS district FROM r JOIN u USING (scope, address) JOIN m USING (scope, address) GROUP BY ALL""")
def address_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, s = D.table(spark, sf_dir, "lineitem"), D.table(spark, sf_dir, "supplier")  # noqa: E741
    rows = l.join(s, l.l_suppkey == s.s_suppkey).select(F.col("s_name").alias("scope"), F.concat(F.lit("a"), F.col("l_partkey") % 3).alias("address"), F.col("l_returnflag").alias("use"), F.concat(F.lit("d"), F.col("l_partkey") % 4).alias("district"), (F.col("l_orderkey") % 50).alias("household"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"))
    uses = F.array_join(F.transform(F.map_entries("use_counts"), lambda e: F.concat(e.key, F.lit(":"), e.value)), ",")
    return clean.address_summary(rows).select("scope", "address", "orders", "households", uses.alias("uses"), "district")
