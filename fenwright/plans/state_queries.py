"""State queries: what uploads, approvals, exclusions and rollbacks leave, over orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fenwright.operators import bi, cube, state
from fenwright.plans import domain as D
from fenwright.plans.bi_queries import ORDERS, orders_cube
from fenwright.registry import query

TOTALS = "(sum(total_count))::BIGINT AS total_count, (sum(error_count))::BIGINT AS error_count"
NUMBER = "order_number::BIGINT"


@query(f"{ORDERS} SELECT business, {TOTALS} FROM cube GROUP BY business")
def cube_reupload_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half of the days is loaded again: the cube stays."""
    whole = orders_cube(spark, sf_dir)
    again = cube.replace_dates(whole, whole.where("order_date < date'1998-01-01'"))
    return again.groupBy("business").agg(F.sum("total_count").alias("total_count"), F.sum("error_count").alias("error_count"))


@query(f"{ORDERS} SELECT business, {TOTALS} FROM (SELECT * FROM cube WHERE order_date < DATE '1997-01-01' OR order_date > DATE '1997-12-31' UNION ALL SELECT order_date, person, business, subcategory, total_count * 2, error_count FROM cube WHERE order_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31') GROUP BY business")
def cube_replace_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = orders_cube(spark, sf_dir)
    done = cube.replace_period(whole, whole.withColumn("total_count", F.col("total_count") * 2), "1997-01-01", "1997-12-31")
    return done.groupBy("business").agg(F.sum("total_count").alias("total_count"), F.sum("error_count").alias("error_count"))


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Errors in four batches by order number: 0 automatic, 1 to 3 manual; batch 2 is of another job."""
    rows = D.order_rows(spark, sf_dir)
    n = F.col("order_number").cast("long")
    details = rows.where("is_error").select(n.alias("detail_id"), (n % 4).alias("batch_id"), "order_number", *cube.DIMENSIONS)
    batches = spark.createDataFrame([(0, "auto", "a", 5, False), (1, "manual", "a", 1, False), (2, "manual", "b", 3, False), (3, "manual", "a", 2, False)], "batch_id long, batch_type string, job_id string, approved_at long, rolled_back boolean")
    exclusions = rows.where("is_error").where(n % 10 == 0).select("order_number", F.lit(1).alias("at"), F.lit(False).alias("restored")).unionByName(rows.where("is_error").where(n % 20 == 0).select("order_number", F.lit(2).alias("at"), F.lit(True).alias("restored")))
    return rows, details, batches, exclusions


def _counts(spark: SparkSession, sf_dir: str, batches: DataFrame) -> DataFrame:
    rows, details, _, exclusions = _tables(spark, sf_dir)
    totals = cube.build(rows)
    done = state.with_errors(totals, state.active(details, batches, exclusions))
    return done.groupBy("business").agg(F.sum("total_count").alias("total_count"), F.sum("error_count").alias("error_count"))


LEFT = f"is_error AND ({NUMBER} % 10 <> 0 OR {NUMBER} % 20 = 0)"


@query(f"{ORDERS} SELECT business, count(*) AS total_count, count(*) FILTER ({LEFT} AND {NUMBER} % 4 <> 2) AS error_count FROM order_rows GROUP BY business")
def approve_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir, state.roll_back_latest(_tables(spark, sf_dir)[2]))


@query(f"{ORDERS} SELECT business, count(*) AS total_count, count(*) FILTER ({LEFT} AND {NUMBER} % 4 <> 3) AS error_count FROM order_rows GROUP BY business")
def rollback_of_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir, state.roll_back_latest(_tables(spark, sf_dir)[2], job_id="a"))


@query(f"{ORDERS} SELECT business, count(*) AS total_count, count(*) FILTER ({LEFT}) AS error_count FROM order_rows GROUP BY business")
def exclude_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir, _tables(spark, sf_dir)[2])


@query(f"{ORDERS} SELECT order_number FROM order_rows WHERE NOT ({LEFT}) AND {NUMBER} % 3 = 0")
def approve_new_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, details, batches, exclusions = _tables(spark, sf_dir)
    asked = rows.where(F.col("order_number").cast("long") % 3 == 0).select("order_number")
    return state.approve(details, batches, exclusions, asked)[0]


@query(f"{ORDERS} SELECT order_number FROM order_rows WHERE is_error AND ({NUMBER} % 4 <> 0 OR order_date NOT IN (SELECT order_date FROM order_rows WHERE order_date < DATE '1998-01-01' AND {NUMBER} % 8 = 0)) UNION ALL SELECT order_number FROM order_rows WHERE order_date < DATE '1998-01-01' AND {NUMBER} % 8 = 0 AND NOT (is_error AND {NUMBER} % 10 = 0 AND {NUMBER} % 20 <> 0)")  # a day without a fresh row keeps its automatic details
def replace_automatic_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, details, batches, exclusions = _tables(spark, sf_dir)
    n = F.col("order_number").cast("long")
    days = rows.where("order_date < date'1998-01-01'")
    fresh = days.where(n % 8 == 0).select((n + 10**9).alias("detail_id"), F.lit(0).cast("long").alias("batch_id"), "order_number", *cube.DIMENSIONS)
    return state.replace_automatic(details, batches, fresh, exclusions)[0].select("order_number")


STATE = f"""WITH {D.ORDER_ROWS_SQL}, e AS (SELECT *, {NUMBER} AS n FROM order_rows WHERE is_error), x AS (SELECT order_number FROM e WHERE n % 10 = 0 AND n % 20 <> 0), on_ AS (SELECT * FROM e WHERE order_number NOT IN (SELECT order_number FROM x))"""


@query(f"{STATE} SELECT order_number, order_date, person, CASE WHEN n % 6 = 0 THEN 'moved' ELSE business END AS business, subcategory FROM e", dates=("order_date",))
def approvals_reconnected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later upload has other businesses for some of the approved orders."""
    rows, details, _, _ = _tables(spark, sf_dir)
    upload = rows.where(F.col("order_number").cast("long") % 3 == 0).withColumn("business", F.when(F.col("order_number").cast("long") % 2 == 0, "moved").otherwise(F.col("business")))
    return state.reconnect(details, upload).select("order_number", *cube.DIMENSIONS)


@query(f"{STATE}, c AS (SELECT order_number, is_error AS is_auto FROM order_rows WHERE {NUMBER} % 4 < 2) SELECT order_number, CASE WHEN order_number IN (SELECT order_number FROM on_) THEN 'confirmed' ELSE 'candidate' END AS view FROM c WHERE order_number IN (SELECT order_number FROM on_) OR NOT is_auto OR order_number IN (SELECT order_number FROM x)")
def job_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, details, batches, exclusions = _tables(spark, sf_dir)
    n = F.col("order_number").cast("long")
    once = rows.where(n % 4 < 2).select("order_number", F.col("is_error").alias("is_auto"), n.alias("position"))
    candidates, confirmed = state.views(once.unionByName(once.withColumn("position", F.col("position") + 1)), state.active(details, batches, exclusions), exclusions)
    return candidates.select("order_number", F.lit("candidate").alias("view")).unionByName(confirmed.select("order_number", F.lit("confirmed").alias("view")))


GIVEN = f"""g AS (SELECT CASE WHEN n % 50 = 1 THEN ' ' WHEN n % 50 = 2 THEN 'none' || n ELSE order_number END AS order_number, CASE WHEN n % 50 = 3 THEN 'other' ELSE subcategory END AS subcategory FROM (SELECT *, {NUMBER} AS n FROM order_rows WHERE {NUMBER} % 5 = 1)
  UNION ALL SELECT order_number, subcategory FROM order_rows WHERE {NUMBER} % 100 = 26)"""


@query(f"{STATE}, {GIVEN}, t AS (SELECT trim(order_number) AS order_number, subcategory, count(*) OVER (PARTITION BY trim(order_number)) AS times FROM g) SELECT t.order_number, t.subcategory, CASE WHEN t.order_number = '' THEN 'blank' WHEN times > 1 THEN 'twice' WHEN o.order_number IS NULL THEN 'unknown' WHEN t.subcategory <> o.subcategory THEN 'mismatch' WHEN t.order_number IN (SELECT order_number FROM on_) THEN 'active' END AS problem FROM t LEFT JOIN order_rows o ON o.order_number = t.order_number")
def registration_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, details, batches, exclusions = _tables(spark, sf_dir)
    n = F.col("order_number").cast("long")
    given = rows.where(n % 5 == 1).select(F.when(n % 50 == 1, " ").when(n % 50 == 2, F.concat(F.lit("none"), "order_number")).otherwise(F.col("order_number")).alias("order_number"), F.when(n % 50 == 3, "other").otherwise(F.col("subcategory")).alias("subcategory"))
    given = given.unionByName(rows.where(n % 100 == 26).select("order_number", "subcategory"))
    return state.registration(given, rows, state.active(details, batches, exclusions), most=10**9)


@query(f"{STATE} SELECT 'good' AS given, count(*) + (SELECT count(*) FROM order_rows WHERE NOT is_error AND {NUMBER} % 40 = 6) AS details FROM e UNION ALL SELECT 'bad', count(*) FROM e")
def registration_all_or_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are all good become details; with one bad row among them, none does."""
    rows, details, batches, exclusions = _tables(spark, sf_dir)
    n = F.col("order_number").cast("long")
    good = rows.where(~F.col("is_error") & (n % 40 == 6)).select("order_number", "subcategory")
    bad = good.unionByName(spark.createDataFrame([("none", "x")], "order_number string, subcategory string"))
    known, on = rows.withColumn("detail_id", n), state.active(details, batches, exclusions)
    done = lambda given, name: state.register(details, state.registration(given, known, on, most=10**9), known, 9).agg(F.lit(name).alias("given"), F.count("*").alias("details"))
    return done(good, "good").unionByName(done(bad, "bad"))


@query(f"{STATE} SELECT business, count(*) FILTER (n % 7 <> 0) AS taken, count(*) FILTER (n % 7 = 0) AS doubled FROM e GROUP BY business")
def historical_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A refresh in which every seventh order stands twice."""
    rows = D.order_rows(spark, sf_dir).where("is_error")
    again = rows.where(F.col("order_number").cast("long") % 7 == 0)
    taken, doubled = state.replace_historical(rows.unionByName(again))
    both = taken.select("business", F.lit(True).alias("good")).unionByName(doubled.join(rows.select("order_number", "business"), "order_number").select("business", F.lit(False).alias("good")))
    return both.groupBy("business").agg(F.count_if("good").alias("taken"), F.count_if(~F.col("good")).alias("doubled"))


@query(f"{ORDERS} SELECT order_date, business, {TOTALS} FROM cube WHERE order_date BETWEEN DATE '1996-02-01' AND DATE '1996-02-29' AND person = 'NATION_3' GROUP BY ALL UNION ALL SELECT NULL, business, {TOTALS} FROM cube WHERE order_date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' AND business = 'ASIA' GROUP BY ALL", dates=("order_date",))
def period_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A month of one person by day, and a year of one business."""
    whole = orders_cube(spark, sf_dir)
    sums = [F.sum(c).alias(c) for c in ("total_count", "error_count")]
    month, year = bi.window("month", 1996, 2), bi.window("year", 1996)
    a = cube.within(whole, str(month[0]), str(month[1]), person="NATION_3").groupBy("order_date", "business").agg(*sums)
    b = cube.within(whole, str(year[0]), str(year[1]), business="ASIA").groupBy("business").agg(*sums).select(F.lit(None).cast("date").alias("order_date"), "business", "total_count", "error_count")
    return a.unionByName(b)


@query(f"WITH {D.ORDER_ROWS_SQL}, d AS (SELECT person, coalesce(nullif(CASE WHEN {NUMBER} % 9 = 0 THEN ' ' ELSE subcategory END, ' '), '(미분류)') AS category, CASE WHEN {NUMBER} % 5 = 0 THEN '(내용 없음)' ELSE business END AS detail FROM order_rows WHERE is_error), g AS (SELECT person, category, detail, count(*) AS n FROM d GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY person ORDER BY n DESC, category, detail) AS place FROM g")
def person_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A person's errors by category and detail, the largest group first; blank ones under a name of their own."""
    n = F.col("order_number").cast("long")
    rows = D.order_rows(spark, sf_dir).where("is_error").select("person", F.when(n % 9 == 0, " ").otherwise(F.col("subcategory")).alias("category"), F.when(n % 5 != 0, F.col("business")).alias("detail"))
    return bi.grouped_details(rows)
