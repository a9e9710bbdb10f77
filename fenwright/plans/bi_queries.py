"""Overview queries over events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fenwright.operators import bi, cube
from fenwright.plans import domain as D
from fenwright.registry import query

CUBE = "SELECT order_date, person, business, subcategory, count(*) AS total_count, sum(is_error::INT)::BIGINT AS error_count FROM {0} GROUP BY ALL"
EVENTS = f"WITH {D.EVENT_ROWS_SQL}, cube AS ({CUBE.format('event_rows')})"
ORDERS = f"WITH {D.ORDER_ROWS_SQL}, cube AS ({CUBE.format('order_rows')})"
SUMS = "sum(total_count)::BIGINT AS total_count, sum(error_count)::BIGINT AS error_count"
RATE = "coalesce(round_even(sum(error_count)::DOUBLE / nullif(sum(total_count), 0)::DOUBLE * 100, 2), 0)"
SUMS_RATE = f"{SUMS}, {RATE} AS error_rate"


def events_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube.build(D.event_rows(spark, sf_dir))


def orders_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube.build(D.order_rows(spark, sf_dir))


@query(f"{EVENTS} SELECT * FROM cube", dates=("order_date",))
def cube_events_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_cube(spark, sf_dir)


@query(f"{ORDERS} SELECT date_trunc('month', order_date)::DATE AS order_date, person, business, subcategory, {SUMS} FROM cube GROUP BY ALL", dates=("order_date",))
def cube_orders_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube.merge(orders_cube(spark, sf_dir).withColumn("order_date", F.trunc("order_date", "month")))


@query(f"{ORDERS} SELECT * FROM cube", dates=("order_date",))
def cube_merge_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cubes of two halves of the rows, merged: the same as the cube of all."""
    rows = D.order_rows(spark, sf_dir)
    half = F.crc32("order_number") % 2
    return cube.merge(cube.build(rows.where(half == 0)), cube.build(rows.where(half == 1)))


@query(f"{EVENTS} SELECT 0::BIGINT AS negative, 0::BIGINT AS excess, count(*) FILTER (WHERE order_date < DATE '2024-01-10' OR order_date > DATE '2024-01-25') AS outside, 0::BIGINT AS doubled FROM cube")
def cube_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube.violations(events_cube(spark, sf_dir), "2024-01-10", "2024-01-25")


FILLED = "SELECT {keys}, coalesce(sum(total_count), 0)::BIGINT AS total_count, coalesce(sum(error_count), 0)::BIGINT AS error_count, " + RATE + " AS error_rate"


@query(f"{EVENTS} {FILLED.format(keys='d::DATE AS bucket')} FROM range(DATE '2023-12-25', DATE '2024-02-06', INTERVAL 1 DAY) s(d) LEFT JOIN cube ON order_date = d::DATE GROUP BY d", dates=("bucket",))
def trend_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bi.trend(events_cube(spark, sf_dir), "2023-12-25", "2024-02-05")


@query(f"{EVENTS}, b AS (SELECT DISTINCT business FROM cube) {FILLED.format(keys='d::DATE AS bucket, b.business')} FROM range(DATE '2024-01-01', DATE '2024-02-01', INTERVAL 1 DAY) s(d) CROSS JOIN b LEFT JOIN cube ON order_date = d::DATE AND cube.business = b.business GROUP BY d, b.business", dates=("bucket",))
def trend_by_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bi.trend(events_cube(spark, sf_dir), "2024-01-01", "2024-01-31", series="business")


@query(f"{ORDERS} {FILLED.format(keys='d::DATE AS bucket')} FROM range(DATE '1994-11-01', DATE '2002-01-01', INTERVAL 1 MONTH) s(d) LEFT JOIN cube ON date_trunc('month', order_date)::DATE = d::DATE GROUP BY d", dates=("bucket",))
def trend_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bi.trend(orders_cube(spark, sf_dir), "1994-11-15", "2001-12-15", by="month")


@query(f"{ORDERS} SELECT year(order_date)::INT AS year, {SUMS_RATE} FROM cube GROUP BY 1")
def yearly_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bi.yearly(orders_cube(spark, sf_dir))


@query(f"{ORDERS} SELECT year(order_date)::INT AS year, {SUMS_RATE} FROM cube WHERE month(order_date) = 2 GROUP BY 1")
def yearly_rate_of_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bi.yearly(orders_cube(spark, sf_dir), month=2)


@query(f"{ORDERS} SELECT {SUMS_RATE}, max(order_date) AS last_date FROM cube", dates=("last_date",))
def overview_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bi.summary(orders_cube(spark, sf_dir))


@query(f"{ORDERS} SELECT min(order_date) AS first_date, max(order_date) AS last_date, count(DISTINCT person) AS people, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT business AS x FROM cube)) AS businesses, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT strftime(order_date, '%Y-%m') AS x FROM cube)) AS months FROM cube", dates=("first_date", "last_date"))
def filter_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bi.filters(orders_cube(spark, sf_dir))


@query(f"{ORDERS} SELECT subcategory, {SUMS_RATE} FROM cube GROUP BY ALL")
def by_subcategory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bi.by_dimensions(orders_cube(spark, sf_dir), "subcategory")


@query(f"{ORDERS} SELECT business, person, {SUMS_RATE} FROM cube GROUP BY ALL")
def by_business_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bi.by_dimensions(orders_cube(spark, sf_dir), "business", "person")


@query(f"{ORDERS} SELECT subcategory, business, person, grouping(subcategory, business, person)::INT AS gid, {SUMS_RATE} FROM cube WHERE order_date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' GROUP BY GROUPING SETS ((subcategory), (business), (business, person))")
def overview_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bi.overview(orders_cube(spark, sf_dir), "1996-01-01", "1998-12-31")


RANKED = "SELECT *, row_number() OVER (ORDER BY {0}) AS rank FROM g QUALIFY rank <= {1}"


@query(f"{ORDERS}, g AS (SELECT subcategory, {SUMS_RATE} FROM cube GROUP BY ALL) " + RANKED.format("error_count DESC, error_rate DESC, subcategory", 3))
def rank_subcategory_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bi.ranking(orders_cube(spark, sf_dir), ["subcategory"], "count", 3)


@query(f"{ORDERS}, g AS (SELECT business, person, {SUMS_RATE} FROM cube GROUP BY ALL) " + RANKED.format("error_rate DESC, error_count DESC, business, person", 10))
def rank_person_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bi.ranking(orders_cube(spark, sf_dir), ["business", "person"], "rate", 10)


@query(f"{ORDERS}, g AS (SELECT business, person, {SUMS_RATE} FROM cube GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY business ORDER BY error_count DESC, error_rate DESC, person) AS rank, coalesce(round_even(error_count::DOUBLE / nullif(sum(error_count) OVER (PARTITION BY business), 0)::DOUBLE * 100, 1), 0) AS share FROM g")
def person_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bi.benchmark(orders_cube(spark, sf_dir))


def compared_sql(now: tuple[str, str], then: tuple[str, str], key: str) -> str:
    part = lambda c, p: f"coalesce(sum({c}) FILTER (WHERE order_date BETWEEN DATE '{p[0]}' AND DATE '{p[1]}'), 0)::BIGINT"
    r = lambda p: f"coalesce(round_even({p}_error::DOUBLE / nullif({p}_total, 0)::DOUBLE * 100, 2), 0)"
    return f"""{ORDERS}, b AS (SELECT {key}, {part('total_count', now)} AS current_total, {part('error_count', now)} AS current_error, {part('total_count', then)} AS previous_total, {part('error_count', then)} AS previous_error
      FROM cube WHERE order_date BETWEEN DATE '{now[0]}' AND DATE '{now[1]}' OR order_date BETWEEN DATE '{then[0]}' AND DATE '{then[1]}' GROUP BY {key}),
    c AS (SELECT *, {r('current')} AS current_rate, {r('previous')} AS previous_rate FROM b),
    compared AS (SELECT *, current_error - previous_error AS delta_count, round_even(current_rate - previous_rate, 2) AS delta_rate FROM c)"""


MAY, APRIL, LAST_MAY = ("1998-05-01", "1998-05-31"), ("1998-04-01", "1998-04-30"), ("1997-05-01", "1997-05-31")


@query(compared_sql(MAY, APRIL, "business") + " SELECT * FROM compared")
def compare_prev_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bi.compare(orders_cube(spark, sf_dir), MAY, APRIL, "business")


@query(compared_sql(MAY, LAST_MAY, "subcategory") + " SELECT * FROM compared")
def compare_prev_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bi.compare(orders_cube(spark, sf_dir), MAY, LAST_MAY, "subcategory")


@query(compared_sql(MAY, APRIL, "person") + " SELECT * FROM compared ORDER BY abs(delta_count) DESC, current_error DESC, person LIMIT 10")
def delta_causes_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bi.causes(bi.compare(orders_cube(spark, sf_dir), MAY, APRIL, "person"), "person")


@query(f"{EVENTS} SELECT business, {SUMS_RATE}, list_position(['중부', '북부', '남부', '동부', '서부'], business)::BIGINT AS position FROM cube GROUP BY business")
def business_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bi.in_order(bi.by_dimensions(events_cube(spark, sf_dir), "business"), "business", D.BUSINESSES)


@query(f"{EVENTS}, d AS (SELECT order_date, {SUMS_RATE} FROM cube WHERE order_date BETWEEN DATE '2024-01-03' AND DATE '2024-01-27' GROUP BY 1) SELECT round_even(quantile_cont(error_rate, 0.2), 2) AS p20, round_even(quantile_cont(error_rate, 0.8), 2) AS p80, count(*) AS days FROM d")
def rate_baseline_p20_p80(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bi.baseline(events_cube(spark, sf_dir), "2024-01-03", "2024-01-27")


def _details(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = D.event_rows(spark, sf_dir).where("is_error").withColumn("automatic", F.col("k") % 10 == 0)
    return rows.where("order_date >= date'2024-01-15'"), rows.where("order_date < date'2024-01-15'")


PATTERNS = f"""WITH {D.EVENT_ROWS_SQL}, d AS (SELECT *, k % 10 = 0 AS automatic FROM event_rows WHERE is_error),
marked AS (SELECT event_id, business, subcategory, k, order_date, automatic OR EXISTS (SELECT 1 FROM d p WHERE p.order_date < DATE '2024-01-15' AND p.subcategory = d.subcategory AND p.business = d.business AND p.k = d.k)
  OR row_number() OVER (PARTITION BY subcategory, business, k ORDER BY order_date, event_id) > 1 AS repeated FROM d WHERE order_date >= DATE '2024-01-15')"""


@query(PATTERNS + " SELECT event_id, repeated FROM marked")
def patterns_new_vs_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, before = _details(spark, sf_dir)
    return bi.new_or_repeated(now, before, ["subcategory", "business", "k"], ["order_date", "event_id"]).select("event_id", "repeated")


@query(PATTERNS + " SELECT subcategory, business, k, count(*) AS n FROM marked WHERE repeated GROUP BY ALL HAVING count(*) >= 3 ORDER BY n DESC, subcategory, business, k LIMIT 8")
def patterns_top_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, before = _details(spark, sf_dir)
    return bi.top_patterns(bi.new_or_repeated(now, before, ["subcategory", "business", "k"], ["order_date", "event_id"]), ["subcategory", "business", "k"])
