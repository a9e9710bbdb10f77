"""The tables at hand as the library's domain: orders with errors, events as a cube, points, texts.

Order rows come from orders, customer, nation and region; an order is in error if its status is F,
cancelled if its status is P and its key divisible by 7. Points are the first two embedding values in metres.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUSINESSES = ("중부", "북부", "남부", "동부", "서부")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """rows of a scan over all cores. A table of one row group is one task's, however much work its texts are; one of many is left alone."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_number, order_date, person, business, subcategory, department, cancelled, is_error."""
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.select(
        F.col("o_orderkey").cast("string").alias("order_number"),
        F.to_date("o_orderdate").alias("order_date"),
        F.col("n_name").alias("person"),
        F.col("r_name").alias("business"),
        F.col("o_orderpriority").alias("subcategory"),
        F.when(F.col("o_custkey") % 4 != 0, "사업부").otherwise("품질").alias("department"),
        ((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 7 == 0)).alias("cancelled"),
        (F.col("o_orderstatus") == "F").alias("is_error"),
    )


ORDER_ROWS_SQL = """order_rows AS (
  SELECT o_orderkey::VARCHAR AS order_number, o_orderdate::DATE AS order_date, n_name AS person, r_name AS business, o_orderpriority AS subcategory,
         CASE WHEN o_custkey % 4 <> 0 THEN '사업부' ELSE '품질' END AS department,
         o_orderstatus = 'P' AND o_orderkey % 7 = 0 AS cancelled, o_orderstatus = 'F' AS is_error
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, order_date, person, business, subcategory, is_error, k."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.to_date("ts").alias("order_date"),
        F.concat(F.lit("u"), F.col("user_id")).alias("person"),
        F.element_at(F.array(*map(F.lit, BUSINESSES)), (F.col("user_id") % 5 + 1).cast("int")).alias("business"),
        F.concat(F.lit("c"), F.get_json_object("props", "$.k").cast("int") % 6).alias("subcategory"),
        (F.col("event_type") == "error").alias("is_error"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


EVENT_ROWS_SQL = """event_rows AS (
  SELECT event_id, ts::DATE AS order_date, 'u' || user_id AS person, ['중부', '북부', '남부', '동부', '서부'][user_id % 5 + 1] AS business,
         'c' || (json_extract_string(props, '$.k')::INT % 6) AS subcategory, event_type = 'error' AS is_error, json_extract_string(props, '$.k')::BIGINT AS k
  FROM events)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x, y (metres, whole centimetres), label, orders."""
    e = table(spark, sf_dir, "embeddings")
    metres = lambda i: (F.floor(F.element_at("embedding", i).cast("double") * 1000000) / 100.0)
    return e.select(F.col("vec_id").alias("id"), metres(1).alias("x"), metres(2).alias("y"), "label", (F.col("vec_id") % 7 + 1).alias("orders"))


POINTS_SQL = """points AS (
  SELECT vec_id AS id, floor(embedding[1]::DOUBLE * 1000000) / 100.0 AS x, floor(embedding[2]::DOUBLE * 1000000) / 100.0 AS y, label, vec_id % 7 + 1 AS orders FROM embeddings)"""
