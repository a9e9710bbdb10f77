"""The metrics cube: totals and errors by (order_date, person, business, subcategory)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = ("order_date", "person", "business", "subcategory")
UNKNOWN = "(미확인)"


def clean_dimension(c: Column) -> Column:
    """Trimmed of any Unicode space; null and blank become the unknown mark, so grouping keys are never null."""
    return F.coalesce(F.nullif(F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", ""), F.lit("")), F.lit(UNKNOWN))


def build(rows: DataFrame) -> DataFrame:
    """Cube of rows (the dimensions and is_error). Rows without a date do not count; a null flag is no error."""
    cleaned = rows.where("order_date is not null").select("order_date", *(clean_dimension(F.col(d)).alias(d) for d in DIMENSIONS[1:]), F.coalesce("is_error", F.lit(False)).cast("long").alias("e"))
    return cleaned.groupBy(*DIMENSIONS).agg(F.count("*").alias("total_count"), F.sum("e").alias("error_count"))


def merge(*parts: DataFrame) -> DataFrame:
    """Cubes of several months or sources as one."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*DIMENSIONS).agg(F.sum("total_count").alias("total_count"), F.sum("error_count").alias("error_count"))


def violations(cube: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """One row of counts of what a cube must not hold: negative counts, more errors than rows, days outside the period, doubled keys."""
    outside = F.lit(False)
    if start:
        outside = outside | (F.col("order_date") < F.lit(start).cast("date"))
    if end:
        outside = outside | (F.col("order_date") > F.lit(end).cast("date"))
    doubled = cube.groupBy(*DIMENSIONS).count().where("count > 1").agg(F.count("*").alias("doubled"))
    return cube.agg(F.count_if((F.col("total_count") < 0) | (F.col("error_count") < 0)).alias("negative"), F.count_if(F.col("error_count") > F.col("total_count")).alias("excess"), F.count_if(outside).alias("outside")).join(doubled)


def within(cube: DataFrame, start: str, end: str, person: str | None = None, business: str | None = None) -> DataFrame:
    """Rows of an inclusive period, and of one person or business if given; the predicates reach the scan."""
    out = cube.where(F.col("order_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if person is not None:
        out = out.where(F.col("person") == person)
    return out if business is None else out.where(F.col("business") == business)


def rate(error: Column, total: Column) -> Column:
    """Percent to two decimals, half to even; 0 without rows."""
    return F.coalesce(F.bround(F.try_divide(error, total) * 100, 2), F.lit(0.0))


def replace_period(cube: DataFrame, fresh: DataFrame, start: str, end: str) -> DataFrame:
    """The cube with an inclusive period exchanged for what `fresh` holds of it."""
    inside = F.col("order_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return cube.where(~inside).unionByName(fresh.where(inside))


def replace_dates(cube: DataFrame, fresh: DataFrame) -> DataFrame:
    """The cube with all days of `fresh` exchanged: loading the same upload again changes nothing."""
    return cube.join(fresh.select("order_date").distinct(), "order_date", "left_anti").unionByName(fresh)


def adjust(cube: DataFrame, deltas: DataFrame) -> DataFrame:
    """error_count moved by deltas (dimensions, delta), never below 0 or above total_count."""
    summed = deltas.groupBy(*DIMENSIONS).agg(F.sum("delta").alias("delta"))
    moved = F.greatest(F.lit(0), F.least(F.col("total_count"), F.col("error_count") + F.coalesce("delta", F.lit(0))))
    return cube.join(summed, list(DIMENSIONS), "left").select(*DIMENSIONS, "total_count", moved.alias("error_count"))
