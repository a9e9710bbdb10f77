"""Figures along long orders in two levels: inside ranges of the order, and what the ranges before carry over.

A key may hold most rows (a scope of all points). Its rows are dealt to ranges of its order, a task each; only one row a range
meets the others of its key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fenwright.operators.cut import cut

PART = "_part"


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df, as a table, with the number of the range of the order (keys, then `order`) that each row is in."""
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return cut(df.repartitionByRange(n, *keys, *order).withColumn(PART, F.spark_partition_id()), "ranges")


def inside(keys: Sequence[str], order: Sequence[str]) -> Window:
    return Window.partitionBy(*keys, PART).orderBy(*order)


def _over(keys: Sequence[str]) -> Window:
    """Ranges of a key, one row each."""
    return Window.partitionBy(*keys).orderBy(PART)


def _joined(rows: DataFrame, parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows and the figures of their range; a null key is a key."""
    of = [*keys, PART]
    renamed = parts.withColumnsRenamed({c: f"_of_{c}" for c in of})
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in of]
    return rows.join(renamed, same).drop(*(f"_of_{c}" for c in of))


def with_previous(rows: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """rows (of `ranged`) with struct `previous`: the values of the row before in the key's order; null at its beginning."""
    w = inside(keys, order)
    last = rows.groupBy(*keys, PART).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("last"))
    carried = last.select(*keys, PART, F.lag("last").over(_over(keys)).alias("carried"))
    return _joined(rows, carried, keys).withColumn("previous", F.coalesce(F.lag(F.struct(*values)).over(w), F.col("carried"))).drop("carried")


def with_running(rows: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """rows (of `ranged`) with running sums from the beginning of the key's order."""
    w = inside(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    added = rows.groupBy(*keys, PART).agg(*(F.sum(c).alias(f"{n}_") for n, c in sums.items()))
    before = added.select(*keys, PART, *(F.coalesce(F.sum(f"{n}_").over(_over(keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"{n}_") for n in sums))
    return _joined(rows, before, keys).withColumns({n: F.sum(c).over(w) + F.col(f"{n}_") for n, c in sums.items()}).drop(*(f"{n}_" for n in sums))
