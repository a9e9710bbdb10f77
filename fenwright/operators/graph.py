"""Connected components of undirected graphs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fenwright.operators.cut import cut as table


#: Beyond so many edges the steps of a round are tables of their own.
FEW_EDGES = 1_000_000


def connected_components(edges: DataFrame, left: str, right: str, cut: Callable[[DataFrame], DataFrame] = table) -> DataFrame:
    """(node, component) of every node that has an edge; component is the smallest node reachable.

    Large-star and small-star rounds: each joins every edge with the smallest neighbour of its end,
    so that a node with very many edges is an ordinary skewed join, which Spark can split as, in large
    graphs, both its sides are tables, and no neighbour list is ever gathered. Rounds end when the edges no
    longer change, after about the logarithm of the longest shortest path. Null ends and loops are ignored (a loop alone gives no row).
    """
    e = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u is not null and v is not null and u <> v")
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
        step = cut if now[0] > FEW_EDGES else (lambda df: df)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = step(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = step(both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # Every node of `large` points to a smaller one; link those it points to, and itself, to the smallest.
        least = step(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
