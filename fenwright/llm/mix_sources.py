"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Sources share a budget of words by weight. No source gives more than `most` times its size; what
it cannot give is shared among the others by weight, until none is above. Within a source,
documents stand in an order shuffled by a hash of their id. A document's virtual finish time is
the number of its source's words up to its end, divided by the source's target, so every source
reaches 1 exactly when its target is used up, and the mix is the documents in order of that
time, cut at 1, where the words of all sources together are the budget. Sources that give more
than they have go round again (copies 1, 2, ...).

A source may hold most of the rows: prefix sums are taken in two levels, over buckets of the
shuffled order and inside them, so no task holds a source.

Cases: null text has size 0 and takes nothing; a null source is one of its own and the last.
Rows of one id are told apart by size; repeated rows count as often as they stand, and which of
them is cut makes no difference. An empty table gives an empty mix. Extra columns stay as they
are, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fenwright.llm import _store, _text

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
ROWS_A_BUCKET, BUCKET_DIGITS = 2048, 4
#: Up to so many sources their table is broadcast.
FEW_SOURCES = 10_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def shuffled(id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """For sizes (source, source_size): those and target. One row a source, so one task may order them."""
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    level = (share * F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    leveled = weighed.withColumn("nth", F.row_number().over(order)).withColumn("level", level).withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    filled = leveled.withColumn("water", F.min_by("level", F.when(~F.col("capped"), F.col("nth"))).over(Window.partitionBy()))
    return filled.select("source", "source_size", F.when(F.col("capped") | F.col("water").isNull(), F.col("cap")).otherwise(F.col("water") * F.col("weight")).cast("double").alias("target"))


def schedule(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = "mix", keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """docs (doc_id, source, text and others; or the columns of `keep`) with one struct column more, and its name: size,
    source_size, target, start (words of the source before the document), finish (virtual, of
    its first copy) and takes (words taken of each copy)."""
    spark = docs.sparkSession
    q = _text.fresh(docs, "wfq")
    own = F.struct(word_count(F.col("text")).alias("size"), shuffled(F.col("doc_id"), seed).alias("key"), F.col("source").alias("source"), F.col("doc_id").alias("id"))
    narrow = _store.written(docs.select(own.alias("w")).select("w.*"), "mix-sizes")
    n, n_sources = narrow.agg(F.count("*"), F.count_distinct(F.coalesce("source", F.lit("\0")))).first()
    digits = max(0, min(BUCKET_DIGITS, math.ceil(math.log(max(1, n / ROWS_A_BUCKET), 16))))
    bucket = F.substring("key", 1, digits) if digits else F.lit("")

    sums = narrow.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    goals = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    offsets = sums.select(F.col("source").alias("at_source"), F.col("bucket").alias("at_bucket"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("before"))
    goals = goals.withColumnRenamed("source", "of_source")
    if n_sources <= FEW_SOURCES:
        goals = F.broadcast(goals)
    buckets = offsets.join(goals, F.col("at_source").eqNullSafe(F.col("of_source"))).drop("of_source")

    rows = docs.select(F.struct(*(docs.columns if keep is None else keep)).alias("row"), own.alias("w")).select("row", "w.*").withColumn("bucket", F.substring("key", 1, digits) if digits else F.lit(""))
    joined = rows.join(buckets, F.col("source").eqNullSafe(F.col("at_source")) & (F.col("bucket") == F.col("at_bucket")))
    inside = Window.partitionBy("at_source", "at_bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.col("before") + F.sum("size").over(inside) - F.col("size")
    whole = F.floor(F.col("target")).cast("long")
    timed = joined.withColumn("start", start).withColumn("finish", F.when(F.col("target") > 0, (F.col("start") + F.col("size")) / F.col("target")).otherwise(F.lit(0.0)))
    takes = F.array(*[F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), whole - F.col("start") - k * F.col("source_size"))) for k in range(most)])
    return timed.select("row.*", F.struct("size", "source_size", "target", "start", "finish", takes.alias("takes")).alias(q)), q


def judge(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, virtual_finish; in order of the virtual time."""
    timed, q = schedule(docs.select("doc_id", "source", "text"), keep=["doc_id"])
    taken = F.aggregate(f"{q}.takes", F.lit(0).cast("long"), lambda a, x: a + x)
    out = timed.select("doc_id", f"{q}.size", f"{q}.source_size", f"{q}.target", taken.alias("taken"), F.col(f"{q}.finish").alias("virtual_finish"))
    return out.repartitionByRange("virtual_finish", "doc_id").sortWithinPartitions("virtual_finish", "doc_id")


def mix(docs: DataFrame) -> DataFrame:
    """The mix: a row for each copy of each document that is taken, with the columns of docs, range-sorted by virtual
    finish time. A copy that the cut goes through stays whole if half of it or more is within, else it goes; a
    document without words is neither source's nor budget's and stays once."""
    timed, q = schedule(docs)
    copy = _text.fresh(timed, "copy")
    copies = timed.select("*", F.posexplode(f"{q}.takes").alias(copy, copy + "_takes"))
    kept = copies.where((2 * F.col(copy + "_takes") >= F.col(f"{q}.size")) & ((F.col(f"{q}.size") > 0) | (F.col(copy) == 0)))
    due = F.col(f"{q}.finish") + F.when(F.col(f"{q}.target") > 0, F.col(copy) * F.col(f"{q}.source_size") / F.col(f"{q}.target")).otherwise(F.lit(0.0))
    return kept.withColumn(copy, due).repartitionByRange(copy, "doc_id").sortWithinPartitions(copy, "doc_id").select(*docs.columns)
