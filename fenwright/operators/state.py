"""Approvals, exclusions and uploads as tables: every change gives new tables, nothing is edited in place.

details: detail_id, batch_id, order_number and the cube's dimensions. batches: batch_id, batch_type (manual, auto),
job_id, approved_at, rolled_back. exclusions: order_number, at, restored (the latest entry of an order counts).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fenwright.operators import cube as C


def excluded(exclusions: DataFrame) -> DataFrame:
    """Orders whose latest entry excludes them."""
    last = exclusions.groupBy("order_number").agg(F.max_by("restored", "at").alias("restored"))
    return last.where("not restored").select("order_number")


def active(details: DataFrame, batches: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Details of batches in force, without excluded orders."""
    live = batches.where("not rolled_back").select("batch_id", "batch_type")
    return details.join(live, "batch_id").join(excluded(exclusions), "order_number", "left_anti")


def with_errors(totals: DataFrame, details: DataFrame) -> DataFrame:
    """A cube's totals with the active details as its errors; a detail without a total changes nothing, errors never pass the total."""
    deltas = details.select(*C.DIMENSIONS, F.lit(1).alias("delta"))
    return C.adjust(totals.withColumn("error_count", F.lit(0).cast("long")), deltas)


def approve(details: DataFrame, batches: DataFrame, exclusions: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new, refused) of rows to approve: refused are orders given twice and those already active."""
    known = active(details, batches, exclusions).select("order_number").distinct().withColumn("known", F.lit(True))
    nth = F.count("*").over(Window.partitionBy("order_number"))
    marked = rows.withColumn("times", nth).join(known, "order_number", "left")
    good = (F.col("times") == 1) & F.col("known").isNull()
    return marked.where(good).drop("times", "known"), marked.where(~good).drop("times", "known")


def registration(rows: DataFrame, known: DataFrame, active_details: DataFrame, most: int = 500) -> DataFrame:
    """Preview of rows (order_number, subcategory) to register as errors by hand, each with its problem, null if there is none: blank
    number, given twice, not among the known orders (order_number, subcategory, ..), of another subcategory there, or active
    already; all have one if they are more than `most`."""
    number = F.trim(F.coalesce("order_number", F.lit("")))
    times = F.count("*").over(Window.partitionBy("order_number"))
    given = rows.withColumn("order_number", number).withColumn("times", times)
    given = given.withColumn("given", F.lit(given.limit(most + 1).count()))
    there = known.groupBy("order_number").agg(F.min("subcategory").alias("theirs"))
    on = active_details.select("order_number").distinct().withColumn("on", F.lit(True))
    joined = given.join(there, "order_number", "left").join(on, "order_number", "left")
    problem = (
        F.when(F.col("given") > most, "too_many").when(F.col("order_number") == "", "blank").when(F.col("times") > 1, "twice")
        .when(F.col("theirs").isNull(), "unknown").when(~F.col("subcategory").eqNullSafe(F.col("theirs")), "mismatch").when(F.col("on"), "active")
    )
    return joined.withColumn("problem", problem).select("order_number", "subcategory", "problem")


def register(details: DataFrame, preview: DataFrame, known: DataFrame, batch_id: int) -> DataFrame:
    """details with the previewed rows as details of a batch, all of them or, if one has a problem, none."""
    if not preview.where("problem is not null").isEmpty():
        return details
    first = known.groupBy("order_number").agg(F.min(F.struct("detail_id", *C.DIMENSIONS)).alias("k"))
    new = preview.select("order_number").join(first, "order_number").select("order_number", "k.*").withColumn("batch_id", F.lit(batch_id).cast("long"))
    return details.unionByName(new.select(*details.columns))


def replace_historical(fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(details, doubled): a full refresh of historical details; orders that stand there twice are told, and none of them is taken."""
    counted = fresh.withColumn("times", F.count("*").over(Window.partitionBy("order_number")))
    return counted.where("times = 1").drop("times"), counted.where("times > 1").select("order_number", "times").distinct()


def roll_back_latest(batches: DataFrame, job_id: str | None = None) -> DataFrame:
    """batches with the latest manual one in force (of a job, if given) rolled back."""
    at = (F.col("batch_type") == "manual") & ~F.col("rolled_back")
    if job_id is not None:
        at = at & (F.col("job_id") == job_id)
    last = batches.where(at).agg(F.max_by("batch_id", F.struct("approved_at", "batch_id")).alias("last"))
    return batches.crossJoin(F.broadcast(last)).withColumn("rolled_back", F.col("rolled_back") | F.coalesce(F.col("batch_id") == F.col("last"), F.lit(False))).drop("last")


def replace_automatic(details: DataFrame, batches: DataFrame, fresh: DataFrame, exclusions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(details, counts) after an upload: automatic details of the uploaded days go, fresh ones come, except orders that
    a manual batch holds or that are excluded."""
    typed = details.join(batches.select("batch_id", "batch_type", "rolled_back"), "batch_id")
    days = fresh.select("order_date").distinct()
    gone = typed.where("batch_type = 'auto'").join(days, "order_date", "left_semi")
    kept = details.join(gone.select("detail_id"), "detail_id", "left_anti")
    manual = typed.where("batch_type = 'manual' and not rolled_back").select("order_number").distinct()
    new = fresh.join(manual, "order_number", "left_anti").join(excluded(exclusions), "order_number", "left_anti")
    counts = gone.agg(F.count("*").alias("replaced")).crossJoin(fresh.join(manual, "order_number", "left_semi").agg(F.count("*").alias("skipped_manual")))
    return kept.unionByName(new.select(*details.columns)), counts


def reconnect(details: DataFrame, rows: DataFrame) -> DataFrame:
    """Details with the dimensions of the latest upload, where it has the order."""
    dims = C.DIMENSIONS
    now = rows.select("order_number", *(F.col(d).alias(f"new_{d}") for d in dims))
    return details.join(now, "order_number", "left").select(*[F.coalesce(F.col(f"new_{c}"), F.col(c)).alias(c) if c in dims else F.col(c) for c in details.columns])


def views(classified: DataFrame, active_details: DataFrame, exclusions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates, confirmed) of classified rows (order_number, is_auto, position): active orders are confirmed once, excluded
    automatic ones go back to the candidates."""
    on = active_details.select("order_number").distinct()
    off = excluded(exclusions)
    confirmed = classified.join(on, "order_number", "left_semi")
    candidates = classified.join(on, "order_number", "left_anti").join(off.withColumn("off", F.lit(True)), "order_number", "left").where("not is_auto or off").drop("off")
    first = lambda df: df.withColumn("_n", F.row_number().over(Window.partitionBy("order_number").orderBy("position"))).where("_n = 1").drop("_n")
    return first(candidates), first(confirmed)
