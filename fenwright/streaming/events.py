"""Event streams: the cube kept current by day, windowed counts with late data, and resuming a log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fenwright.operators import cube


def read(spark: SparkSession, folder: str, schema: str, files_a_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def after(log: DataFrame, last: int) -> DataFrame:
    """Entries of an event log after the one last seen."""
    return log.where(F.col("id") > last)


def windowed(events: DataFrame, late: str = "2 hours", size: str = "1 hour") -> DataFrame:
    """Counts and errors by window and business; a window is final when the watermark has passed it."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "business").agg(F.count("*").alias("total_count"), F.count_if("is_error").alias("error_count")).select(F.col("window.start").alias("start"), "business", "total_count", "error_count")


def keep_cube(rows: DataFrame, rows_path: str, cube_path: str, checkpoint: str) -> StreamingQuery:
    """Keep a cube, partitioned by day, current with a stream of rows (row_id, dimensions, is_error).

    Each batch's rows are written under its number, so a repeated batch overwrites itself; then only the days
    it touched are built again from all their rows and replaced, so the cube is right after any failure.
    """

    def update(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        dynamic = {"partitionOverwriteMode": "dynamic"}
        batch.where("order_date is not null").withColumn("batch", F.lit(number)).write.mode("overwrite").options(**dynamic).partitionBy("order_date", "batch").parquet(rows_path)
        days = batch.select("order_date").where("order_date is not null").distinct()
        if days.isEmpty():
            return
        touched = spark.read.parquet(rows_path).join(days, "order_date", "left_semi").dropDuplicates(["row_id"])
        cube.build(touched).write.mode("overwrite").options(**dynamic).partitionBy("order_date").parquet(cube_path)

    return rows.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
