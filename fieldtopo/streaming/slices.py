"""Grids that arrive in time: slices as windowed aggregates of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import written  # noqa: F401  (makes sure that a shared folder is named)


def slice_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Streaming (or batch) counts and values of each event type by window; later rows than `late` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.floor("value").cast("long")).alias("total"))


def run_slice_counts(spark: SparkSession, source: str, root: str) -> DataFrame:
    """Run the stream over all files that are there, and return the last state of each window.

    Updates of each micro-batch are appended with their batch id; a batch that is run again replaces its own folder."""
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{source[:-1]}[{source[-1]}]")  # a pattern may stand for one file, a plain path may not

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.select(F.col("w.start").alias("start"), "event_type", "n", "total").write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")

    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    query = slice_counts(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    updates = spark.read.parquet(f"{root}/out")
    return updates.groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n"), F.max_by("total", "batch").alias("total"))
