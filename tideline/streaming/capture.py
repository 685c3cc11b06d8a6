"""Vintages from a stream: each micro-batch is written idempotently, and late revisions stand beside what they revise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

KEYS = ["source", "series_id", "period", "vintage_date"]


def write_batch(path: str):
    """A foreachBatch function: one folder for each batch number, written anew if the batch is repeated, so a restart changes nothing."""

    def put(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c not in KEYS]
        once = batch.groupBy(*KEYS).agg(F.max(F.struct(*rest)).alias("_r")).select(*KEYS, "_r.*")
        once.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return put


def capture(observations: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Starts the capture of a streaming DataFrame of observations; with once, of what is there now."""
    writer = observations.writeStream.foreachBatch(write_batch(path)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest(spark, path: str) -> DataFrame:
    """The captured observations, of each key as the latest batch has it."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in KEYS]
    return rows.groupBy(*KEYS).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*KEYS, "_r.*").drop("batch")


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 day", slide: str | None = None, late: str = "2 days") -> DataFrame:
    """Counts and sums by key in tumbling (or sliding) windows of event time; events later than `late` are left out once their window is closed."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(window.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), key, "n", "total")
