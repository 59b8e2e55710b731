"""Ledger aggregates as streams: the batch plans over files that arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def daily(calls: DataFrame) -> DataFrame:
    """Calls and reserved tokens by day; the same plan for a table and for a stream (A3)."""
    return calls.groupBy("day").agg(F.count("*").alias("calls"), F.coalesce(F.sum("reserved"), F.lit(0)).alias("tokens"))


def windows(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by window and type; on a stream, events later than ``late`` are left out."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("at", late)
    return timed.groupBy(F.window("at", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("start"), "event_type", "n", "total"
    )


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Runs of a user's events with no gap as long as ``gap``."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("at", gap)
    return timed.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(
        "user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n"
    )


def due(schedule: DataFrame, now: float, interval: float) -> DataFrame:
    """``schedule`` with ``fires`` and the next due time: what is due fires once, however late."""
    fires = F.col("next_due") <= F.lit(now)
    return schedule.withColumn("fires", fires).withColumn("next_due", F.when(fires, F.lit(now + interval)).otherwise(F.col("next_due")))


def drain(spark: SparkSession, source: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run a streaming aggregate over all that is there, into a Parquet folder per batch, and read the last state.

    The checkpoint folder makes a restart continue where it stopped; writing a
    batch again overwrites its own folder, so no row counts twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number:09d}")

    query = source.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(path)
    if mode == "complete":
        rows = rows.filter(F.col("batch") == rows.agg(F.max("batch")).first()[0])
    return rows.drop("batch")
