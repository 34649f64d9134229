"""Streams of events: counts by window with late data, and sessions. The batch
engine needs none of it; it lets the same measures follow a feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events and their value by type and window; events later than ``late`` are
    left out of a stream."""
    own = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = own.withWatermark("ts", late) if own.isStreaming else own
    out = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("value"))
    return out.select(F.col("w.start").cast("string").alias("window_start"), "event_type", "events", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """Runs of a user's events without a longer gap."""
    own = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = own.withWatermark("ts", late) if own.isStreaming else own
    out = timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("events"))
    return out.select("user_id", F.col("w.start").cast("string").alias("session_start"), "events")


def follow(spark: SparkSession, folder: str, schema, name: str):
    """A query that keeps the counts of a growing folder in memory, for a viewer."""
    events = spark.readStream.schema(schema).parquet(folder)
    return windowed_counts(events).writeStream.format("memory").queryName(name).outputMode("complete").start()
