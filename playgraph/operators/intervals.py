"""Intervals and hours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from playgraph.functions.text import hour_key, offset_in_hour


def search_windows(offsets: DataFrame, key: str, offset: str, half_width: int = 300_000, length: int = 3_600_000) -> DataFrame:
    """GRF-21: the window of each offset, clamped to the hour (milliseconds)."""
    return offsets.withColumn("start_ms", F.greatest(F.lit(0), F.col(offset) - half_width)).withColumn("end_ms", F.least(F.lit(length), F.col(offset) + half_width))


def merge_windows(windows: DataFrame, key: str, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """JN-17, WIN-06: overlapping or touching windows of a key as one, with their number: a running maximum of ends marks the
    gaps, a running sum of gaps numbers the islands."""
    w = Window.partitionBy(key).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    g = windows.where(F.col(start).isNotNull() & F.col(end).isNotNull()).withColumn("_b", before)
    g = g.withColumn("_i", F.sum(F.when(F.col("_b").isNull() | (F.col(start) > F.col("_b")), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy(key, "_i").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("_i")


def hour_buckets(entries: DataFrame, ts: str) -> DataFrame:
    """JN-18: entries with their hour's object key and the offset in it."""
    return entries.where(F.col(ts).isNotNull()).withColumn("hour_key", hour_key(F.col(ts))).withColumn("offset_s", offset_in_hour(F.col(ts)))
