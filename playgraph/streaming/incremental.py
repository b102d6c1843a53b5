"""Streaming extension: facet counts kept up to date, sessions inferred from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session_counts(events: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Events per inferred session, batch or stream: a session window closes after ``gap`` without events; a stream drops
    what comes later than ``late``."""
    e = events.withWatermark(ts, late) if events.isStreaming else events
    return e.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def facet_stream(plays: DataFrame, path: str, checkpoint: str):
    """Month counts per node as a stream: each micro-batch is aggregated and appended under its batch id, so a replayed batch
    overwrites itself; ``facet_counts`` sums them."""

    def write(batch: DataFrame, batch_id: int) -> None:
        agg = batch.where("artist_id is not null and month > 0").groupBy("artist_id", "month").agg(F.count("*").alias("plays"))
        agg.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return plays.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def facet_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("artist_id", "month").agg(F.sum("plays").alias("plays"))
