"""Pairs of consecutive items within a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def adjacent_positional(df: DataFrame, session: str, order: list[str | Column], item: str) -> DataFrame:
    """WIN-01: (source, target, session) of each row and the next one of its session in ``order``. Gap tolerant; self pairs
    stay. ``order`` should be total, so that ties fall the same way every time. One shuffle, by session."""
    w = Window.partitionBy(session).orderBy(*order)
    return (
        df.select(F.col(session), F.col(item).alias("source"), F.lead(item).over(w).alias("target"))
        .where(F.col("source").isNotNull() & F.col("target").isNotNull())
        .select("source", "target", F.col(session).alias("session"))
    )


def adjacent_strict(df: DataFrame, session: str, seq: str, item: str, center_keep: list[str] | None = None) -> DataFrame:
    """JN-06: pairs whose sequence numbers differ by exactly one; repeated numbers multiply. Columns of the first side named in
    ``center_keep`` come along. The join key is (session, number), so one long session is spread over many tasks."""
    keep = center_keep or []
    a = df.select(F.col(session).alias("session"), (F.col(seq) + 1).alias("_k"), F.col(item).alias("source"), *keep)
    b = df.select(F.col(session).alias("session"), F.col(seq).alias("_k"), F.col(item).alias("target"), *[F.col(c).alias(f"next_{c}") for c in keep])
    return a.join(b, ["session", "_k"]).drop("_k")


def session_cooccurrence(df: DataFrame, session: str, seq: str, item: str) -> DataFrame:
    """JN-08: unordered item pairs in one session that are not neighbours there, with the number of such sessions. Pairs are
    built from distinct items; a long session is joined by pairs of salts (``sharing.key_pairs``), so it is spread over many
    tasks."""
    from playgraph.operators.sharing import key_pairs

    near = adjacent_strict(df, session, seq, item)
    near = near.select(F.col("session").alias("key"), F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    return key_pairs(df, item, session).join(near, ["key", "a", "b"], "left_anti").groupBy("a", "b").agg(F.count("*").alias("sessions"))


def infer_sessions(df: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """Sessions by inactivity gap: a running sum of gap starts per key."""
    w = Window.partitionBy(key).orderBy(ts)
    start = (F.unix_timestamp(ts) - F.unix_timestamp(F.lag(ts).over(w))) > gap_seconds
    return df.withColumn("session_no", F.sum(F.coalesce(start, F.lit(True)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
