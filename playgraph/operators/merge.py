"""Table changes as pure functions: DataFrames in, the new table out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from playgraph.functions.text import label_form


def upsert_coalesce(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """DML-01: one row per key; new values win where they aren't null. New columns are kept, missing ones are null."""
    cols = [c for c in dict.fromkeys([*old.columns, *new.columns]) if c != key]
    o = old.select(key, *[(F.col(c) if c in old.columns else F.lit(None)).alias(f"_o_{c}") for c in cols])
    n = new.select(key, *[(F.col(c) if c in new.columns else F.lit(None)).alias(f"_n_{c}") for c in cols])
    return o.join(n, key, "full_outer").select(key, *[F.coalesce(f"_n_{c}", f"_o_{c}").alias(c) for c in cols])


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """DML-02: the old rows, and of the new ones whose key is not there the first in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = new.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return old.unionByName(first.join(old.select(*keys), keys, "left_anti"))


def insert_or_replace(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """DML-03: the last new row of each key, and the old rows of other keys. ``order`` puts the last row first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    last = new.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return old.join(last.select(*keys), keys, "left_anti").unionByName(last)


def update_stats(nodes: DataFrame, stats: DataFrame, key: str, keep_if_null: list[str]) -> DataFrame:
    """DML-04: stats overwrite the node's columns where the key is in ``stats``; those of ``keep_if_null`` only when not null."""
    cols = [c for c in stats.columns if c != key]
    s = stats.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_s_{c}") for c in cols])
    j = nodes.join(s, key, "left")
    pick = {c: F.when(F.col("_hit"), F.coalesce(f"_s_{c}", c) if c in keep_if_null else F.col(f"_s_{c}")).otherwise(F.col(c)) for c in cols}
    return j.withColumns(pick).drop("_hit", *[f"_s_{c}" for c in cols])


def reset_and_map(nodes: DataFrame, mapping: DataFrame, key: str, column: str) -> DataFrame:
    """DML-05, JN-15: ``column`` recomputed from ``mapping`` (key, column) by exact key; all others become null."""
    return nodes.drop(column).join(mapping.select(key, column), key, "left")


def merge_map(nodes: DataFrame, qid: str, node_id: str = "id") -> DataFrame:
    """(old_id, keep_id) of nodes that share an external id: the smallest id is kept."""
    w = Window.partitionBy(qid)
    m = nodes.where(F.col(qid).isNotNull()).select(F.col(node_id).alias("old_id"), F.min(node_id).over(w).alias("keep_id"))
    return m.where("old_id <> keep_id")


def rekey_pairs(edges: DataFrame, mapping: DataFrame, a: str, b: str, symmetric: bool) -> DataFrame:
    """DML-06: edge ends moved to the kept ids; self edges go; of rows that fall together the one that had the kept ids before
    stands, then the one with the smallest old ids; symmetric pairs are put in order first."""
    ma = mapping.select(F.col("old_id").alias(a), F.col("keep_id").alias("_ka"))
    mb = mapping.select(F.col("old_id").alias(b), F.col("keep_id").alias("_kb"))
    e = edges.join(ma, a, "left").join(mb, b, "left")
    e = e.withColumn("_moved", (F.col("_ka").isNotNull() | F.col("_kb").isNotNull()).cast("int")).withColumn("_oa", F.col(a)).withColumn("_ob", F.col(b))
    na, nb = F.coalesce("_ka", a), F.coalesce("_kb", b)
    e = e.withColumn("_na", F.least(na, nb) if symmetric else na).withColumn("_nb", F.greatest(na, nb) if symmetric else nb).where("_na <> _nb")
    w = Window.partitionBy("_na", "_nb").orderBy("_moved", F.least("_oa", "_ob"), F.greatest("_oa", "_ob"), "_oa")
    e = e.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return e.withColumn(a, F.col("_na")).withColumn(b, F.col("_nb")).select(*edges.columns)


def rekey_single(facts: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """DML-06: facts of one node moved to the kept id, equal rows once."""
    m = mapping.select(F.col("old_id").alias(key), F.col("keep_id").alias("_k"))
    return facts.join(m, key, "left").withColumn(key, F.coalesce("_k", key)).select(*facts.columns).distinct()


def valid_labels(labels: DataFrame, severities: list[str], modes: list[str]) -> DataFrame:
    """DML-10: labels with a known severity and, unless not_wrong, a known failure mode; the latest per (labeler, row); the
    mode of not_wrong is ''."""
    d = labels.withColumn("severity", label_form(F.col("severity"))).withColumn("failure_mode", label_form(F.coalesce("failure_mode", F.lit(""))))
    d = d.withColumn("labeler", F.lower(F.trim("labeler"))).where("row_id is not null and labeler <> ''").where(F.col("severity").isin(severities))
    d = d.withColumn("failure_mode", F.when(F.col("severity") == "not_wrong", "").otherwise(F.col("failure_mode")))
    d = d.where((F.col("severity") == "not_wrong") | F.col("failure_mode").isin(modes))
    w = Window.partitionBy("labeler", "row_id").orderBy(F.desc_nulls_last("updated_at"), "severity", "failure_mode")
    return d.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
