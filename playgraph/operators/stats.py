"""Aggregates over plays, names and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def safe_ratio(a: Column, b: Column) -> Column:
    """MTH-04: a / b, 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def node_stats(entries: DataFrame, node: str, ts: str, dj: str, flag: str, show: str, genre: str | None = None, order: str = "id") -> DataFrame:
    """AGG-02: plays, first and last year, distinct djs and shows, share of requests and, in input order, the first genre that
    has a name, of each node. One aggregation; the distinct counts are expanded by Catalyst."""
    year = F.when(F.col(ts).isNotNull() & (F.col(ts) > F.timestamp_seconds(F.lit(0))), F.year(ts))
    aggs = [
        F.count("*").alias("total_plays"),
        F.min(year).alias("active_first_year"),
        F.max(year).alias("active_last_year"),
        F.countDistinct(dj).alias("dj_count"),
        (F.sum((F.col(flag) == 1).cast("int")) / F.count("*")).alias("request_ratio"),
        F.countDistinct(show).alias("show_count"),
    ]
    if genre:
        aggs.append(F.min_by(genre, F.when(F.col(genre).isNotNull(), F.col(order))).alias("genre"))
    return entries.where(F.col(node).isNotNull()).groupBy(node).agg(*aggs)


def facet_cube(plays: DataFrame, node: str = "artist_id") -> DataFrame:
    """AGG-03, AGG-05: plays per (node, month) and (node, dj) in one pass by grouping sets. Month 0 and null djs are left out
    of their own set."""
    p = plays.where(F.col(node).isNotNull())
    g = p.groupingSets([[F.col(node), F.col("month")], [F.col(node), F.col("dj_id")]], F.col(node), F.col("month"), F.col("dj_id"))
    c = g.agg(F.grouping("month").alias("_gm"), F.count("*").alias("plays"))
    month = c.where("_gm = 0 and month > 0").select(node, F.lit("month").alias("facet"), F.col("month").cast("long").alias("key"), "plays")
    return month.unionByName(c.where("_gm = 1 and dj_id is not null").select(node, F.lit("dj").alias("facet"), F.col("dj_id").cast("long").alias("key"), "plays"))


def facet_totals(plays: DataFrame, facet: str, session: str = "show_id", order: tuple[str, ...] = ("sequence", "id"), node: str = "artist_id") -> DataFrame:
    """AGG-04: per value of ``facet`` the plays and the positional pairs that begin there; a value found in only one of the two
    has 0 of the other."""
    p = plays.where(F.col(node).isNotNull())
    w = Window.partitionBy(session).orderBy(*order)
    valid = F.col(facet).isNotNull() & ((F.col(facet) > 0) if facet == "month" else F.lit(True))
    total = p.where(valid).groupBy(facet).agg(F.count("*").alias("total_plays"))
    pairs = p.withColumn("_n", F.lead(node).over(w)).where(valid & F.col("_n").isNotNull()).groupBy(facet).agg(F.count("*").alias("total_pairs"))
    return total.join(pairs, facet, "full_outer").na.fill(0, ["total_plays", "total_pairs"])


def show_month(plays: DataFrame) -> DataFrame:
    """The month of each show: that of its first play (by sequence, id) with one."""
    return plays.where("month > 0").groupBy("show_id").agg(F.min_by("month", F.struct("sequence", "id")).alias("month"))


def display_names(shows: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """Best name of each natural key: the first in order that differs from the key itself, else the key."""
    k = F.col(key).cast("string")
    better = F.when(F.col(name).isNotNull() & (F.col(name) != k), F.col(order))
    return shows.where(F.col(key).isNotNull()).groupBy(k.alias("key")).agg(F.coalesce(F.min_by(name, better), F.first(k)).alias("name"))


def raw_name_counts(entries: DataFrame, name: str, min_plays: int) -> DataFrame:
    """AGG-24: raw names (trimmed, lower case) with at least ``min_plays`` entries."""
    return entries.groupBy(F.lower(F.trim(name)).alias("name")).agg(F.count("*").alias("plays")).where((F.col("plays") >= min_plays) & (F.col("name") != ""))


def method_histogram(df: DataFrame, method: str) -> DataFrame:
    """AGG-20: rows per method, with percent of all."""
    c = df.groupBy(method).agg(F.count("*").alias("n"))
    return c.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 4))


def unambiguous(df: DataFrame, key: str, value: str) -> DataFrame:
    """AGG-16, AGG-17: keys borne by exactly one row, with its value."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_c"), F.min(value).alias(value)).where("_c = 1").drop("_c")


def duplicate_groups(df: DataFrame, key: str, id_col: str) -> DataFrame:
    """AGG-15: keys of several rows with their sorted ids (the groups are the duplicates of one external id)."""
    g = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(id_col)).alias("ids"))
    return g.where("n > 1")


def edge_counts(tables: dict[str, tuple[DataFrame, str, str]], ids: DataFrame) -> DataFrame:
    """AGG-19: edges of each id (column ``id``) over all tables and both ends, 0 for none."""
    ends = None
    for df, a, b in tables.values():
        part = df.select(F.col(a).alias("id")).unionAll(df.select(F.col(b).alias("id")))
        ends = part if ends is None else ends.unionAll(part)
    c = ends.groupBy("id").agg(F.count("*").alias("edges"))
    return ids.select("id").distinct().join(c, "id", "left").na.fill(0, ["edges"])


def classifier_metrics(df: DataFrame, score: str, truth: str, threshold: float, group: str | None = None) -> DataFrame:
    """AGG-22: tp, fp, tn, fn, precision, recall, f1, mean score of positives and negatives; score > threshold (strictly)
    predicts positive; ratios with a zero denominator are 0; rows without score or truth don't count."""
    hit, pos = F.col(score) > threshold, F.col(truth).cast("boolean")
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    d = df.where(F.col(score).isNotNull() & F.col(truth).isNotNull())
    g = d.groupBy(group) if group else d.groupBy()
    m = g.agg(count(hit & pos).alias("tp"), count(hit & ~pos).alias("fp"), count(~hit & ~pos).alias("tn"), count(~hit & pos).alias("fn"), F.avg(F.when(pos, F.col(score))).alias("mean_pos"), F.avg(F.when(~pos, F.col(score))).alias("mean_neg"))
    m = m.withColumn("precision", safe_ratio(F.col("tp").cast("double"), F.col("tp") + F.col("fp"))).withColumn("recall", safe_ratio(F.col("tp").cast("double"), F.col("tp") + F.col("fn")))
    return m.withColumn("f1", safe_ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def conditional_counts(df: DataFrame, **conditions: Column) -> DataFrame:
    """AGG-23: total rows and rows for which each condition holds."""
    return df.agg(F.count("*").alias("total"), *[F.coalesce(F.sum(c.cast("int")), F.lit(0)).alias(n) for n, c in conditions.items()])


def mojibake_duplicates(names: DataFrame, repair) -> DataFrame:
    """GRF-20: pairs of names of which ``repair`` turns one into the other. ``names``: name, plays, edges."""
    f = names.withColumn("_fixed", repair(F.col("name"))).where("_fixed is not null and _fixed <> name")
    c = f.select(F.col("name").alias("corrupted_name"), F.col("_fixed").alias("fixed_name"), F.col("plays").alias("corrupted_plays"), F.col("edges").alias("corrupted_edges"))
    return c.join(names.select(F.col("name").alias("fixed_name"), F.col("plays").alias("fixed_plays"), F.col("edges").alias("fixed_edges")), "fixed_name")
