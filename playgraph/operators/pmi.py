"""Pointwise mutual information of item pairs: whole, faceted, ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def pmi_edges(pairs: DataFrame, items: DataFrame, item: str) -> DataFrame:
    """AGG-01: source, target, raw_count, pmi = log2((n_ab / N_pairs) / ((n_a / N)(n_b / N))) of directed pairs. The marginals
    count all of ``items``, not pair ends. Empty input gives no rows. The two totals are one broadcast row."""
    ab = pairs.groupBy("source", "target").agg(F.count("*").alias("raw_count"))
    n = items.where(F.col(item).isNotNull()).groupBy(F.col(item).alias("_i")).agg(F.count("*").alias("_n"))
    totals = ab.agg(F.sum("raw_count").alias("_p")).crossJoin(F.broadcast(n.agg(F.sum("_n").alias("_t"))))
    j = ab.join(n.select(F.col("_i").alias("source"), F.col("_n").alias("_a")), "source").join(n.select(F.col("_i").alias("target"), F.col("_n").alias("_b")), "target")
    j = j.crossJoin(F.broadcast(totals))
    share = (F.col("raw_count") / F.col("_p")) / ((F.col("_a") / F.col("_t")) * (F.col("_b") / F.col("_t")))
    return j.select("source", "target", "raw_count", F.log2(share).alias("pmi"))


def strong_edges(edges: DataFrame, min_raw_count: int = 2) -> DataFrame:
    """FLT-03: edges of at least ``min_raw_count`` and a positive pmi."""
    return edges.where((F.col("raw_count") >= min_raw_count) & (F.col("pmi") > 0))


def top_neighbors(edges: DataFrame, centers: DataFrame, n: int) -> DataFrame:
    """TOP-01: of each center (column ``center``) the ``n`` edges either way with the highest pmi, then smaller neighbour."""
    both = edges.select(F.col("source").alias("center"), F.col("target").alias("neighbor"), "raw_count", "pmi").unionByName(
        edges.where("source <> target").select(F.col("target").alias("center"), F.col("source").alias("neighbor"), "raw_count", "pmi")
    )
    w = Window.partitionBy("center").orderBy(F.desc("pmi"), "neighbor", F.desc("raw_count"))
    return both.join(centers, "center", "left_semi").withColumn("rank", F.row_number().over(w)).where(f"rank <= {n}")


def heat_blend(raw: Column, pmi: Column, max_raw: Column, max_pmi: Column, heat: float) -> Column:
    """TOP-02: (1 - heat) * raw / max(raw) + heat * pmi / max(pmi); a maximum of 0 or null counts as 1."""
    one = lambda m: F.when(F.coalesce(m, F.lit(0)) == 0, F.lit(1.0)).otherwise(m)
    return F.lit(1 - heat) * raw / one(max_raw) + F.lit(heat) * pmi / one(max_pmi)


def heat_neighbors(edges: DataFrame, center: str, neighbor: str, heat: float = 0.5, limit: int = 20) -> DataFrame:
    """TOP-02 per center: weight by the blend on the center's own maxima, ties to the smaller neighbour."""
    w = Window.partitionBy(center)
    e = edges.withColumn("weight", heat_blend(F.col("raw_count"), F.col("pmi"), F.max("raw_count").over(w), F.max("pmi").over(w), heat))
    return e.withColumn("rank", F.row_number().over(w.orderBy(F.desc("weight"), neighbor))).where(f"rank <= {limit}")


def facet_pmi(plays: DataFrame, centers: DataFrame, month: int | None = None, dj: int | None = None, heat: float = 0.5, limit: int = 20) -> DataFrame:
    """AGG-05, AGG-06: neighbours of each center within a facet. ``plays``: show_id, sequence, artist_id, month, dj_id.
    Strict pairs both ways are summed per (center, neighbour); the facet binds the center's side only; marginals and totals
    are those of the facet; neighbours without plays in it go, as do pmi of 0 or less; weight is unrounded, pmi to 4 places."""
    facet = F.lit(True)
    if month is not None:
        facet = facet & (F.col("month") == month)
    if dj is not None:
        facet = facet & (F.col("dj_id") == dj)
    side = plays.where(facet & F.col("artist_id").isNotNull()).join(centers.select(F.col("center").alias("artist_id")), "artist_id", "left_semi")
    a = side.select("show_id", "sequence", F.col("artist_id").alias("center"))
    other = plays.where("artist_id is not null").select("show_id", F.col("sequence").alias("s2"), F.col("artist_id").alias("neighbor"))
    # both directions in one join: the neighbour stands one before or one after
    near = a.withColumn("s2", F.explode(F.array(F.col("sequence") - 1, F.col("sequence") + 1))).join(other, ["show_id", "s2"])
    ab = near.groupBy("center", "neighbor").agg(F.count("*").alias("raw_count"))
    inside = plays.where(facet & F.col("artist_id").isNotNull())
    n = inside.groupBy("artist_id").agg(F.count("*").alias("n"))
    w = Window.partitionBy("show_id").orderBy("sequence", "id")
    lead = plays.where("artist_id is not null").withColumn("_next", F.lead("artist_id").over(w)).where(facet & F.col("_next").isNotNull())
    totals = n.agg(F.sum("n").alias("t")).crossJoin(F.broadcast(lead.agg(F.count("*").alias("p"))))
    j = ab.join(n.select(F.col("artist_id").alias("center"), F.col("n").alias("na")), "center").join(n.select(F.col("artist_id").alias("neighbor"), F.col("n").alias("nb")), "neighbor")
    j = j.crossJoin(F.broadcast(totals)).where("p > 0")
    j = j.withColumn("pmi", F.log2((F.col("raw_count") / F.col("p")) / ((F.col("na") / F.col("t")) * (F.col("nb") / F.col("t"))))).where("pmi > 0")
    return heat_neighbors(j, "center", "neighbor", heat, limit).select("center", "neighbor", "raw_count", F.round("pmi", 4).alias("pmi"), "weight", "rank")
