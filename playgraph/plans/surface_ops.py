"""The query surface as DataFrame functions over a set of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from playgraph.functions.text import contains_ci
from playgraph.operators.sampling import random_rows


def search(nodes: DataFrame, q: str, limit: int = 10) -> DataFrame:
    """API-02, TOP-03: nodes whose name holds ``q``; those that begin with it first, then by plays, then id."""
    if not q or not 1 <= limit <= 100:
        raise ValueError("a query of at least one character and a limit of 1 to 100")
    hit = nodes.where(contains_ci(F.col("canonical_name"), q))
    first = F.lower(F.col("canonical_name")).startswith(q.lower()).cast("int")
    top = hit.select("id", "canonical_name", "total_plays", first.alias("_f")).orderBy(F.desc("_f"), F.desc("total_plays"), "id").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("_f"), F.desc("total_plays"), "id"))).drop("_f")


def random_node(nodes: DataFrame, edges: DataFrame, seed: int = 42) -> DataFrame:
    """API-01, TOP-04: a node at random among those with a transition."""
    ends = edges.select(F.col("source_id").alias("id")).union(edges.select(F.col("target_id").alias("id"))).distinct()
    return random_rows(nodes.join(ends, "id", "left_semi"), "id", 1, seed)


def facets(month_totals: DataFrame, dj_totals: DataFrame | None = None) -> DataFrame:
    """API-03: months and, on request, djs that plays can be restricted to, with their numbers."""
    m = month_totals.select(F.lit("month").alias("facet"), F.col("month").cast("long").alias("key"), "total_plays", "total_pairs")
    return m if dj_totals is None else m.unionByName(dj_totals.select(F.lit("dj").alias("facet"), F.col("dj_id").alias("key"), "total_plays", "total_pairs"))


def communities(table: DataFrame, min_size: int = 5, limit: int = 50) -> DataFrame:
    """API-04, TOP-05."""
    return table.where(F.col("size") >= min_size).orderBy(F.desc("size"), "community").limit(limit)


def node_detail(nodes: DataFrame, ids: DataFrame, entities: DataFrame | None = None, audio: DataFrame | None = None) -> DataFrame:
    """API-05, API-06, JN-10: nodes with what optional tables know of them; an absent table contributes nothing."""
    out = nodes.join(ids.select("id").distinct(), "id", "left_semi")
    if entities is not None:
        out = out.join(entities, "id", "left")
    if audio is not None:
        out = out.join(audio.withColumnRenamed("artist_id", "id"), "id", "left")
    return out


def neighbors_by_key(requests: DataFrame, key: str, nodes: DataFrame, ranked: DataFrame, limit: int = 20) -> DataFrame:
    """API-08..10, TOP-07: neighbours for external keys: every key asked for is present; a key that several nodes bear, or
    none, has no neighbours; neighbours without a key of their own are passed over, the first ``limit`` of twice as many
    stand. ``ranked``: center, neighbor, weight, rank."""
    one = nodes.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_c"), F.min("id").alias("center")).where("_c = 1").drop("_c")
    asked = requests.select(key).distinct().join(one, key, "left")
    near = ranked.where(f"rank <= {2 * limit}").join(nodes.select(F.col("id").alias("neighbor"), F.col(key).alias("neighbor_key")).where("neighbor_key is not null"), "neighbor")
    w = Window.partitionBy("center").orderBy("rank", "neighbor")
    near = near.withColumn("place", F.row_number().over(w)).where(f"place <= {limit}").select("center", "neighbor_key", "weight", "place")
    return asked.join(near, "center", "left").select(key, "neighbor_key", "weight", "place")


def neighbors_by_type(edges: DataFrame, centers: DataFrame, directed: list[str], limit: int = 20) -> DataFrame:
    """API-07, API-08: type, center, neighbor, score, rank: of each center (column ``center``; one or many) and type of edge
    the ``limit`` best neighbours by score, then id. ``edges``: src, dst, type, score; types named in ``directed`` count from
    their source only, the others both ways; self edges go."""
    ways = edges.select(F.col("src").alias("center"), F.col("dst").alias("neighbor"), "type", "score")
    back = edges.where(~F.col("type").isin(directed)).select(F.col("dst").alias("center"), F.col("src").alias("neighbor"), "type", "score")
    b = ways.unionByName(back).where("center <> neighbor").join(centers.select("center").distinct(), "center", "left_semi")
    w = Window.partitionBy("type", "center").orderBy(F.desc("score"), "neighbor")
    return b.withColumn("rank", F.row_number().over(w)).where(f"rank <= {limit}").select("type", "center", "neighbor", "score", "rank")


def alias_group(nodes: DataFrame, entity: str) -> DataFrame:
    """API-12: the nodes of each entity that has several, most played first."""
    n = F.count("*").over(Window.partitionBy(entity))
    r = F.row_number().over(Window.partitionBy(entity).orderBy(F.desc("total_plays"), "id"))
    return nodes.where(F.col(entity).isNotNull()).withColumn("_n", n).withColumn("place", r).where("_n > 1").select(entity, "id", "canonical_name", "place")


def narrative_input(pairs: DataFrame, nodes: DataFrame, relations: DataFrame, shared: DataFrame) -> DataFrame:
    """API-13: the data a narrative of each pair (x, y) rests on: both nodes' facts, the number of relations and the ranked
    shared neighbours, and whether that is enough."""
    a = nodes.select(F.col("id").alias("x"), F.col("canonical_name").alias("x_name"), F.col("genre").alias("x_genre"), F.col("total_plays").alias("x_plays"))
    b = nodes.select(F.col("id").alias("y"), F.col("canonical_name").alias("y_name"), F.col("genre").alias("y_genre"), F.col("total_plays").alias("y_plays"))
    r = relations.groupBy("x", "y").agg(F.count("*").alias("relations"))
    s = shared.groupBy("x", "y").agg(F.count("*").alias("shared_neighbors"), F.max("aa").alias("aa"))
    j = pairs.join(a, "x").join(b, "y").join(r, ["x", "y"], "left").join(s, ["x", "y"], "left").na.fill(0, ["relations", "shared_neighbors"])
    return j.withColumn("enough", (F.col("relations") > 0) | (F.coalesce("aa", F.lit(0.0)) >= 0.8))


def generated_bio(nodes: DataFrame, station: str = "the station") -> DataFrame:
    """API-14, CND-03: a sentence made of what is known, for nodes without a text of their own: genre, plays, djs and the years,
    'between' both or 'since' the first; a year 0 counts as unknown."""
    first, last = F.nullif("active_first_year", F.lit(0)), F.nullif("active_last_year", F.lit(0))
    years = F.when(first.isNotNull() & last.isNotNull(), F.concat(F.lit(" between "), first.cast("string"), F.lit(" and "), last.cast("string")))
    years = years.when(first.isNotNull(), F.concat(F.lit(" since "), first.cast("string"))).otherwise("")
    genre = F.coalesce(F.nullif("genre", F.lit("")), F.lit("Unknown genre"))
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    return nodes.select("id", F.concat(genre, F.lit(" artist played "), number("total_plays"), F.lit(" times by "), number("dj_count"), F.lit(f" DJs on {station}"), years, F.lit(".")).alias("bio"))


def facet_pair_count(plays: DataFrame, pairs: DataFrame, month: int | None = None, dj_id: int | None = None) -> DataFrame:
    """GRF-19: x, y, n: how often one of a pair was played right after the other (the next sequence number of the show), in
    either order, the first of the two in ``month`` and by ``dj_id``; at least one of them must be given."""
    if month is None and dj_id is None:
        raise ValueError("a month or a dj")
    first = plays
    for c, v in (("month", month), ("dj_id", dj_id)):
        if v is not None:
            first = first.where(F.col(c) == v)
    p1 = first.select("show_id", (F.col("sequence") + 1).alias("sequence"), F.col("artist_id").alias("_a"))
    p2 = plays.select("show_id", "sequence", F.col("artist_id").alias("_b"))
    met = p1.join(p2, ["show_id", "sequence"]).groupBy(F.least("_a", "_b").alias("_lo"), F.greatest("_a", "_b").alias("_hi")).agg(
        F.count("*").alias("n")
    )
    # a pair of one node with itself counts for both orders
    met = met.withColumn("n", F.when(F.col("_lo") == F.col("_hi"), 2 * F.col("n")).otherwise(F.col("n")))
    asked = pairs.select("x", "y").distinct().withColumns({"_lo": F.least("x", "y"), "_hi": F.greatest("x", "y")})
    return asked.join(met, ["_lo", "_hi"], "left").select("x", "y", F.coalesce("n", F.lit(0)).alias("n"))


def best_text(candidates: list[str]):
    """CND-03: the longer of the first two texts, else the first of the rest that isn't blank."""
    a, b, *rest = [F.when(F.trim(c) != "", F.col(c)) for c in candidates]
    longer = F.when(F.length(a) >= F.coalesce(F.length(b), F.lit(0)), a).otherwise(b)
    return F.coalesce(longer, a, *rest)


def recent_audits(audits: DataFrame, threshold: float = 0.2, flagged_only: bool = False, limit: int = 50) -> DataFrame:
    """API-16, API-20: audits by time, newest first, flagged where the ungrounded share exceeds the threshold."""
    n = F.col("grounded") + F.col("ungrounded")
    a = audits.withColumn("ratio", F.when(n > 0, F.col("ungrounded") / n).otherwise(0.0)).withColumn("flagged", F.col("ratio") > threshold)
    return (a.where("flagged") if flagged_only else a).orderBy(F.desc("at"), "id").limit(limit)


def health(tables: dict[str, DataFrame]) -> DataFrame:
    """API-17: rows of each table."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


#: Columns a labeler must not see.
REDACTED = ["expected_label", "construction_method", "insufficient_signal", "cell_id"]


def redacted(rows: DataFrame) -> DataFrame:
    """API-19: the rows without the columns that give an answer away."""
    return rows.drop(*REDACTED)
