"""The whole build: log to published graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from playgraph.catalog import table
from playgraph.config import PipelineConfig
from playgraph.functions.text import month_or_zero
from playgraph.operators import adjacency, graph, pmi, resolver, sharing, stats
from playgraph.plans.surface_ops import health
from playgraph.session import cut
from playgraph.sources import sinks


def build_tables(spark: SparkSession, d: str, config: PipelineConfig | None = None) -> dict[str, DataFrame]:
    """Resolve the log, mine pairs, derive edges, facets and metrics. What several tables rest on is written once to the shared
    folder; everything else stays one lazy plan per table."""
    c = config or PipelineConfig()
    entries = table(spark, d, "flowsheet_entry").where("entry_type_code < 7")
    codes, releases = table(spark, d, "library_code"), table(spark, d, "library_release")
    r = resolver.resolve(entries, releases, codes, fuzzy=c.fuzzy)
    r = resolver.re_resolve(r, codes, c.relaxed_min_plays).where("canonical <> ''")
    r = cut(r.select("id", "canonical", "method", "show_id", "sequence", "label_name", "request_flag", "start_time", month_or_zero(F.col("start_time")).alias("month")))
    ids = cut(sinks.assign_ids(r, "canonical"))
    play = cut(r.join(ids.select(F.col("id").alias("artist_id"), F.col("name").alias("canonical")), "canonical").select("id", "artist_id", "show_id", F.xxhash64("label_name").alias("dj_id"), "sequence", "month", "request_flag", "start_time"))
    pairs = adjacency.adjacent_positional(play.where("show_id is not null"), "show_id", ["sequence", "id"], "artist_id")
    edges = cut(pmi.pmi_edges(pairs, play, "artist_id"))
    strong = pmi.strong_edges(edges, c.min_raw_count).select(F.col("source").alias("source_id"), F.col("target").alias("target_id"), "raw_count", "pmi")
    style = sharing.jaccard(play, "artist_id", "dj_id", c.max_shared_df, c.min_jaccard)
    if c.top_k:
        style = graph.prune_topk(cut(style), "a", "b", F.col("jaccard"), c.top_k)
    st = stats.node_stats(play, "artist_id", "start_time", "dj_id", "request_flag", "show_id")
    flow = cut(edges.where(F.col("raw_count") >= c.min_raw_count).select("source", "target", "raw_count"))
    comm = cut(graph.communities(flow, "source", "target", "raw_count"))
    rank = graph.pagerank(flow, "source", "target", c.pagerank_rounds)
    between = graph.betweenness(flow, "source", "target", c.betweenness_sources)
    artist = ids.select("id", F.col("name").alias("canonical_name")).join(st.withColumnRenamed("artist_id", "id"), "id", "left")
    for m in (comm, rank, between):
        artist = artist.join(m.withColumnRenamed("node", "id"), "id", "left")
    cube = stats.facet_cube(play)
    return {
        "artist": artist,
        "play": play,
        "dj_transition": strong,
        "shared_style": style,
        "community": comm.groupBy("community").agg(F.count("*").alias("size")),
        "artist_month_count": cube.where("facet = 'month'").select("artist_id", F.col("key").cast("int").alias("month"), "plays"),
        "artist_dj_count": cube.where("facet = 'dj'").select("artist_id", F.col("key").alias("dj_id"), "plays"),
        "month_total": stats.facet_totals(play, "month"),
        "dj_total": stats.facet_totals(play, "dj_id"),
        "resolution_method": stats.method_histogram(r, "method"),
    }


def run(spark: SparkSession, d: str, root: str, config: PipelineConfig | None = None) -> str:
    """Build and publish; the new version must hold against the one it replaces, table by table."""
    c = config or PipelineConfig()
    pub = sinks.Publisher(spark, root)
    old = pub.current()
    tables = build_tables(spark, d, c)

    def gate(s: SparkSession, at: str) -> None:
        now = health({n: s.read.parquet(f"{at}/{n}.parquet") for n in tables})
        base = health({n: s.read.parquet(f"{root}/{old}/{n}.parquet") for n in tables}) if old else now.select("table", F.lit(1).cast("long").alias("rows"))
        sinks.enforce(sinks.validation_gate(now, base, c.ratchet, {"artist": c.min_artists}))

    return pub.publish(tables, gate)


def neighbors(artist: DataFrame, transitions: DataFrame, limit: int = 20, heat: float = 0.5) -> DataFrame:
    """API-07, API-08 over published tables: every artist's transition neighbours by heat."""
    w = Window.partitionBy("source_id")
    t = transitions.withColumn("weight", pmi.heat_blend(F.col("raw_count"), F.col("pmi"), F.max("raw_count").over(w), F.max("pmi").over(w), heat))
    return t.join(artist.select(F.col("id").alias("source_id")), "source_id", "left_semi").withColumn("rank", F.row_number().over(w.orderBy(F.desc("weight"), "target_id"))).where(f"rank <= {limit}")
