"""Queries of the public surface."""

from __future__ import annotations

from pyspark.sql import functions as F

from playgraph.catalog import table
from playgraph.operators import graph, pmi, stats
from playgraph.plans import edges as ed
from playgraph.plans import plays as pl
from playgraph.plans import surface_ops as ops
from playgraph.plans.registry import query


@query("health", "select 'artist' as \"table\", count(*) as rows from artist union all select 'play', count(*) from play union all select 'dj_transition', count(*) from dj_transition")
def health(spark, d):
    return ops.health({n: table(spark, d, n) for n in ("artist", "play", "dj_transition")})


@query("facets", f"with m as ({pl._total_sql('month')}), j as ({pl._total_sql('dj_id')}) select 'month' as facet, month::bigint as key, total_plays, total_pairs from m union all select 'dj', dj_id, total_plays, total_pairs from j")
def facets(spark, d):
    p = table(spark, d, "play")
    return ops.facets(stats.facet_totals(p, "month"), stats.facet_totals(p, "dj_id"))


@query("random_node", "with e as (select distinct id from (select source_id as id from dj_transition union all select target_id from dj_transition)) select id, canonical_name from artist where id in (select id from e) order by md5(concat_ws('|', id, '42')), id limit 1")
def random_node(spark, d):
    return ops.random_node(table(spark, d, "artist"), table(spark, d, "dj_transition")).select("id", "canonical_name")


@query("node_detail", "select a.id, a.canonical_name, a.genre, p.avg_danceability from artist a left join audio_profile p on p.artist_id = a.id where a.id % 20 = 0")
def node_detail(spark, d):
    audio = table(spark, d, "audio_profile").select("artist_id", "avg_danceability")
    return ops.node_detail(table(spark, d, "artist").select("id", "canonical_name", "genre"), pl.centers(spark, d).withColumnRenamed("center", "id"), audio=audio)


def _by_key_sql(key: str) -> str:
    return f"""with {ed.AFFINITY_SQL},
one as (select {key} as k, min(id) as center from artist where {key} is not null group by 1 having count(*) = 1), q as (select distinct {key} as k from artist where {key} is not null and id % 20 = 0),
nr as (select kk.center, a.{key} as nk, affinity as weight, row_number() over (partition by kk.center order by rank, neighbor)::int as place from kk join artist a on a.id = kk.neighbor and a.{key} is not null where rank <= 40)
select q.k as {key}, nr.nk as neighbor_key, nr.weight, nr.place from q left join one on one.k = q.k left join nr on nr.center = one.center and nr.place <= 20"""


def _by_key(spark, d, key: str):
    """Neighbours by affinity: twice as many as asked for are ranked, as those without a key are passed over."""
    a = table(spark, d, "artist")
    ranked = graph.affinity(ed.transitions(spark, d), ed.relations(spark, d), pl.centers(spark, d), limit=40).withColumnRenamed("affinity", "weight")
    return ops.neighbors_by_key(a.where(f"{key} is not null and id % 20 = 0"), key, a, ranked, 20)


@query("library_neighbors", _by_key_sql("wxyc_library_code_id"))
def library_neighbors(spark, d):
    return _by_key(spark, d, "wxyc_library_code_id")


@query("discogs_neighbors", _by_key_sql("discogs_artist_id"))
def discogs_neighbors(spark, d):
    return _by_key(spark, d, "discogs_artist_id")


@query("alias_groups", "select discogs_artist_id, id, canonical_name, place from (select discogs_artist_id, id, canonical_name, count(*) over (partition by discogs_artist_id) as n, row_number() over (partition by discogs_artist_id order by total_plays desc, id)::int as place from artist where discogs_artist_id is not null) where n > 1")
def alias_groups(spark, d):
    return ops.alias_group(table(spark, d, "artist"), "discogs_artist_id")


@query("generated_bio", "select id, coalesce(nullif(genre, ''), 'Unknown genre') || ' artist played ' || coalesce(total_plays, 0) || ' times by ' || coalesce(dj_count, 0) || ' DJs on the station' || case when nullif(active_first_year, 0) is not null and nullif(active_last_year, 0) is not null then ' between ' || active_first_year || ' and ' || active_last_year when nullif(active_first_year, 0) is not null then ' since ' || active_first_year else '' end || '.' as bio from artist")
def generated_bio(spark, d):
    return ops.generated_bio(table(spark, d, "artist"))


@query(
    "narrative_input",
    f"""with {ed.RELATIONS_SQL}, {ed.SYM_SQL}, {ed.CENTER_PAIRS_SQL},
al as (select src, dst, type from rel union all select source_id, target_id, 'transition' from t),
ex as (select distinct x, y, type from (select x, y, type from al join pr on src = x and dst = y union all select x, y, type from al join pr on src = y and dst = x)),
re as (select x, y, count(*) as relations from ex group by 1, 2),
qa as (select x, y, shared, round(1 / ln(degree), 3) as term from sn join dg on node = shared where degree >= 2),
wa as (select *, round(sum(term) over (partition by x, y), 3) as aa from qa),
ra as (select *, row_number() over (partition by x, y order by term desc, shared) as rank from wa where aa >= 0.8),
sh as (select x, y, count(*) as shared_neighbors, max(aa) as aa from ra where rank <= 5 group by 1, 2)
select x, y, a.canonical_name as x_name, a.genre as x_genre, a.total_plays as x_plays, b.canonical_name as y_name, b.genre as y_genre, b.total_plays as y_plays, coalesce(relations, 0) as relations, coalesce(shared_neighbors, 0) as shared_neighbors, aa,
  coalesce(relations, 0) > 0 or coalesce(aa, 0) >= 0.8 as enough from pr join artist a on a.id = x join artist b on b.id = y left join re using (x, y) left join sh using (x, y)""",
)
def narrative_input(spark, d):
    t = ed.transitions(spark, d)
    pairs = ed.center_pairs(spark, d)
    every = ed.relations(spark, d).unionByName(graph.long_edges({"transition": (t, "source_id", "target_id", F.col("pmi"), True)}))
    return ops.narrative_input(pairs, table(spark, d, "artist"), graph.explain_pair(every, pairs), graph.adamic_adar(t, "source_id", "target_id", pairs))


@query("redacted_rows", "select row_id, edge, source_id, target_id, source_name, target_name, narrative from labeling_row")
def redacted_rows(spark, d):
    return ops.redacted(table(spark, d, "labeling_row"))


@query("community_list")
def community_list(spark, d):
    c = graph.communities(ed.transitions(spark, d).where("raw_count >= 2"), "source_id", "target_id", "raw_count")
    return ops.communities(c.groupBy("community").agg(F.count("*").alias("size")))


@query(
    "neighbors_with_names",
    f"""with {ed.TRANSITIONS_SQL}, m as (select *, max(raw_count) over (partition by source_id) as mr, max(pmi) over (partition by source_id) as mp from t where source_id % 20 = 0),
w as (select source_id, target_id, round(0.5 * raw_count / (case when coalesce(mr, 0) = 0 then 1 else mr end) + 0.5 * pmi / (case when coalesce(mp, 0) = 0 then 1 else mp end), 9) as weight from m),
r as (select *, row_number() over (partition by source_id order by weight desc, target_id)::int as rank from w) select a.canonical_name as artist, b.canonical_name as neighbor, round(weight, 6) as weight, rank from r join artist a on a.id = source_id join artist b on b.id = target_id where rank <= 20""",
)
def neighbors_with_names(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("source_id")
    t = ed.transitions(spark, d).where("source_id % 20 = 0")
    t = t.withColumn("weight", F.round(pmi.heat_blend(F.col("raw_count"), F.col("pmi"), F.max("raw_count").over(w), F.max("pmi").over(w), 0.5), 9))
    r = t.withColumn("rank", F.row_number().over(w.orderBy(F.desc("weight"), "target_id"))).where("rank <= 20")
    a = table(spark, d, "artist")
    x, y = a.select(F.col("id").alias("source_id"), F.col("canonical_name").alias("artist")), a.select(F.col("id").alias("target_id"), F.col("canonical_name").alias("neighbor"))
    return r.join(x, "source_id").join(y, "target_id").select("artist", "neighbor", F.round("weight", 6).alias("weight"), "rank")


@query("faceted_pair_counts", f"""with {ed.TRANSITIONS_SQL}, pr as (select distinct source_id as x, target_id as y from t where source_id % 20 = 0 and source_id <> target_id),
m as (select a.artist_id as f, b.artist_id as s, count(*) as n from play a join play b on b.show_id = a.show_id and b.sequence = a.sequence + 1 where a.month = 3 group by 1, 2)
select x, y, (coalesce((select sum(n) from m where f = x and s = y), 0) + coalesce((select sum(n) from m where f = y and s = x), 0))::bigint as n from pr""")
def faceted_pair_counts(spark, d):
    return ops.facet_pair_count(table(spark, d, "play"), ed.center_pairs(spark, d), month=3)


@query(
    "neighbors_by_type",
    f"""with {ed.RELATIONS_SQL}, {ed.TRANSITIONS_SQL}, ct as (select id as center from artist where id % 20 = 0),
e as (select src, dst, type, score from rel union all select source_id, target_id, 'member', raw_count::double from t where raw_count >= 3),
b as (select src as center, dst as neighbor, type, score from e union all select dst, src, type, score from e where type <> 'member'),
r as (select *, row_number() over (partition by type, center order by score desc, neighbor)::int as rank from b where center in (select center from ct) and center <> neighbor)
select type, center, neighbor, round(score, 6) as score, rank from r where rank <= 20""",
)
def neighbors_by_type(spark, d):
    """API-07, API-08: every type of edge for a batch of centers: symmetric ones both ways, directed ones from the center."""
    member = ed.transitions(spark, d).where("raw_count >= 3").select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), F.lit("member").alias("type"), F.col("raw_count").cast("double").alias("score"))
    edges = ed.relations(spark, d).select("src", "dst", "type", "score").unionByName(member)
    return ops.neighbors_by_type(edges, pl.centers(spark, d), ["member"], 20).withColumn("score", F.round("score", 6))
