"""Queries for table changes, sampling and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from playgraph.catalog import table
from playgraph.functions import text as tx
from playgraph.operators import graph, merge, sampling
from playgraph.plans.edges import SYM_SQL, TRANSITIONS_SQL, middles, transitions
from playgraph.plans.registry import query
from playgraph.sources import sinks


@query("upsert_coalesce", "with o as (select id, genre, total_plays from artist where id % 3 <> 0), n as (select id, case when id % 2 = 0 then genre end as genre, total_plays + 1 as total_plays from artist where id % 5 <> 0) select coalesce(n.id, o.id) as id, coalesce(n.genre, o.genre) as genre, coalesce(n.total_plays, o.total_plays) as total_plays from o full outer join n on o.id = n.id")
def upsert_coalesce(spark, d):
    a = table(spark, d, "artist").select("id", "genre", "total_plays")
    new = a.where("id % 5 <> 0").select("id", F.when(F.col("id") % 2 == 0, F.col("genre")).alias("genre"), (F.col("total_plays") + 1).alias("total_plays"))
    return merge.upsert_coalesce(a.where("id % 3 <> 0"), new, "id")


@query("insert_or_ignore", "with o as (select source_id, target_id, raw_count from (select *, row_number() over (partition by source_id, target_id order by raw_count, pmi) as k from dj_transition where source_id % 2 = 0) where k = 1), n as (select source_id, target_id, raw_count from (select *, row_number() over (partition by source_id, target_id order by raw_count desc, pmi) as k from dj_transition) where k = 1) select * from o union all select * from n where not exists (select 1 from o where o.source_id = n.source_id and o.target_id = n.target_id)")
def insert_or_ignore(spark, d):
    t = table(spark, d, "dj_transition").select("source_id", "target_id", "raw_count", "pmi")
    old = t.where("source_id % 2 = 0").groupBy("source_id", "target_id").agg(F.min("raw_count").alias("raw_count"))
    return merge.insert_or_ignore(old, t.select("source_id", "target_id", "raw_count"), ["source_id", "target_id"], [F.desc("raw_count")])


@query("insert_or_replace", "with n as (select source_id, target_id, max(raw_count) as raw_count from dj_transition where source_id % 2 = 1 group by 1, 2), o as (select source_id, target_id, min(raw_count) as raw_count from dj_transition group by 1, 2) select * from n union all select * from o where not exists (select 1 from n where n.source_id = o.source_id and n.target_id = o.target_id)")
def insert_or_replace(spark, d):
    t = table(spark, d, "dj_transition").select("source_id", "target_id", "raw_count")
    old = t.groupBy("source_id", "target_id").agg(F.min("raw_count").alias("raw_count"))
    return merge.insert_or_replace(old, t.where("source_id % 2 = 1"), ["source_id", "target_id"], [F.desc_nulls_last("raw_count")])


@query("update_stats", "with s as (select artist_id, count(*) as total_plays, case when artist_id % 2 = 0 then 'X' end as genre from play where artist_id is not null group by 1) select a.id, case when s.artist_id is not null then s.total_plays else a.total_plays end as total_plays, case when s.artist_id is not null then coalesce(s.genre, a.genre) else a.genre end as genre from artist a left join s on s.artist_id = a.id")
def update_stats(spark, d):
    s = table(spark, d, "play").where("artist_id is not null").groupBy(F.col("artist_id").alias("id")).agg(F.count("*").alias("total_plays")).withColumn("genre", F.when(F.col("id") % 2 == 0, "X"))
    return merge.update_stats(table(spark, d, "artist").select("id", "total_plays", "genre"), s, "id", ["genre"])


@query("reset_and_map", "select a.id, m.code from artist a left join (select presentation_name, min(id) as code from library_code group by 1 having count(*) = 1) m on m.presentation_name = a.canonical_name")
def reset_and_map(spark, d):
    a = table(spark, d, "artist").select("id", "canonical_name", F.lit(0).cast("long").alias("code"))
    m = table(spark, d, "library_code").groupBy(F.col("presentation_name").alias("canonical_name")).agg(F.count("*").alias("c"), F.min("id").alias("code")).where("c = 1")
    return merge.reset_and_map(a, m, "canonical_name", "code").select("id", "code")


@query(
    "entity_dedup",
    f"""with {TRANSITIONS_SQL}, m as (select id as old_id, min(id) over (partition by discogs_artist_id) as keep_id from artist where discogs_artist_id is not null),
mm as (select * from m where old_id <> keep_id),
e as (select coalesce(x.keep_id, t.source_id) as na, coalesce(y.keep_id, t.target_id) as nb, t.*, (case when x.keep_id is not null or y.keep_id is not null then 1 else 0 end) as moved from t left join mm x on x.old_id = t.source_id left join mm y on y.old_id = t.target_id),
r as (select *, row_number() over (partition by na, nb order by moved, least(source_id, target_id), greatest(source_id, target_id), source_id) as k from e where na <> nb)
select na as source_id, nb as target_id, raw_count from r where k = 1""",
)
def entity_dedup(spark, d):
    m = merge.merge_map(table(spark, d, "artist"), "discogs_artist_id")
    return merge.rekey_pairs(transitions(spark, d), m, "source_id", "target_id", False).select("source_id", "target_id", "raw_count")


@query("entity_dedup_facts", "with mm as (select old_id, keep_id from (select id as old_id, min(id) over (partition by discogs_artist_id) as keep_id from artist where discogs_artist_id is not null) where old_id <> keep_id) select distinct coalesce(keep_id, artist_id) as artist_id, dj_id from play left join mm on old_id = artist_id")
def entity_dedup_facts(spark, d):
    m = merge.merge_map(table(spark, d, "artist"), "discogs_artist_id")
    return merge.rekey_single(table(spark, d, "play").select("artist_id", "dj_id"), m, "artist_id")


@query(
    "valid_labels",
    """with l as (select lower(trim(labeler, ' ')) as labeler, row_id, translate(lower(trim(severity, ' ')), ' -', '__') as severity, translate(lower(trim(coalesce(failure_mode, ''), ' ')), ' -', '__') as failure_mode, updated_at from narrative_label where row_id is not null),
v as (select labeler, row_id, severity, case when severity = 'not_wrong' then '' else failure_mode end as failure_mode, updated_at from l where severity in ('severe', 'minor', 'not_wrong') and labeler <> '' and (severity = 'not_wrong' or failure_mode in ('subject_hallucination', 'neighbor_characterization', 'dj_intent', 'data_noise', 'other'))),
r as (select *, row_number() over (partition by labeler, row_id order by updated_at desc nulls last, severity, failure_mode) as k from v) select labeler, row_id, severity, failure_mode from r where k = 1""",
)
def valid_labels(spark, d):
    v = merge.valid_labels(table(spark, d, "narrative_label"), ["severe", "minor", "not_wrong"], ["subject_hallucination", "neighbor_characterization", "dj_intent", "data_noise", "other"])
    return v.select("labeler", "row_id", "severity", "failure_mode")


@query(
    "overfetch_translate",
    f"""with {TRANSITIONS_SQL}, r as (select source_id, target_id, pmi, row_number() over (partition by source_id order by pmi desc, target_id) as k from t), m as (select id as target_id, wxyc_library_code_id as code from artist where wxyc_library_code_id is not null),
w as (select source_id, target_id, code, pmi from r join m using (target_id) where k <= 20), z as (select *, row_number() over (partition by source_id order by pmi desc, target_id)::int as rank from w) select source_id, target_id, code, rank from z where rank <= 10""",
)
def overfetch_translate(spark, d):
    m = table(spark, d, "artist").where("wxyc_library_code_id is not null").select(F.col("id").alias("target_id"), F.col("wxyc_library_code_id").alias("code"))
    r = sampling.overfetch(transitions(spark, d), "source_id", [F.desc("pmi"), "target_id"], m, "target_id", 10)
    return r.select("source_id", "target_id", "code", "rank")


DRAW = "md5(concat_ws('|', {}, '42'))"


@query(
    "stratified_sample",
    f"""with a as (select id, genre, case when total_plays > 800 then 'HIGH' when total_plays between 100 and 400 then 'LOW' end as fame from artist),
r as (select genre, fame, id, row_number() over (partition by genre, fame order by {DRAW.format("id")}, id)::int as draw from a where genre is not null and fame is not null) select * from r where draw <= 3""",
)
def stratified_sample(spark, d):
    a = table(spark, d, "artist").withColumn("fame", tx.fame_band(F.col("total_plays")))
    return sampling.stratified(a.where("genre is not null and fame is not null"), ["genre", "fame"], ["id"], 3).select("genre", "fame", "id", "draw")


@query("label_sheet", f"with u as (select row_id as key, narrative, row_number() over (order by {DRAW.format('row_id')} || '|' || row_id) as n from labeling_row where edge is not null) select printf('R%04d', n) as row_id, narrative from u")
def label_sheet(spark, d):
    r = table(spark, d, "labeling_row")
    return sampling.label_sheet([r.where("edge = 'dj_transition'"), r.where("edge <> 'dj_transition'")], "row_id", ["cell_id"]).select("row_id", "narrative")


PROFILES_SQL = """pr as (select a.id, a.genre, case when p.voice_instrumental_ratio > 0.7 then 'vocal-forward' when p.voice_instrumental_ratio < 0.3 then 'instrumental' end as voice, st.styles
  from artist a left join (select artist_id, arg_min(voice_instrumental_ratio, artist_id) as voice_instrumental_ratio from audio_profile group by 1) p on p.artist_id = a.id
  left join (select artist_id, list_sort(list(distinct month::varchar)) as styles from play where artist_id is not null and month is not null group by 1) st on st.artist_id = a.id)"""


def pair_profiles(spark, d):
    """Labelled pairs with voice, styles and genre of both sides."""
    v = table(spark, d, "audio_profile").select(F.col("artist_id").alias("id"), F.when(F.col("voice_instrumental_ratio") > 0.7, "vocal-forward").when(F.col("voice_instrumental_ratio") < 0.3, "instrumental").alias("voice"))
    st = table(spark, d, "play").where("artist_id is not null and month is not null").groupBy(F.col("artist_id").alias("id")).agg(F.array_sort(F.collect_set(F.col("month").cast("string"))).alias("styles"))
    p = table(spark, d, "artist").select("id", "genre").join(v, "id", "left").join(st, "id", "left")
    out = table(spark, d, "labeling_row").select("row_id", "source_id", "target_id")
    for side in ("source", "target"):
        out = out.join(p.select(F.col("id").alias(f"{side}_id"), *[F.col(c).alias(f"{side}_{c}") for c in ("voice", "styles", "genre")]), f"{side}_id", "left")
    return out


def _corrupted_sql() -> str:
    pick = lambda n, seed: f"(('0x' || left(md5(concat_ws('|', row_id, '{seed}')), 8))::bigint % {n})"
    ways = []
    for s in ("source", "target"):
        ways += [
            f"case when {s}_voice is not null then '{s}:voice_instrumental' end",
            f"case when len({s}_styles) > 0 and len(list_filter(pool, lambda p: p.g is distinct from {s}_genre)) > 0 then '{s}:outlier_styles' end",
            f"case when {s}_genre <> '' and len(list_filter(genres, lambda g: g <> {s}_genre)) > 0 then '{s}:genre_swap' end",
        ]
    cols = []
    for s in ("source", "target"):
        rest, other = f"list_filter(genres, lambda g: g <> {s}_genre)", f"list_filter(pool, lambda p: p.g is distinct from {s}_genre)"
        cols += [
            f"case when way = '{s}:voice_instrumental' then case {s}_voice when 'instrumental' then 'vocal-forward' else 'instrumental' end else {s}_voice end as {s}_voice",
            f"case when way = '{s}:outlier_styles' then {other}[{pick(f'len({other})', 43)} + 1].k else array_to_string({s}_styles, '|') end as {s}_styles",
            f"case when way = '{s}:genre_swap' then {rest}[{pick(f'len({rest})', 43)} + 1] else {s}_genre end as {s}_genre",
        ]
    return f"""with {PROFILES_SQL},
r as (select l.row_id, x.voice as source_voice, x.styles as source_styles, x.genre as source_genre, y.voice as target_voice, y.styles as target_styles, y.genre as target_genre from labeling_row l left join pr x on x.id = source_id left join pr y on y.id = target_id),
seen as (select source_genre as g, source_styles as s from r union all select target_genre, target_styles from r),
gs as (select list_sort(list(distinct g)) as genres from seen where g is not null),
k as (select distinct g, array_to_string(s, '|') as k from seen where g is not null and len(s) > 0),
kk as (select g, k, row_number() over (partition by g order by md5(concat_ws('|', k, '42')), k) as n from k),
po as (select list(struct_pack(g := g, k := k) order by g, k) as pool from kk where n <= 20),
w as (select r.*, genres, pool, list_filter([{", ".join(ways)}], lambda x: x is not null) as ways from r, gs, po),
c as (select *, case when len(ways) > 0 then ways[{pick("len(ways)", 42)} + 1] end as way from w)
select row_id, split_part(way, ':', 1) as side, split_part(way, ':', 2) as strategy, {", ".join(cols)} from c"""


@query("corrupted_profiles", _corrupted_sql())
def corrupted_profiles(spark, d):
    c = sampling.corrupt(pair_profiles(spark, d), "row_id")
    for s in ("source", "target"):
        c = c.withColumn(f"{s}_styles", F.array_join(f"{s}_styles", "|"))
    return c.select("row_id", "side", "strategy", *[f"{s}_{x}" for s in ("source", "target") for x in ("voice", "styles", "genre")])


@query(
    "pair_risk",
    f"""with {TRANSITIONS_SQL}, a as (select id, coalesce(total_plays, 0) as plays, genre, coalesce(dj_count, 0) as styles, coalesce(dj_count, 0) + case when id in (select artist_id from audio_profile) then 3 else 0 end as rich from artist)
select source_id, target_id, (case when (x.plays + y.plays) / 2 > 1000 then 1.0 when (x.plays + y.plays) / 2 > 500 then 0.5 else 0.0 end + case when least(x.rich, y.rich) = 0 then 1.0 when least(x.rich, y.rich) < 3 then 0.5 else 0.0 end
+ case when greatest(x.styles, y.styles) > 20 then 1.0 when greatest(x.styles, y.styles) > 10 then 0.5 else 0.0 end + case when x.genre is distinct from y.genre then 1.0 else 0.0 end)::double as risk
from t join a x on x.id = source_id join a y on y.id = target_id""",
)
def pair_risk(spark, d):
    sound = table(spark, d, "audio_profile").select(F.col("artist_id").alias("id"), F.lit(3).alias("sound")).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0))
    a = table(spark, d, "artist").join(sound, "id", "left")
    side = lambda s, k: a.select(F.col("id").alias(k), zero("total_plays").alias(f"plays_{s}"), (zero("dj_count") + zero("sound")).alias(f"rich_{s}"), zero("dj_count").alias(f"styles_{s}"), F.col("genre").alias(f"genre_{s}"))
    j = transitions(spark, d).join(side("a", "source_id"), "source_id").join(side("b", "target_id"), "target_id")
    return sampling.band_risk(j).select("source_id", "target_id", F.col("risk").cast("double").alias("risk"))


ELIGIBLE_SQL = """el as (select id, genre, case when total_plays > 800 then 'HIGH' else 'LOW' end as fame, case when dj_count >= 3 and id in (select artist_id from audio_profile) then 'RICH' else 'THIN' end as richness from artist
  where genre is not null and (total_plays > 800 or total_plays between 100 and 400) and canonical_name not like 'Various%' and canonical_name not like 'V/A%' and canonical_name not like '%Soundtrack%' and lower(canonical_name) <> 'unknown')"""


def eligible(spark, d):
    sound = table(spark, d, "audio_profile").select(F.col("artist_id").alias("id"), F.lit(True).alias("sound")).distinct()
    a = table(spark, d, "artist").where(tx.no_compilation(F.col("canonical_name")) & F.col("genre").isNotNull()).join(sound, "id", "left")
    a = a.select("id", "genre", tx.fame_band(F.col("total_plays")).alias("fame"), tx.richness(F.coalesce("dj_count", F.lit(0)), F.coalesce("sound", F.lit(False))).alias("richness"))
    return a.where("fame is not null")


@query("eligible_nodes", f"with {ELIGIBLE_SQL} select * from el")
def eligible_nodes(spark, d):
    return eligible(spark, d)


@query(
    "pair_cells",
    f"""with {SYM_SQL}, {ELIGIBLE_SQL}, va as (select id from artist where canonical_name like 'Various%' or canonical_name like 'V/A%'),
m as (select sy.*, degree from sy join dg using (node) where degree >= 2 and node in (select id from artist) and node not in (select id from va)),
ind as (select a.other as x, b.other as y from m a join m b on a.node = b.node and a.other < b.other group by 1, 2 having sum(1 / ln(a.degree)) >= 0.8),
k as (select least(source_id, target_id) as x, greatest(source_id, target_id) as y, 'DIRECT' as edge from t where raw_count >= 2 and source_id <> target_id union select x, y, 'INDIRECT' from ind where not exists (select 1 from sy where node = x and other = y)),
j as (select a.fame, a.richness, case when a.genre = b.genre then 'SAME' else 'CROSS' end as genre, edge, x, y from k join el a on a.id = x join el b on b.id = y and b.fame = a.fame and b.richness = a.richness),
r as (select *, row_number() over (partition by fame, richness, genre, edge order by md5(concat_ws('|', x, y, '42')), x, y)::int as draw from j) select * from r where draw <= 5""",
)
def pair_cells(spark, d):
    t = transitions(spark, d)
    direct = t.where("raw_count >= 2 and source_id <> target_id").select(F.least("source_id", "target_id").alias("x"), F.greatest("source_id", "target_id").alias("y"))
    return sampling.pair_cells(eligible(spark, d), direct, graph.two_hop(t, "source_id", "target_id", 0.8, middles(spark, d)), 5)


@query("missing_profiles", "select id from artist where id not in (select artist_id from audio_profile where artist_id is not null)")
def missing_profiles(spark, d):
    done = table(spark, d, "audio_profile").select(F.col("artist_id").alias("id"))
    return sampling.pending(table(spark, d, "artist").select("id"), done, ["id"])


@query(
    "validation_gate",
    "with n as (select 'play' as t, count(*) as r from play union all select 'artist', count(*) from artist), s as (select 'play' as t, 1000 as seed union all select 'artist', 100000000 union all select 'gone', 7 union all select 'new', 0) select s.t as \"table\", s.seed::bigint as seed, coalesce(r, 0) as rows, greatest(1, floor(seed * 0.5))::bigint as floor, coalesce(r, 0) >= greatest(1, floor(seed * 0.5)) as ok from s left join n on s.t = n.t where seed > 0",
)
def validation_gate(spark, d):
    from playgraph.plans.surface_ops import health

    counts = health({"play": table(spark, d, "play"), "artist": table(spark, d, "artist")})
    base = spark.createDataFrame([("play", 1000), ("artist", 100000000), ("gone", 7), ("new", 0)], "`table` string, rows long")
    return sinks.validation_gate(counts, base)


@query("edges_by_id", "with e as (select distinct source_name, target_name from labeling_row), i as (select id, canonical_name as name from artist), l as (select lower(name) as n, min(id) as id from i group by 1) select e.source_name as source, e.target_name as target, coalesce(a.id, la.id) as source_id, coalesce(b.id, lb.id) as target_id from e left join i a on a.name = e.source_name left join l la on la.n = lower(e.source_name) left join i b on b.name = e.target_name left join l lb on lb.n = lower(e.target_name) where coalesce(a.id, la.id) is not null and coalesce(b.id, lb.id) is not null")
def edges_by_id(spark, d):
    e = table(spark, d, "labeling_row").select(F.col("source_name").alias("source"), F.col("target_name").alias("target")).distinct()
    return sinks.edges_by_id(e, table(spark, d, "artist").select("id", F.col("canonical_name").alias("name"))).select("source", "target", "source_id", "target_id")


@query("assigned_ids", "select row_number() over (order by encode(presentation_name)) as id, presentation_name as name from (select distinct presentation_name from library_code where presentation_name is not null)")
def assigned_ids(spark, d):
    return sinks.assign_ids(table(spark, d, "library_code"), "presentation_name")


@query(
    "connected_candidates",
    f"with {SYM_SQL}, c as (select id, degree from artist join dg on node = id where degree >= 8 and total_plays between 5 and 400 and genre is not null) select id, degree from c order by md5(concat_ws('|', id, '42')), id limit 120",
)
def connected_candidates(spark, d):
    a = table(spark, d, "artist").where("total_plays between 5 and 400 and genre is not null").select("id", "genre")
    return sampling.connected_candidates(a, transitions(spark, d), "source_id", "target_id", 8, 120).select("id", "degree")
