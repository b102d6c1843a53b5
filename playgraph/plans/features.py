"""Queries over vectors, profiles, hours and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playgraph.catalog import table
from playgraph.functions import text as tx
from playgraph.operators import intervals, vectors
from playgraph.plans.registry import query

#: The genre labels of the first nine positions of a sound vector, by number.
GENRES = [f"g{i}" for i in range(9)]


def usable(df: DataFrame, vector: str, dim: int = 59) -> DataFrame:
    v = F.col(vector)
    return df.where(v.isNotNull() & (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)))


USABLE = "{v} is not null and len({v}) = 59 and len(list_filter({v}, lambda x: x is null or isnan(x))) = 0"


@query(
    "cosine_edges",
    "with v as (select vec_id, embedding, sqrt(list_dot_product(embedding::double[], embedding::double[])) as n from embeddings) select a.vec_id as a, b.vec_id as b, round(list_dot_product(a.embedding::double[], b.embedding::double[]) / (a.n * b.n), 6) as similarity from v a join v b on a.vec_id < b.vec_id and list_dot_product(a.embedding::double[], b.embedding::double[]) / (a.n * b.n) >= 0.3",
)
def cosine_edges(spark, d):
    return vectors.cosine_edges(table(spark, d, "embeddings"), "vec_id", "embedding", 0.3).withColumn("similarity", F.round("similarity", 6))


@query("cosine_to_next", "select a.vec_id, round(coalesce(list_dot_product(a.embedding::double[], b.embedding::double[]) / nullif(sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])) * sqrt(list_dot_product(b.embedding::double[], b.embedding::double[])), 0), 0), 6) as sim from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def cosine_to_next(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return e.join(b, "vec_id").select("vec_id", F.round(vectors.cosine(F.col("v"), F.col("w")), 6).alias("sim"))


@query("centroid_profile", "with p as (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as pos from embeddings) select label, (pos - 1)::int as pos, round(avg(x), 6) as x from p group by 1, 2")
def centroid_profile(spark, d):
    m = vectors.mean_vector(table(spark, d, "embeddings"), "label", "embedding")
    return m.select("label", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query("genre_vote", "with v as (select artist_name, genre, sum(genre_probability) as w from segment_features where genre is not null and genre_probability is not null and not isnan(genre_probability) and artist_name is not null group by 1, 2) select artist_name, arg_min(genre, (-round(w, 9), genre)) as genre, round(max(w), 6) as weight from v group by 1")
def genre_vote(spark, d):
    s = table(spark, d, "segment_features").where("artist_name is not null and not isnan(genre_probability)")
    v = vectors.weighted_vote(s, "artist_name", "genre", "genre_probability", "g")
    return v.select("artist_name", F.col("g").alias("genre"), F.round("g_weight", 6).alias("weight"))


@query(
    "recording_profile",
    f"""with s as (select *, feature_vector as vector from segment_features where artist_name is not null and danceability is not null and not isnan(danceability)),
b as (select artist_name, count(*) as recording_count, round(avg(danceability), 6) as avg_danceability, round(avg(case when voice_instrumental = 'voice' then 1.0 when voice_instrumental is not null then 0.0 end), 6) as voice_ratio from s group by 1 having count(*) >= 2),
v as (select artist_name, genre, sum(genre_probability) as w from s where genre is not null and genre_probability is not null group by 1, 2),
g as (select artist_name, arg_min(genre, (-round(w, 9), genre)) as primary_genre, max(w) as w from v group by 1)
select artist_name, recording_count, avg_danceability, voice_ratio, primary_genre, round(w / recording_count, 6) as primary_genre_probability from b left join g using (artist_name)""",
)
def recording_profile(spark, d):
    s = table(spark, d, "segment_features").where("artist_name is not null and danceability is not null and not isnan(danceability)").withColumn("vector", F.col("feature_vector"))
    p = vectors.recording_profile(s, "artist_name", 2)
    return p.select("artist_name", "recording_count", F.round("avg_danceability", 6).alias("avg_danceability"), F.round("voice_ratio", 6).alias("voice_ratio"), "primary_genre", F.round("primary_genre_probability", 6).alias("primary_genre_probability"))


@query(
    "segment_profile",
    f"""with s as (select * from segment_features where artist_name is not null and {USABLE.format(v="feature_vector")}),
b as (select artist_name, count(*) as segments, avg(danceability) as dance, coalesce(avg(case when bpm > 0 then bpm end), 0) as bpm, avg(case when voice_instrumental = 'voice' then voice_instrumental_probability else 1 - voice_instrumental_probability end) as voice from s group by 1),
k0 as (select artist_name, concat_ws(' ', musical_key, scale) as k, sum(key_strength) as w from s where musical_key is not null and key_strength > 0 group by 1, 2),
k as (select artist_name, arg_min(k, (-round(w, 9), k)) as primary_key from k0 group by 1),
m0 as (select artist_name, unnest(feature_vector) as x, generate_subscripts(feature_vector, 1) as pos from s), m1 as (select artist_name, pos, avg(x) as x from m0 where pos <= 9 group by 1, 2),
m as (select artist_name, 'g' || (arg_max(pos, round(x, 9) * 100 - pos * 1e-9) - 1) as primary_genre, max(x) as p from m1 group by 1)
select artist_name, segments, round(dance, 6) as avg_danceability, round(bpm, 6) as avg_bpm, round(voice, 6) as voice_ratio, primary_key, primary_genre, round(p, 6) as primary_genre_probability from b left join k using (artist_name) left join m using (artist_name)""",
)
def segment_profile(spark, d):
    s = usable(table(spark, d, "segment_features").where("artist_name is not null"), "feature_vector")
    p = vectors.segment_profile(s, "artist_name", GENRES)
    return p.select("artist_name", "segments", *[F.round(c, 6).alias(c) for c in ("avg_danceability", "avg_bpm", "voice_ratio", "primary_genre_probability")], "primary_key", "primary_genre")


@query(
    "acoustic_similarity_topk",
    f"""with u as materialized (select artist_id as id, feature_centroid as v from audio_profile where {USABLE.format(v="feature_centroid")}),
v as (select id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as n from u),
e as (select a.id as a, b.id as b, coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) / nullif(a.n * b.n, 0), 0) as s from v a join v b on a.id < b.id), f as (select a, b, round(s, 9) as s from e where s >= 0.97),
z as (select a as node, b as other, s from f union all select b, a, s from f), r as (select *, row_number() over (partition by node order by s desc, other) as k from z),
keep as (select distinct least(node, other) as a, greatest(node, other) as b from r where k <= 5)
select a, b, round(s, 6) as similarity, round(greatest(0, (s - 0.97) / (1 - 0.97)), 4) as scaled from f join keep using (a, b)""",
)
def acoustic_similarity_topk(spark, d):
    from playgraph.operators.graph import prune_topk, saturation

    e = vectors.cosine_edges(usable(table(spark, d, "audio_profile"), "feature_centroid"), "artist_id", "feature_centroid", 0.97).withColumn("similarity", F.round("similarity", 9))
    p = prune_topk(e, "a", "b", F.col("similarity"), 5)
    return p.select("a", "b", F.round("similarity", 6).alias("similarity"), F.round(saturation(F.col("similarity")), 4).alias("scaled"))


@query(
    "audio_descriptors",
    """select artist_id, case when primary_genre_probability > 0.7 then 'clearly ' || primary_genre end as genre_word, case when avg_danceability < 0.3 then 'minimal pulse' when avg_danceability > 0.6 then 'highly danceable' end as dance_word,
case when voice_instrumental_ratio < 0.2 then 'instrumental' when voice_instrumental_ratio > 0.8 then 'vocal-forward' end as voice_word from audio_profile
where (primary_genre_probability is null or not isnan(primary_genre_probability)) and (avg_danceability is null or not isnan(avg_danceability)) and (voice_instrumental_ratio is null or not isnan(voice_instrumental_ratio))""",
)
def audio_descriptors(spark, d):
    a = table(spark, d, "audio_profile")
    for c in ("primary_genre_probability", "avg_danceability", "voice_instrumental_ratio"):
        a = a.where(F.col(c).isNull() | ~F.isnan(c))
    return vectors.audio_descriptors(a).select("artist_id", "genre_word", "dance_word", "voice_word")


@query(
    "top_moods",
    f"""with p as (select artist_id, unnest(feature_centroid[10:16]) as x, generate_subscripts(feature_centroid[10:16], 1) as i from audio_profile where {USABLE.format(v="feature_centroid")}),
r as (select artist_id, x, i, row_number() over (partition by artist_id order by x desc, i) as k from p)
select artist_id, string_agg(['acoustic', 'aggressive', 'electronic', 'happy', 'party', 'relaxed', 'sad'][i], '|' order by k) as moods from r where k <= 3 and x > 0.3 group by 1""",
)
def top_moods(spark, d):
    a = usable(table(spark, d, "audio_profile"), "feature_centroid")
    m = a.select("artist_id", F.array_join(vectors.top_labelled(F.col("feature_centroid"), 9, vectors.MOODS), "|").alias("moods"))
    return m.where("moods <> ''")


@query("tempo_words", "select id, case when bpm < 90 then 'slow' when bpm > 130 then 'fast' end as tempo from segment_features where bpm is not null and not isnan(bpm)")
def tempo_words(spark, d):
    return table(spark, d, "segment_features").where("bpm is not null and not isnan(bpm)").select("id", vectors.tempo_word(F.col("bpm")).alias("tempo"))


@query("hour_bucket", "select id, strftime(start_time at time zone 'UTC', '%Y/%m/%d/%Y%m%d%H00.mp3') as hour_key, round(epoch_us(start_time) / 1e6 - epoch_us(date_trunc('hour', start_time)) / 1e6, 3) as offset_s from flowsheet_entry where start_time is not null")
def hour_bucket(spark, d):
    h = intervals.hour_buckets(table(spark, d, "flowsheet_entry"), "start_time")
    return h.select("id", "hour_key", F.round("offset_s", 3).alias("offset_s"))


@query(
    "window_merge",
    """with w as (select show_id as key, greatest(0, sequence * 180000 - 100000) as s, least(3600000, sequence * 180000 + 100000) as e from flowsheet_entry where show_id is not null and sequence is not null and entry_type_code < 7),
b as (select *, max(e) over (partition by key order by s, e rows between unbounded preceding and 1 preceding) as pe from w),
i as (select *, sum(case when pe is null or s > pe then 1 else 0 end) over (partition by key order by s, e rows between unbounded preceding and current row) as isl from b)
select key, min(s) as start_ms, max(e) as end_ms, count(*) as n from i group by key, isl""",
)
def window_merge(spark, d):
    e = table(spark, d, "flowsheet_entry").where("show_id is not null and sequence is not null and entry_type_code < 7")
    w = intervals.search_windows(e.select(F.col("show_id").alias("key"), (F.col("sequence") * 180000).alias("o")), "key", "o", 100_000)
    return intervals.merge_windows(w, "key")


@query("feature_layout", f"select id, round(list_sum(feature_vector[1:9]), 6) as genre_mass, round(feature_vector[32], 6) as danceability, len(feature_vector)::int as dim from segment_features where {USABLE.format(v='feature_vector')}")
def feature_layout(spark, d):
    """ARR-02: vectors taken apart and put together by the layout."""
    s = usable(table(spark, d, "segment_features"), "feature_vector")
    v = F.col("feature_vector")
    again = vectors.feature_vector([F.slice(v, 1, 9), F.slice(v, 10, 7), F.slice(v, 17, 5), F.slice(v, 22, 10)], [F.get(v, i) for i in range(31, 36)], [F.slice(v, 37, 5), F.slice(v, 42, 8), F.slice(v, 50, 10)])
    s = s.withColumn("_v", again)
    mass = F.aggregate(F.slice("_v", 1, 9), F.lit(0.0), lambda a, x: a + x)
    return s.select("id", F.round(mass, 6).alias("genre_mass"), F.round(F.get("_v", 31), 6).alias("danceability"), F.size("_v").alias("dim"))


@query(
    "fame_bands",
    """with a as (select case when total_plays > 800 then 'HIGH' when total_plays between 100 and 400 then 'LOW' end as fame, case when coalesce(dj_count, 0) >= 3 and id in (select artist_id from audio_profile) then 'RICH' else 'THIN' end as richness from artist)
select fame, richness, count(*) as n from a group by 1, 2""",
)
def fame_bands(spark, d):
    sound = table(spark, d, "audio_profile").select(F.col("artist_id").alias("id"), F.lit(True).alias("sound")).distinct()
    a = table(spark, d, "artist").join(sound, "id", "left")
    a = a.select(tx.fame_band(F.col("total_plays")).alias("fame"), tx.richness(F.coalesce("dj_count", F.lit(0)), F.coalesce("sound", F.lit(False))).alias("richness"))
    return a.groupBy("fame", "richness").agg(F.count("*").alias("n"))
