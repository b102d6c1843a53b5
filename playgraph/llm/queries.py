"""The pN_ queries of the training-data operators over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playgraph.catalog import table
from playgraph.llm import consensus as cons
from playgraph.llm import canon, cooccur, knn, looks, mixing, mojibake, packing, tokens, topn, variants


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    ref = table(spark, d, "library_code").select("id", "presentation_name")
    typed = table(spark, d, "flowsheet_entry").where("entry_type_code < 7").select(F.col("id").alias("entry_id"), F.col("artist_name").alias("name"))
    typed = typed.where(r"name rlike '\\S'").join(ref.select(F.col("presentation_name").alias("name")), "name", "left_anti")
    mapped = canon.map_to_list(typed, "name", ref, "id", "presentation_name")
    return typed.join(mapped, "name").select("entry_id", F.col("entry").alias("library_code_id"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for name, key, vector in (("audio_profile", "artist_id", "feature_centroid"), ("segment_features", "id", "feature_vector")):
        n = knn.nearest_neighbors(table(spark, d, name), key, vector)
        parts.append(n.select(F.lit(name).alias("collection"), "vector_id", "neighbor_id"))
    return parts[0].unionByName(parts[1])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    t = cooccur.PairTable(spark).apply(table(spark, d, "play"), basket="show_id", item="artist_id", pos="sequence")
    found = t.scores(min_together=8).where("n_ab * n >= 12 * n_a * n_b")
    return found.select(F.col("a").alias("artist_id_a"), F.col("b").alias("artist_id_b"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = variants.variant_pairs(table(spark, d, "artist"), "id", "canonical_name")
    return pairs.select(F.col("id_a").alias("artist_id_a"), F.col("id_b").alias("artist_id_b"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_n_per_group(table(spark, d, "dj_transition"), "source_id", "target_id", "pmi", "raw_count", 10).select("source_id", "target_id")


def _verdicts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    labels = cons.latest_labels(table(spark, d, "narrative_label"), "row_id", "labeler", "severity", "updated_at", cons.SEVERITIES, ["failure_mode"])
    severity, who = cons.consensus(labels, cons.SEVERITIES)
    modes = labels.where("value <> 'not_wrong'").select("item", "labeler", F.col("failure_mode").alias("value"))
    mode, who_mode = cons.consensus(modes, cons.FAILURE_MODES)
    return labels, severity, who, mode, who_mode


TEXT_FIELDS = ["artist_name", "song_title", "release_title"]


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.detect(table(spark, d, "flowsheet_entry"), "id", "entry_type_code", TEXT_FIELDS).select("entry_id", "field_name")


def p6_repairs(spark: SparkSession, d: str) -> DataFrame:
    found = mojibake.detect(table(spark, d, "flowsheet_entry"), "id", "entry_type_code", TEXT_FIELDS)
    return found.select("entry_id", "field_name", "chain", "repaired", "readable", F.round("posterior", 6).alias("posterior"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    _, severity, _, mode, _ = _verdicts(spark, d)
    s = severity.where("n_labels >= 3").select(F.col("item").alias("row_id"), F.col("value").alias("severity"))
    m = mode.select(F.col("item").alias("row_id"), F.col("value").alias("mode"))
    # a wrong row whose labelers named no known mode is 'other'
    out = F.when(F.col("severity") == "not_wrong", F.lit("")).otherwise(F.coalesce("mode", F.lit("other")))
    return s.join(m, "row_id", "left").select("row_id", "severity", out.alias("failure_mode"))


def p7_reliability(spark: SparkSession, d: str) -> DataFrame:
    _, _, who, _, _ = _verdicts(spark, d)
    return who.select("labeler", "value", "n_labels", *[F.round(c, 6).alias(c) for c in ("hit", "false_hit", "reliability")])


def p7_agreement(spark: SparkSession, d: str) -> DataFrame:
    _, severity, _, _, _ = _verdicts(spark, d)
    return severity.select(F.col("item").alias("row_id"), F.col("value").alias("severity"), "n_labels", F.round("belief", 6).alias("belief"), F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"), "rounds", F.round("moved", 6).alias("moved"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return looks.alike_pairs(table(spark, d, "documents"), "doc_id", "text").select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def _sized(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", "source", tokens.n_tokens(F.col("text")).alias("n_tokens"))


def p8_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_sized(spark, d), "doc_id", "n_tokens", table(spark, d, "pack_capacity"), "container", "capacity_tokens")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    used = p8_packing(spark, d).where("bin is not null").groupBy("container", "capacity").agg(F.countDistinct("bin").alias("bins"), F.sum("size").alias("tokens"))
    return used.select("container", "capacity", "bins", "tokens", F.round(F.col("tokens") / (F.col("bins") * F.col("capacity")), 6).alias("filled"))


def p9_selection(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_sized(spark, d), "doc_id", "source", "n_tokens", table(spark, d, "mix_target"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_sized(spark, d), "doc_id", "source", "n_tokens", table(spark, d, "mix_target"))[1]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_repairs": p6_repairs,
    "p7_found": p7_found,
    "p7_reliability": p7_reliability,
    "p7_agreement": p7_agreement,
    "p8_packing": p8_packing,
    "p8_fill": p8_fill,
    "p9_selection": p9_selection,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
}

ORACLE: dict[str, str] = {
    "p2_found": """
with v as (
  select 'audio_profile' as collection, artist_id as id, feature_centroid as v from audio_profile
  union all select 'segment_features', id, feature_vector from segment_features),
u as (select collection, id, v, sqrt(list_dot_product(v, v)) as n from v
  where len(v) = 59 and len(list_filter(v, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0),
s as (select a.collection, a.id as vector_id, b.id as neighbor_id,
    row_number() over (partition by a.collection, a.id order by round(list_dot_product(a.v, b.v) / (a.n * b.n), 9) desc, b.id) as r
  from u a join u b on a.collection = b.collection and a.id <> b.id)
select collection, vector_id, neighbor_id from s where r <= 5""",
    "p3_found": """
with p as (select distinct show_id, artist_id, sequence from play where show_id is not null and artist_id is not null),
pairs as (select distinct a.show_id, a.artist_id as artist_id_a, b.artist_id as artist_id_b
  from p a join p b on a.show_id = b.show_id and a.artist_id < b.artist_id and abs(a.sequence - b.sequence) <= 3),
ab as (select artist_id_a, artist_id_b, count(*) as n_ab from pairs group by 1, 2),
m as (select artist_id, count(distinct show_id) as n from p group by 1),
t as (select count(distinct show_id) as n from play)
select artist_id_a, artist_id_b from ab join m ma on ma.artist_id = artist_id_a join m mb on mb.artist_id = artist_id_b, t
where n_ab >= 8 and n_ab * t.n >= 12 * ma.n * mb.n""",
    "p5_found": """
with k as (select source_id, target_id, pmi, raw_count,
    row_number() over (partition by source_id, target_id order by pmi desc, raw_count desc nulls last) as d
  from dj_transition where pmi is not null and not isnan(pmi) and source_id is not null and target_id is not null),
r as (select source_id, target_id, row_number() over (partition by source_id order by pmi desc, raw_count desc nulls last, target_id) as r from k where d = 1)
select source_id, target_id from r where r <= 10""",
}
