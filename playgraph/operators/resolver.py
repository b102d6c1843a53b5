"""Name resolution: tiers of exact, normalized and fuzzy joins over distinct names."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from playgraph.functions.fuzzy import Candidates
from playgraph.functions.text import is_compilation, key_form, normalize_identity, normalized_forms, split_names

#: A catalogue of up to this many names is broadcast to the fuzzy search; a larger one is searched in shards.
BROADCAST_NAMES = 100_000
FUZZY, RELAXED, MARGIN = 0.90, 0.82, 0.02


def fk_chain(entries: DataFrame, releases: DataFrame, codes: DataFrame, release_id: str = "library_release_id") -> DataFrame:
    """JN-01: entries with ``fk_name``, the name their release's code has; null where a link is missing. Both sides are joined
    by key; AQE broadcasts the small ones."""
    r = releases.select(F.col("id").alias(release_id), F.col("library_code_id").alias("_code"))
    c = codes.select(F.col("id").alias("_code"), F.col("presentation_name").alias("fk_name"))
    return entries.join(r, release_id, "left").join(c, "_code", "left").drop("_code")


def exact_index(codes: DataFrame, name: str = "presentation_name", order: str = "id") -> DataFrame:
    """JN-02: key -> canonical name, the first in order for each key."""
    return codes.where(F.col(name).isNotNull()).groupBy(key_form(F.col(name)).alias("key")).agg(F.min_by(name, order).alias("canonical"))


def form_index(codes: DataFrame, name: str = "presentation_name") -> DataFrame:
    """JN-03: form -> canonical name, for forms that lead to one name only."""
    forms = codes.where(F.col(name).isNotNull()).select(F.col(name).alias("canonical"), F.explode(normalized_forms((F.col(name)))).alias("form"))
    return forms.where("form <> ''").groupBy("form").agg(F.countDistinct("canonical").alias("_c"), F.min("canonical").alias("canonical")).where("_c = 1").drop("_c")


def composite_index(credits: DataFrame) -> DataFrame:
    """JN-04, SRC-14: (release, folded title) -> artist, the last one given (largest id) stands."""
    return credits.groupBy("release_id", key_form(F.col("track_title")).alias("title")).agg(F.max_by("artist_name", "id").alias("credit"))


def fuzzy_match(names: DataFrame, index: DataFrame, threshold: float = FUZZY, margin: float = MARGIN) -> DataFrame:
    """JN-05, WIN-04: name -> canonical, score. The best key at or above ``threshold``, unless the second is nearer than
    ``margin`` and leads elsewhere. ``names``: distinct key forms (column ``name``); ``index``: key, canonical. Bounds that
    lose nothing cut the comparisons; a catalogue past BROADCAST_NAMES is searched in shards whose two best merge."""
    keys = index.select("key", "canonical")
    n = keys.count()
    spark = names.sparkSession
    schema = "name string, key string, score double"

    def run(c: Candidates, f: pd.DataFrame) -> pd.DataFrame:
        rows = [(q, k, s) for q in f["name"] for k, s in c.search(q, threshold)]
        return pd.DataFrame(rows, columns=["name", "key", "score"])

    if n <= BROADCAST_NAMES:
        shared = spark.sparkContext.broadcast([r["key"] for r in keys.collect()])

        def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            c = None
            for f in frames:
                c = c or Candidates(shared.value)
                yield run(c, f)

        found = names.select("name").repartition(spark.sparkContext.defaultParallelism * 3, "name").mapInPandas(search, schema)
    else:
        shards = -(-n // BROADCAST_NAMES)
        q = names.select("name").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("salt", F.pmod(F.xxhash64("name"), F.lit(64)))
        k = keys.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(63))).cast("long"))
        found = q.groupBy("shard", "salt").cogroup(k.groupBy("shard", "salt")).applyInPandas(lambda a, b: run(Candidates(b["key"].tolist()), a), schema)
    w = Window.partitionBy("name").orderBy(F.desc("score"), "key")
    two = found.join(keys, "key").withColumn("r", F.row_number().over(w)).where("r <= 2")
    nxt = two.withColumn("s2", F.lead("score").over(w)).withColumn("c2", F.lead("canonical").over(w)).where("r = 1")
    return nxt.where(F.col("s2").isNull() | (F.col("score") - F.col("s2") >= margin) | (F.col("c2") == F.col("canonical"))).select("name", "canonical", "score")


def resolve(entries: DataFrame, releases: DataFrame, codes: DataFrame, credits: DataFrame | None = None, external: DataFrame | None = None, name: str = "artist_name", title: str = "song_title", fuzzy: bool = True) -> DataFrame:
    """GRF-01: entries with ``canonical`` and ``method``; the first tier that hits: compilation_track (a compilation entry whose
    release and title have a credit), catalog (the FK chain), exact, normalized (unambiguous), fuzzy, external, raw. Names are
    resolved once each; credits are resolved by name again."""
    e = fk_chain(entries, releases, codes).withColumn("_key", key_form(F.coalesce(name, F.lit(""))))
    if credits is not None:
        idx = composite_index(credits).select(F.col("release_id").alias("library_release_id"), F.col("title").alias("_title"), "credit")
        e = e.withColumn("_title", key_form(F.col(title))).join(idx, ["library_release_id", "_title"], "left").drop("_title")
        e = e.withColumn("credit", F.when(is_compilation(F.col(name)) & (F.col("library_release_id") > 0), F.col("credit")))
    else:
        e = e.withColumn("credit", F.lit(None).cast("string"))
    distinct = e.select(F.coalesce(key_form(F.col("credit")), F.when(F.col("fk_name").isNull(), F.col("_key"))).alias("name")).where("name <> ''").distinct()
    named = resolve_names(distinct, codes, external, fuzzy)
    e = e.withColumn("_name", F.coalesce(key_form(F.col("credit")), F.when(F.col("fk_name").isNull(), F.col("_key"))))
    j = e.join(named.withColumnRenamed("name", "_name"), "_name", "left")
    method = F.when(F.col("credit").isNotNull(), "compilation_track").when(F.col("fk_name").isNotNull(), "catalog").otherwise(F.coalesce("tier", F.lit("raw")))
    by_name = F.coalesce("found", "_name", "_key")
    canonical = F.when(F.col("credit").isNotNull(), by_name).otherwise(F.coalesce("fk_name", by_name))
    return j.withColumn("canonical", canonical).withColumn("method", method).drop("_key", "_name", "found", "tier", "fk_name", "credit")


def resolve_names(names: DataFrame, codes: DataFrame, external: DataFrame | None = None, fuzzy: bool = True) -> DataFrame:
    """name, found, tier of distinct key forms through exact, normalized, fuzzy and external; null when none hits."""
    exact, form = exact_index(codes), form_index(codes)
    n = names.join(exact.withColumnRenamed("key", "name").withColumnRenamed("canonical", "c_exact"), "name", "left")
    n = n.withColumn("form", normalize_identity(F.col("name"))).join(exact.select(F.col("key").alias("form"), F.col("canonical").alias("c_n1")), "form", "left")
    n = n.join(form.withColumnRenamed("canonical", "c_n2"), "form", "left").drop("form")
    n = n.withColumn("c_norm", F.coalesce("c_n1", "c_n2"))
    if fuzzy:
        left = n.where("c_exact is null and c_norm is null").select("name")
        n = n.join(fuzzy_match(left, exact).select("name", F.col("canonical").alias("c_fuzzy")), "name", "left")
    else:
        n = n.withColumn("c_fuzzy", F.lit(None).cast("string"))
    if external is not None:
        n = n.join(external.select(F.col("name"), F.col("canonical").alias("c_ext")), "name", "left")
    else:
        n = n.withColumn("c_ext", F.lit(None).cast("string"))
    tier = F.when(F.col("c_exact").isNotNull(), "exact").when(F.col("c_norm").isNotNull(), "normalized").when(F.col("c_fuzzy").isNotNull(), "fuzzy").when(F.col("c_ext").isNotNull(), "external")
    return n.select("name", F.coalesce("c_exact", "c_norm", "c_fuzzy", "c_ext").alias("found"), tier.alias("tier"))


def re_resolve(resolved: DataFrame, codes: DataFrame, min_plays: int = 10, threshold: float = RELAXED) -> DataFrame:
    """GRF-02: raw names with enough plays are matched once more at a lower threshold, as 'fuzzy_relaxed'."""
    raw = resolved.where("method = 'raw'").groupBy(F.col("canonical").alias("name")).agg(F.count("*").alias("c")).where((F.col("c") >= min_plays) & (F.col("name") != "")).select("name")
    hit = fuzzy_match(raw, exact_index(codes), threshold).select(F.col("name").alias("canonical"), F.col("canonical").alias("_new"))
    j = resolved.join(hit, "canonical", "left")
    use = (F.col("method") == "raw") & F.col("_new").isNotNull()
    return j.withColumns({"method": F.when(use, "fuzzy_relaxed").otherwise(F.col("method")), "canonical": F.when(use, F.col("_new")).otherwise(F.col("canonical"))}).drop("_new")


def archive_match(names: DataFrame, catalog: DataFrame, name: str = "name") -> DataFrame:
    """GRF-03: (name, canonical) of archive names: exact, compilations skipped, normalized if unambiguous, else each part of a
    joint name on its own (several rows)."""
    n = names.select(F.col(name).alias("name")).where(~is_compilation(F.col(name))).distinct().withColumn("key", key_form(F.col("name")))
    exact, form = exact_index(catalog), form_index(catalog)
    n = n.join(exact.withColumnRenamed("canonical", "c1"), "key", "left").withColumn("form", normalize_identity(F.col("key")))
    n = n.join(form.withColumnRenamed("canonical", "c2"), "form", "left").withColumn("whole", F.coalesce("c1", "c2"))
    part = n.where("whole is null").select("name", F.explode(split_names(F.col("key"))).alias("key")).join(exact, "key").select("name", "canonical")
    return n.where("whole is not null").select("name", F.col("whole").alias("canonical")).unionByName(part).distinct()
