"""Feature vectors: similarity, profiles, descriptors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """ARR-01: cosine similarity, 0.0 where a norm is 0; vectors of unequal length give null."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n))


def cosine_edges(vectors: DataFrame, id_col: str, vector: str, threshold: float, block_rows: int = 2048) -> DataFrame:
    """JN-16, GRF-07: a < b, similarity of all pairs at or above ``threshold``, exact. Ids are hashed to blocks of about
    ``block_rows`` vectors; each unordered pair of blocks meets once, as one matrix product in NumPy. Every vector is copied
    to as many tasks as there are blocks, which is what a complete comparison costs."""
    v = vectors.select(F.col(id_col).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v")).where("id is not null and v is not null")
    n = v.count()
    blocks = max(1, -(-n // block_rows))
    kind = v.schema["id"].dataType.simpleString()
    v = v.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    pair = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    cells = v.withColumn("o", pair).select(F.least("block", "o").alias("p"), F.greatest("block", "o").alias("q"), "block", "id", "v")

    def cell(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        def side(b: int) -> tuple[np.ndarray, np.ndarray]:
            s = f[f["block"] == b]
            m = np.array(s["v"].tolist(), float).reshape(len(s), -1)
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            return s["id"].to_numpy(), np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)

        (ia, ma), (ib, mb) = side(key[0]), side(key[1])
        if not len(ia) or not len(ib):
            return pd.DataFrame({"a": ia[:0], "b": ib[:0], "similarity": np.zeros(0)})
        s = ma @ mb.T
        i, j = np.nonzero(s >= threshold)
        keep = (ia[i] < ib[j]) if key[0] == key[1] else np.ones(len(i), bool)
        i, j = i[keep], j[keep]
        return pd.DataFrame({"a": np.minimum(ia[i], ib[j]), "b": np.maximum(ia[i], ib[j]), "similarity": s[i, j]})

    return cells.groupBy("p", "q").applyInPandas(cell, f"a {kind}, b {kind}, similarity double")


def mean_vector(df: DataFrame, key: str, vector: str) -> DataFrame:
    """AGG-12, AGG-14: element-wise mean per key, by position; a partial aggregate, so a key of any size is no problem."""
    p = df.where(F.col(vector).isNotNull()).select(key, F.posexplode(vector).alias("pos", "x"))
    m = p.groupBy(key, "pos").agg(F.avg("x").alias("x"))
    return m.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centroid"))


def weighted_vote(df: DataFrame, key: str, label: str, weight: str, out: str) -> DataFrame:
    """Label with the largest summed weight, ties to the smaller label; its weight and the number of rows."""
    v = df.where(F.col(label).isNotNull() & F.col(weight).isNotNull()).groupBy(key, label).agg(F.sum(weight).alias("w"))
    return v.groupBy(key).agg(F.min_by(label, F.struct((-F.round("w", 9)).alias("n"), F.col(label))).alias(out), F.max("w").alias(f"{out}_weight"))


def recording_profile(recs: DataFrame, key: str, min_recordings: int = 1) -> DataFrame:
    """AGG-12: mean danceability, fraction of vocal recordings, mean vector, genre by summed probability (its share of all
    rows), for keys with enough recordings. Columns: danceability, voice_instrumental, genre, genre_probability, vector."""
    base = recs.groupBy(key).agg(F.count("*").alias("recording_count"), F.avg("danceability").alias("avg_danceability"), F.avg((F.col("voice_instrumental") == "voice").cast("double")).alias("voice_ratio")).where(F.col("recording_count") >= min_recordings)
    vote = weighted_vote(recs, key, "genre", "genre_probability", "primary_genre")
    j = base.join(vote, key, "left").join(mean_vector(recs, key, "vector"), key, "left")
    return j.withColumn("primary_genre_probability", F.col("primary_genre_weight") / F.col("recording_count")).drop("primary_genre_weight")


def segment_profile(segs: DataFrame, key: str, genre_labels: list[str]) -> DataFrame:
    """AGG-13: primary genre as the largest entry of the mean vector's first positions, mean voice probability, mean bpm of
    segments with one, key by summed strength (of "key scale", strength > 0)."""
    voice = F.when(F.col("voice_instrumental") == "voice", F.col("voice_instrumental_probability")).otherwise(1 - F.col("voice_instrumental_probability"))
    base = segs.groupBy(key).agg(
        F.count("*").alias("segments"), F.avg("danceability").alias("avg_danceability"), F.avg(voice).alias("voice_ratio"), F.coalesce(F.avg(F.when(F.col("bpm") > 0, F.col("bpm"))), F.lit(0.0)).alias("avg_bpm")
    )
    named = segs.where(F.col("musical_key").isNotNull() & (F.col("key_strength") > 0)).withColumn("_k", F.concat_ws(" ", "musical_key", "scale"))
    keys = weighted_vote(named, key, "_k", "key_strength", "primary_key").drop("primary_key_weight")
    n = len(genre_labels)
    head = F.slice("centroid", 1, n)
    labels = F.array(*[F.lit(g) for g in genre_labels])
    genre = mean_vector(segs, key, "feature_vector").withColumn("_m", F.array_max(head)).select(key, F.col("_m").alias("primary_genre_probability"), F.element_at(labels, F.array_position(head, F.col("_m")).cast("int")).alias("primary_genre"))
    return base.join(keys, key, "left").join(genre, key, "left")


def distribution(m: Column, labels: list[str]) -> Column:
    """MAP-01: a classifier's map as a vector over ``labels``, 0.0 where a label is missing."""
    return F.array(*[F.coalesce(m[F.lit(x)], F.lit(0.0)) for x in labels])


def feature_vector(parts: list[Column], scalars: list[Column], tail: list[Column]) -> Column:
    """ARR-02: the fixed layout: distributions, single values, further distributions."""
    return F.concat(*parts, F.array(*scalars), *tail)


def top_labelled(vector: Column, start: int, labels: list[str], n: int = 3, floor: float = 0.3) -> Column:
    """ARR-03: of the entries from ``start`` (0-based) the labels of the ``n`` largest above ``floor``, largest first, ties in
    label order."""
    part = F.slice(vector, start + 1, len(labels))
    pairs = F.transform(part, lambda x, i: F.struct((-x).alias("v"), i.alias("i")))
    names = F.array(*[F.lit(x) for x in labels])
    best = F.filter(F.slice(F.array_sort(pairs), 1, n), lambda s: -s["v"] > floor)
    return F.transform(best, lambda s: F.element_at(names, s["i"] + 1))


#: Mood labels in vector order, and the thresholds of the descriptors.
MOODS = ["acoustic", "aggressive", "electronic", "happy", "party", "relaxed", "sad"]
DANCE_LOW, DANCE_HIGH, VOICE_LOW, VOICE_HIGH, GENRE_SURE, BPM_SLOW, BPM_FAST = 0.3, 0.6, 0.2, 0.8, 0.7, 90, 130


def audio_descriptors(p: DataFrame) -> DataFrame:
    """CND-01: words for what is remarkable of a profile; null where nothing but the count would be left."""
    band = lambda c, lo, a, hi, b: F.when(F.col(c) < lo, a).when(F.col(c) > hi, b)
    d = p.withColumns({
        "genre_word": F.when(F.col("primary_genre_probability") > GENRE_SURE, F.concat(F.lit("clearly "), "primary_genre")),
        "dance_word": band("avg_danceability", DANCE_LOW, "minimal pulse", DANCE_HIGH, "highly danceable"),
        "voice_word": band("voice_instrumental_ratio", VOICE_LOW, "instrumental", VOICE_HIGH, "vocal-forward"),
        "moods": top_labelled(F.col("feature_centroid"), 9, MOODS),
    })
    some = F.coalesce("genre_word", "dance_word", "voice_word").isNotNull() | (F.coalesce(F.size("moods"), F.lit(0)) > 0)
    return d.withColumn("recording_count", F.when(some, F.col("recording_count")))


def tempo_word(bpm: Column) -> Column:
    return F.when(bpm < BPM_SLOW, "slow").when(bpm > BPM_FAST, "fast")

