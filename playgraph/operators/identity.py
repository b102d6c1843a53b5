"""Cross references, influences, hierarchies and external-id bridges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playgraph.session import cut

#: Names of one unit of ``influence_edges``.
UNIT_NAMES = 1000


def code_xrefs(xrefs: DataFrame, codes: DataFrame) -> DataFrame:
    """GRF-04: code -> code references by name; unresolved and self references go, a null comment is ''."""
    a = codes.select(F.col("id").alias("a"), F.col("name").alias("artist_a"))
    b = codes.select(F.col("id").alias("b"), F.col("name").alias("artist_b"))
    return xrefs.join(a, "a").join(b, "b").where("artist_a <> artist_b").select("artist_a", "artist_b", F.coalesce("comment", F.lit("")).alias("comment"), F.lit("library_code").alias("source"))


def release_xrefs(xrefs: DataFrame, releases: DataFrame, codes: DataFrame) -> DataFrame:
    """GRF-04: code -> release -> code references."""
    a = codes.select(F.col("id").alias("a"), F.col("name").alias("artist_a"))
    b = releases.select(F.col("id").alias("b"), F.col("library_code_id").alias("code")).join(codes.select(F.col("id").alias("code"), F.col("name").alias("artist_b")), "code")
    return xrefs.join(a, "a").join(b, "b").where("artist_a <> artist_b").select("artist_a", "artist_b", F.coalesce("comment", F.lit("")).alias("comment"), F.lit("release").alias("source"))


def import_xrefs(edges: DataFrame, nodes: DataFrame, existing: DataFrame) -> DataFrame:
    """EXP-12: ``existing`` (a_id, b_id, comment, source) with references by name (``code_xrefs``, ``release_xrefs``) added: both
    names must be nodes (id, name); a reference already there, or given twice, is added once."""
    x = edges.join(nodes.select(F.col("name").alias("artist_a"), F.col("id").alias("a_id")), "artist_a").join(nodes.select(F.col("name").alias("artist_b"), F.col("id").alias("b_id")), "artist_b")
    new = x.groupBy("a_id", "b_id", "source").agg(F.min("comment").alias("comment")).join(existing.select("a_id", "b_id", "source"), ["a_id", "b_id", "source"], "left_anti")
    cols = ["a_id", "b_id", "comment", "source"]
    return existing.select(*cols).unionByName(new.select(*cols))


def influence_edges(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """GRF-05, JN-19: influences by name; both ends known, no self pairs, the first per name pair, by the text of its external
    ids ('source>target').

    Names with the same external ids are one unit (at most about UNIT_NAMES of them). The first ids are found per pair of units,
    and as a name is in one unit, the name pairs made of units are distinct as they come: they are never shuffled."""
    known = names.select("qid", "name").where("qid is not null and name is not null").groupBy("name").agg(F.sort_array(F.collect_set("qid")).alias("qids"))
    sizes = known.groupBy("qids").agg(F.ceil(F.count("*") / UNIT_NAMES).alias("parts"))
    unit = known.join(sizes, "qids").groupBy("qids", F.pmod(F.xxhash64("name"), F.col("parts")).alias("part")).agg(F.collect_list("name").alias("members"))
    unit = cut(unit.select(F.monotonically_increasing_id().alias("unit"), "qids", "members"))
    of = unit.select("unit", F.explode("qids").alias("qid"))
    s = of.select(F.col("qid").alias("source_qid"), F.col("unit").alias("s"))
    t = of.select(F.col("qid").alias("target_qid"), F.col("unit").alias("t"))
    text = F.concat_ws(">", "source_qid", "target_qid")
    met = pairs.select("source_qid", "target_qid").distinct().join(s, "source_qid").join(t, "target_qid").groupBy("s", "t").agg(F.min(F.struct(text.alias("text"), "source_qid", "target_qid")).alias("q"))
    met = met.join(unit.select(F.col("unit").alias("s"), F.col("members").alias("sources")), "s").join(unit.select(F.col("unit").alias("t"), F.col("members").alias("targets")), "t")
    each = met.select("targets", "q", F.explode("sources").alias("source")).select("source", F.explode("targets").alias("target"), "q.source_qid", "q.target_qid")
    return each.where("source <> target")


def label_hierarchy(labels: DataFrame, links: DataFrame) -> DataFrame:
    """GRF-06: (parent_id, child_id): labels deduplicated by name with the first non-null id, linked both by external id,
    inserted once."""
    one = labels.groupBy("name").agg(F.min(F.when(F.col("qid").isNotNull(), F.col("id"))).alias("known"), F.min("id").alias("any"), F.min("qid").alias("qid"))
    one = one.select(F.coalesce("known", "any").alias("id"), "qid").where("qid is not null")
    p = one.select(F.col("id").alias("parent_id"), F.col("qid").alias("parent_qid"))
    c = one.select(F.col("id").alias("child_id"), F.col("qid").alias("child_qid"))
    return links.join(p, "parent_qid").join(c, "child_qid").where("parent_id <> child_id").select("parent_id", "child_id").distinct()


def bridge_ids(entities: DataFrame, mapping: DataFrame, via: str, fill: str) -> DataFrame:
    """GRF-24, JN-13: fill ``fill`` where it is null through ``mapping`` (via, fill); a mapping with several values for one key
    proves nothing and is left out; values that exist stay."""
    m = mapping.where(F.col(fill).isNotNull()).groupBy(via).agg(F.countDistinct(fill).alias("_c"), F.min(fill).alias("_f")).where("_c = 1").drop("_c")
    return entities.join(m, via, "left").withColumn(fill, F.coalesce(fill, "_f")).drop("_f")


def property_bridge(mapping: DataFrame, left: str, right: str) -> DataFrame:
    """JN-13: pairs (left value, right value) that share an entity: a self-join of (qid, property, value) with a filter on each
    side."""
    a = mapping.where(F.col("property") == left).select("qid", F.col("value").alias("left"))
    b = mapping.where(F.col("property") == right).select("qid", F.col("value").alias("right"))
    return a.join(b, "qid").select("left", "right").distinct()
