import os

import pytest
from pyspark.sql import functions as F

from playgraph.config import PipelineConfig
from playgraph.functions import text as tx
from playgraph.plans import pipeline
from playgraph.sources.sinks import Publisher

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_build_publish_and_invariants(spark, tmp_path):
    root = f"file://{tmp_path}/graph"
    v = pipeline.run(spark, DATA, root, PipelineConfig(pagerank_rounds=5, betweenness_sources=8))
    p = Publisher(spark, root)
    assert p.current() == v
    a, t = p.read("artist"), p.read("dj_transition")
    assert a.count() > 100 and a.select("canonical_name").distinct().count() == a.count()
    assert t.where("pmi is null or raw_count < 2").count() == 0
    assert t.join(a, t.source_id == a.id, "left_anti").count() == 0
    assert a.where("pagerank <= 0 or pagerank > 1 or betweenness < 0").count() == 0
    assert p.read("month_total").agg(F.sum("total_plays")).first()[0] == p.read("play").where("month > 0").count()
    assert pipeline.neighbors(a, t, limit=3).groupBy("source_id").count().where("count > 3").count() == 0


def test_config_is_checked():
    with pytest.raises(ValueError):
        PipelineConfig(top_k=-1)


def test_claims_and_terms(spark):
    df = spark.createDataFrame([("G|ARTIST: a\nU|STRUCTURE: b\n U|ODD: c\nnoise",), ("none",)], "t string")
    assert [r[0] for r in df.select(tx.weighted_claims(F.col("t"))).collect()] == [0.5, 0.0]
    df = spark.createDataFrame([("The ambience drones, warmly.", ["ambient"])], "t string, k array<string>")
    s = df.select(tx.term_score(F.col("t"), F.col("k")), tx.term_score(F.col("t"), F.col("k"), {"ambien": ["ambience"]}, ["warmly"])).first()
    assert (round(s[0], 4), round(s[1], 4)) == (1.0, 0.3333)
