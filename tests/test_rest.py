import numpy as np
import pytest
from pyspark.sql import functions as F

from playgraph import catalog
from playgraph.functions import text as tx
from playgraph.operators import intervals, merge, sampling, vectors
from playgraph.plans import surface_ops as ops
from playgraph.sources import readers, sinks
from playgraph.streaming import incremental
from tests.util import rows


def test_dump_reader_escapes_and_types(spark, tmp_path):
    p = tmp_path / "dump.sql"
    p.write_text("-- x\nINSERT INTO `T` VALUES (1,'a\\'b','x''y',NULL,1.5),(2,'c,d)','\\n',7,'z');\nINSERT INTO `OTHER` VALUES (9,'no');\nINSERT INTO `T` VALUES (x,'','e',3,2);\n")
    df = readers.read_dump(spark, str(p), "T", [("id", 0, "bigint"), ("a", 1, "string"), ("b", 2, "string"), ("n", 3, "int"), ("f", 4, "double")])
    assert rows(df) == [(1, "a'b", "x'y", None, 1.5), (2, "c,d)", "\n", 7, None), (None, "", "e", 3, 2.0)]


def test_typed_entries_and_absent_tables(spark, tmp_path):
    raw = spark.createDataFrame([(None, "12"), ("a", "none")], "artist_name string, library_release_id string")
    assert rows(readers.typed_entries(raw)) == [("", 12), ("a", 0)]
    schema = raw.schema
    assert catalog.table_or_empty(spark, str(tmp_path), "gone", schema).count() == 0
    assert catalog.ensure_columns(raw.drop("artist_name"), schema).columns == ["library_release_id", "artist_name"]


def test_track_credits_and_search(spark):
    j = '[{"comp_id": 5, "tracks": [{"title": "T", "artists": ["A", "B"]}, {"title": "U", "artists": []}]}]'
    c = readers.track_credits(spark.createDataFrame([(j,), ("broken",)], "j string"), "j")
    assert rows(c, "release_id", "track_title", "artist_name") == [(5, "T", "A")]
    q = spark.createDataFrame([("a", "t"), ("b", "t"), ("c", "t")], "artist_name string, title string")
    f = lambda d: spark.createDataFrame(d, "artist_name string, title string, artist_id long")
    assert rows(readers.search_artist(q, f([("A", "T", 1)]), f([("A", "T", 9), ("B", "T", 2)]))) == [("a", "t", 1), ("b", "t", 2), ("c", "t", None)]


def test_feature_files_and_label_rows(spark, tmp_path):
    d = tmp_path / "ab"
    d.mkdir()
    (d / "rec1-0.json").write_text('{"x": 1.5}')
    (d / "rec2-0.json").write_text("{broken")
    assert ("rec1", 1.5) in rows(readers.read_feature_files(spark, str(tmp_path), catalog.T.StructType().add("x", "double")), "record_id", "x")
    (tmp_path / "l.jsonl").write_text('{"row_id": "r1"}\n\n{"row_id": ""}\n')
    assert rows(readers.read_label_rows(spark, str(tmp_path / "l.jsonl")), "row_id") == [("r1",)]


def test_cosine_edges_against_numpy(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(60, 5))
    m[3] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, v array<double>")
    u = np.divide(m, np.linalg.norm(m, axis=1, keepdims=True), out=np.zeros_like(m), where=np.linalg.norm(m, axis=1, keepdims=True) > 0)
    s = u @ u.T
    want = sorted(((i, j) for i in range(60) for j in range(i + 1, 60) if s[i, j] >= 0.4), key=repr)
    assert rows(vectors.cosine_edges(df, "id", "v", 0.4, block_rows=16), "a", "b") == want
    z = df.where("id = 3").select(vectors.cosine(F.col("v"), F.col("v"))).first()[0]
    assert z == 0.0


def test_profiles_and_descriptors(spark):
    s = spark.createDataFrame([("a", 0.5, "voice", 0.8, "x", 0.9, [1.0, 3.0], 100.0, "C", "major", 0.5), ("a", 0.7, "instrumental", 0.8, "y", 0.5, [3.0, 5.0], 0.0, "D", "minor", 0.9)], "k string, danceability double, voice_instrumental string, voice_instrumental_probability double, genre string, genre_probability double, feature_vector array<double>, bpm double, musical_key string, scale string, key_strength double")
    p = vectors.segment_profile(s, "k", ["g0", "g1"]).first()
    assert (p["segments"], p["avg_bpm"], p["primary_key"], p["primary_genre"], p["primary_genre_probability"]) == (2, 100.0, "D minor", "g1", 4.0)
    assert abs(p["voice_ratio"] - 0.5) < 1e-9
    r = vectors.recording_profile(s.withColumn("vector", F.col("feature_vector")), "k", 2).first()
    assert (r["voice_ratio"], r["primary_genre"], r["primary_genre_probability"], r["centroid"]) == (0.5, "x", 0.45, [2.0, 4.0])
    assert vectors.recording_profile(s.withColumn("vector", F.col("feature_vector")), "k", 3).count() == 0
    v = [0.0] * 9 + [0.9, 0.2, 0.4, 0.4, 0.1, 0.0, 0.0]
    d = spark.createDataFrame([(1, 3, "rock", 0.8, 0.2, 0.5, v), (2, 4, "rock", 0.7, 0.4, 0.5, None)], "id long, recording_count long, primary_genre string, primary_genre_probability double, avg_danceability double, voice_instrumental_ratio double, feature_centroid array<double>")
    got = {r["id"]: r for r in vectors.audio_descriptors(d).collect()}
    assert (got[1]["genre_word"], got[1]["dance_word"], got[1]["moods"], got[1]["recording_count"]) == ("clearly rock", "minimal pulse", ["acoustic", "electronic", "happy"], 3)
    assert got[2]["recording_count"] is None


def test_windows_merge_when_they_touch(spark):
    w = spark.createDataFrame([("h", 0, 10), ("h", 10, 20), ("h", 5, 8), ("h", 30, 40), ("g", 1, 2)], "k string, start_ms long, end_ms long")
    assert rows(intervals.merge_windows(w, "k"), "k", "start_ms", "end_ms", "n") == [("g", 1, 2, 1), ("h", 0, 20, 3), ("h", 30, 40, 1)]
    o = intervals.search_windows(spark.createDataFrame([(1, 100)], "k long, o long"), "k", "o", 300, 350).first()
    assert (o["start_ms"], o["end_ms"]) == (0, 350)


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id long, x string, y long")
    new = spark.createDataFrame([(2, None, 9), (3, "c", 3)], "id long, x string, y long")
    assert rows(merge.upsert_coalesce(old, new, "id")) == [(1, "a", 1), (2, "b", 9), (3, "c", 3)]
    assert rows(merge.insert_or_ignore(old, new.unionByName(new.where("id = 3").withColumn("y", F.lit(0).cast("long"))), ["id"], ["y"])) == [(1, "a", 1), (2, "b", 2), (3, "c", 0)]
    assert rows(merge.insert_or_replace(old, new, ["id"], [F.desc("y")])) == [(1, "a", 1), (2, None, 9), (3, "c", 3)]
    assert rows(merge.update_stats(old, new, "id", ["x"])) == [(1, "a", 1), (2, "b", 9)]
    assert rows(merge.reset_and_map(old, new.select("id", "y"), "id", "y")) == [(1, "a", None), (2, "b", 9)]


def test_entity_merge_rules(spark):
    n = spark.createDataFrame([(1, "q"), (5, "q"), (7, "q"), (2, None), (3, "z")], "id long, qid string")
    m = merge.merge_map(n, "qid")
    assert rows(m) == [(5, 1), (7, 1)]
    e = spark.createDataFrame([(1, 2, "kept"), (5, 2, "moved"), (5, 7, "self"), (2, 7, "back"), (3, 5, "new")], "a long, b long, t string")
    assert rows(merge.rekey_pairs(e, m, "a", "b", False)) == [(1, 2, "kept"), (2, 1, "back"), (3, 1, "new")]
    assert rows(merge.rekey_pairs(e, m, "a", "b", True)) == [(1, 2, "kept"), (1, 3, "new")]
    f = spark.createDataFrame([(1, "s"), (5, "s"), (3, "s")], "a long, s string")
    assert rows(merge.rekey_single(f, m, "a")) == [(1, "s"), (3, "s")]


def test_ids_are_stable_and_ordered(spark):
    first = sinks.assign_ids(spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "n string"), "n")
    assert rows(first) == [(1, "a"), (2, "b")]
    again = sinks.assign_ids(spark.createDataFrame([("0",), ("b",), ("z",)], "n string"), "n", first)
    assert rows(again) == [(1, "a"), (2, "b"), (3, "0"), (4, "z")]
    e = spark.createDataFrame([("A", "b", 3, 1.0), ("a", "b", 9, 1.0), ("a", "gone", 5, 1.0), ("b", "a", 1, 1.0)], "source string, target string, raw_count long, pmi double")
    assert rows(sinks.insert_edges(e, first)) == [(1, 2, 9, 1.0)]


def test_publish_gate_and_gexf(spark, tmp_path):
    p = sinks.Publisher(spark, f"file://{tmp_path}/pub")
    df = spark.range(3)
    v1 = p.publish({"t": df})

    def bad(s, at):
        sinks.enforce(sinks.validation_gate(ops.health({"t": s.read.parquet(f"{at}/t.parquet")}), s.createDataFrame([("t", 100)], "`table` string, rows long")))

    with pytest.raises(ValueError):
        p.publish({"t": df}, gate=bad)
    assert p.current() == v1 and p.read("t").count() == 3
    v2 = p.publish({"t": spark.range(5)})
    assert p.current() == v2 and p.read("t").count() == 5 and p.clean() == 1
    out = tmp_path / "g.gexf"
    sinks.write_gexf(spark.createDataFrame([(1, 'A "q" & b')], "id long, label string"), spark.createDataFrame([(1, 1, 2.0)], "source long, target long, weight double"), str(out))
    import xml.etree.ElementTree as ET

    assert len(ET.parse(out).getroot().findall(".//{*}node")) == 1


def test_samples_do_not_depend_on_partitions(spark):
    d = spark.range(100).withColumn("g", F.col("id") % 3)
    a = sampling.stratified(d, ["g"], ["id"], 4)
    assert a.count() == 12 and rows(a) == rows(sampling.stratified(d.repartition(7), ["g"], ["id"], 4))
    m = spark.createDataFrame([(i, i) for i in (1, 3, 5)], "id long, code long")
    got = sampling.overfetch(d.withColumn("k", F.lit(1)), "k", ["id"], m, "id", 2)
    assert rows(got, "id", "rank") == [(1, 1), (3, 2)]


def test_surface(spark):
    n = spark.createDataFrame([(1, "The Cat", 5), (2, "Cathode", 1), (3, "Dog", 9)], "id long, canonical_name string, total_plays long")
    assert [r["id"] for r in ops.search(n, "cat").collect()] == [2, 1]
    with pytest.raises(ValueError):
        ops.search(n, "")
    nodes = spark.createDataFrame([(1, 10), (2, 20), (3, 20), (4, None)], "id long, code long")
    ranked = spark.createDataFrame([(1, 4, 3.0, 1), (1, 2, 2.0, 2), (2, 1, 1.0, 1)], "center long, neighbor long, weight double, rank int")
    req = spark.createDataFrame([(10,), (20,), (99,)], "code long")
    assert rows(ops.neighbors_by_key(req, "code", nodes, ranked)) == [(10, 20, 2.0, 1), (20, None, None, None), (99, None, None, None)]
    a = spark.createDataFrame([(1, 4, 1, 5), (2, 3, 2, 6), (3, 0, 0, 7)], "id long, grounded long, ungrounded long, at long")
    assert [(r["id"], r["flagged"]) for r in ops.recent_audits(a).collect()] == [(3, False), (2, True), (1, False)]


def test_streams(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    schema = "artist_id long, month int"
    spark.createDataFrame([(1, 3), (1, 3), (2, 0)], schema).write.parquet(str(src))
    q = incremental.facet_stream(spark.readStream.schema(schema).parquet(str(src)), str(out), str(tmp_path / "ck"))
    q.awaitTermination()
    spark.createDataFrame([(1, 3)], schema).write.mode("append").parquet(str(src))
    q = incremental.facet_stream(spark.readStream.schema(schema).parquet(str(src)), str(out), str(tmp_path / "ck"))
    q.awaitTermination()
    assert rows(incremental.facet_counts(spark, str(out))) == [(1, 3, 3)]
    e = spark.createDataFrame([(1, 0), (1, 600), (1, 9000)], "u long, t long").selectExpr("u", "timestamp_seconds(t) ts")
    assert [r[0] for r in incremental.session_counts(e, "u", "ts").orderBy("start").select("events").collect()] == [2, 1]


def test_gate_leaves_out_tables_that_were_empty(spark):
    t = lambda d: spark.createDataFrame(d, "`table` string, rows long")
    got = rows(sinks.validation_gate(t([("a", 0), ("b", 4)]), t([("a", 0), ("b", 9), ("c", 1)])), "table", "seed", "rows", "floor", "ok")
    assert got == [("b", 9, 4, 4, True), ("c", 1, 0, 1, False)]
    assert rows(sinks.validation_gate(t([("a", 0)]), t([("a", 0)]), min_rows={"a": 1}), "table", "ok") == [("a", False)]


def test_bio_sentence(spark):
    df = spark.createDataFrame([(1, "Rock", 5, 2, 2001, 2009), (2, None, 0, 0, 2003, None), (3, "Jazz", 1, 1, None, 2000)], "id long, genre string, total_plays long, dj_count long, active_first_year long, active_last_year long")
    assert [r[1] for r in rows(ops.generated_bio(df, "Radio X"))] == [
        "Rock artist played 5 times by 2 DJs on Radio X between 2001 and 2009.",
        "Unknown genre artist played 0 times by 0 DJs on Radio X since 2003.",
        "Jazz artist played 1 times by 1 DJs on Radio X.",
    ]


def test_risk_bands(spark):
    cols = "plays_a long, rich_a long, styles_a long, genre_a string, plays_b long, rich_b long, styles_b long, genre_b string"
    df = spark.createDataFrame([(2001, 0, 21, "a", 1, 9, 1, "b"), (600, 2, 11, "a", 500, 9, 1, "a"), (10, 3, 10, None, 10, 3, 1, None), (1001, 5, 1, "a", 1000, 5, 1, None)], cols)
    assert sorted(r["risk"] for r in sampling.band_risk(df).collect()) == [0.0, 1.5, 2.0, 4.0]


def test_corruptions_are_feasible_and_single(spark):
    data = [(f"r{i}", "instrumental" if i % 2 else None, ["x"] if i % 3 else [], "rock" if i % 5 else None, None, [], "jazz" if i % 7 else None) for i in range(60)] + [("none", None, [], None, None, None, None)]
    df = spark.createDataFrame(data, "row_id string, source_voice string, source_styles array<string>, source_genre string, target_voice string, target_styles array<string>, target_genre string")
    got = {r["row_id"]: r for r in sampling.corrupt(df, "row_id").collect()}
    sides, seen = ("source", "target"), set()
    for r, sv, ss, sg, tv, ts, tg in data:
        g, was = got[r], {"source": (sv, ss, sg), "target": (tv, ts, tg)}
        changed = [s for s in sides if (g[f"{s}_voice"], g[f"{s}_styles"], g[f"{s}_genre"]) != was[s]]
        if g["strategy"] is None:
            assert not changed and r == "none" or (sv, tg) == (None, None) or not (sg or tg)
            continue
        seen.add(g["strategy"])
        v, st, ge = was[g["side"]]
        if g["strategy"] == "voice_instrumental":
            assert changed == [g["side"]] and v == "instrumental" and g[f"{g['side']}_voice"] == "vocal-forward"
        elif g["strategy"] == "genre_swap":
            assert changed == [g["side"]] and ge and g[f"{g['side']}_genre"] in {"rock", "jazz"} - {ge}
        else:
            assert st and g[f"{g['side']}_styles"]
    assert seen == {"voice_instrumental", "genre_swap"} or seen == {"voice_instrumental", "genre_swap", "outlier_styles"}


def test_kept_table_follows_size_and_time(spark, tmp_path):
    src, made = tmp_path / "s.txt", []
    src.write_text("one")

    def build():
        made.append(1)
        return spark.read.text(str(src))

    at = f"file://{tmp_path}/kept"
    assert rows(readers.cached(spark, f"file://{src}", build, at)) == rows(readers.cached(spark, f"file://{src}", build, at)) == [("one",)]
    src.write_text("three")
    assert rows(readers.cached(spark, f"file://{src}", build, at)) == [("three",)] and len(made) == 2


def test_jdbc_source(spark):
    url = "jdbc:derby:memory:src;create=true"
    df = spark.createDataFrame([(i, f"n{i}") for i in range(20)], "ID int, NAME string")
    try:
        df.write.jdbc(url, "T", mode="overwrite", properties={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    except Exception as e:  # no such driver in this Spark
        pytest.skip(str(e)[:80])
    assert rows(readers.read_jdbc(spark, url, "T", ("ID", 0, 20, 3))) == rows(df)


def test_months_and_chains(spark):
    df = spark.createDataFrame([(0, None, "b"), (12, " ", None), (13, "a", "b")], "m int, x string, y string")
    value, source = tx.first_of(("x", F.col("x")), ("y", F.col("y")))
    assert [tuple(r) for r in df.select(tx.month_name(F.col("m")), value, source).collect()] == [("", "b", "y"), ("December", None, None), (None, "a", "x")]
    j = spark.createDataFrame([('["a","b"]',), ("a",), ("[broken",), (None,)], "j string")
    assert [tuple(r) for r in j.select(tx.parse_array(F.col("j")), tx.array_weight(F.col("j"))).collect()] == [(["a", "b"], 2), (None, 0), (None, 0), (None, 0)]
