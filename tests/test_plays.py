import math

from playgraph.operators import adjacency, pmi, stats
from tests.util import rows

PLAY = "id long, artist_id long, show_id long, dj_id long, sequence long, month int, request_flag int, played_at timestamp"


def plays(spark, data):
    return spark.createDataFrame([(i, a, s, 1, q, 3, 0, None) for i, (a, s, q) in enumerate(data, 1)], PLAY)


def test_positional_pairs_are_gap_tolerant_sorted_and_stay_in_their_show(spark):
    p = plays(spark, [(1, 10, 5), (2, 10, 1), (3, 10, 9), (4, 11, 1), (4, 11, 2), (5, 12, 1)])
    got = rows(adjacency.adjacent_positional(p, "show_id", ["sequence", "id"], "artist_id"), "source", "target")
    assert got == [(1, 3), (2, 1), (4, 4)]


def test_positional_pairs_of_nothing(spark):
    assert rows(adjacency.adjacent_positional(plays(spark, []), "show_id", ["sequence"], "artist_id")) == []


def test_strict_pairs_need_the_next_number_and_multiply(spark):
    p = plays(spark, [(1, 10, 1), (2, 10, 2), (3, 10, 2), (4, 10, 4)])
    assert rows(adjacency.adjacent_strict(p, "show_id", "sequence", "artist_id"), "source", "target") == [(1, 2), (1, 3)]


def test_pmi_of_the_hand_computed_case(spark):
    p = spark.createDataFrame([(1, "A", 1, 1), (2, "B", 1, 2), (3, "A", 2, 1), (4, "B", 2, 2)], "id long, a string, s long, q long")
    pairs = adjacency.adjacent_positional(p, "s", ["q"], "a")
    assert rows(pmi.pmi_edges(pairs, p, "a")) == [("A", "B", 2, 2.0)]


def test_pmi_is_directed_and_filtered(spark):
    e = spark.createDataFrame([("a", "b", 2, 1.0), ("b", "a", 1, 3.0), ("c", "d", 5, -0.5)], "source string, target string, raw_count long, pmi double")
    assert rows(pmi.strong_edges(e), "source") == [("a",)]
    c = spark.createDataFrame([("a",)], "center string")
    assert rows(pmi.top_neighbors(e, c, 1), "neighbor", "pmi") == [("b", 3.0)]


def test_heat_ends_and_zero_maximum(spark):
    e = spark.createDataFrame([(1, 2, 4, 1.0), (1, 3, 2, 2.0), (5, 6, 0, 0.0)], "c long, n long, raw_count long, pmi double")
    by = lambda h: {(r["c"], r["n"]): r["weight"] for r in pmi.heat_neighbors(e, "c", "n", h).collect()}
    assert by(0.0) == {(1, 2): 1.0, (1, 3): 0.5, (5, 6): 0.0}
    assert by(1.0)[1, 3] == 1.0


def test_facet_pmi_sums_both_ways_and_binds_the_center(spark):
    data = [(1, 1, 1), (2, 1, 2), (1, 1, 3), (2, 2, 1), (1, 2, 2), (3, 3, 1), (4, 3, 2)]
    p = plays(spark, data)
    got = pmi.facet_pmi(p, spark.createDataFrame([(1,)], "center long"), month=3)
    r = got.collect()
    assert [(x["center"], x["neighbor"], x["raw_count"]) for x in r] == [(1, 2, 3)]
    assert math.isclose(r[0]["pmi"], round(math.log2((3 / 4) / ((3 / 7) * (2 / 7))), 4))
    assert pmi.facet_pmi(p, spark.createDataFrame([(1,)], "center long"), month=9).count() == 0


def test_node_stats(spark):
    d = spark.createDataFrame([(1, "x", "2004-02-01 00:00:00", 1, 1, 1, None), (2, "x", None, None, 0, 1, "jazz"), (3, "x", "2006-01-01 00:00:00", 2, 0, 2, "rock"), (4, None, None, 1, 1, 1, "pop")], "id long, a string, t string, dj long, f int, s long, g string")
    d = d.withColumn("t", d.t.cast("timestamp"))
    assert rows(stats.node_stats(d, "a", "t", "dj", "f", "s", "g")) == [("x", 3, 2004, 2006, 2, 1 / 3, 2, "jazz")]


def test_facet_totals_fill_with_zero(spark):
    p = spark.createDataFrame([(1, 1, 1, 1, 1, 3), (2, 2, 1, 2, 2, 4)], "id long, artist_id long, show_id long, dj_id long, sequence long, month int")
    assert rows(stats.facet_totals(p, "month")) == [(3, 1, 1), (4, 1, 0)]


def test_classifier_metrics_of_published_counts(spark):
    data = [(0.9, 1)] * 30 + [(0.9, 0)] * 244 + [(0.1, 0)] * 8
    m = stats.classifier_metrics(spark.createDataFrame(data, "s double, t int"), "s", "t", 0.5).first()
    assert (m["tp"], m["fp"], m["tn"], m["fn"]) == (30, 244, 8, 0)
    assert (round(m["precision"], 2), round(m["recall"], 2), round(m["f1"], 2)) == (0.11, 1.0, 0.20)
    none = stats.classifier_metrics(spark.createDataFrame([], "s double, t int"), "s", "t", 0.5).first()
    assert none["precision"] == 0.0 and none["tp"] == 0


def test_unambiguous_and_duplicates(spark):
    d = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 4)], "k string, id long")
    assert rows(stats.unambiguous(d, "k", "id")) == [("a", 1)]
    assert rows(stats.duplicate_groups(d, "k", "id")) == [("b", 2, [2, 3])]


def test_sessions_by_gap(spark):
    d = spark.createDataFrame([(1, 0), (1, 100), (1, 5000)], "u long, t long").selectExpr("u", "timestamp_seconds(t) as ts")
    assert [r[0] for r in adjacency.infer_sessions(d, "u", "ts", 600).orderBy("ts").select("session_no").collect()] == [1, 1, 2]
