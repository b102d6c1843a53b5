import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from playgraph.operators import graph, identity, sharing
from tests.util import rows


def edges(spark, data, schema="a long, b long, w double"):
    return spark.createDataFrame(data, schema)


def test_shared_keys_cap_at_the_boundary(spark):
    f = spark.createDataFrame([(n, "k3") for n in (1, 2, 3)] + [(1, "k2"), (2, "k2"), (1, "k2"), (4, "lone")], "n long, k string")
    assert rows(sharing.shared_keys(f, "n", "k", 3)) == [(1, 2, 2, ["k2", "k3"]), (1, 3, 1, ["k3"]), (2, 3, 1, ["k3"])]
    assert rows(sharing.shared_keys(f, "n", "k", 2)) == [(1, 2, 1, ["k2"])]
    assert rows(sharing.shared_keys(f, "n", "k", 3, 2), "a", "b") == [(1, 2)]


def test_jaccard_leaves_frequent_keys_out_of_both(spark):
    f = spark.createDataFrame([(n, "hub") for n in range(1, 6)] + [(1, "x"), (2, "x"), (2, "y")], "n long, k string")
    assert rows(sharing.jaccard(f, "n", "k", 3, 0.1)) == [(1, 2, 1, 0.5)]


def test_hub_keys_are_whole_and_salts_and_blocks_change_nothing(spark, monkeypatch):
    r = random.Random(5)
    facts = [(n, k) for n in range(70) for k in "abcdefgh" if r.random() < 0.4] + [(n, "hub") for n in range(70)]
    f = spark.createDataFrame(facts, "n long, k string")
    by = {n: {k for m, k in facts if m == n} for n in range(70)}
    both = {(a, b): by[a] & by[b] for a, b in combinations(range(70), 2)}
    monkeypatch.setattr(sharing, "SALT_ROWS", 9)
    monkeypatch.setattr(sharing, "BLOCK", 16)
    assert rows(sharing.shared_keys(f, "n", "k")) == sorted(((a, b, len(k), sorted(k)) for (a, b), k in both.items() if k), key=repr)
    want = [(a, b, len(k), len(k) / len(by[a] | by[b])) for (a, b), k in both.items() if k and len(k) / len(by[a] | by[b]) >= 0.5]
    assert rows(sharing.jaccard(f, "n", "k", None, 0.5)) == sorted(want, key=repr)


def test_registered_queries_keep_keys_of_many_nodes(spark, tmp_path):
    from playgraph.config import PipelineConfig
    from playgraph.plans.registry import QUERIES

    n = 130
    spark.createDataFrame([(i, 1, s) for i in range(n) for s in (7, 8)], "artist_id long, dj_id long, show_id long").write.parquet(f"{tmp_path}/play.parquet")
    spark.createDataFrame([(f"n{i}", "one label") for i in range(n)], "artist_name string, label_name string").write.parquet(f"{tmp_path}/flowsheet_entry.parquet")
    spark.createDataFrame([(i, p) for i in range(n) for p in (1, 2)], "l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    pairs = n * (n - 1) // 2
    assert {q: QUERIES[q](spark, str(tmp_path)).count() for q in ("shared_style_jaccard", "label_family", "shared_personnel")} == dict.fromkeys(("shared_style_jaccard", "label_family", "shared_personnel"), pairs)
    assert rows(QUERIES["long_edges"](spark, str(tmp_path)), "type", "edges") == [("personnel", pairs), ("style", pairs)]
    assert PipelineConfig().max_shared_df is None


def test_prune_keeps_what_is_best_for_either_end(spark):
    e = edges(spark, [(1, 2, 1.0), (1, 3, 3.0), (1, 4, 2.0), (2, 4, 0.5)])
    assert rows(graph.prune_topk(e, "a", "b", F.col("w"), 1), "a", "b") == [(1, 2), (1, 3), (1, 4)]
    with pytest.raises(ValueError):
        graph.prune_topk(e, "a", "b", F.col("w"), 0)


def test_explain_takes_either_way_and_the_best_score(spark):
    e = graph.long_edges({"t": (edges(spark, [(1, 2, 1.0), (2, 1, 4.0)]), "a", "b", F.col("w"), True), "s": (edges(spark, [(1, 2, 0.5)]), "a", "b", F.col("w"), False)})
    p = spark.createDataFrame([(2, 1), (1, 9)], "x long, y long")
    assert rows(graph.explain_pair(e, p)) == [(2, 1, "s", 0.5), (2, 1, "t", 4.0)]


def test_affinity_of_one_center(spark):
    t = spark.createDataFrame([(1, 2, 10, 2.0), (3, 1, 5, 4.0)], "source_id long, target_id long, raw_count long, pmi double")
    r = spark.createDataFrame([(1, 2, "style", 0.5), (1, 4, "acoustic", 0.985)], "src long, dst long, type string, score double")
    got = graph.affinity(t, r, spark.createDataFrame([(1,)], "center long"))
    # transitions blend to .75 each, scaled to 1 and weighted 3; style 1; acoustic .5 scaled to 1, weighted 2
    assert [(x["neighbor"], x["affinity"]) for x in got.orderBy("rank").collect()] == [(2, 4.0), (3, 3.0), (4, 2.0)]


def test_adamic_adar_gate_and_two_hop(spark):
    e = edges(spark, [(1, 3, 1.0), (2, 3, 1.0), (1, 4, 1.0), (2, 4, 1.0), (4, 5, 1.0)])
    p = spark.createDataFrame([(1, 2)], "x long, y long")
    got = graph.adamic_adar(e, "a", "b", p)
    assert [(r["shared"], r["term"], r["rank"]) for r in got.orderBy("rank").collect()] == [(3, 1.443, 1), (4, 0.91, 2)]
    assert graph.adamic_adar(e, "a", "b", p, gate=3.0).count() == 0
    assert (1, 2) in rows(graph.two_hop(e, "a", "b", 0.8), "x", "y")


def test_two_hop_goes_through_hubs(spark, tmp_path, monkeypatch):
    from math import log

    from playgraph.plans.registry import QUERIES

    monkeypatch.setattr(sharing, "BLOCK", 16)
    # every pair of 65 nodes meets in four hubs of degree 65: together 0.96, nothing without them
    links = [(h, n) for h in (901, 902, 903, 904) for n in range(65)] + [(0, 1)]
    spark.createDataFrame([(a, b, 2, 1.0) for a, b in links], "source_id long, target_id long, raw_count long, pmi double").write.parquet(f"{tmp_path}/dj_transition.parquet")
    spark.createDataFrame([(i, f"n{i}") for i in {x for e in links for x in e}], "id long, canonical_name string").write.parquet(f"{tmp_path}/artist.parquet")
    got = rows(QUERIES["two_hop_no_edge"](spark, str(tmp_path)), "x", "y", "aa", "middles")
    hubs = [(901, 902), (901, 903), (901, 904), (902, 903), (902, 904), (903, 904)]
    want = [(x, y, round(4 / log(65), 6), 4) for x, y in combinations(range(65), 2) if (x, y) != (0, 1)] + [(x, y, round(63 / log(4) + 2 / log(5), 6), 65) for x, y in hubs]
    assert got == sorted(want, key=repr)


def test_pagerank_sums_to_one_and_ranks_the_sink_of_links(spark):
    e = edges(spark, [(1, 3, 1.0), (2, 3, 1.0), (3, 1, 1.0), (4, 3, 1.0)])
    pr = dict(rows(graph.pagerank(e, "a", "b", 30), "node", "pagerank"))
    assert abs(sum(pr.values()) - 1) < 1e-9 and max(pr, key=pr.get) == 3 and all(0 < x <= 1 for x in pr.values())


def brandes(links, nodes):
    """Exact betweenness by counting shortest paths over all pairs."""
    adj = {n: set() for n in nodes}
    for a, b in links:
        adj[a].add(b)
        adj[b].add(a)
    dist, cnt = {}, {}
    for s in nodes:
        d, c, level = {s: 0}, {s: 1}, [s]
        while level:
            nxt = []
            for u in level:
                for v in adj[u]:
                    if v not in d:
                        d[v], c[v] = d[u] + 1, 0
                        nxt.append(v)
                    if d[v] == d[u] + 1:
                        c[v] += c[u]
            level = nxt
        dist[s], cnt[s] = d, c
    n = len(nodes)
    out = dict.fromkeys(nodes, 0.0)
    for v in nodes:
        for s, t in combinations([x for x in nodes if x != v], 2):
            if t in dist[s] and v in dist[s] and t in dist[v] and dist[s][v] + dist[v][t] == dist[s][t]:
                out[v] += cnt[s][v] * cnt[v][t] / cnt[s][t]
    return {v: x * 2 / ((n - 1) * (n - 2)) for v, x in out.items()}


def test_betweenness_is_exact_with_all_sources(spark):
    r = random.Random(3)
    links = sorted({(a, b) for a, b in ((r.randrange(9), r.randrange(9)) for _ in range(14)) if a < b})
    nodes = sorted({x for e in links for x in e})
    got = dict(rows(graph.betweenness(edges(spark, [(a, b, 1.0) for a, b in links]), "a", "b", 100), "node", "betweenness"))
    want = brandes(links, nodes)
    assert all(abs(got[v] - want[v]) < 1e-9 for v in nodes)


def test_registered_betweenness_takes_all_sources_and_long_paths(spark, tmp_path):
    from playgraph.config import PipelineConfig
    from playgraph.plans.registry import QUERIES

    n = 68
    spark.createDataFrame([(i, i + 1, 2, 1.0) for i in range(n - 1)], "source_id long, target_id long, raw_count long, pmi double").write.parquet(f"{tmp_path}/dj_transition.parquet")
    got = dict(rows(QUERIES["betweenness"](spark, str(tmp_path)), "node", "betweenness"))
    assert all(abs(got[i] - i * (n - 1 - i) * 2 / ((n - 1) * (n - 2))) < 1e-9 for i in range(n))
    assert PipelineConfig().betweenness_sources == 2000


def test_betweenness_in_batches_is_the_same(spark):
    e = edges(spark, [(1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0), (2, 5, 1.0), (5, 4, 1.0), (4, 6, 1.0)])
    assert rows(graph.betweenness(e, "a", "b", batch=2)) == rows(graph.betweenness(e, "a", "b"))


def test_communities_split_two_cliques_and_repeat(spark):
    c1, c2 = list(combinations(range(1, 6), 2)), list(combinations(range(11, 15), 2))
    e = edges(spark, [(a, b, 3.0) for a, b in c1 + c2] + [(1, 11, 1.0)])
    lab = graph.communities(e, "a", "b", "w")
    got = dict(rows(lab, "node", "community"))
    assert {got[i] for i in range(1, 6)} == {0} and {got[i] for i in range(11, 15)} == {1}
    assert rows(lab) == rows(graph.communities(e, "a", "b", "w"))
    singles = lab.select("node", F.col("node").alias("community"))
    assert graph.modularity(e, "a", "b", "w", lab) > graph.modularity(e, "a", "b", "w", singles)


def test_degree_ceiling(spark):
    d = spark.createDataFrame([(i, i) for i in range(1, 21)], "node long, degree long")
    assert max(r[1] for r in rows(graph.degree_ceiling(d, 0.5))) == 11


def test_xrefs_drop_self_and_unknown(spark):
    codes = spark.createDataFrame([(1, "A"), (2, "B"), (3, "A")], "id long, name string")
    x = spark.createDataFrame([(1, 2, None), (1, 3, "same"), (1, 9, "gone")], "a long, b long, comment string")
    assert rows(identity.code_xrefs(x, codes)) == [("A", "B", "", "library_code")]


def test_bridge_fills_nulls_only_and_not_from_ambiguous_keys(spark):
    e = spark.createDataFrame([(1, "q1", None), (2, "q1", "old"), (3, "q2", None)], "id long, qid string, mb string")
    m = spark.createDataFrame([("q1", "m1"), ("q1", "m1"), ("q2", "m2"), ("q2", "m3")], "qid string, mb string")
    assert rows(identity.bridge_ids(e, m, "qid", "mb"), "id", "mb") == [(1, "m1"), (2, "old"), (3, None)]


def test_greedy_pairs_use_each_node_once(spark):
    p = spark.createDataFrame([(1, 1, 2), (2, 2, 3), (3, 3, 4), (4, 5, 6)], "ord long, x long, y long")
    assert graph.greedy_disjoint(p, 5).values.tolist() == [[1, 2], [3, 4], [5, 6]]
