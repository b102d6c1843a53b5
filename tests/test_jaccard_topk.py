import random
from itertools import combinations

from pyspark.sql import functions as F

from playgraph.operators import graph, sharing
from tests.util import rows


def test_best_jaccard_edges_are_found_in_blocks(spark, monkeypatch):
    r = random.Random(2)
    by = {n: frozenset(k for k in "abcdef" if r.random() < 0.35) for n in range(150)}
    f = spark.createDataFrame([(n, k) for n, ks in by.items() for k in ks], "n long, k string")
    for block, k in ((7, 3), (2048, 3), (7, 1), (2048, 200)):
        monkeypatch.setattr(sharing, "BLOCK", block)
        every = sharing.jaccard(f, "n", "k", None, 0.4).cache()
        want = graph.prune_topk(every, "a", "b", F.round("jaccard", 9), k)
        with monkeypatch.context() as m:
            m.setattr(sharing, "block_pairs", None)  # which gives all edges away
            got, before = sharing.jaccard_topk(f, "n", "k", None, 0.4, k)
            assert rows(got) == rows(want, "a", "b", "shared", "jaccard") and rows(before) == [(every.count(),)]
    assert sum(1 for x, y in combinations(by.values(), 2) if x & y and len(x & y) / len(x | y) >= 0.4) == every.count()
    kept, before = sharing.jaccard_topk(f.where("n < 0"), "n", "k", None, 0.4, 3)
    assert rows(kept) == [] and rows(before) == [(0,)]
