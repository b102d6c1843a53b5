import random

import pytest

from playgraph.llm import topn
from tests.util import rows

SCHEMA = "source_id long, target_id long, pmi double, raw_count long"


def brute(data, n):
    best = {}
    for s, t, p, c in data:
        if s is None or t is None or p is None or p != p:
            continue
        k = (p, c if c is not None else -(2**63))
        best[s, t] = max(best.get((s, t), k), k)
    out = []
    for s in {s for s, _ in best}:
        mine = sorted(((-p, -c, t) for (x, t), (p, c) in best.items() if x == s))
        out += [(s, t) for _, _, t in mine[:n]]
    return sorted(out, key=repr)


def top(spark, data, n=3, parts=4):
    return topn.top_n_per_group(spark.createDataFrame(data, SCHEMA).repartition(parts), "source_id", "target_id", "pmi", "raw_count", n)


def test_against_brute_force_with_a_hot_group_ties_and_repeats(spark):
    r = random.Random(1)
    data = [(1 if r.random() < 0.4 else r.randrange(40), r.randrange(60), round(r.random() * 3) / 3, r.choice([1, 2, None])) for _ in range(4000)]
    data += data[:200]
    assert rows(top(spark, data), "source_id", "target_id") == brute(data, 3)


def test_small_chunks_keep_the_result(spark, monkeypatch):
    r = random.Random(2)
    data = [(r.randrange(3), r.randrange(500), r.random(), 1) for _ in range(3000)]
    monkeypatch.setattr(topn, "CHUNK_ROWS", 128)
    assert rows(top(spark, data, 10), "source_id", "target_id") == brute(data, 10)


def test_defined_cases(spark):
    data = [(None, 1, 1.0, 1), (1, None, 1.0, 1), (1, 2, None, 1), (1, 3, float("nan"), 1), (1, 4, 0.5, None), (1, 5, 0.5, 0), (1, 6, -1.0, 9)]
    got = [(r["target_id"], r["raw_count"], r["rank"]) for r in top(spark, data, 5).orderBy("rank").collect()]
    assert got == [(5, 0, 1), (4, None, 2), (6, 9, 3)]
    assert rows(top(spark, [])) == []
    clash = spark.createDataFrame([(1, 2, 1.0, 1, 7, True)], SCHEMA + ", _g long, _bound boolean")
    assert topn.top_n_per_group(clash, "source_id", "target_id", "pmi", "raw_count").count() == 1
    with pytest.raises(ValueError):
        top(spark, data, 0)
