import random
from itertools import combinations

import numpy as np
import pytest

from playgraph.llm import mixing, packing, tokens
from tests.util import rows


def test_sum_of_squares_rule_against_a_plain_version():
    r = random.Random(1)
    sizes, cap = [r.randrange(1, 21) for _ in range(400)], 20
    gaps, out = [], []
    for s in sizes:
        n = lambda g: gaps.count(g) if 0 < g < cap else 0
        best, at = 2 * n(cap - s) + 1 if s < cap else 0, None
        for g in sorted(set(x for x in gaps if x >= s)):
            cost = 1 - 2 * n(g) if g == s else 2 * (n(g - s) - n(g)) + 2
            if cost < best or (at is None and cost <= best):
                best, at = cost, g
        if at is None:
            gaps.append(cap - s)
        else:
            gaps[gaps.index(at)] = at - s
        out.append(sum(g * g for g in gaps))
    bins = packing.sum_of_squares(np.array(sizes), cap)
    fill = {}
    for b, s in zip(bins, sizes):
        fill[b] = fill.get(b, 0) + s
    assert max(fill.values()) <= cap
    assert sorted(cap - f for f in fill.values()) == sorted(gaps)


def test_pack_is_whole_full_and_splits_only_what_exceeds(spark):
    r = random.Random(2)
    sizes = [r.randrange(1, 300) for _ in range(3000)] + [0, None, 1250, 512]
    docs = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)], "doc_id long, n long, bin string")
    caps = spark.createDataFrame([("small", 512), ("large", 2048), ("none", None)], "container string, capacity int")
    got = [r.asDict() for r in packing.pack(docs, "doc_id", "n", caps, "container", "capacity", pieces_per_shard=1000).collect()]
    for name, cap in (("small", 512), ("large", 2048)):
        mine = [g for g in got if g["container"] == name]
        per, fill = {}, {}
        for g in mine:
            per[g["doc_id"]] = per.get(g["doc_id"], 0) + g["size"]
            if g["bin"] is not None:
                fill[g["bin"]] = fill.get(g["bin"], 0) + g["size"]
        assert per == {i: s or 0 for i, s in enumerate(sizes)}
        assert max(fill.values()) <= cap
        assert sum(fill.values()) / (len(fill) * cap) > 0.95
        pieces = {i: sum(g["doc_id"] == i for g in mine) for i in (3002, 3003)}
        assert pieces == ({3002: 3, 3003: 1} if cap == 512 else {3002: 1, 3003: 1})
    empty = spark.createDataFrame([], "doc_id long, n long")
    assert packing.pack(empty, "doc_id", "n", caps, "container", "capacity").count() == 0
    with pytest.raises(ValueError):
        packing.sum_of_squares(np.array([9]), 8)


def test_fit_budget_is_the_best_subset_sum():
    r = random.Random(3)
    for _ in range(60):
        docs = [r.randrange(1, 30) for _ in range(9)]
        lengths = sorted(set(docs))
        budget = r.randrange(0, 140)
        take = mixing.fit_budget(lengths, [docs.count(x) for x in lengths], budget)
        best = max((s for k in range(10) for s in (sum(c) for c in combinations(docs, k)) if s <= budget), default=0)
        assert sum(x * t for x, t in zip(lengths, take)) == best
        assert all(0 <= t <= docs.count(x) for x, t in zip(lengths, take))


def test_large_budgets_leave_a_small_part_to_the_exact_fit():
    lengths, counts = list(range(1, 2000)), [50] * 1999
    take = mixing.fit_budget(lengths, counts, 40_000_000, dp_tokens=5000)
    assert sum(x * t for x, t in zip(lengths, take)) == 40_000_000


def test_mix_reaches_its_shares(spark):
    r = random.Random(4)
    src = ["web"] * 900 + ["wiki"] * 60 + ["mail"] * 40
    docs = spark.createDataFrame([(i, s, r.randrange(5, 60), 1.0) for i, s in enumerate(src)] + [(9990, "web", 0, 1.0), (9991, None, 5, 1.0), (9992, "stray", 5, 1.0), (9993, "web", None, 1.0)], "doc_id long, source string, n long, share double")
    target = spark.createDataFrame([("web", 0.5, 1), ("wiki", 0.3, 4), ("mail", 0.1, None), ("gone", 0.1, 2), ("wiki", 0.2, 4), (None, 0.3, 1)], "source string, target_share double, max_repeat int")
    sel, shares = mixing.mix(docs, "doc_id", "source", "n", target, seed=1)
    s = {x["source"]: x for x in shares.collect()}
    assert set(s) == {"web", "wiki", "mail", "gone"} and s["gone"]["tokens"] == 0
    for name, want in (("web", 0.5 / 0.9), ("wiki", 0.3 / 0.9), ("mail", 0.1 / 0.9)):
        assert abs(s[name]["actual_share"] - want) < 0.002
    got = sel.collect()
    assert all(1 <= x["repeats"] <= {"web": 1, "wiki": 4, "mail": 1}[x["source"]] for x in got)
    assert len({x["doc_id"] for x in got}) == len(got)
    again, _ = mixing.mix(docs.repartition(7), "doc_id", "source", "n", target, seed=1)
    assert rows(again) == rows(sel)
    none, share0 = mixing.mix(docs.limit(0), "doc_id", "source", "n", target)
    assert none.count() == 0 and all(x["tokens"] == 0 for x in share0.collect())


def test_token_counts(spark):
    df = spark.createDataFrame([("hello world",), ("",), (None,), ("é" * 5000,)], "t string")
    n = [r["n"] for r in df.select(tokens.n_tokens(df.t).alias("n")).collect()]
    assert n[0] == 2 and n[1:3] == [0, 0] and n[3] > 1000
