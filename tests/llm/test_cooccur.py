import random
from collections import Counter
from itertools import combinations

from playgraph.llm.cooccur import PairTable, basket_pairs
from tests.util import rows

SCHEMA = "basket long, item long, pos long"


def brute(data, window):
    pairs, items, baskets = Counter(), Counter(), set()
    by = {}
    for b, i, p in data:
        if b is None:
            continue
        baskets.add(b)
        by.setdefault(b, set()).add((i, p))
    for b, s in by.items():
        for i in {i for i, _ in s if i is not None}:
            items[i] += 1
        got = {(min(i, j), max(i, j)) for (i, p), (j, q) in combinations([x for x in s if None not in x], 2) if i != j and abs(p - q) <= window}
        pairs.update(got)
    return pairs, items, len(baskets)


def scored(t):
    return {(r["a"], r["b"]): (r["n_ab"], r["n_a"], r["n_b"], r["n"]) for r in t.scores().collect()}


def expected(data, window):
    p, i, n = brute(data, window)
    return {k: (c, i[k[0]], i[k[1]], n) for k, c in p.items()}


def draw(seed, n=600):
    r = random.Random(seed)
    return [(r.choice([1, r.randrange(30), None]), r.choice([r.randrange(12), r.randrange(12), None]), r.choice([r.randrange(-4, 12), r.randrange(12), None])) for _ in range(n)]


def test_pairs_against_brute_force(spark):
    data = draw(1)
    got = Counter((r["a"], r["b"]) for r in basket_pairs(spark.createDataFrame(data, SCHEMA), 3).collect())
    assert got == brute(data, 3)[0]


def test_increments_equal_a_rebuild(spark, tmp_path):
    first, extra = draw(2), draw(3, 200)
    changed = {b for b, _, _ in extra}
    now = [x for x in first if x[0] not in changed] + [x for x in first if x[0] in changed and hash(x) % 3] + extra
    t = PairTable(spark, f"file://{tmp_path}/t").apply(spark.createDataFrame(first, SCHEMA))
    assert scored(t) == expected(first, 3)
    t.apply(spark.createDataFrame([x for x in now if x[0] in changed], SCHEMA), old=spark.createDataFrame([x for x in first if x[0] in changed], SCHEMA))
    assert scored(t) == expected(now, 3)


def test_removing_everything_and_empty_deltas(spark, tmp_path):
    data = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], SCHEMA)
    none = spark.createDataFrame([], SCHEMA)
    t = PairTable(spark, f"file://{tmp_path}/t").apply(data)
    t.apply(none)
    assert len(scored(t)) == 1
    t.apply(none, old=data)
    assert scored(t) == {}
    assert PairTable(spark, f"file://{tmp_path}/e").apply(none).scores().count() == 0


def test_touched_scores_and_other_column_names(spark, tmp_path):
    d = spark.createDataFrame([(1, 1, 1, 5), (1, 2, 2, 5), (1, 3, 3, 5)], "b long, i long, p long, n long")
    t = PairTable(spark, f"file://{tmp_path}/t").apply(d, basket="b", item="i", pos="p")
    got = t.scores(touched=spark.createDataFrame([(3,)], "item long"))
    assert rows(got, "a", "b") == [(1, 3), (2, 3)]


def test_a_table_goes_on_where_another_left_it(spark, tmp_path):
    first, extra = draw(4), [(b, 100 + i, i) for b in (50, 51) for i in range(3)]
    path = f"file://{tmp_path}/t"
    PairTable(spark, path, window=2, buckets=64).apply(spark.createDataFrame(first, SCHEMA))
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "t" / "pairs").rglob("*.parquet")}
    t = PairTable(spark, path)
    assert (t.window, t.buckets, t.version) == (2, 64, 1) and scored(t) == expected(first, 2)
    t.apply(spark.createDataFrame(extra, SCHEMA))
    assert scored(PairTable(spark, path)) == expected(first + extra, 2)
    # three new pairs touch at most three buckets: the other buckets' files are the same, and still in use
    kept = [p for p in t.at["pairs"].values() if p.startswith("pairs/v1-")]
    assert len(kept) >= len({p.parent for p in files}) - 3 and all(p.stat().st_mtime_ns == at for p, at in files.items())
    assert all(p.startswith(("pairs/v1-", "pairs/v2-")) for p in t.at["pairs"].values())
    for _ in range(3):
        t.apply(spark.createDataFrame(extra[:3], SCHEMA), old=spark.createDataFrame(extra[:3], SCHEMA))
    assert len(t._manifests()) == 2 and scored(PairTable(spark, path)) == expected(first + extra, 2)
