import numpy as np

from playgraph.llm import knn

DIM = 8


def brute(ids, m, k):
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    out = {}
    for i in range(len(ids)):
        s = np.round(u @ u[i], 9)
        order = sorted((-s[j], ids[j]) for j in range(len(ids)) if j != i)
        out[ids[i]] = [x for _, x in order[:k]]
    return out


def got(spark, data, k=5):
    df = spark.createDataFrame(data, "id long, vec array<double>")
    out = {}
    for r in knn.nearest_neighbors(df, "id", "vec", k, DIM).orderBy("vector_id", "rank").collect():
        out.setdefault(r["vector_id"], []).append(r["neighbor_id"])
    return out


def test_exact_with_clusters_copies_and_ties(spark, monkeypatch):
    monkeypatch.setattr(knn, "PER_CLUSTER", 20)
    monkeypatch.setattr(knn, "TILE_ROWS", 16)
    rng = np.random.default_rng(0)
    centers = rng.random((12, DIM))
    m = np.round(np.abs(centers[rng.integers(0, 12, 260)] + rng.normal(0, 0.05, (260, DIM))), 3) + 0.001
    m[100:180] = m[0]  # a group of copies: almost a third of all rows
    m[180:190] = m[1] * 2  # the same direction, another length
    ids = list(rng.permutation(1000)[:260])
    ids = [int(i) for i in ids]
    assert got(spark, list(zip(ids, m.tolist()))) == brute(ids, m, 5)


def test_unusable_vectors_do_not_take_part(spark):
    ok = [1.0] * DIM
    bad = [None, [], [0.0] * DIM, [1.0] * (DIM - 1), [float("nan")] + ok[1:], [float("inf")] + ok[1:], [None] + ok[1:]]
    data = [(i, b) for i, b in enumerate(bad)] + [(None, ok), (20, ok), (21, [2.0] * DIM), (22, [1.0] * (DIM - 1) + [5.0])]
    assert got(spark, data) == {20: [21, 22], 21: [20, 22], 22: [20, 21]}
    assert got(spark, []) == {}
    assert got(spark, data[:3]) == {}


def test_tile_bounds_hold_for_one_tile():
    rng = np.random.default_rng(3)
    u = rng.random((300, DIM))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    ids = np.arange(300)
    top = knn.tile_top(ids, u, ids, u, u.mean(axis=0), 4)
    assert {i: g["other"].tolist() for i, g in top.groupby("id")} == brute(list(range(300)), u, 4)
