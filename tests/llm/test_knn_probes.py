import numpy as np

from playgraph.llm import knn
from tests.llm.test_knn import DIM, brute, got


def test_vectors_far_from_their_own_tile_see_the_nearest_tiles_first(spark, monkeypatch):
    for name, value in (("PER_CLUSTER", 10), ("TILE_ROWS", 8), ("PROBES", 3), ("TASK_ROWS", 64), ("BROADCAST_ROWS", 0)):
        monkeypatch.setattr(knn, name, value)
    held, cut = [], knn.cut

    def seen(df):
        held.append(cut(df))
        return held[-1]

    monkeypatch.setattr(knn, "cut", seen)
    rng = np.random.default_rng(5)
    m = np.round(np.repeat(rng.random((40, DIM)), 7, axis=0) + rng.normal(0, 0.003, (280, DIM)), 4)
    m = np.concatenate([m, rng.random((20, DIM)), m[:12]])  # strays of many decimals, and copies
    ids = [int(i) for i in rng.permutation(1000)[: len(m)]]
    assert got(spark, list(zip(ids, m.tolist()))) == brute(ids, m, 5)
    states = [[(r["open"], len(r["tiles"])) for r in df.collect()] for df in held if "open" in df.columns]
    assert len(states) == 2
    assert all(n == 3 for first, n in states[0] if first) and not any(first for first, _ in states[1])
    # of 39 tiles or more a vector; without the nearest ones first, a stray or one cut off from its group sees nearly all
    assert 0 < len(states[1]) and np.mean([n for _, n in states[1]]) < 20
