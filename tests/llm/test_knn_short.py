import random

import numpy as np

from playgraph.llm import knn
from tests.util import rows

DIM = 4


def test_vectors_of_few_decimals_are_moved_as_short_integers(spark, monkeypatch):
    r = random.Random(6)
    data = [(i, [round(r.random(), 4) for _ in range(DIM)]) for i in range(40)]
    held, cut = [], knn.cut

    def seen(df):
        held.append(cut(df))
        return held[-1]

    monkeypatch.setattr(knn, "cut", seen)

    def search(data):
        held.clear()
        f = spark.createDataFrame(data, "id long, v array<double>")
        return rows(knn.nearest_neighbors(f, "id", "v", 3, DIM), "vector_id", "neighbor_id", "rank")

    def brute(data):
        m = np.array([v for _, v in data])
        m = m / np.linalg.norm(m, axis=1, keepdims=True)
        sim = np.round(m @ m.T, 9)
        return sorted(((i, j, k + 1) for i in range(len(data)) for k, j in enumerate(sorted((j for j in range(len(data)) if j != i), key=lambda j: (-sim[i, j], j))[:3])), key=repr)

    assert search(data) == brute(data)
    assert not any(df.where("v is not null").count() for df in held if "v" in df.columns)
    # others are moved as they are, beside them
    mixed = [(i, [x / 3 for x in v] if i % 3 == 0 else [x * 10 for x in v] if i % 5 == 0 else v) for i, v in data]
    assert search(mixed) == brute(mixed)
