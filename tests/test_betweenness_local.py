import random

from playgraph.operators import graph
from tests.util import rows


def test_betweenness_goes_through_a_small_graph_in_place(spark, monkeypatch):
    r = random.Random(8)
    links = sorted({(a, b) for a, b in ((r.randrange(40), r.randrange(40)) for _ in range(60)) if a < b} | {(i, i + 1) for i in range(40, 90)})
    e = spark.createDataFrame([(a, b) for a, b in links], "a long, b long")
    monkeypatch.setattr(graph, "_dependencies", None)
    some, every = (rows(graph.betweenness(e, "a", "b", n)) for n in (30, 2000))
    monkeypatch.undo()
    monkeypatch.setattr(graph, "LOCAL_LINKS", 0)
    for got, want in ((some, rows(graph.betweenness(e, "a", "b", 30))), (every, rows(graph.betweenness(e, "a", "b")))):
        assert [x for x, _ in got] == [x for x, _ in want] and all(abs(x - y) < 1e-9 for (_, x), (_, y) in zip(got, want))
