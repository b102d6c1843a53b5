from playgraph.operators import identity
from tests.util import rows


def test_influences_are_not_shuffled_as_name_pairs(spark, monkeypatch):
    names = spark.createDataFrame([("Q1", "a"), ("Q10", "a"), ("Q2", "b"), ("Q2", "c"), ("Q2", "d"), ("Q3", "b"), (None, "e"), ("Q3", None)], "qid string, name string")
    pairs = spark.createDataFrame([("Q1", "Q2"), ("Q10", "Q2"), ("Q1", "Q3"), ("Q2", "Q2"), ("Q2", "Q2"), ("Q9", "Q2"), (None, "Q2")], "source_qid string, target_qid string")
    # the first by the text of both ids, in which Q10>Q2 comes before Q1>Q2
    want = [("a", x, "Q10", "Q2") for x in "bcd"] + [(x, y, "Q2", "Q2") for x in "bcd" for y in "bcd" if x != y]
    for size in (1000, 1):
        monkeypatch.setattr(identity, "UNIT_NAMES", size)
        e = identity.influence_edges(pairs, names)
        assert rows(e) == sorted(want)
    top = e._jdf.queryExecution().executedPlan().toString().split("Generate")[0]
    assert "Exchange" not in top and "Aggregate" not in top
