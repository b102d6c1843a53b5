import random

from pyspark.sql import functions as F

from playgraph.operators import sharing
from tests.util import rows


def test_pairs_of_shared_keys_are_not_shuffled(spark, monkeypatch):
    r = random.Random(4)
    facts = [(f"n{n}", k) for n in range(60) for k in ("a", "b", "É", "z z", "c") if r.random() < 0.3] + [("n1", "lone"), (None, "a"), ("n2", None), ("n3", "a"), ("n3", "a")]
    for f in (spark.createDataFrame(facts, "n string, k string"), spark.createDataFrame([(int(n[1:]), len(k) * 7) for n, k in facts if n and k], "n long, k long")):
        want = sharing.shared_keys(f, "n", "k").withColumn("keys", F.array_join(F.transform("keys", lambda k: k.cast("string")), "|"))
        want = rows(want, "a", "b", "shared", "keys")
        for nodes, units, items in ((500, 1000, 500_000), (2, 2, 0)):
            monkeypatch.setattr(sharing, "UNIT_NODES", nodes)
            monkeypatch.setattr(sharing, "SALT_UNITS", units)
            monkeypatch.setattr(sharing, "BROADCAST_ITEMS", items)
            got = sharing.shared_key_texts(f, "n", "k")
            assert rows(got) == want


def test_label_family_has_nothing_after_its_pairs(spark, tmp_path):
    from playgraph.plans.registry import QUERIES

    spark.createDataFrame([(f"n{i}", f"l{i % 3}") for i in range(9)], "artist_name string, label_name string").write.parquet(f"{tmp_path}/flowsheet_entry.parquet")
    q = QUERIES["label_family"](spark, str(tmp_path))
    assert "Exchange" not in q._jdf.queryExecution().executedPlan().toString().split("Generate")[0]
    assert rows(q) == sorted((f"n{i}", f"n{j}", 1, f"l{i % 3}") for i in range(9) for j in range(i + 1, 9) if i % 3 == j % 3)
