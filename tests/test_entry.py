import re

import __spark_entry__ as entry


def test_registry_is_consistent():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 100
    assert all(re.fullmatch(r"\w+", n) for n in q)


def test_flagship_on_the_smallest_scale(spark):
    df = entry.entry(spark)
    assert df.columns == ["source", "target", "raw_count", "pmi"] and df.count() > 0
