from pyspark.sql import functions as F

from playgraph.operators import sharing
from tests.util import rows


def test_units_of_a_hub_key_are_moved_a_bounded_number_of_times(spark, monkeypatch):
    monkeypatch.setattr(sharing, "SALT_UNITS", 2)
    monkeypatch.setattr(sharing, "MAX_SALTS", 3)
    at = spark.range(40).select(F.col("id").alias("unit"), F.array("id", F.lit(0)).alias("kids"), F.lit(0).alias("kid"))
    left, right = (sharing._unit_cells(at, end) for end in "ab")
    assert left.count() == right.count() == 3 * 40
    met = left.join(right, ["kid", "p", "q"]).select("ua", "ub")
    assert rows(met) == sorted(((a, b) for a in range(40) for b in range(40)), key=repr)
