"""Items that appear together (problem 3): an incremental, hash-bucketed pair table."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playgraph.session import cut, shared_dir


def basket_pairs(rows: DataFrame, window: int) -> DataFrame:
    """Distinct (basket, a, b), a < b, of items whose positions in the basket differ by at most ``window``.

    Positions are cut into bins of ``window`` + 1; a row meets its own bin and the one before, so the join key is
    (basket, bin): a basket holding any share of all rows is spread over as many tasks as it has bins."""
    size = window + 1
    d = rows.where("basket is not null and item is not null and pos is not null").select("basket", "item", "pos").distinct()
    left = d.withColumn("bin", F.floor(F.col("pos") / size))
    right = d.select(
        "basket",
        F.col("item").alias("item2"),
        F.col("pos").alias("pos2"),
        F.explode(F.array(F.floor(F.col("pos") / size), F.floor(F.col("pos") / size) - 1)).alias("bin"),
    )
    near = left.join(right, ["basket", "bin"]).where(
        (F.col("item") != F.col("item2"))
        & F.col("pos2").between(F.col("pos"), F.col("pos") + window)
        & ((F.col("pos2") > F.col("pos")) | (F.col("item") < F.col("item2")))
    )
    return near.select("basket", F.least("item", "item2").alias("a"), F.greatest("item", "item2").alias("b")).distinct()


class PairTable:
    """Counts of baskets two items share, of baskets an item is in, and of baskets, kept as Parquet under ``path``.

    ``apply`` takes the rows of the changed baskets as they were (``old``) and as they are now (``new``); both emit signed
    deltas, which are merged into the counts, so the table always equals one built from all present baskets at once. Counts lie
    in hash buckets of the pair (and of the item); a merge reads and rewrites only the buckets its deltas touch. A manifest
    names each bucket's folder; it is written last and under a new number, so a lost executor or a failed merge leaves the
    table as it was, and a table opened on an existing path goes on from its newest manifest. Folders that neither the newest
    manifest nor the one before it names are removed.

    Defined cases: a null basket does not count; a row with a null item counts its basket only; a row with a null position
    counts for its item and basket, but is near nothing; repeated rows count once; an item is never paired with itself; empty
    deltas change nothing; further columns are ignored. Window and number of buckets are those the table was made with."""

    def __init__(self, spark: SparkSession, path: str | None = None, window: int = 3, buckets: int = 16):
        self.spark, self.window, self.buckets = spark, window, buckets
        self.path = path or f"{shared_dir(spark)}/pair-table-{uuid.uuid4().hex}"
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.version, self.at = 0, {"pairs": {}, "marks": {}}
        if numbers := self._manifests():
            self.version = numbers[-1]
            held = self._manifest(self.version)
            self.window, self.buckets, self.at = held["window"], held["buckets"], held["at"]

    def _manifests(self) -> list[int]:
        if not self._fs.exists(self._hadoop(self.path)):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(self._hadoop(self.path))]
        return sorted(int(n.removeprefix("manifest-")) for n in names if n.startswith("manifest-"))

    def _manifest(self, number: int) -> dict:
        return json.loads("".join(r["value"] for r in self.spark.read.text(f"{self.path}/manifest-{number}").collect()))

    def _rows(self, df: DataFrame, basket: str, item: str, pos: str) -> DataFrame:
        return df.select(F.col(basket).alias("basket"), F.col(item).alias("item"), F.col(pos).alias("pos")).where("basket is not null")

    def _read(self, name: str, schema: str, buckets: set[str] | None = None) -> DataFrame:
        at = [f"{self.path}/{p}" for b, p in self.at[name].items() if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*at) if at else self.spark.createDataFrame([], schema)

    def _merge(self, name: str, keys: list[str], deltas: DataFrame, to: int) -> dict[str, str]:
        """The buckets of ``name`` after the deltas (keys, n) came in; those untouched keep their folders."""
        schema = ", ".join(f"{k} long" for k in [*keys, "n"])
        bucket = F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int").alias("bucket")
        touched = None
        if self.at[name]:
            deltas = cut(deltas.groupBy(*keys).agg(F.sum("n").alias("n")).where("n <> 0"))
            touched = {str(r["bucket"]) for r in deltas.select(bucket).distinct().collect()}  # at most as many as buckets
            deltas = deltas.unionByName(self._read(name, schema, touched))
        merged = deltas.groupBy(*keys).agg(F.sum("n").alias("n")).where("n <> 0").select(*keys, "n", bucket)
        folder = f"{name}/v{to}-{uuid.uuid4().hex[:8]}"
        if touched is None or touched:
            merged.write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        kept = {} if touched is None else {b: p for b, p in self.at[name].items() if b not in touched}
        here = self._hadoop(f"{self.path}/{folder}")
        found = [x.getPath().getName() for x in self._fs.listStatus(here)] if self._fs.exists(here) else []
        return kept | {n.removeprefix("bucket="): f"{folder}/{n}" for n in found if n.startswith("bucket=")}

    def apply(self, new: DataFrame, old: DataFrame | None = None, basket: str = "basket", item: str = "item", pos: str = "pos") -> PairTable:
        signed = [(self._rows(new, basket, item, pos), 1)] + ([(self._rows(old, basket, item, pos), -1)] if old is not None else [])
        pairs = marks = None
        for rows, sign in signed:
            # the pre-aggregated signed deltas of one side
            p = basket_pairs(rows, self.window).groupBy("a", "b").agg((F.count("*") * sign).alias("n"))
            member = rows.select("basket", "item").distinct()
            m = member.where("item is not null").groupBy("item").agg((F.count("*") * sign).alias("n"))
            # the basket count, as the item null
            m = m.unionByName(member.select("basket").distinct().agg((F.count("*") * sign).alias("n")).select(F.lit(None).cast("long").alias("item"), "n"))
            pairs = p if pairs is None else pairs.unionByName(p)
            marks = m if marks is None else marks.unionByName(m)
        to = self.version + 1
        at = {"pairs": self._merge("pairs", ["a", "b"], pairs, to), "marks": self._merge("marks", ["item"], marks, to)}
        before = self.at
        tmp, final = self._hadoop(f"{self.path}/.manifest-{uuid.uuid4().hex}"), self._hadoop(f"{self.path}/manifest-{to}")
        out = self._fs.create(tmp, False)
        out.write(bytearray(json.dumps({"window": self.window, "buckets": self.buckets, "at": at}).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(tmp, final):
            raise RuntimeError(f"another merge has written version {to} of {self.path}")
        self.version, self.at = to, at
        self._clean(before)
        return self

    def _clean(self, before: dict[str, dict[str, str]]) -> None:
        """Remove what neither this version nor the one before it names."""
        named = {p for at in (self.at, before) for x in at.values() for p in x.values()}
        for number in self._manifests()[:-2]:
            for x in self._manifest(number)["at"].values():
                for p in x.values():
                    if p not in named:
                        self._fs.delete(self._hadoop(f"{self.path}/{p}"), True)
            self._fs.delete(self._hadoop(f"{self.path}/manifest-{number}"), False)

    def pairs(self) -> DataFrame:
        return self._read("pairs", "a long, b long, n long")

    def scores(self, min_together: int = 1, touched: DataFrame | None = None) -> DataFrame:
        """a, b, n_ab, n_a, n_b, n, lift = n_ab * n / (n_a * n_b). ``touched`` (item) restricts to pairs with such an item:
        the scores that a merge affected, while the basket count stands."""
        marks = self._read("marks", "item long, n long")
        total = marks.where("item is null").select(F.col("n").alias("n"))
        p = self.pairs().withColumnRenamed("n", "n_ab").where(f"n_ab >= {int(min_together)}")
        if touched is not None:
            t = touched.select(F.col("item").alias("t")).distinct()
            p = p.join(t, p.a == t.t, "left_semi").unionByName(p.join(t, p.b == t.t, "left_semi")).distinct()
        of = marks.where("item is not null")
        p = p.join(of.select(F.col("item").alias("a"), F.col("n").alias("n_a")), "a").join(of.select(F.col("item").alias("b"), F.col("n").alias("n_b")), "b")
        # one row: the number of baskets
        p = p.crossJoin(F.broadcast(total))
        return p.select("a", "b", "n_ab", "n_a", "n_b", "n", (F.col("n_ab") * F.col("n") / (F.col("n_a") * F.col("n_b"))).alias("lift"))
