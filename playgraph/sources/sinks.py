"""Sinks: ids, edge tables, graph files, staged publishing behind a gate."""

from __future__ import annotations

import json
import os
import uuid
from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def assign_ids(names: DataFrame, name: str, existing: DataFrame | None = None) -> DataFrame:
    """SNK-01, SNK-02: (id, name): stable ids of ``existing`` (id, name), new names numbered after its largest in name order.
    Numbers come from ranges: names are range-partitioned, counted per partition and numbered within, so no single task sorts
    all names."""
    from playgraph.session import cut

    n = names.select(F.col(name).alias("name")).where("name is not null").distinct()
    start = 0
    if existing is not None:
        n = n.join(existing.select("name"), "name", "left_anti")
        start = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    r = cut(n.repartitionByRange("name").withColumn("p", F.spark_partition_id()))
    sizes = {x["p"]: x["c"] for x in r.groupBy("p").agg(F.count("*").alias("c")).collect()}  # a row a partition
    before, run = {}, start
    for p in sorted(sizes):
        before[p], run = run, run + sizes[p]
    if not before:
        new = n.select(F.lit(None).cast("long").alias("id"), "name").limit(0)
    else:
        base = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[F.col("p")]
        new = r.withColumn("id", (base + F.row_number().over(Window.partitionBy("p").orderBy("name"))).cast("long")).select("id", "name")
    return new if existing is None else existing.select("id", "name").unionByName(new)


def edges_by_id(edges: DataFrame, ids: DataFrame, a: str = "source", b: str = "target") -> DataFrame:
    """SNK-04: edge names as ids: exact, else by lower case (the smallest id of a lower-case name); unknown ends go."""
    low = ids.groupBy(F.lower("name").alias("low")).agg(F.min("id").alias("lid"))
    out = edges
    for c in (a, b):
        x = ids.select(F.col("name").alias(c), F.col("id").alias(f"_{c}"))
        y = low.select(F.col("low").alias(f"_low_{c}"), F.col("lid").alias(f"_l_{c}"))
        out = out.join(x, c, "left").withColumn(f"_low_{c}", F.lower(c)).join(y, f"_low_{c}", "left").drop(f"_low_{c}")
        out = out.withColumn(f"{c}_id", F.coalesce(f"_{c}", f"_l_{c}")).drop(f"_{c}", f"_l_{c}")
    return out.where(F.col(f"{a}_id").isNotNull() & F.col(f"{b}_id").isNotNull())


def insert_edges(edges: DataFrame, ids: DataFrame, min_count: int = 2) -> DataFrame:
    """SNK-03: edges of at least ``min_count`` and positive pmi by id, one row a pair (that of the highest count)."""
    e = edges_by_id(edges.where((F.col("raw_count") >= min_count) & (F.col("pmi") > 0)), ids)
    return e.groupBy("source_id", "target_id").agg(F.max(F.struct("raw_count", "pmi")).alias("x")).select("source_id", "target_id", "x.raw_count", "x.pmi")


def write_tables(tables: dict[str, DataFrame], path: str, partition_by: dict[str, list[str]] | None = None) -> None:
    """SNK-05, SNK-07, DML-07: each table overwritten under ``path``; tables not named stay."""
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        cols = (partition_by or {}).get(name)
        (w.partitionBy(*cols) if cols else w).parquet(os.path.join(path, f"{name}.parquet"))


class Publisher:
    """SNK-08: versions of a set of tables in a folder; readers follow the newest pointer file, made only after all is written. A failed
    build leaves the old version in place; ``clean`` removes versions that nothing points to."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _pointers(self) -> list[str]:
        """Names of the pointers, oldest first: CURRENT-<number>-<version>."""
        if not self._fs.exists(self._path(self.root)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return sorted((n for n in names if n.startswith("CURRENT-")), key=lambda n: (int(n.split("-")[1]), n))

    def current(self) -> str | None:
        found = self._pointers()
        return found[-1].split("-", 2)[2] if found else None

    def publish(self, tables: dict[str, DataFrame], gate=None) -> str:
        version = f"v-{uuid.uuid4().hex[:12]}"
        at = f"{self.root}/{version}"
        try:
            write_tables(tables, at)
            if gate is not None:
                gate(self.spark, at)
        except Exception:
            self._fs.delete(self._path(at), True)
            raise
        found = self._pointers()
        number = int(found[-1].split("-")[1]) + 1 if found else 1
        # one new file is one step: a reader sees the old pointer or the new one, never none
        self._fs.create(self._path(f"{self.root}/CURRENT-{number}-{version}"), False).close()
        for name in found:
            self._fs.delete(self._path(f"{self.root}/{name}"), False)
        return version

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self.current()}/{name}.parquet")

    def clean(self) -> int:
        keep, n = self.current(), 0
        for s in self._fs.listStatus(self._path(self.root)):
            name = s.getPath().getName()
            if name.startswith("v-") and name != keep:
                self._fs.delete(s.getPath(), True)
                n += 1
        return n


def validation_gate(counts: DataFrame, baseline: DataFrame, frac: float = 0.5, min_rows: dict[str, int] | None = None) -> DataFrame:
    """SNK-09: per table that had rows in the baseline, or for which a minimum is stated: rows now, the floor max(1,
    int(baseline * frac)) or the stated minimum if larger, and whether it holds; a missing table has 0 rows."""
    least = F.create_map(*[F.lit(x) for kv in (min_rows or {"": 0}).items() for x in kv])[F.col("table")]
    j = baseline.select("table", F.col("rows").alias("seed")).join(counts.select("table", "rows"), "table", "left").na.fill(0, ["rows"])
    j = j.where((F.col("seed") > 0) | (F.coalesce(least, F.lit(0)) > 0))
    floor = F.greatest(F.lit(1), F.floor(F.col("seed") * frac), F.coalesce(least, F.lit(0))).cast("long")
    return j.withColumn("floor", floor).withColumn("ok", F.col("rows") >= floor)


def enforce(gate: DataFrame) -> None:
    bad = [r["table"] for r in gate.where("not ok").select("table").collect()]
    if bad:
        raise ValueError(f"too few rows: {', '.join(sorted(bad))}")


def write_gexf(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """SNK-06: a graph file of nodes (id, label) and edges (source, target, weight), streamed row by row to one writer."""
    with open(path, "w", encoding="utf-8") as f:
        f.write('<?xml version="1.0" encoding="UTF-8"?>\n<gexf xmlns="http://www.gexf.net/1.2draft" version="1.2">\n<graph defaultedgetype="undirected">\n<nodes>\n')
        for r in nodes.select("id", "label").toLocalIterator():
            f.write(f'<node id={quoteattr(str(r["id"]))} label={quoteattr(str(r["label"]))}/>\n')
        f.write("</nodes>\n<edges>\n")
        for i, r in enumerate(edges.select("source", "target", "weight").toLocalIterator()):
            f.write(f'<edge id="{i}" source={quoteattr(str(r["source"]))} target={quoteattr(str(r["target"]))} weight="{r["weight"]}"/>\n')
        f.write("</edges>\n</graph>\n</gexf>\n")


def write_reports(df: DataFrame, path: str, kind: str = "csv") -> None:
    """SNK-10."""
    (df.write.mode("overwrite").option("header", "true").csv(path) if kind == "csv" else df.write.mode("overwrite").json(path))


def json_detail(keys) -> str:
    """JSN-01 at the export edge."""
    return json.dumps(list(keys), ensure_ascii=False)
