"""Filling fixed-capacity containers with items (problem 8): sum-of-squares packing in shards."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playgraph.session import cut as checkpointed

#: Pieces of one shard; each shard is packed by one task, and shards are even since a piece's shard is a hash of its id.
SHARD_PIECES = 20_000


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item, in the order given; items larger than ``capacity`` are an error.

    Let N(g) be the number of open containers with gap g. Each item goes where the sum of all N(g)^2 becomes smallest:
    into a gap g it changes the sum by 2 (N(g - s) - N(g)) + 2, into a new container by 2 N(capacity - s) + 1; a gap of 0 is
    closed and does not count. Ties go to the smallest gap, and to an open container before a new one."""
    if len(sizes) and (sizes.max() > capacity or sizes.min() < 1):
        raise ValueError("sizes must be in 1..capacity")
    n = np.zeros(capacity + 1, np.int64)
    open_at: dict[int, list[int]] = {}
    out = np.empty(len(sizes), np.int64)
    count = 0
    for i, s in enumerate(sizes.tolist()):
        gaps = np.flatnonzero(n[s:]) + s
        best, at = 2 * n[capacity - s] + 1 if s < capacity else 0, capacity
        if len(gaps):
            after = n[gaps - s]
            cost = 2 * (after - n[gaps]) + 2
            if gaps[0] == s:
                cost[0] = 1 - 2 * n[s]
            k = int(np.argmin(cost))
            if cost[k] <= best:
                at = int(gaps[k])
        if at == capacity:
            b, count = count, count + 1
        else:
            b = open_at[at].pop()
            n[at] -= 1
        left = at - s
        if left:
            n[left] += 1
            open_at.setdefault(left, []).append(b)
        out[i] = b
    return out


def pack(docs: DataFrame, id_col: str, size_col: str, capacities: DataFrame, name_col: str, capacity_col: str, pieces_per_shard: int = SHARD_PIECES) -> DataFrame:
    """container, capacity, doc_id, piece, start, size, bin: each document in containers of every capacity.

    A document is one piece unless it exceeds the capacity; then it is cut into pieces of the capacity and a rest, the full
    ones each filling a container of their own. The other pieces are packed by sum of squares, in a seeded random order, in
    shards of about ``pieces_per_shard`` pieces (a shard's end leaves a few containers partly open); ``bin`` is unique within
    a container kind. A single key of any size does not matter: shards are cut by a hash of id and piece.

    Defined cases: documents of null or no size have a row with a null bin; null ids are packed as well; equal ids are
    different pieces; a null or non-positive capacity packs nothing; extra columns are ignored; empty tables give an empty
    result."""
    # a handful of kinds of containers; every document is packed into each
    caps = [(r[name_col], int(r[capacity_col])) for r in capacities.select(name_col, capacity_col).distinct().collect() if r[capacity_col] and r[capacity_col] > 0]
    spark = docs.sparkSession
    schema = "container string, capacity int, doc_id long, piece int, start long, size long, bin string"
    if not caps:
        return spark.createDataFrame([], schema)
    kinds = F.explode(F.array(*[F.struct(F.lit(c).alias("container"), F.lit(k).alias("capacity")) for c, k in sorted(caps)])).alias("c")
    # written once: sizes are dear to find, and every kind of piece reads them
    base = checkpointed(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(size_col).cast("long"), F.lit(0)).alias("n")))
    each = base.select("doc_id", "n", kinds).select("doc_id", "n", "c.container", "c.capacity")
    cut = each.where("n > 0").withColumn("piece", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / F.col("capacity")).cast("int"))))
    start = (F.col("piece").cast("long") * F.col("capacity")).alias("start")
    cut = cut.select("container", "capacity", "doc_id", "piece", start, F.least(F.col("capacity").cast("long"), F.col("n") - F.col("piece").cast("long") * F.col("capacity")).alias("size"))
    none = each.where("n <= 0").select("container", "capacity", "doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("string").alias("bin"))
    # pieces of equal ids are numbered, so that names do not depend on how rows are spread
    full = cut.where("size = capacity").groupBy(*cut.columns).agg(F.count("*").alias("c")).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("c"))))
    filled = full.select(*cut.columns, F.concat_ws("-", F.lit("full"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "piece", "k").alias("bin"))
    rest = cut.where("size < capacity")
    shards = max(1, -(-base.where("n > 0").count() // pieces_per_shard))

    def shard(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        # seeded order: by a hash of id and piece, so that a result does not depend on how rows arrive
        f = f.sort_values(["h", "doc_id", "piece", "size"], kind="stable", na_position="last")
        capacity = int(f["capacity"].iloc[0])
        bins = sum_of_squares(f["size"].to_numpy(), capacity)
        return f.assign(bin=[f"{key[1]}-{b}" for b in bins])[["container", "capacity", "doc_id", "piece", "start", "size", "bin"]]

    h = F.xxhash64("doc_id", "piece", "container")
    salted = rest.withColumn("h", h).withColumn("shard", F.pmod(F.xxhash64("h", F.lit("shard")), F.lit(shards)))
    packed = salted.groupBy("container", "shard").applyInPandas(shard, schema)
    return packed.unionByName(filled.select(packed.columns)).unionByName(none)
