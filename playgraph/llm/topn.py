"""Top N items within every group (problem 5), by partition lower bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows a task holds at once while it looks for its local bounds.
CHUNK_ROWS = 262_144
_LOW = -(2**63)


def _local_best(n: int):
    """Per partition: keep each group's N best distinct items; the N-th carries ``bound`` = true, as it is a lower bound of
    the group's true N-th best. State is folded every CHUNK_ROWS rows, so memory is bounded for any partition size."""

    def fold(cols: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        g, t, s, c = cols
        order = np.lexsort((-c.astype(np.float64), -s, t, g))  # the best row of a pair first
        g, t, s, c = (x[order] for x in (g, t, s, c))
        first = np.ones(len(g), bool)
        first[1:] = (g[1:] != g[:-1]) | (t[1:] != t[:-1])
        g, t, s, c = (x[first] for x in (g, t, s, c))
        order = np.lexsort((t, np.bitwise_not(c), -s, g))  # ~c descends exactly where -c could overflow
        g, t, s, c = (x[order] for x in (g, t, s, c))
        starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.array([], int)
        rank = np.arange(len(g)) - np.repeat(starts, np.diff(np.r_[starts, len(g)]))
        keep = rank < n
        return [x[keep] for x in (g, t, s, c)], rank[keep] == n - 1

    def out(cols: list[np.ndarray], bound: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(bound)], names=["_g", "_t", "_s", "_c", "_bound"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0
        for b in batches:
            held.append([b.column(i).to_numpy(zero_copy_only=False) for i in range(4)])
            rows += b.num_rows
            if rows >= CHUNK_ROWS:
                cols, bound = fold([np.concatenate(x) for x in zip(*held)])
                if len(bound) > CHUNK_ROWS // 2:  # many small groups: hand them on, start anew
                    yield out(cols, bound)
                    held, rows = [], 0
                else:
                    held, rows = [cols], len(bound)
        if held:
            yield out(*fold([np.concatenate(x) for x in zip(*held)]))

    return run


def top_n_per_group(df: DataFrame, group: str, item: str, score: str, count: str, n: int = 10) -> DataFrame:
    """The first ``n`` items of every group by ``score`` desc, ``count`` desc, ``item`` asc. Returns group, item, score, count,
    ``rank`` (1..n). ``group``, ``item`` and ``count`` are integer columns, ``score`` a double.

    Method: each partition finds its own N-th best distinct item per group, which bounds the group's true N-th best from
    below; the largest bound per group meets the partitions' survivors on the one exchange by group, rows under it go, and
    what is left is ranked. A group holding any share of all rows sends at most N rows per task chunk through the shuffle.

    Defined cases: a null or NaN score, a null group or a null item does not count; a null count ranks below any number; of
    several rows for one (group, item) the highest (score, count) stands; equal scores go by count, then the smaller item, so
    the result is a total order; a group with fewer than ``n`` items keeps all; empty input gives an empty result; other
    columns, whatever their names, are ignored."""
    if n < 1:
        raise ValueError("n must be at least 1")
    kept = df.select(
        F.col(group).cast("long").alias("_g"),
        F.col(item).cast("long").alias("_t"),
        F.col(score).cast("double").alias("_s"),
        F.coalesce(F.col(count).cast("long"), F.lit(_LOW)).alias("_c"),
    ).where("_g is not null and _t is not null and _s is not null and not isnan(_s)")
    local = kept.mapInArrow(_local_best(n), "_g long, _t long, _s double, _c long, _bound boolean")
    key = F.struct("_s", "_c", (-F.col("_t")).alias("_nt"))
    group_w = Window.partitionBy("_g")
    survivors = (
        local.withColumn("_key", key)
        .withColumn("_floor", F.max(F.when(F.col("_bound"), F.col("_key"))).over(group_w))
        .where("_floor is null or _key >= _floor")
    )
    best = survivors.groupBy("_g", "_t").agg(F.max(F.struct("_s", "_c")).alias("_b")).select("_g", "_t", "_b._s", "_b._c")
    ranked = best.withColumn("rank", F.row_number().over(group_w.orderBy(F.desc("_s"), F.desc("_c"), "_t"))).where(f"rank <= {n}")
    return ranked.select(
        F.col("_g").alias(group), F.col("_t").alias(item), F.col("_s").alias(score), F.when(F.col("_c") > _LOW, F.col("_c")).alias(count), "rank"
    )
