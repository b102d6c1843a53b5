"""Most similar vectors for every vector (problem 2): an exact block matrix join in tiles of packed vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from playgraph.session import cut, release

#: The clusters that lay out the blocks are fitted on at most this many vectors; every vector is assigned, searched and found.
FIT_ROWS = 16_384
#: Vectors per cluster aimed at, and the most clusters (their centroids are broadcast: at most MAX_CLUSTERS x dim doubles).
PER_CLUSTER, MAX_CLUSTERS = 200, 4096
#: Rows of one tile; a larger cluster is cut into several tiles.
TILE_ROWS = 4096
#: Tiles that a vector goes to at once; one with more to see goes to the nearest of them first, which tells it how far to look.
PROBES = 12
#: Vectors of which all values are whole numbers of 1 / SCALE are moved as 2-byte integers, which loses nothing.
SCALE = 10_000
#: Rows of one task, about, and groups of equal vectors up to which they are broadcast.
TASK_ROWS, BROADCAST_ROWS = 50_000, 200_000
_SLACK = 2e-9  # similarities are compared after rounding to 9 decimals
_NEAR = 4e-5  # what float32 may err by in the difference of two squared distances, with room


def fit_centroids(sample: np.ndarray, k: int, rounds: int = 6, seed: int = 7) -> np.ndarray:
    """Lloyd's k-means on unit vectors; centroids are not normalised. Only the layout of blocks depends on them."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(sample, c)
        n = np.bincount(own, minlength=len(c))
        s = np.stack([np.bincount(own, x, len(c)) for x in sample.T], axis=1)
        c[n > 0] = s[n > 0] / n[n > 0, None]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row, in float32: another one may be nearer by less than half of _NEAR."""
    short, half = np.ascontiguousarray(c.T, np.float32), ((c * c).sum(1) / 2).astype(np.float32)
    step = max(1, 4_000_000 // len(c))
    return np.concatenate([(half - x[a : a + step].astype(np.float32) @ short).argmin(1) for a in range(0, len(x), step)] or [np.zeros(0, int)])


def _unit(p: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors of packed ones: values times SCALE as 2-byte integers, or doubles."""
    rows = p.to_pylist()
    m = np.empty((len(rows), dim))
    size = np.fromiter(map(len, rows), int, len(rows))
    for kind, width, scale in (("<i2", 2, SCALE), ("<f8", 8, 1)):
        at = np.flatnonzero(size == width * dim)
        if len(at):
            m[at] = np.frombuffer(b"".join(rows if len(at) == len(rows) else [rows[i] for i in at]), kind).reshape(-1, dim) / scale
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _packed(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    ends = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] * x.itemsize)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(x.tobytes())])], ["id", "p"])


def _lists(values: np.ndarray, size: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(values))


def _whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """All batches of a task as one."""
    some = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(some).combine_chunks() if some else None


def tile_top(ids: np.ndarray, u: np.ndarray, base_ids: np.ndarray, w: np.ndarray, center: np.ndarray, k: int, least: np.ndarray | None = None) -> pd.DataFrame:
    """row (of ``u``), id, other, sim: the k best of one tile's base rows for each query row, exact to the rounding, best
    first; none below ``least``, where that is given.

    Both sides are taken relative to the tile's centre; a float32 product gives every similarity within a bound. Pairs whose best
    possible similarity reaches the k-th certain one are recomputed in float64."""
    ru, rw = (u - center).astype(np.float32), np.ascontiguousarray((w - center).T, np.float32)
    side = (w @ center).astype(np.float32)
    row = (u @ center - center @ center).astype(np.float32)
    err = np.float32(u.shape[1] * 1.2e-7 * (np.linalg.norm(ru, axis=1).max(initial=0) * np.linalg.norm(rw, axis=0).max(initial=0)) + 2e-6)
    least = np.full(len(u), -2.0) if least is None else least
    rows, cols, sims = [], [], []
    step = max(1, 2_000_000 // max(1, len(base_ids)))
    for a in range(0, len(ids), step):
        z = slice(a, a + step)
        s = ru[z] @ rw
        s += side
        floor = (least[z] - _SLACK).astype(np.float32) - row[z] - err
        hit = s >= floor[:, None]
        many = np.flatnonzero(np.count_nonzero(hit, axis=1) > 4 * k)
        if len(many) and len(base_ids) > k + 1:
            # a row may meet itself, hence one more
            kth = np.partition(s[many], len(base_ids) - k - 1, axis=1)[:, len(base_ids) - k - 1]
            hit[many] &= s[many] >= (kth - 2 * err)[:, None]
        i, j = np.nonzero(hit)
        i += a
        apart = ids[i] != base_ids[j]
        i, j = i[apart], j[apart]
        exact = np.empty(len(i))
        for b in range(0, len(i), 100_000):
            y = slice(b, b + 100_000)
            exact[y] = np.einsum("ij,ij->i", u[i[y]], w[j[y]])
        exact = np.round(exact, 9)
        rows.append(i), cols.append(base_ids[j]), sims.append(exact)
    row, other, sim = _best(*(np.concatenate(x) for x in (rows, cols, sims)), k, least) if rows else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    return pd.DataFrame({"row": row, "id": ids[row], "other": other, "sim": sim})


def _best(row: np.ndarray, other: np.ndarray, sim: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of each row, none below the row's ``least``."""
    good = sim >= least[row]
    row, other, sim = row[good], other[good], sim[good]
    order = np.lexsort((other, -sim, row))
    row, other, sim = row[order], other[order], sim[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], other[first], sim[first]


class Layout:
    """Clusters and their tiles: which tiles may hold neighbours of a vector."""

    def __init__(self, centroids: np.ndarray, size: np.ndarray, far: np.ndarray):
        self.c = centroids
        self.short, self.squares = np.ascontiguousarray(centroids.T, np.float32), (centroids * centroids).sum(1).astype(np.float32)
        self.far = far.astype(np.float32)
        self.filled = size > 0
        self.tiles = np.maximum(1, -(-size // TILE_ROWS))
        self.first = np.cumsum(self.tiles) - self.tiles
        self.cluster = np.repeat(np.arange(len(centroids)), self.tiles)
        gap = self.squares[:, None] + self.squares[None, :] - 2 * (centroids.astype(np.float32) @ self.short)
        self.gap = np.sqrt(np.maximum(gap, 0))

    def visits(self, u: np.ndarray, own: np.ndarray, kth: np.ndarray, most: int | None, done: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of tiles, tiles, open?) of each row: all but those in ``done`` that neither the ring of distances (triangle
        inequality) nor the bisector between centroids excludes under the bound ``kth``. A row with more than ``most`` gets
        the nearest of them only and stays open."""
        reach = (np.sqrt(np.maximum(0, 2 - 2 * (kth - _SLACK))) + 1e-6).astype(np.float32)
        sizes, tiles, opens = [], [], []
        step = max(1, 4_000_000 // len(self.c))
        for a in range(0, len(u), step):
            z = slice(a, a + step)
            d2 = self.squares - 2 * (u[z].astype(np.float32) @ self.short)
            d2 += 1
            limit = self.far + reach[z, None]
            limit *= limit
            # a cluster's members lie on its side of the bisector with the vector's own centroid
            side = self.gap[own[z]] if len(set(own[z])) > 1 else self.gap[own[z][:1]]
            side = side * (2 * reach[z, None])
            side += d2[np.arange(len(d2)), own[z]][:, None]
            np.minimum(limit, side, out=limit)
            limit += _NEAR
            seen = d2 <= limit
            seen &= self.filled
            i, c = np.nonzero(seen)
            n = self.tiles[c]
            t = np.repeat(self.first[c], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            i, near = np.repeat(i, n), np.repeat(d2[i, c], n)
            # those seen before
            length = np.array([len(x) for x in done[z]], int)
            was = np.repeat(np.arange(len(length)), length) * len(self.cluster) + np.concatenate(done[z] or [np.zeros(0, int)])
            new = ~np.isin(i * len(self.cluster) + t, was)
            i, t, near = i[new], t[new], near[new]
            size = np.bincount(i, minlength=len(d2))
            more = np.zeros(len(d2), bool) if most is None else size > most
            if more.any():
                order = np.lexsort((t, near, i))
                i, t = i[order], t[order]
                keep = ~more[i] | (np.arange(len(i)) - np.searchsorted(i, i) < most)
                i, t = i[keep], t[keep]
            sizes.append(np.bincount(i, minlength=len(d2))), tiles.append(t), opens.append(more)
        return np.concatenate(sizes), np.concatenate(tiles), np.concatenate(opens)


STATE = "id long, p binary, own int, tile int, others array<long>, sims array<double>, kth double, tiles array<int>, open boolean"


def _state(ids: pa.Array, p: pa.Array, u: np.ndarray, own: np.ndarray, tile: np.ndarray, found: tuple[np.ndarray, np.ndarray, np.ndarray], k: int, layout: Layout, most: int | None, done: list[np.ndarray]) -> pa.RecordBatch:
    """Rows of STATE: each vector with its best neighbours so far, the bound they give, and the tiles yet to see."""
    row, other, sim = found
    n = np.bincount(row, minlength=len(u))
    kth = np.full(len(u), -1.0)
    full = np.flatnonzero(n >= k)
    kth[full] = sim[np.cumsum(n)[full] - 1]
    size, tiles, more = layout.visits(u, own, kth, most, done)
    cols = [ids, p, pa.array(own, pa.int32()), pa.array(tile, pa.int32()), _lists(other.astype(np.int64), n), _lists(sim, n), pa.array(kth), _lists(tiles.astype(np.int32), size), pa.array(more)]
    return pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in STATE.split(", ")])


def nearest_neighbors(df: DataFrame, id_col: str, vector_col: str, k: int = 5, dim: int = 59) -> DataFrame:
    """vector_id, neighbor_id, similarity, rank: every usable vector's ``k`` most similar others by cosine similarity rounded
    to 9 decimals, equal similarities by smaller id. Exact: the accuracy loss is none.

    Layout: equal vectors are searched once, and only those that have copies meet them again (a copy group may be any share of
    all rows; it is cut to its k + 1 smallest ids by a ranked window, which Spark limits before the shuffle, before it meets the
    others). Distinct vectors are grouped into clusters fitted on a bounded sample, clusters into tiles. Pass 1 compares the
    vectors of each tile, which bounds the distance of their k-th neighbour; a vector that more than PROBES other tiles could
    serve under that bound sees the nearest of them first and is bounded anew. The last pass joins each vector with every tile
    that neither the triangle inequality (the distance of a cluster's farthest member) nor the bisector between centroids
    excludes, so no neighbour is lost. Tiles yield at most k rows a query, and none beyond its bound.

    Defined cases: a null vector, one of another length, with a null, NaN or infinite entry, or only zeros does not take part;
    a null id does not either; with k or fewer usable vectors each gets all others; an empty table gives an empty result;
    repeated ids are the caller's to avoid; further columns are ignored."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") == dim))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # a null entry comes as NaN; -0.0 counts as 0.0
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            ok = np.isfinite(x).all(1) & (x != 0).any(1)
            ids, x = b.column(0).to_numpy(zero_copy_only=False)[ok], x[ok] + 0.0
            whole = (np.abs(x) <= 3).all(1)
            q = np.rint(np.where(whole[:, None], x, 0) * SCALE)
            whole &= (q / SCALE == x).all(1)
            yield _packed(ids[whole], q[whole].astype("<i2"))
            yield _packed(ids[~whole], x[~whole])

    packed = cut(rows.mapInArrow(pack, "id long, p binary"))
    # one representative (the smallest id) of equal vectors, told by 128 bits of hash; only ids of groups are moved
    keyed = packed.select("id", F.xxhash64("p").alias("h1"), F.xxhash64(F.lit(1), "p").alias("h2"))
    groups = cut(keyed.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("c")).where("c > 1").select("h1", "h2", "rep"))
    counted = lambda x: F.broadcast(x) if x.count() <= BROADCAST_ROWS else x
    copies = cut(keyed.join(counted(groups), ["h1", "h2"]).select("id", "rep"))
    spare = copies.where("id <> rep").select("id")
    reps = packed.join(counted(spare), "id", "left_anti")
    n = packed.count() - spare.count()
    if n == 0:
        return spark.createDataFrame([], "vector_id long, neighbor_id long, similarity double, rank int")
    clusters = int(min(MAX_CLUSTERS, max(1, n // PER_CLUSTER)))
    # a bounded, documented sample: the FIT_ROWS smallest hashes of the ids
    sample = reps.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("p").toArrow()
    centroids = spark.sparkContext.broadcast(fit_centroids(_unit(sample["p"].combine_chunks(), dim), clusters))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = _unit(b.column(1), dim)
            own = _nearest(u, centroids.value)
            far = np.linalg.norm(u - centroids.value[own], axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own, pa.int32()), pa.array(far)], ["id", "p", "own", "d"])

    placed = cut(reps.mapInArrow(assign, "id long, p binary, own int, d double"))
    del packed, keyed, reps, groups
    # at most MAX_CLUSTERS rows: size, and how far a cluster's members lie from its centroid
    rings = placed.groupBy("own").agg(F.count("*").alias("n"), F.max("d").alias("far")).toPandas()
    size, far = np.zeros(len(centroids.value), int), np.zeros(len(centroids.value))
    size[rings["own"]], far[rings["own"]] = rings["n"], rings["far"]
    layout = Layout(centroids.value, size, far)
    shared = spark.sparkContext.broadcast(layout)
    element = lambda values, at: F.element_at(F.array(*[F.lit(int(x)) for x in values]), F.col(at) + 1) if max(values) > 1 else F.lit(1)
    parts = lambda rows: max(spark.sparkContext.defaultParallelism * 2, -(-rows // TASK_ROWS))

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _whole(batches)
        if t is None:
            return
        at, part = (t[c].to_numpy() for c in ("own", "part"))
        tile = shared.value.first[at] + part
        order = np.argsort(tile, kind="stable")
        for z in np.split(order, np.flatnonzero(np.diff(tile[order])) + 1):
            ids, p = t["id"].combine_chunks().take(pa.array(z)), t["p"].combine_chunks().take(pa.array(z))
            u, own = _unit(p, dim), at[z]
            i = ids.to_numpy()
            top = tile_top(i, u, i, u, shared.value.c[own[0]], k)
            found = top["row"].to_numpy(), top["other"].to_numpy(), top["sim"].to_numpy()
            yield _state(ids, p, u, own, tile[z], found, k, shared.value, PROBES, list(tile[z][:, None]))

    cells = placed.select("id", "p", "own", F.pmod(F.xxhash64("id"), element(layout.tiles, "own")).cast("int").alias("part"))
    one = cut(cells.repartition(parts(n), "own", "part").mapInArrow(inner, STATE))
    del placed, cells
    release(spark)
    base = one.select("id", "p", "tile")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _whole(batches)
        if t is None:
            return
        tile, salt, kth = (t[c].to_numpy(zero_copy_only=False) for c in ("tile", "salt", "kth"))
        ids, p = t["id"].combine_chunks(), t["p"].combine_chunks()
        order = np.lexsort((salt, tile))
        for z in np.split(order, np.flatnonzero(np.diff(tile[order]) | np.diff(salt[order])) + 1):
            asks = ~np.isnan(kth[z])
            q, b = z[asks], z[~asks]
            if len(q) and len(b):
                take = lambda x: (ids.take(pa.array(x)).to_numpy(), _unit(p.take(pa.array(x)), dim))
                top = tile_top(*take(q), *take(b), shared.value.c[shared.value.cluster[tile[z[0]]]], k, kth[q])
                yield pa.RecordBatch.from_pandas(top[["id", "other", "sim"]], preserve_index=False)

    def join(state: DataFrame) -> DataFrame:
        """id, other, sim of all rows of ``state`` with the tiles they have yet to see. The rows that ask one tile are cut by a salt."""
        asks = state.select(F.explode("tiles").alias("tile"), "id", "p", "kth")
        load = {r["tile"]: r["n"] for r in state.select(F.explode("tiles").alias("tile")).groupBy("tile").agg(F.count("*").alias("n")).collect()}
        salts = np.ones(len(layout.cluster), int)
        for t, m in load.items():
            salts[t] = -(-m // (4 * TILE_ROWS))
        asks = asks.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(1)), element(salts, "tile")).cast("int"))
        asked = base.withColumn("kth", F.lit(float("nan"))).withColumn("salt", F.explode(F.sequence(F.lit(0), element(salts, "tile") - 1)))
        both = asks.unionByName(asked).repartition(parts(n + sum(load.values())), "tile", "salt")
        return both.mapInArrow(meet, "id long, other long, sim double")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, p, own, tile, others, sims, _, tiles, _, o2, s2 = b.columns
            row = np.concatenate([np.repeat(np.arange(len(b)), x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)) for x in (others, o2)])
            other, sim = (np.concatenate([x.flatten().to_numpy() for x in y]) for y in ((others, o2), (sims, s2)))
            found = _best(row, other, sim, k, np.full(len(b), -2.0))
            u, at = _unit(p, dim), tile.to_numpy()
            done = [np.append(x, y).astype(int) for x, y in zip(tiles.to_pylist(), at)]
            yield _state(ids, p, u, own.to_numpy(), at, found, k, shared.value, None, done)

    opened = one.where("open")
    rest = one.where("not open")
    if opened.limit(1).count():
        near = join(opened).groupBy("id").agg(F.collect_list(F.struct("other", "sim")).alias("x")).select("id", F.col("x.other").alias("o2"), F.col("x.sim").alias("s2"))
        rest = rest.unionByName(cut(opened.join(near, "id", "left").select(*one.columns, "o2", "s2").mapInArrow(again, STATE)))
    pair = F.explode(F.arrays_zip("others", "sims")).alias("x")
    top = rest.select("id", pair).select(F.col("id").alias("rep_q"), F.col("x.others").alias("other"), F.col("x.sims").alias("sim")).unionByName(join(rest).withColumnRenamed("id", "rep_q"))
    top = cut(top)
    del one, opened, rest, base
    release(spark)
    # representatives back to ids: a neighbour group gives its smallest ids, an own group its other copies at similarity 1
    first = cut(copies.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(f"r <= {k + 1}").select("rep", "id"))
    extra = counted(first.where("id <> rep"))
    wide = top.unionByName(top.join(extra.withColumnRenamed("rep", "other"), "other").select("rep_q", F.col("id").alias("other"), "sim"))
    wide = wide.unionByName(first.select(F.col("rep").alias("rep_q"), F.col("id").alias("other"), F.lit(1.0).alias("sim")))
    ahead = wide.withColumn("rank", F.row_number().over(Window.partitionBy("rep_q").orderBy(F.desc("sim"), "other"))).where(f"rank <= {k + 1}")
    alone = ahead.join(counted(copies.where("id = rep").select(F.col("rep").alias("rep_q"))), "rep_q", "left_anti").where(f"rank <= {k}").select(F.col("rep_q").alias("id"), "other", "sim", "rank")
    full = ahead.drop("rank").join(counted(copies.withColumnRenamed("rep", "rep_q")), "rep_q").where("id <> other")
    ranked = full.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "other"))).where(f"rank <= {k}").select("id", "other", "sim", "rank")
    found = alone.unionByName(ranked)
    return found.select(F.col("id").alias("vector_id"), F.col("other").alias("neighbor_id"), F.col("sim").alias("similarity"), "rank")
