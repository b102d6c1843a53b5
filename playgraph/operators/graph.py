"""Edges in long form, pruning, neighbour queries and graph metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from playgraph.operators.pmi import heat_blend
from playgraph.operators.sharing import block_pairs
from playgraph.session import cut

#: Links (both ways counted) up to which ``betweenness`` sends the graph to its tasks.
LOCAL_LINKS = 5_000_000


def symmetrize(edges: DataFrame, a: str, b: str, *keep: str) -> DataFrame:
    """JN-09, SET-01: each edge from both ends as (node, other, ...); self edges once."""
    fwd = edges.select(F.col(a).alias("node"), F.col(b).alias("other"), *keep)
    return fwd.unionAll(edges.where(F.col(a) != F.col(b)).select(F.col(b).alias("node"), F.col(a).alias("other"), *keep))


def canonical_pair(edges: DataFrame, a: str, b: str) -> DataFrame:
    """The ends in order, self pairs gone (FLT-04)."""
    rest = [c for c in edges.columns if c not in (a, b)]
    return edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias(a), F.greatest(a, b).alias(b), *rest)


def prune_topk(edges: DataFrame, a: str, b: str, weight: Column, k: int) -> DataFrame:
    """WIN-02, DML-08: the edges (of canonical pairs) that are among the ``k`` heaviest of either end; ties to the smaller
    other end. row_number() <= k lets Spark cut each end's rows before the shuffle."""
    if k <= 0:
        raise ValueError("k must be positive")
    e = edges.withColumn("_w", weight)
    w = Window.partitionBy("node").orderBy(F.desc("_w"), "other")
    top = symmetrize(e, a, b, "_w").withColumn("_r", F.row_number().over(w)).where(f"_r <= {k}")
    keep = top.select(F.least("node", "other").alias(a), F.greatest("node", "other").alias(b)).distinct()
    return edges.join(keep, [a, b], "left_semi")


def symmetric_neighbors(edges: DataFrame, centers: DataFrame, a: str, b: str, weight: str, limit: int) -> DataFrame:
    """GRF-14: of each center the heaviest neighbours either way, ties to the smaller one."""
    w = Window.partitionBy("node").orderBy(F.desc(weight), "other")
    s = symmetrize(edges, a, b, weight).join(centers.select(F.col("center").alias("node")), "node", "left_semi")
    return s.withColumn("rank", F.row_number().over(w)).where(f"rank <= {limit}").select(F.col("node").alias("center"), F.col("other").alias("neighbor"), weight, "rank")


def union_neighbors(parts: list[DataFrame], limit: int) -> DataFrame:
    """GRF-15: neighbours (center, neighbor, weight) of several relations: the heaviest rows of each center, then the first
    row of each neighbour. A missing optional relation is simply not in ``parts``."""
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    w = Window.partitionBy("center").orderBy(F.desc("weight"), "neighbor")
    cutoff = u.withColumn("_r", F.row_number().over(w)).where(f"_r <= {limit}")
    return cutoff.groupBy("center", "neighbor").agg(F.max("weight").alias("weight"))


def long_edges(tables: dict[str, tuple[DataFrame, str, str, Column, bool]]) -> DataFrame:
    """src, dst, type, score, directed: all relations in one view. Values are (table, end a, end b, score, directed)."""
    out = None
    for kind, (df, a, b, score, directed) in tables.items():
        part = df.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(kind).alias("type"), score.cast("double").alias("score"), F.lit(directed).alias("directed"))
        out = part if out is None else out.unionByName(part)
    return out


def explain_pair(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """GRF-16: every relation between the two nodes of each pair (x, y), either way; the highest score of a type."""
    p = pairs.select("x", "y").distinct()
    ways = edges.join(p, (edges.src == p.x) & (edges.dst == p.y)).unionByName(edges.join(p, (edges.src == p.y) & (edges.dst == p.x) & (p.x != p.y)))
    return ways.groupBy("x", "y", "type").agg(F.max("score").alias("score"))


#: Weight of each relation in the affinity score; transitions and the rest also depend on heat.
AFFINITY_BASE = {"personnel": 1.5, "style": 1.0, "label": 1.0, "compilation": 1.0, "influence": 1.5, "acoustic": 2.0, "member": 2.0}
ACOUSTIC_FLOOR = 0.97


def saturation(score: Column) -> Column:
    """MTH-02: acoustic similarity above its floor, rescaled to 0..1."""
    return F.greatest(F.lit(0.0), (score - ACOUSTIC_FLOOR) / (1 - ACOUSTIC_FLOOR))


def affinity(transitions: DataFrame, relations: DataFrame, centers: DataFrame, heat: float = 0.5, limit: int = 20, cap: int = 100) -> DataFrame:
    """GRF-13: composite affinity of each center's neighbours.

    transitions: source_id, target_id, raw_count, pmi. relations: src, dst, type, score. Of each center, table and direction
    the ``cap`` best rows are taken (transitions by raw count, the rest by score, then id). A transition's score is the heat
    blend on the center's maxima, the incoming row standing where both ways exist. Scores are scaled by the maximum of their
    type, the first row of a type per neighbour counts (outgoing before incoming), and the weighted sum is rounded to 3."""
    c = centers.select(F.col("center")).distinct()
    both = transitions.select(F.col("source_id").alias("center"), F.col("target_id").alias("neighbor"), "raw_count", "pmi", F.lit(0).alias("way"))
    both = both.unionByName(transitions.select(F.col("target_id").alias("center"), F.col("source_id").alias("neighbor"), "raw_count", "pmi", F.lit(1).alias("way")))
    w = Window.partitionBy("center", "way").orderBy(F.desc("raw_count"), "neighbor")
    t = both.join(c, "center", "left_semi").where("center <> neighbor").withColumn("_r", F.row_number().over(w)).where(f"_r <= {cap}")
    t = t.groupBy("center", "neighbor").agg(F.max_by(F.struct("raw_count", "pmi"), "way").alias("x")).select("center", "neighbor", "x.*")
    by_c = Window.partitionBy("center")
    t = t.withColumn("score", heat_blend(F.col("raw_count"), F.col("pmi"), F.max("raw_count").over(by_c), F.max("pmi").over(by_c), heat))
    t = t.select("center", "neighbor", F.lit("transition").alias("type"), "score")
    r = relations.select(F.col("src").alias("center"), F.col("dst").alias("neighbor"), "type", "score", F.lit(0).alias("way"))
    r = r.unionByName(relations.select(F.col("dst").alias("center"), F.col("src").alias("neighbor"), "type", "score", F.lit(1).alias("way")))
    r = r.join(c, "center", "left_semi").where("center <> neighbor")
    r = r.withColumn("_r", F.row_number().over(Window.partitionBy("center", "type", "way").orderBy(F.desc("score"), "neighbor"))).where(f"_r <= {cap}")
    r = r.groupBy("center", "neighbor", "type").agg(F.min_by("score", F.struct("way", (-F.col("score")).alias("n"))).alias("score"))
    r = r.withColumn("score", F.when(F.col("type") == "acoustic", saturation(F.col("score"))).otherwise(F.col("score")))
    every = t.unionByName(r)
    top = F.max("score").over(Window.partitionBy("center", "type"))
    weight = F.when(F.col("type") == "transition", F.lit(3 * min(1.0, 2 * (1 - heat))))
    for kind, base in AFFINITY_BASE.items():
        weight = weight.when(F.col("type") == kind, F.lit(base * 2 * heat))
    part = weight.otherwise(F.lit(0.0)) * F.col("score") / F.when(top == 0, F.lit(1.0)).otherwise(top)
    s = every.withColumn("part", part).groupBy("center", "neighbor").agg(F.sum("part").alias("part"))
    s = s.select("center", "neighbor", F.round("part", 3).alias("affinity"))
    return s.withColumn("rank", F.row_number().over(by_c.orderBy(F.desc("affinity"), "neighbor"))).where(f"rank <= {limit}")


def degree(edges: DataFrame, a: str, b: str) -> DataFrame:
    """AGG-18: distinct partners of each node, self edges left out."""
    return symmetrize(edges.where(F.col(a) != F.col(b)), a, b).groupBy("node").agg(F.countDistinct("other").alias("degree"))


def degree_ceiling(deg: DataFrame, share: float = 0.95) -> DataFrame:
    """EXP-02: nodes up to the degree at place int(n * share) of the sorted list (not interpolated). Degrees meet in a
    histogram, so nothing is sorted but distinct degrees."""
    h = deg.groupBy("degree").agg(F.count("*").alias("c"))
    run = F.sum("c").over(Window.partitionBy(F.lit(1)).orderBy("degree").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("c").over(Window.partitionBy(F.lit(1)))
    cap = h.withColumn("run", run).withColumn("n", total).where(F.col("run") > F.floor(F.col("n") * share)).agg(F.min("degree").alias("cap"))
    return deg.crossJoin(F.broadcast(cap)).where("degree <= cap").select("node", "degree")


def shared_neighbors(edges: DataFrame, a: str, b: str, pairs: DataFrame) -> DataFrame:
    """SET-03: x, y, shared: common neighbours of each pair."""
    s = symmetrize(edges.where(F.col(a) != F.col(b)), a, b).distinct()
    p = pairs.select("x", "y").distinct()
    left = p.join(s.select(F.col("node").alias("x"), F.col("other").alias("shared")), "x")
    return left.join(s.select(F.col("node").alias("y"), F.col("other").alias("shared")), ["y", "shared"]).select("x", "y", "shared")


def adamic_adar(edges: DataFrame, a: str, b: str, pairs: DataFrame, gate: float = 0.8, top: int = 5) -> DataFrame:
    """GRF-17, MTH-03: the ``top`` shared neighbours of each pair by round(1 / ln(degree), 3), of pairs whose terms sum to the
    gate at least; ties to the smaller neighbour."""
    deg = degree(edges, a, b).select(F.col("node").alias("shared"), "degree").where("degree >= 2")
    s = shared_neighbors(edges, a, b, pairs).join(deg, "shared").withColumn("term", F.round(1 / F.log("degree"), 3))
    w = Window.partitionBy("x", "y")
    s = s.withColumn("aa", F.round(F.sum("term").over(w), 3)).where(F.col("aa") >= gate)
    return s.withColumn("rank", F.row_number().over(w.orderBy(F.desc("term"), "shared"))).where(f"rank <= {top}").select("x", "y", "shared", "degree", "term", "aa", "rank")


def two_hop(edges: DataFrame, a: str, b: str, min_aa: float, middles: DataFrame | None = None) -> DataFrame:
    """GRF-18, JN-14: pairs without an edge that share neighbours with a summed unrounded 1 / ln(degree) of at least
    ``min_aa``. The paths through one hub are its degree squared, so pairs are counted by pairs of blocks. ``middles`` (node),
    if given, are the only nodes that count as shared neighbours; degrees stay those over all edges."""
    s = symmetrize(edges.where(F.col(a) != F.col(b)), a, b).distinct()
    deg = s.groupBy("node").agg(F.count("*").alias("degree")).where("degree >= 2")
    mid = deg if middles is None else deg.join(middles.select("node").distinct(), "node", "left_semi")
    m = s.join(mid, "node").select(F.col("other").alias("node"), F.col("node").alias("key"), (1 / F.log("degree")).alias("weight"))
    aa = block_pairs(m, lambda shared, total, na, nb: total >= min_aa).select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("total").alias("aa"), F.col("shared").alias("middles"))
    return aa.join(s.select(F.col("node").alias("x"), F.col("other").alias("y")), ["x", "y"], "left_anti")


def resource_allocation(edges: DataFrame, a: str, b: str, pairs: DataFrame) -> DataFrame:
    """EXP-01: per pair the sums of 1 / degree and of 1 / ln(degree) (1.0 at degree 1 or less) over shared neighbours."""
    deg = degree(edges, a, b).select(F.col("node").alias("shared"), "degree")
    s = shared_neighbors(edges, a, b, pairs).join(deg, "shared")
    return s.groupBy("x", "y").agg(F.sum(1 / F.col("degree")).alias("ra"), F.sum(F.when(F.col("degree") <= 1, 1.0).otherwise(1 / F.log("degree"))).alias("aa1"), F.count("*").alias("n"))


def pmi_graph(edges: DataFrame, min_raw_count: int, order: list[str]) -> DataFrame:
    """GRF-12: undirected edges of positive pmi; of two opposite ones the later by ``order`` stands."""
    e = edges.where((F.col("raw_count") >= min_raw_count) & (F.col("pmi") > 0))
    return e.groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.max_by(F.struct("raw_count", "pmi"), F.struct(*order)).alias("x")).select("a", "b", "x.raw_count", "x.pmi")


def transition_graph(edges: DataFrame, compilations: DataFrame, min_raw_count: int = 2) -> DataFrame:
    """GRF-08: directed edges of at least ``min_raw_count`` between nodes that aren't compilations (column ``node``)."""
    e = edges.where(F.col("raw_count") >= min_raw_count)
    return e.join(compilations.select(F.col("node").alias("source")), "source", "left_anti").join(compilations.select(F.col("node").alias("target")), "target", "left_anti")


def pagerank(edges: DataFrame, source: str, target: str, rounds: int = 20, alpha: float = 0.85, every: int = 5) -> DataFrame:
    """GRF-11: node, pagerank after ``rounds`` steps on the unweighted directed graph, dangling mass shared evenly. Lineage is
    cut every few rounds by a reliable checkpoint."""
    e = cut(edges.select(F.col(source).alias("s"), F.col(target).alias("t")).distinct())
    out = e.groupBy("s").agg(F.count("*").alias("out"))
    nodes = cut(e.select(F.col("s").alias("node")).union(e.select(F.col("t").alias("node"))).distinct().join(out.select(F.col("s").alias("node"), "out"), "node", "left"))
    n = nodes.count()
    if n == 0:
        return nodes.select("node", F.lit(0.0).alias("pagerank"))
    r = nodes.withColumn("pr", F.lit(1.0 / n))
    for k in range(rounds):
        gain = e.join(r.where("out is not null").select(F.col("node").alias("s"), (F.col("pr") / F.col("out")).alias("x")), "s").groupBy(F.col("t").alias("node")).agg(F.sum("x").alias("gain"))
        lost = r.agg(F.coalesce(F.sum(F.when(F.col("out").isNull(), F.col("pr"))), F.lit(0.0)).alias("lost"))
        r = nodes.join(gain, "node", "left").crossJoin(F.broadcast(lost))
        r = r.select("node", "out", (F.lit((1 - alpha) / n) + alpha * (F.coalesce("gain", F.lit(0.0)) + F.col("lost") / n)).alias("pr"))
        if (k + 1) % every == 0:
            r = cut(r)
    return r.select("node", F.col("pr").alias("pagerank"))


def communities(edges: DataFrame, a: str, b: str, weight: str, rounds: int = 12) -> DataFrame:
    """GRF-09: node, community by deterministic local moving on modularity over the weighted undirected projection.

    Each round every node weighs joining each neighbouring community (weight to it minus its expected weight); moves are made
    by alternating halves of the nodes (by hash), so that two nodes don't swap for ever; ties go to the smaller community. All
    steps are joins and aggregates; nothing is gathered. Communities are numbered from 0 by size, then smallest member."""
    und = symmetrize(canonical_pair(edges.select(a, b, weight), a, b).groupBy(a, b).agg(F.sum(weight).cast("double").alias("w")), a, b, "w")
    e = cut(und.groupBy("node", "other").agg(F.sum("w").alias("w")))
    k = cut(e.groupBy("node").agg(F.sum("w").alias("k")))
    m2 = float(k.agg(F.sum("k").alias("s")).first()["s"] or 1.0)
    label = cut(k.select("node", "k", F.col("node").alias("c")))
    for i in range(rounds):
        tot = label.groupBy("c").agg(F.sum("k").alias("tot"))
        links = e.join(label.select(F.col("node").alias("other"), "c"), "other").groupBy("node", "c").agg(F.sum("w").alias("w"))
        # staying without links inside is an option as well
        links = links.unionByName(label.select("node", "c", F.lit(0.0).alias("w"))).groupBy("node", "c").agg(F.sum("w").alias("w"))
        own = label.select("node", "k", F.col("c").alias("mine"))
        gain = links.join(tot, "c").join(own, "node")
        gain = gain.withColumn("g", F.round(F.col("w") - F.col("k") * (F.col("tot") - F.when(F.col("c") == F.col("mine"), F.col("k")).otherwise(0.0)) / m2, 9))
        best = gain.groupBy("node").agg(F.min_by("c", F.struct((-F.col("g")).alias("n"), (F.col("c") != F.col("mine")).alias("m"), "c")).alias("best"))
        turn = F.pmod(F.xxhash64("node", F.lit(7)), F.lit(2)) == i % 2
        nxt = cut(own.join(best, "node").select("node", "k", F.when(turn, F.col("best")).otherwise(F.col("mine")).alias("c"), (turn & (F.col("best") != F.col("mine"))).alias("moved")))
        moved = nxt.where("moved").limit(1).count()
        label = nxt.select("node", "k", "c")
        if not moved and i % 2:
            break
    size = label.groupBy("c").agg(F.count("*").alias("size"), F.min("node").alias("first"))
    order = size.withColumn("community", F.row_number().over(Window.orderBy(F.desc("size"), "first")) - 1)
    return label.join(order.select("c", "community"), "c").select("node", "community")


def modularity(edges: DataFrame, a: str, b: str, weight: str, label: DataFrame) -> float:
    """Modularity of a labelling (node, community) on the undirected projection."""
    e = canonical_pair(edges.select(a, b, weight), a, b).groupBy(a, b).agg(F.sum(weight).cast("double").alias("w"))
    j = e.join(label.select(F.col("node").alias(a), F.col("community").alias("ca")), a).join(label.select(F.col("node").alias(b), F.col("community").alias("cb")), b)
    t = j.agg(F.sum("w").alias("m"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("i")).first()
    d = j.select(F.col("ca").alias("c"), "w").unionAll(j.select(F.col("cb").alias("c"), "w")).groupBy("c").agg(F.sum("w").alias("k")).agg(F.sum(F.col("k") * F.col("k")).alias("s")).first()
    return t["i"] / t["m"] - d["s"] / (2 * t["m"]) ** 2 if t["m"] else 0.0


def betweenness(edges: DataFrame, a: str, b: str, sources: int = 2000, seed: int = 42, batch: int = 500) -> DataFrame:
    """GRF-10: node, betweenness (undirected, unweighted, normalised) from ``sources`` seeded sources, exact from all nodes if
    there are no more. Brandes' method: a graph of up to LOCAL_LINKS counted links is broadcast and each task takes some sources;
    a larger one is gone through level by level for ``batch`` sources at once, as joins: (source, node, depth, paths) going out
    until no node is new, then dependencies coming back, spread over the cluster."""
    spark = edges.sparkSession
    e = cut(symmetrize(canonical_pair(edges.select(a, b), a, b).distinct(), a, b))
    nodes = cut(e.select("node").distinct())
    n = nodes.count()
    if n < 3:
        return nodes.withColumn("betweenness", F.lit(0.0))
    k = min(sources, n)
    src = nodes.orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(k).select(F.col("node").alias("s"))
    scale = 1.0 / ((n - 1) * (n - 2)) * (n / k)
    if e.count() <= LOCAL_LINKS:
        links = e.toArrow()
        names, at = np.unique(links["node"].to_numpy(), return_inverse=True)
        order = np.argsort(at, kind="stable")
        ptr = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=n))])
        shared = spark.sparkContext.broadcast((names, ptr, np.searchsorted(names, links["other"].to_numpy()[order]).astype(np.int32)))
        del links, at, order

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, ptr, other = shared.value
            total = np.zeros(len(names))
            for f in frames:
                for s in np.searchsorted(names, f["s"].to_numpy()):
                    total += _from_source(ptr, other, int(s))
            hit = total > 0
            yield pd.DataFrame({"node": names[hit], "dep": total[hit]})

        parts = min(k, spark.sparkContext.defaultParallelism * 4)
        sums = src.repartition(parts, "s").mapInPandas(run, f"node {e.schema['node'].dataType.simpleString()}, dep double")
    else:
        src = cut(src.withColumn("part", F.floor((F.row_number().over(Window.orderBy("s")) - 1) / batch)))
        sums = None
        for p in range(-(-k // batch)):
            got = cut(_dependencies(e, src.where(f"part = {p}").select("s")).where("s <> node").groupBy("node").agg(F.sum("dep").alias("dep")))
            sums = got if sums is None else sums.unionByName(got)
    sums = sums.groupBy("node").agg(F.sum("dep").alias("dep"))
    return nodes.join(sums, "node", "left").select("node", (F.coalesce("dep", F.lit(0.0)) * scale).alias("betweenness"))


def _from_source(ptr: np.ndarray, other: np.ndarray, s: int) -> np.ndarray:
    """The dependency of source ``s`` on each node; the neighbours of node i are other[ptr[i] : ptr[i + 1]]. Work is in
    proportion to the links reached, whatever the number of levels."""
    n = len(ptr) - 1
    depth, paths, dep = np.full(n, -1, np.int32), np.zeros(n), np.zeros(n)
    depth[s], paths[s] = 0, 1.0
    level, steps = np.array([s]), []

    def add(into: np.ndarray, at: np.ndarray, what: np.ndarray) -> None:
        if len(at) * 8 > n:
            into += np.bincount(at, what, n)
        else:
            np.add.at(into, at, what)

    while len(level):
        size = ptr[level + 1] - ptr[level]
        to = other[np.arange(size.sum()) + np.repeat(ptr[level] - (np.cumsum(size) - size), size)]
        new = depth[to] < 0
        fro, to = np.repeat(level, size)[new], to[new]
        if not len(to):
            break
        steps.append((fro, to))
        depth[to] = len(steps)
        add(paths, to, paths[fro])
        level = np.flatnonzero(depth == len(steps)) if len(to) * 8 > n else np.unique(to)
    for fro, to in reversed(steps):
        add(dep, fro, (1 + dep[to]) / paths[to] * paths[fro])
    dep[s] = 0
    return dep


def _dependencies(e: DataFrame, src: DataFrame) -> DataFrame:
    """s, node, dep: the dependency of each source on each node it reaches; e has (node, other) both ways."""
    seen = level = cut(src.select("s", F.col("s").alias("node"), F.lit(0).alias("d"), F.lit(1.0).alias("paths")))
    depth = 0
    while True:
        step = level.join(e, "node").groupBy("s", F.col("other").alias("node")).agg(F.sum("paths").alias("paths"))
        level = cut(step.join(seen.select("s", "node"), ["s", "node"], "left_anti").select("s", "node", F.lit(depth + 1).alias("d"), "paths"))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
        depth += 1
    seen = cut(seen)
    back = seen.where(f"d = {depth}").select("s", "node", "paths", F.lit(0.0).alias("dep"))
    total = None
    for d in range(depth, 0, -1):
        part = cut(back)
        total = part.select("s", "node", "dep") if total is None else total.unionByName(part.select("s", "node", "dep"))
        give = part.join(e.select("node", F.col("other").alias("up")), "node").select("s", F.col("up").alias("node"), ((1 + F.col("dep")) / F.col("paths")).alias("x"))
        above = seen.where(f"d = {d - 1}").select("s", "node", "paths")
        got = give.groupBy("s", "node").agg(F.sum("x").alias("x"))
        back = above.join(got, ["s", "node"], "left").select("s", "node", "paths", (F.col("paths") * F.coalesce("x", F.lit(0.0))).alias("dep"))
    return total if total is not None else back.select("s", "node", "dep")


def community_metadata(members: DataFrame, styles: DataFrame, plays: DataFrame, genres: DataFrame, generic: list[str]) -> DataFrame:
    """AGG-21: community, size, top_genres (5 commonest styles), label (first two of the 10 commonest styles that aren't
    generic, else the commonest genre), top_artists (5 by plays). Inputs keyed by node."""
    def top(df: DataFrame, value: str, n: int, score: Column, name: str) -> DataFrame:
        w = Window.partitionBy("community").orderBy(F.desc("_s"), value)
        d = df.groupBy("community", value).agg(score.alias("_s")).withColumn("_r", F.row_number().over(w)).where(f"_r <= {n}")
        return d.groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", value))), lambda x: x[value]).alias(name))

    size = members.groupBy("community").agg(F.count("*").alias("size"))
    st = top(members.join(styles, "node"), "style", 10, F.count("*"), "styles")
    ge = top(members.join(genres.where("genre is not null"), "node"), "genre", 1, F.count("*"), "genres")
    ar = top(members.join(plays, "node"), "node", 5, F.max("plays"), "top_artists")
    j = size.join(st, "community", "left").join(ge, "community", "left").join(ar, "community", "left")
    named = F.slice(F.array_except(F.coalesce("styles", F.array().cast("array<string>")), F.array(*[F.lit(g) for g in generic])), 1, 2)
    label = F.when(F.size(named) > 0, F.concat_ws(" / ", named)).otherwise(F.coalesce(F.get("genres", 0), F.lit("")))
    return j.select("community", "size", label.alias("label"), F.slice(F.coalesce("styles", F.array().cast("array<string>")), 1, 5).alias("top_genres"), F.coalesce("top_artists", F.array().cast("array<bigint>")).alias("top_artists"))


def greedy_disjoint(pairs: DataFrame, n: int) -> pd.DataFrame:
    """EXP-05: pairs in order (column ``ord``) such that each node is used once, ``n`` at most. Greedy matching is sequential:
    candidates stream to the driver in order until ``n`` are found, they are never collected as a whole."""
    used: set = set()
    out = []
    for r in pairs.orderBy("ord", "x", "y").select("x", "y").toLocalIterator():
        if r["x"] not in used and r["y"] not in used and r["x"] != r["y"]:
            used |= {r["x"], r["y"]}
            out.append((r["x"], r["y"]))
            if len(out) >= n:
                break
    return pd.DataFrame(out, columns=["x", "y"])
