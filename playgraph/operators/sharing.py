"""Edges between nodes that share attributes: an inverted index by key self-join, hub keys salted; counts by pairs of blocks of nodes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from playgraph.session import cut

#: Nodes of one salt of a hub key: no group of the key join has more than about SALT_ROWS squared rows.
SALT_ROWS = 2000
#: Nodes of one block of ``block_pairs``.
BLOCK = 2048
#: Nodes of one unit of ``shared_key_texts``, units of one salt of a hub key, and the most salts: a unit is moved as often.
UNIT_NODES, SALT_UNITS, MAX_SALTS = 500, 8000, 16
#: Keys and nodes of all units up to which they are broadcast (about 40 bytes each).
BROADCAST_ITEMS = 3_000_000


def _facts(facts: DataFrame, node: str, key: str, max_df: int | None) -> tuple[DataFrame, DataFrame]:
    """(all distinct facts whose key isn't too frequent, those of keys that at least two nodes have, with the key's ``df``)."""
    d = facts.select(F.col(node).alias("node"), F.col(key).alias("key")).where("node is not null and key is not null").distinct()
    df = d.groupBy("key").agg(F.count("*").alias("df"))
    kept = d if max_df is None else d.join(df.where(F.col("df") > max_df).select("key"), "key", "left_anti")
    shared = df.where((F.col("df") >= 2) & (F.col("df") <= max_df if max_df is not None else F.lit(True)))
    return kept, d.join(shared, "key")


def _pairs(shared: DataFrame) -> DataFrame:
    """JN-07: (a, b, key), a < b. A key of many nodes is joined by pairs of salts, so no group of the join is unbounded."""
    salts = F.ceil(F.col("df") / SALT_ROWS).cast("int")
    own, other = F.pmod(F.xxhash64("node"), salts).cast("int"), F.explode(F.sequence(F.lit(0), salts - 1))
    left = shared.select("key", F.col("node").alias("a"), own.alias("p"), other.alias("q"))
    right = shared.select("key", F.col("node").alias("b"), own.alias("q"), other.alias("p"))
    return left.join(right, ["key", "p", "q"]).where("a < b").select("key", "a", "b")


def key_pairs(facts: DataFrame, node: str, key: str) -> DataFrame:
    """(key, a, b), a < b: the pairs of distinct nodes of each key, hub keys salted."""
    return _pairs(_facts(facts, node, key, None)[1])


def _meet(na: np.ndarray, ka: np.ndarray, wa: np.ndarray | None, nb: np.ndarray, kb: np.ndarray) -> tuple[np.ndarray, ...]:
    """Nodes of two blocks, their numbers of keys, and as matrices the number and the summed weight of common keys (the number
    again, if there are no weights). Keys that many nodes of both blocks have are matrix products, the others are expanded pair
    by pair."""
    xa, ia, sa = np.unique(na, return_inverse=True, return_counts=True)
    xb, ib, sb = np.unique(nb, return_inverse=True, return_counts=True)
    keys, inv = np.unique(np.concatenate([ka, kb]), return_inverse=True)
    ja, jb = inv[: len(ka)], inv[len(ka) :]
    ca, cb = np.bincount(ja, minlength=len(keys)), np.bincount(jb, minlength=len(keys))
    n, m = len(xa), len(xb)
    count = np.zeros(n * m)
    total = count if wa is None else np.zeros(n * m)
    dense = ca * cb >= max(64, n * m // 256)
    heavy = np.flatnonzero(dense)
    for at in range(0, len(heavy), 512):
        part = heavy[at : at + 512]
        place = np.full(len(keys), -1)
        place[part] = np.arange(len(part))
        fa, fb = place[ja] >= 0, place[jb] >= 0
        one, right = np.zeros((n, len(part))), np.zeros((m, len(part)))
        one[ia[fa], place[ja[fa]]] = 1
        right[ib[fb], place[jb[fb]]] = 1
        count += (one @ right.T).ravel()
        if wa is not None:
            one[ia[fa], place[ja[fa]]] = wa[fa]
            total += (one @ right.T).ravel()
    order = np.argsort(jb, kind="stable")
    start = np.concatenate([[0], np.cumsum(cb)])[:-1]
    light = np.flatnonzero(~dense[ja] & (cb[ja] > 0))
    # at most about four million pairs at once
    runs = np.cumsum(cb[ja[light]]) // 4_000_000
    for r in np.unique(runs):
        f = light[runs == r]
        times = cb[ja[f]]
        off = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        code = np.repeat(ia[f], times) * m + ib[order[np.repeat(start[ja[f]], times) + off]]
        count += np.bincount(code, minlength=n * m)
        if wa is not None:
            total += np.bincount(code, np.repeat(wa[f], times), n * m)
    return xa, sa, xb, sb, count.reshape(n, m), total.reshape(n, m)


def block_pairs(facts: DataFrame, keep: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(a, b, shared, total, na, nb), a < b: all pairs of nodes with a common key for which ``keep(shared, total, na, nb)``
    holds; ``total`` sums the key's weight, na and nb are the nodes' numbers of keys. Input: distinct (node, key, weight).

    Nodes are hashed to blocks and each pair of blocks is counted whole in one task: no key is too frequent, what is shuffled
    is the facts and not their pairs, and pairs that don't hold never leave the task."""
    facts = cut(facts.select("node", "key", F.col("weight").cast("double").alias("weight")))
    blocks = max(1, -(-facts.select("node").distinct().count() // BLOCK))
    packed = facts.withColumn("block", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int")).groupBy("block")
    packed = packed.agg(F.collect_list("node").alias("n"), F.collect_list("key").alias("k"), F.collect_list("weight").alias("w"))
    packed = cut(packed.repartition(min(blocks, 128), "block"))
    left, right = (packed.select(*[F.col(c).alias(f"{c}{s}") for c in packed.columns]) for s in "ab")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                xa, sa, xb, sb, shared, total = _meet(r.na, r.ka, r.wa, r.nb, r.kb)
                for at in range(0, len(xa), 256):
                    c, t = shared[at : at + 256], total[at : at + 256]
                    hit = (c > 0) & keep(c, t, sa[at : at + 256, None], sb[None, :])
                    i, j = np.nonzero(hit)
                    a, b, na, nb = xa[at + i], xb[j], sa[at + i], sb[j]
                    if r.blocka == r.blockb:
                        up = a < b
                        i, j, a, b, na, nb = i[up], j[up], a[up], b[up], na[up], nb[up]
                    turn = a > b
                    yield pd.DataFrame({
                        "a": np.where(turn, b, a), "b": np.where(turn, a, b), "shared": c[i, j].astype(np.int64), "total": t[i, j],
                        "na": np.where(turn, nb, na), "nb": np.where(turn, na, nb),
                    })

    kind = facts.schema["node"].dataType.simpleString()
    return left.join(right, F.col("blocka") <= F.col("blockb")).mapInPandas(count, f"a {kind}, b {kind}, shared long, total double, na long, nb long")


def shared_keys(facts: DataFrame, node: str, key: str, max_df: int | None = None, min_shared: int = 1) -> DataFrame:
    """AGG-07, AGG-09, AGG-10: a < b, shared (number of keys in common), keys (sorted). Keys of fewer than 2 or, if it is
    given, more than ``max_df`` nodes are skipped; a key at the limit counts."""
    _, shared = _facts(facts, node, key, max_df)
    return _pairs(shared).groupBy("a", "b").agg(F.count("*").alias("shared"), F.array_sort(F.collect_set("key")).alias("keys")).where(F.col("shared") >= min_shared)


def _unit_cells(at: DataFrame, end: str) -> DataFrame:
    """The units of each key (unit, kids, kid) by cells of a key join: side 'a' or 'b' of pairs of salts (p, q)."""
    salts = F.least(F.ceil(F.count("*") / SALT_UNITS), F.lit(MAX_SALTS)).cast("int")
    at = at.join(at.groupBy("kid").agg(salts.alias("salts")), "kid")
    own, other = ("p", "q") if end == "a" else ("q", "p")
    return at.select("kid", F.col("unit").alias(f"u{end}"), F.col("kids").alias(f"k{end}"), F.pmod(F.xxhash64("unit"), "salts").cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias(other))


def shared_key_texts(facts: DataFrame, node: str, key: str, sep: str = "|") -> DataFrame:
    """AGG-07, AGG-09: a < b, shared, keys as ``shared_keys`` without a limit gives them, the keys joined to one text; for nodes
    of few keys each.

    Nodes with the same keys are one unit (at most about UNIT_NODES of them). Units meet by key, and two that have several keys
    in common are kept at the first of these only, so node pairs are distinct as they come: they are made last, from pairs of
    units, and are never shuffled."""
    spark = facts.sparkSession
    d = cut(_facts(facts, node, key, None)[1])
    # numbered in the order of the keys
    ids = cut(d.select("key").distinct().orderBy("key").withColumn("kid", F.monotonically_increasing_id()))
    sets = cut(d.join(ids, "key").groupBy("node").agg(F.sort_array(F.collect_list("kid")).alias("kids")))
    sizes = sets.groupBy("kids").agg(F.ceil(F.count("*") / UNIT_NODES).alias("parts"))
    unit = sets.join(sizes, "kids").groupBy("kids", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part")).agg(F.collect_list("node").alias("members"))
    unit = cut(unit.select(F.monotonically_increasing_id().alias("unit"), "kids", "members"))
    at = unit.select("unit", "kids", F.explode("kids").alias("kid"))
    pairs = d.select("key", "df").distinct().agg(F.sum(F.col("df") * F.col("df"))).first()[0] or 0
    parts = int(min(4000, max(spark.sparkContext.defaultParallelism * 8, pairs // 40_000_000)))
    cells = ["kid", "p", "q"]
    left, right = (_unit_cells(at, end).repartition(parts, *cells) for end in "ab")
    met = left.join(right.hint("merge"), cells).where("ua <= ub").where(F.get(F.array_intersect("ka", "kb"), F.lit(0)) == F.col("kid")).select("ua", "ub")
    named = unit.select("unit", F.posexplode("kids").alias("i", "kid")).join(ids, "kid").groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("i", F.col("key").cast("string").alias("key")))).alias("names"))
    named = cut(unit.select("unit", "members").join(named.select("unit", F.col("names.key").alias("names")), "unit"))
    small = named.agg(F.sum(F.size("members") + F.size("names"))).first()[0] or 0
    for s in "ab":
        side = named.select(F.col("unit").alias(f"u{s}"), F.col("members").alias(f"m{s}"), F.col("names").alias(f"n{s}"))
        met = met.join(side.hint("broadcast" if small <= BROADCAST_ITEMS else "merge"), f"u{s}")
    both = F.array_intersect("na", "nb")
    met = met.select((F.col("ua") == F.col("ub")).alias("one"), "ma", "mb", F.size(both).cast("long").alias("shared"), F.array_join(both, sep).alias("keys"))
    each = met.select("one", "mb", "shared", "keys", F.explode("ma").alias("x")).select("one", "x", "shared", "keys", F.explode("mb").alias("y")).where("not one or x < y")
    return each.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "shared", "keys")


def jaccard(facts: DataFrame, node: str, key: str, max_df: int | None, min_jaccard: float) -> DataFrame:
    """AGG-08: jaccard = |common| / |union| over keys that aren't more frequent than ``max_df``, if it is given; those are left
    out of both."""
    kept, _ = _facts(facts, node, key, max_df)
    p = block_pairs(kept.withColumn("weight", F.lit(1.0)), lambda shared, _, na, nb: shared / (na + nb - shared) >= min_jaccard)
    return p.select("a", "b", "shared", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("jaccard"))


def _ahead(found: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` best rows of each class."""
    d = found.sort_values(["c", "place", "other"], ascending=[True, False, True])
    return d[d.groupby("c").cumcount() < k]


def jaccard_topk(facts: DataFrame, node: str, key: str, max_df: int | None, min_jaccard: float, k: int) -> tuple[DataFrame, DataFrame]:
    """(kept, all): of the edges of ``jaccard`` those that are among the ``k`` best of either end by jaccard rounded to 9
    decimals, ties to the smaller other end, as (a, b, shared, jaccard); and one row with the number of all edges, ``before``.

    Nodes with the same keys form a class, named by its smallest node. Blocks of classes are compared, each pair in one task,
    which counts the edges and finds each class's k best others: of equally good classes those with the smallest names have the
    smallest nodes. Edges that aren't kept never leave the task; k rows a class and task are shuffled."""
    if k <= 0:
        raise ValueError("k must be positive")
    kept, _ = _facts(facts, node, key, max_df)
    sets = cut(kept.groupBy("node").agg(F.sort_array(F.collect_list("key")).alias("keys")))
    cls = cut(sets.groupBy("keys").agg(F.min("node").alias("c"), F.count("*").alias("m")))
    of = cut(sets.join(cls, "keys").select("node", "c"))
    blocks = max(1, -(-cls.count() // BLOCK))
    packed = cls.select("c", F.explode("keys").alias("key"), "m", F.pmod(F.xxhash64("c"), F.lit(blocks)).cast("int").alias("block")).groupBy("block")
    packed = packed.agg(F.collect_list("c").alias("n"), F.collect_list("key").alias("k"), F.collect_list("m").alias("w"))
    packed = cut(packed.repartition(min(blocks, 128), "block"))
    left, right = (packed.select(*[F.col(c).alias(f"{c}{s}") for c in packed.columns]) for s in "ab")

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, pd.DataFrame] = {}  # by left block, k rows a class
        before = within = 0
        for f in frames:
            for r in f.itertuples(index=False):
                xa, sa, xb, sb, shared, _ = _meet(r.na, r.ka, None, r.nb, r.kb)
                ma, mb = (np.asarray(w)[np.unique(n, return_index=True)[1]].astype(np.float64) for n, w in ((r.na, r.wa), (r.nb, r.wb)))
                floor, parts = np.full(len(xa), -1.0), []
                if (done := best.get(r.blocka)) is not None:
                    worst = done.groupby("c")["place"].agg(["size", "min"])
                    worst = worst[worst["size"] >= k]
                    floor[np.searchsorted(xa, worst.index.to_numpy())] = worst["min"].to_numpy()
                    parts.append(done)
                for at in range(0, len(xa), 256):
                    z = slice(at, at + 256)
                    c = shared[z]
                    j = c / (sa[z, None] + sb[None, :] - c)
                    hit = (c > 0) & (j >= min_jaccard)
                    if r.blocka == r.blockb:
                        hit[np.arange(len(c)), at + np.arange(len(c))] = False
                        within += int(ma[z] @ hit @ mb)
                    elif r.blocka < r.blockb:
                        before += int(ma[z] @ hit @ mb)
                    place = np.where(hit, np.floor(j * 1e9 + 0.5), -1.0)
                    if len(xb) > k and hit.sum() > 4 * k * len(c):
                        floor[z] = np.maximum(floor[z], np.partition(place, len(xb) - k, axis=1)[:, len(xb) - k])
                    x, y = np.nonzero(hit & (place >= floor[z, None]))
                    parts.append(pd.DataFrame({"c": xa[at + x], "place": place[x, y].astype(np.int64), "other": xb[y], "shared": c[x, y].astype(np.int64), "jaccard": j[x, y]}))
                best[r.blocka] = _ahead(pd.concat(parts), k)
        for d in best.values():
            yield d.assign(before=0)
        # pairs of two classes of one block were met from both sides
        yield pd.DataFrame({"c": [None], "place": [0], "other": [None], "shared": [0], "jaccard": [0.0], "before": [before + within // 2]})

    kind = facts.select(node).schema[0].dataType.simpleString()
    # one task holds a left block and a run of right ones
    pairs = left.crossJoin(right.coalesce(1 + blocks // 64).hint("shuffle_replicate_nl"))
    found = cut(pairs.mapInPandas(compare, f"c {kind}, place long, other {kind}, shared long, jaccard double, before long"))
    same = F.expr("m * (m - 1) div 2") if min_jaccard <= 1 else F.lit(0)
    before = found.agg(F.coalesce(F.sum("before"), F.lit(0)).alias("x")).crossJoin(cls.agg(F.coalesce(F.sum(same), F.lit(0)).alias("y"))).select((F.col("x") + F.col("y")).alias("before"))

    def first(df: DataFrame, by: str, end: str, n: int) -> DataFrame:
        order = [F.desc("place"), end] if "place" in df.columns else [end]
        return df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(f"_r <= {n}").drop("_r")

    some = first(of, "c", "node", k + 1)
    others = first(found.where("c is not null"), "c", "other", k).join(some.select(F.col("c").alias("other"), F.col("node").alias("end")), "other")
    cols = ["c", "end", "place", "shared", "jaccard"]
    own = some.join(cls.where("m > 1").select("c", F.size("keys").cast("long").alias("shared")), "c")
    own = own.select("c", F.col("node").alias("end"), F.lit(1_000_000_000).cast("long").alias("place"), "shared", F.lit(1.0).alias("jaccard")).where(F.lit(min_jaccard <= 1))
    # a node is not among its own ends, so a class needs one more
    near = of.join(first(others.select(*cols).unionByName(own), "c", "end", k + 1), "c").where("node <> end")
    edges = first(near, "node", "end", k).groupBy(F.least("node", "end").alias("a"), F.greatest("node", "end").alias("b"))
    return edges.agg(F.max("shared").alias("shared"), F.max("jaccard").alias("jaccard")), before


def coappearance(credits: DataFrame, release: str, artist: str, titles: DataFrame | None = None, max_df: int | None = None) -> DataFrame:
    """AGG-10: artists on one compilation: number of releases and, given ``titles`` (release, title), the sorted titles that
    aren't null."""
    _, shared = _facts(credits, artist, release, max_df)
    p = _pairs(shared)
    if titles is not None:
        p = p.join(titles.select(F.col("release").alias("key"), "title"), "key", "left")
        return p.groupBy("a", "b").agg(F.countDistinct("key").alias("compilations"), F.array_sort(F.collect_set("title")).alias("titles"))
    return p.groupBy("a", "b").agg(F.count("*").alias("compilations"))


def compilation_appearances(track_artists: DataFrame) -> DataFrame:
    """AGG-11: (artist, release, others): the other artists of each release an artist is on, sorted; releases without any are
    left out. Input: (release, artist), where ``artist`` may repeat. One row a release holds its artists once; each artist's
    row takes itself off."""
    d = track_artists.select("release", "artist").where("release is not null and artist is not null").distinct()
    every = d.groupBy("release").agg(F.array_sort(F.collect_list("artist")).alias("every")).where("size(every) > 1")  # artists of one release
    return d.join(every, "release").select("artist", "release", F.array_except("every", F.array("artist")).alias("others"))


def enrichment(styles: DataFrame, personnel: DataFrame, labels: DataFrame) -> DataFrame:
    """AGG-11: per artist the sorted distinct styles, the people with their sorted roles, and the labels with the first id each
    name has. Inputs: (artist, style), (artist, person, role), (artist, label, label_id, ord). Compilations come from
    ``compilation_appearances``."""
    s = styles.groupBy("artist").agg(F.array_sort(F.collect_set("style")).alias("styles"))
    p = personnel.groupBy("artist", "person").agg(F.array_sort(F.collect_set("role")).alias("roles"))
    p = p.groupBy("artist").agg(F.array_sort(F.collect_list(F.struct("person", "roles"))).alias("personnel"))
    lab = labels.groupBy("artist", "label").agg(F.min_by("label_id", "ord").alias("label_id"))
    lab = lab.groupBy("artist").agg(F.array_sort(F.collect_list(F.struct("label", "label_id"))).alias("labels"))
    return s.join(p, "artist", "full_outer").join(lab, "artist", "full_outer")


def capped_sorted(facts: DataFrame, node: str, value: str, n: int = 5) -> DataFrame:
    """TOP-09: the alphabetically first ``n`` distinct values of each node."""
    d = facts.select(node, value).where(F.col(value).isNotNull()).distinct()
    r = d.withColumn("_r", F.row_number().over(Window.partitionBy(node).orderBy(value))).where(f"_r <= {n}")
    return r.groupBy(node).agg(F.array_sort(F.collect_list(value)).alias("values"))
