"""Seeded samples and over-fetching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def seeded(seed: int, *cols: str | Column) -> Column:
    """A draw that depends on the row's key and the seed only, so a sample is the same on any cluster: hex digits."""
    return F.md5(F.concat_ws("|", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols], F.lit(str(seed))))


def pick(n: Column, seed: int, *cols: str | Column) -> Column:
    """A number from 0 below ``n`` by such a draw."""
    return F.pmod(F.conv(F.left(seeded(seed, *cols), F.lit(8)), 16, 10).cast("long"), n.cast("long")).cast("int")


def random_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """TOP-04, TOP-06: n rows at random."""
    return df.orderBy(seeded(seed, key), key).limit(n)


def stratified(df: DataFrame, cell: list[str], key: list[str], n: int, seed: int = 42) -> DataFrame:
    """WIN-07, TOP-08: up to ``n`` rows at random of each cell."""
    w = Window.partitionBy(*cell).orderBy(seeded(seed, *key), *key)
    return df.withColumn("draw", F.row_number().over(w)).where(f"draw <= {n}")


def overfetch(ranked: DataFrame, key: str, order: list[Column | str], mapping: DataFrame, on: str, n: int, factor: int = 2) -> DataFrame:
    """TOP-07: the best ``factor`` x ``n`` rows of each key, those that ``mapping`` (on, ...) knows, cut to ``n`` again."""
    w = Window.partitionBy(key).orderBy(*order)
    wide = ranked.withColumn("_r", F.row_number().over(w)).where(f"_r <= {n * factor}").drop("_r")
    return wide.join(mapping, on).withColumn("rank", F.row_number().over(w)).where(f"rank <= {n}")


def label_sheet(pools: list[DataFrame], key: str, withheld: list[str], seed: int = 42) -> DataFrame:
    """EXP-09: pools united, shuffled by seed, numbered R0001.. without the answer columns. Numbers come from ranges of the draw
    (``sinks.assign_ids``), so no task sorts all rows."""
    from playgraph.sources.sinks import assign_ids

    u = pools[0]
    for p in pools[1:]:
        u = u.unionByName(p)
    u = u.withColumn("_draw", F.concat_ws("|", seeded(seed, key), F.col(key).cast("string")))
    n = assign_ids(u, "_draw").select(F.col("id").alias("_n"), F.col("name").alias("_draw"))
    return u.join(n, "_draw").withColumn("row_id", F.format_string("R%04d", "_n")).drop("_n", "_draw", *withheld)


def pending(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """EXP-10, SRC-12, GRF-23: work whose key is not among the done ones."""
    return todo.join(done.select(*keys), keys, "left_anti")


#: The two voice descriptors, each the other's opposite.
VOICE_FLIP = {"instrumental": "vocal-forward", "vocal-forward": "instrumental"}


def _of_another(genre: Column):
    return lambda p: ~p["g"].eqNullSafe(genre)


def corrupt(rows: DataFrame, key: str, seed: int = 42, pool_per_genre: int = 20) -> DataFrame:
    """GRF-22: one controlled corruption of a pair of profiles. ``rows``: ``key`` and, for source and target, ``{side}_voice``,
    ``{side}_styles`` (array) and ``{side}_genre``. Feasible are, on either side: ``voice_instrumental`` where the descriptor is
    one of the two, flipping it; ``outlier_styles`` where there are styles and another genre's styles to put in their place;
    ``genre_swap`` where there is a genre and another one to take. One of the feasible (side, strategy) is drawn by the row's
    key; rows without any have null in both and are unchanged.

    The other genres' styles are drawn from up to ``pool_per_genre`` seeded style lists a genre, as the pool is sent to every
    task; genres are a small category."""
    sides = ("source", "target")
    seen = rows.select(F.col("source_genre").alias("g"), F.col("source_styles").alias("s")).unionByName(rows.select(F.col("target_genre").alias("g"), F.col("target_styles").alias("s")))
    genres = seen.where("g is not null").agg(F.array_sort(F.collect_set("g")).alias("_genres"))
    keyed = seen.where("g is not null and size(s) > 0").select("g", "s", F.array_join("s", "|").alias("k")).distinct()
    lists = stratified(keyed, ["g"], ["k"], pool_per_genre, seed).agg(F.array_sort(F.collect_list(F.struct("g", "k", "s"))).alias("_pool"))
    # two rows of one cell each: the genres and the pool
    d = rows.crossJoin(F.broadcast(genres)).crossJoin(F.broadcast(lists))
    ways = []
    for side in sides:
        voice, styles, genre = (F.col(f"{side}_{c}") for c in ("voice", "styles", "genre"))
        other = F.exists("_pool", _of_another(genre))
        ways += [
            F.when(voice.isin(*VOICE_FLIP), F.lit(f"{side}:voice_instrumental")),
            F.when((F.size(styles) > 0) & other, F.lit(f"{side}:outlier_styles")),
            F.when((genre != "") & (F.size(F.array_except("_genres", F.array(genre))) > 0), F.lit(f"{side}:genre_swap")),
        ]
    d = d.withColumn("_ways", F.array_compact(F.array(*ways)))
    d = d.withColumn("_way", F.when(F.size("_ways") > 0, F.element_at("_ways", pick(F.greatest(F.size("_ways"), F.lit(1)), seed, key) + 1)))
    flip = F.create_map(*[F.lit(x) for kv in VOICE_FLIP.items() for x in kv])
    out = {"side": F.split_part("_way", F.lit(":"), F.lit(1)), "strategy": F.split_part("_way", F.lit(":"), F.lit(2))}
    for side in sides:
        voice, styles, genre = (F.col(f"{side}_{c}") for c in ("voice", "styles", "genre"))
        way = lambda s, side=side: F.coalesce(F.col("_way") == f"{side}:{s}", F.lit(False))
        rest = F.array_except("_genres", F.array(genre))
        pool = F.filter("_pool", _of_another(genre))
        out[f"{side}_voice"] = F.when(way("voice_instrumental"), F.element_at(flip, voice)).otherwise(voice)
        out[f"{side}_styles"] = F.when(way("outlier_styles"), F.element_at(pool, pick(F.greatest(F.size(pool), F.lit(1)), seed + 1, key) + 1)["s"]).otherwise(styles)
        out[f"{side}_genre"] = F.when(way("genre_swap"), F.element_at(rest, pick(F.greatest(F.size(rest), F.lit(1)), seed + 1, key) + 1)).otherwise(genre)
    return d.withColumns(out).drop("_genres", "_pool", "_ways", "_way")


def band_risk(pairs: DataFrame) -> DataFrame:
    """EXP-03: risk of a pair as four terms: mean plays (over 1000: 1, over 500: a half), the poorer side's richness (none: 1,
    below 3: a half), the most styles (over 20: 1, over 10: a half), and 1 for different genres (a null is one of its own)."""
    plays = (F.col("plays_a") + F.col("plays_b")) / 2
    rich, styles = F.least("rich_a", "rich_b"), F.greatest("styles_a", "styles_b")
    over = lambda c, most, some: F.when(c > most, 1.0).when(c > some, 0.5).otherwise(0.0)
    poor = F.when(rich == 0, 1.0).when(rich < 3, 0.5).otherwise(0.0)
    return pairs.withColumn("risk", over(plays, 1000, 500) + poor + over(styles, 20, 10) + F.when(F.col("genre_a").eqNullSafe(F.col("genre_b")), 0.0).otherwise(1.0))


def pair_cells(nodes: DataFrame, direct: DataFrame, indirect: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """TOP-08: up to ``n`` pairs at random of each of 2 x 2 x 2 x 2 cells: fame, richness (both ends alike), same or cross genre,
    direct edge or none. ``nodes``: id, genre, fame, richness of the eligible ones; ``direct`` and ``indirect``: (x, y), x < y;
    a pair with an edge is no indirect one."""
    a = nodes.select(F.col("id").alias("x"), F.col("genre").alias("gx"), "fame", "richness")
    b = nodes.select(F.col("id").alias("y"), F.col("genre").alias("gy"), F.col("fame").alias("fy"), F.col("richness").alias("ry"))
    kinds = direct.select("x", "y", F.lit("DIRECT").alias("edge")).unionByName(indirect.select("x", "y", F.lit("INDIRECT").alias("edge"))).distinct()
    j = kinds.join(a, "x").join(b, "y").where("fame = fy and richness = ry")
    j = j.withColumn("genre", F.when(F.col("gx") == F.col("gy"), "SAME").otherwise("CROSS"))
    return stratified(j, ["fame", "richness", "genre", "edge"], ["x", "y"], n, seed).select("fame", "richness", "genre", "edge", "x", "y", "draw")


def connected_candidates(nodes: DataFrame, edges: DataFrame, a: str, b: str, least: int, n: int, seed: int = 42) -> DataFrame:
    """EXP-04: up to ``n`` nodes at random among those with at least ``least`` distinct partners."""
    from playgraph.operators.graph import degree

    d = degree(edges, a, b).where(F.col("degree") >= least).select(F.col("node").alias("id"), "degree")
    return random_rows(nodes.join(d, "id"), "id", n, seed)
