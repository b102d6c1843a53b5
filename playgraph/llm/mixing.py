"""Mixing sources to target weights (problem 9): budgets fitted by subset sums over exact token lengths."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from playgraph.session import cut

#: The part of a source's budget that is left to the exact subset sum, in tokens at most.
DP_TOKENS = 65_536
#: Ranges of the seeded hash that a group of equal lengths is ranked in.
RANK_BUCKETS = 64


def fit_budget(lengths: list[int], counts: list[int], budget: int, dp_tokens: int = DP_TOKENS) -> list[int]:
    """How many documents of each length to take so that their tokens come as near below ``budget`` as can be: in proportion
    to the counts up to the last ``dp_tokens`` tokens, the rest by a bounded-knapsack subset sum over what remains."""
    total = sum(x * c for x, c in zip(lengths, counts))
    if budget >= total:
        return list(counts)
    room = max(0, budget - dp_tokens)
    take = [c * room // total for c in counts] if total else [0] * len(counts)
    left = budget - sum(x * t for x, t in zip(lengths, take))
    # shares rounded down leave one document a length and more: add by largest remainder while more than the DP's part is left
    order = sorted(range(len(lengths)), key=lambda i: (-(counts[i] * room % total), -lengths[i]))
    while left > dp_tokens:
        moved = False
        for i in order:
            if left > dp_tokens and take[i] < counts[i] and lengths[i] <= left:
                take[i] += 1
                left -= lengths[i]
                moved = True
        if not moved:
            break
    free = [c - t for c, t in zip(counts, take)]
    # subset sum: bit j of ``reach`` is set if j tokens can be met; bounded counts are split into powers of two
    stages: list[tuple[int, int, int]] = []
    reach, mask = 1, (1 << (left + 1)) - 1
    for i, (x, c) in enumerate(zip(lengths, free)):
        k = 1
        c = min(c, left // x)
        while c > 0:
            k = min(k, c)
            nxt = (reach | (reach << (k * x))) & mask
            if nxt != reach:
                stages.append((i, k, reach))
                reach = nxt
            c -= k
            k *= 2
            if reach >> left & 1:
                break
        if reach >> left & 1:
            break
    at = reach.bit_length() - 1
    for i, k, before in reversed(stages):
        if not before >> at & 1:
            at -= k * lengths[i]
            take[i] += k
    return take


def mix(docs: DataFrame, id_col: str, source_col: str, size_col: str, targets: DataFrame, seed: int = 0, budget: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Returns (selection, shares).

    selection: doc_id, source, n_tokens, repeats (1..max_repeat). shares: source, target_share, max_repeat, documents,
    available, budget, tokens, actual_share.

    The budget is the largest total at which every source that has documents can give its target share with at most its
    ``max_repeat`` uses of each document, or ``budget`` if smaller. A source's part is met by whole passes over its documents
    and, for what remains, by counting documents by exact token length, fitting the remainder by subset sum, and choosing
    among the documents of one length by a seeded hash. Sizes meet in a histogram per source, so the fit's input is bounded by
    the longest document, not by the corpus; a length that a third of all documents share is ranked in hash ranges.

    Defined cases: documents of null or no size, null source or unknown source are not chosen; a source without documents or
    with a null or non-positive share gets 0, and the others' shares are of what remains (both are reported); a null
    ``max_repeat`` counts as 1, less than 1 as 0; of repeated target rows the largest share stands; empty tables give empty
    results; columns besides those named are ignored."""
    spark = docs.sparkSession
    t = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max(F.coalesce("max_repeat", F.lit(1))).alias("max_repeat"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), F.col(size_col).cast("long").alias("n_tokens")).where("n_tokens > 0 and source is not null")
    rows = cut(rows.join(F.broadcast(t.select("source")), "source", "left_semi") if t.count() < 100_000 else rows.join(t.select("source"), "source", "left_semi"))
    histogram = cut(rows.groupBy("source", "n_tokens").agg(F.count("*").alias("c")))
    have = histogram.groupBy("source").agg(F.sum("c").alias("documents"), F.sum(F.col("c") * F.col("n_tokens")).alias("available"))
    plan = t.join(have, "source", "left").na.fill(0, ["documents", "available"])
    plan = plan.withColumn("can", F.col("available") * F.greatest("max_repeat", F.lit(0)))
    live = F.col("can").cast("boolean") & (F.col("target_share") > 0)
    plan = cut(plan.withColumn("share", F.when(live, F.col("target_share")).otherwise(0.0)))
    sums = plan.agg(F.sum("share").alias("s"), F.min(F.when(F.col("share") > 0, F.col("can") / F.col("share"))).alias("m")).first()
    norm = float(sums["s"] or 0)
    total = int((sums["m"] or 0) * norm + 1e-6)
    if budget is not None:
        total = min(total, int(budget))
    plan = plan.withColumn("budget", F.when(F.col("share") > 0, F.floor(F.col("share") / F.lit(norm or 1.0) * total + 1e-9)).otherwise(0).cast("long"))
    passes = F.when(F.col("available") > 0, F.floor(F.col("budget") / F.col("available"))).otherwise(0).cast("long")
    plan = plan.withColumn("passes", passes).withColumn("rest", F.col("budget") - F.col("passes") * F.col("available"))

    def fit(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("n_tokens")
        take = fit_budget(f["n_tokens"].tolist(), f["c"].tolist(), int(f["rest"].iloc[0]))
        return pd.DataFrame({"source": f["source"], "n_tokens": f["n_tokens"], "passes": f["passes"], "take": take})

    fitted = cut(histogram.join(plan.select("source", "passes", "rest"), "source").groupBy("source").applyInPandas(fit, "source string, n_tokens long, passes long, take long"))
    # the first ``take`` documents of a length by seeded hash: ranks within hash ranges, plus the ranges before
    ranked = rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("b", F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * RANK_BUCKETS).cast("int"))
    before = ranked.groupBy("source", "n_tokens", "b").agg(F.count("*").alias("c"))
    before = before.withColumn("before", F.sum("c").over(Window.partitionBy("source", "n_tokens").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))).na.fill(0, ["before"])
    need = before.join(fitted, ["source", "n_tokens"]).select("source", "n_tokens", "b", "before", "passes", "take")
    local = Window.partitionBy("source", "n_tokens", "b").orderBy("h", "doc_id")
    out = ranked.withColumn("r", F.row_number().over(local)).join(need, ["source", "n_tokens", "b"])
    out = out.withColumn("repeats", (F.col("passes") + (F.col("before") + F.col("r") <= F.col("take")).cast("long")).cast("int")).where("repeats > 0")
    selection = cut(out.select("doc_id", "source", "n_tokens", "repeats"))
    got = selection.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"))
    shares = plan.join(got, "source", "left").na.fill(0, ["tokens"])
    shares = shares.withColumn("actual_share", F.coalesce(F.try_divide(F.col("tokens").cast("double"), F.sum("tokens").over(Window.partitionBy(F.lit(1)))), F.lit(0.0)))
    return selection, shares.select("source", "target_share", "max_repeat", "documents", "available", "budget", "tokens", "actual_share")
