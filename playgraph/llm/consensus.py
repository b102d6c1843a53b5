"""Consensus from several annotators' labels (problem 7): one-against-the-rest message passing on the label edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from playgraph.session import cut

#: The rubric's spellings.
SEVERITIES = ["severe", "minor", "not_wrong"]
#: What is expected of an annotator before any label: weighs as much as two items.
HIT, FALSE_HIT = 0.75, 0.15
FAILURE_MODES = ["subject_hallucination", "neighbor_characterization", "dj_intent", "data_noise", "other"]


def spelled(col: str):
    """The rubric's spelling of a value however written: trimmed, lower case, spaces and hyphens as underscores."""
    return F.regexp_replace(F.lower(F.trim(F.col(col))), r"[\s\-_]+", "_")


def latest_labels(df: DataFrame, item: str, labeler: str, value: str, at: str, classes: list[str], extra: list[str] | None = None) -> DataFrame:
    """item, labeler, value (+ extra): of each labeler's labels of an item the latest, if its value is one of ``classes``.
    Labelers are told apart after trimming and lower-casing; of labels of one time the smallest value stands; a label
    without a time is the oldest; null items and null or blank labelers don't count."""
    cols = [value, *(extra or [])]
    d = df.select(
        F.col(item).alias("item"), F.lower(F.trim(F.col(labeler))).alias("labeler"), F.col(at).alias("at"), *[spelled(c).alias(f"v{i}") for i, c in enumerate(cols)]
    ).where("item is not null and labeler <> ''")
    w = Window.partitionBy("item", "labeler").orderBy(F.desc_nulls_last("at"), *[F.asc_nulls_last(f"v{i}") for i in range(len(cols))])
    d = d.withColumn("r", F.row_number().over(w)).where("r = 1").where(F.col("v0").isin(classes))
    return d.select("item", "labeler", *[F.col(f"v{i}").alias(n) for i, n in enumerate(["value", *(extra or [])])])


def consensus(labels: DataFrame, classes: list[str], max_iter: int = 100, tol: float = 1e-3, smooth: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """``labels``: item, labeler, value, one row per edge. Returns (verdicts, labelers).

    verdicts: item, value, belief, n_labels, agreement (share of labels equal to the verdict), kappa (how much more often two
    of the item's labels agree than two labels of all items would by chance, 1 at most; null for a single label), rounds and
    moved (how many rounds the messages took, and the largest change of a belief in the last one).
    labelers: labeler, value, n_labels, hit (of items believed to be ``value``, the share labelled so), false_hit (of the
    others), reliability (expected share of the labeler's labels that are right).

    Each class is judged against the rest on the bipartite label graph. An annotator-to-item message is the log-likelihood
    ratio of the annotator's label under hit and false-hit rates estimated from all OTHER items; an item-to-annotator message
    is the belief from all OTHER annotators' messages plus the class's prior. Messages run until no belief moves by more than
    ``tol``; should that take more than ``max_iter`` rounds, ``moved`` shows it. Sums per item and annotator are partial aggregates, so an annotator or item with a
    third of all edges is never gathered in one task; an edge's own share is taken off the sum.

    Ties between classes fall to the class named first. No labels give empty results. Repeated edges must be removed before
    (``latest_labels`` does)."""
    one = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(c).alias("class")) for i, c in enumerate(classes)])
    edges = labels.where(F.col("value").isin(classes)).select("item", "labeler", "value")
    edges = edges.select("*", F.explode(one).alias("c")).select("item", "labeler", "c.k", (F.col("value") == F.col("c.class")).cast("double").alias("x"))
    # start: the leave-one-out vote share
    votes = edges.groupBy("item", "k").agg(F.count("*").alias("n"), F.sum("x").alias("s"))
    state = cut(edges.join(votes, ["item", "k"]).select("item", "labeler", "k", "x", ((F.col("s") - F.col("x") + 1 / len(classes)) / F.col("n")).alias("b")))
    rounds, moved = 0, None
    for rounds in range(1, max_iter + 1):
        sums = state.groupBy("labeler", "k").agg(
            F.sum("b").alias("pos"), F.sum(F.col("b") * F.col("x")).alias("pos_x"), F.sum(1 - F.col("b")).alias("neg"), F.sum((1 - F.col("b")) * F.col("x")).alias("neg_x")
        )
        # means over all annotators: the smoothing prior of an annotator, and the class's share of items; a row a class
        pos, neg = F.sum("pos"), F.sum("neg")
        means = sums.groupBy("k").agg(
            ((F.sum("pos_x") + 2 * HIT) / (pos + 2)).alias("hit0"), ((F.sum("neg_x") + 2 * FALSE_HIT) / (neg + 2)).alias("false0"), (pos / F.greatest(pos + neg, F.lit(1e-9))).alias("share")
        )
        sums = sums.join(F.broadcast(means), "k")
        clip = lambda c: F.least(F.greatest(c, F.lit(0.02)), F.lit(0.98))
        b, x = F.col("b"), F.col("x")
        hit = clip((F.col("pos_x") - b * x + smooth * F.col("hit0")) / (F.col("pos") - b + smooth))
        miss = clip((F.col("neg_x") - (1 - b) * x + smooth * F.col("false0")) / (F.col("neg") - (1 - b) + smooth))
        up = F.when(x > 0, F.log(hit / miss)).otherwise(F.log((1 - hit) / (1 - miss)))
        share = clip(F.col("share"))
        sent = state.join(sums, ["labeler", "k"]).select("item", "labeler", "k", "x", "b", up.alias("m"), F.log(share / (1 - share)).alias("logit"))
        total = sent.groupBy("item", "k").agg(F.sum("m").alias("all"), F.max("logit").alias("logit")).select("item", "k", (F.col("all") + F.col("logit")).alias("all"))
        nxt = sent.drop("logit").join(total, ["item", "k"]).select("item", "labeler", "k", "x", b.alias("was"), (1 / (1 + F.exp(-(F.col("all") - F.col("m"))))).alias("b"), "all")
        # cut every round: the plan stays that of one round, so its compiled code is used again
        state = cut(nxt)
        moved = state.agg(F.max(F.abs(F.col("b") - F.col("was"))).alias("m")).first()["m"]
        if moved is None or moved <= tol:
            break
    names = F.array(*[F.lit(c) for c in classes])
    per = state.groupBy("item", "k").agg(F.max("all").alias("all"), F.count("*").alias("n"), F.sum("x").alias("votes"))
    top = F.max(F.struct(F.round("all", 9).alias("all"), (-F.col("k")).alias("nk"), "n", "votes")).alias("t")
    norm = F.sum(F.exp(F.col("all") - F.col("top"))).alias("z")
    # agreement of two labels of an item against that of two labels at large: one row
    shares = per.groupBy("k").agg(F.sum("votes").alias("v"))
    chance = shares.agg((F.sum(F.col("v") * F.col("v")) / (F.sum("v") * F.sum("v"))).alias("chance"))
    pairwise = F.sum(F.col("votes") * (F.col("votes") - 1)) / (F.max("n") * (F.max("n") - 1))
    best = per.withColumn("top", F.max("all").over(Window.partitionBy("item"))).groupBy("item").agg(top, norm, F.when(F.max("n") > 1, pairwise).alias("same")).crossJoin(F.broadcast(chance))
    verdicts = best.select(
        "item", F.element_at(names, 1 - F.col("t.nk")).alias("value"), (1 / F.col("z")).alias("belief"), F.col("t.n").alias("n_labels"), (F.col("t.votes") / F.col("t.n")).alias("agreement"),
        F.when(F.col("chance") < 1, (F.col("same") - F.col("chance")) / (1 - F.col("chance"))).otherwise(F.col("same")).alias("kappa"), F.lit(rounds).alias("rounds"), F.lit(moved).cast("double").alias("moved"),
    )
    full = state.withColumn("p", 1 / (1 + F.exp(-F.col("all"))))
    labelers = full.groupBy("labeler", "k").agg(
        F.count("*").alias("n_labels"),
        (F.sum(F.col("p") * F.col("x")) / F.greatest(F.sum("p"), F.lit(1e-9))).alias("hit"),
        (F.sum((1 - F.col("p")) * F.col("x")) / F.greatest(F.sum(1 - F.col("p")), F.lit(1e-9))).alias("false_hit"),
        F.sum(F.col("p") * F.col("x")).alias("right"),
    )
    labelers = labelers.withColumn("reliability", F.sum("right").over(Window.partitionBy("labeler")) / F.col("n_labels"))
    return verdicts, labelers.select("labeler", F.element_at(names, F.col("k") + 1).alias("value"), "n_labels", "hit", "false_hit", "reliability")
