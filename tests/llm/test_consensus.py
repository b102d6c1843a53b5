import random

from playgraph.llm import consensus as cons
from tests.util import rows

SCHEMA = "row_id string, labeler string, severity string, failure_mode string, updated_at timestamp"


def simulate(seed, items=150):
    r = random.Random(seed)
    skill = {f"w{i}": s for i, s in enumerate([0.95, 0.9, 0.85, 0.8, 0.45, 0.4, 0.35, 0.35, 0.3])}
    truth, edges = {}, []
    for i in range(items):
        t = truth[f"r{i}"] = r.choice(cons.SEVERITIES)
        for w in r.sample(sorted(skill), 5):
            edges.append((f"r{i}", w, t if r.random() < skill[w] else r.choice([s for s in cons.SEVERITIES if s != t])))
    return truth, edges, skill


def test_better_than_majority_and_labelers_in_order(spark):
    truth, edges, skill = simulate(5)
    v, who = cons.consensus(spark.createDataFrame(edges, "item string, labeler string, value string"), cons.SEVERITIES)
    got = {r["item"]: r["value"] for r in v.collect()}
    assert set(got) == set(truth)

    def majority(i):
        mine = [v for j, _, v in edges if j == i]
        return max(cons.SEVERITIES, key=lambda c: (mine.count(c), -cons.SEVERITIES.index(c)))

    right = sum(got[i] == t for i, t in truth.items())
    plain = sum(majority(i) == t for i, t in truth.items())
    assert right > plain and right / len(truth) > 0.85
    rel = {r["labeler"]: r["reliability"] for r in who.collect()}
    assert min(rel[w] for w in skill if skill[w] > 0.75) > max(rel[w] for w in skill if skill[w] < 0.5)


def test_chance_corrected_agreement_and_convergence(spark):
    edges = [("x", "a", "minor"), ("x", "b", "minor"), ("y", "a", "severe"), ("y", "b", "minor"), ("z", "c", "severe")]
    v, _ = cons.consensus(spark.createDataFrame(edges, "item string, labeler string, value string"), cons.SEVERITIES)
    got = {r["item"]: r for r in v.collect()}
    chance = (2 / 5) ** 2 + (3 / 5) ** 2
    assert abs(got["x"]["kappa"] - 1) < 1e-9 and abs(got["y"]["kappa"] + chance / (1 - chance)) < 1e-9 and got["z"]["kappa"] is None
    assert all(r["rounds"] < 100 and r["moved"] <= 1e-3 for r in got.values())


def test_latest_label_spellings_and_nulls(spark):
    data = [
        ("r", " A ", "Not-Wrong ", "", "2025-01-02 00:00:00"), ("r", "a", "severe", "other", "2025-01-01 00:00:00"),
        ("r", "b", "severe", "dj intent", None), ("r", "b", "MINOR", "DJ-INTENT", "2025-01-01 00:00:00"), ("r", "b", "MINOR", "DJ-INTENT", "2025-01-01 00:00:00"),
        ("r", "c", "n/a", None, "2025-01-03 00:00:00"), ("r", "c", "severe", None, "2025-01-02 00:00:00"), ("r", " ", "severe", None, None), (None, "d", "severe", None, None), ("r", None, "severe", None, None),
    ]
    df = spark.createDataFrame(data, SCHEMA.replace("timestamp", "string")).selectExpr("row_id", "labeler", "severity", "failure_mode", "cast(updated_at as timestamp) updated_at", "1 as item", "2 as at")
    got = cons.latest_labels(df, "row_id", "labeler", "severity", "updated_at", cons.SEVERITIES, ["failure_mode"])
    assert rows(got) == [("r", "a", "not_wrong", ""), ("r", "b", "minor", "dj_intent")]


def test_empty_one_edge_and_ties(spark):
    schema = "item string, labeler string, value string"
    v, who = cons.consensus(spark.createDataFrame([], schema), cons.SEVERITIES)
    assert rows(v) == [] and rows(who) == []
    v, _ = cons.consensus(spark.createDataFrame([("x", "a", "minor")], schema), cons.SEVERITIES)
    assert [(r["item"], r["value"], r["n_labels"], r["agreement"]) for r in v.collect()] == [("x", "minor", 1, 1.0)]
    v, _ = cons.consensus(spark.createDataFrame([("x", "a", "minor"), ("x", "b", "severe")], schema), cons.SEVERITIES)
    assert rows(v, "value") == [("severe",)]
