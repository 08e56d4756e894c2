import numpy as np
import pytest
from pyspark.sql import functions as F

from opinara.operators import models as M
from opinara.plans import retraining
from opinara.schema import LABELS


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    centers = np.array([[2.0, 0.0, 0.0], [0.0, 2.0, 0.0], [0.0, 0.0, 2.0]])
    names = ["negative", "neutral", "positive"]
    data = []
    for i in range(450):
        c = 0 if i % 10 < 2 else (1 if i % 10 < 4 else 2)
        data.append((i, "ab"[i % 2], names[c], [float(x) for x in centers[c] + rng.normal(0, 0.5, 3)]))
    return spark.createDataFrame(data, "id int, category string, label string, features array<float>").cache()


@pytest.fixture(scope="module")
def halves(rows):
    return rows.filter("id DIV 10 % 5 != 0"), rows.filter("id DIV 10 % 5 = 0")


@pytest.mark.parametrize(
    "fit",
    [M.logistic, lambda t: M.perceptron(t, hidden=(8, 4)), lambda t: M.boosted_trees(t, trees=3, depth=3),
     lambda t: M.calibrated_svc(t, max_iter=4)],
    ids=["logistic", "perceptron", "trees", "svc"],
)
def test_models_learn(halves, fit):
    train, test = halves
    predictions = fit(train)(test)
    assert M.metrics(predictions).first()["macro_f1"] > 0.85
    total = F.col("prob_negative") + F.col("prob_neutral") + F.col("prob_positive")
    assert predictions.filter(F.abs(total - 1) > 1e-6).isEmpty() and predictions.count() == test.count()


def quick(train):
    return M.logistic(train, max_iter=5)


def test_experiments(spark, halves):
    train, test = halves
    table = M.compare_models({"a": M.logistic(train), "b": M.logistic(train, max_iter=1)}, test)
    assert {r["model"] for r in table.collect()} == {"a", "b"}
    registry = train.select("id", F.lit("true_model_wrong_negative").alias("audit_status"), F.lit("").alias("notes")).filter("id < 100")
    held = test.withColumn("eval_set", F.when((F.col("label") == "neutral") & (F.col("id") % 2 == 0), "frozen").otherwise("test"))
    swept = M.upweight_sweep(train, held, registry, factors=(4.0,), floor=0.5, fit=quick).first()
    assert swept["satisfied_floor"] and swept["frozen_recall"] > 0
    blocked = M.upweight_sweep(train, held, registry, factors=(4.0,), floor=1.1, fit=quick).first()
    assert not blocked["satisfied_floor"] and blocked["negative_recall"] is None
    curve = M.quality_vs_quantity(train.filter("id < 100"), train.filter("id >= 100"), test, sizes=(40,), max_iter=5).collect()
    assert {(r["training"], r["train_size"]) for r in curve} >= {("verified_only", 40), ("raw_only", 40), ("raw_ten_times", 280)}
    per = M.category_curves(train, test, ["a", "b", "missing"], fractions=(0.5, 1.0), minimum=(50, 10, 10), max_iter=5)
    assert sorted((r["category"], r["train_size"]) for r in per.collect()) == [("a", 90), ("a", 180), ("b", 90), ("b", 180)]


def test_retraining_round(spark, halves):
    train, test = halves
    hard = (F.col("label") == "neutral") & (F.col("id") % 2 == 0)
    dataset = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.when(hard, "frozen").otherwise("test")))
    dataset = dataset.select(F.col("id").alias("review_id"), "label", "split", "features")
    votes = train.filter("id < 20").select(
        F.col("id").alias("review_id"), F.explode(F.array(F.lit("s"), F.lit("t"))).alias("s"), F.col("label").alias("manual_label")
    )
    votes = votes.select(
        "review_id", F.concat("s", (F.col("review_id") % 7).cast("string")).alias("session_id"), "manual_label",
        F.lit("2025-01-01").alias("date"), F.lit(0.2).alias("confidence_margin"),
    )
    fresh = votes.withColumn("review_id", F.col("review_id") + 1000)
    routed = retraining.verdicts(votes.unionByName(fresh), dataset.select("review_id"), ["date", "session_id"])
    vectors = train.select(F.concat(F.lit("new_"), (F.col("id") + 1000).cast("string")).alias("id"), "features")
    predict, gate = retraining.retrain(dataset, routed, vectors)
    row = gate.first()
    assert row["negative_recall"] > 0.7 and row["publish"] in (True, False)
    assert predict(test).count() == test.count()


def test_trained_weights_reach_the_scorer(spark, tmp_path):
    from opinara.functions.vectors import review_scorer
    from opinara.plans import retraining
    from opinara.sources import tables

    rows = [(k, LABELS[k % 3], [float(k % 3 == 0), float(k % 3 == 1), float(k % 3 == 2), 0.1 * (k % 5)]) for k in range(90)]
    train = spark.createDataFrame(rows, "id long, label string, features array<float>")
    predict, weights = M.trained(train, hidden=(6, 4), max_iter=40)
    path = str(tmp_path / "weights")
    gate = spark.createDataFrame([(True,), (False,)], "publish boolean")
    assert not retraining.publish(spark, weights, gate.where("NOT publish"), path)
    assert retraining.publish(spark, weights, gate.where("publish"), path)
    stored = tables.read_weights(spark, path)
    own = {r.id: r for r in predict(train).collect()}
    for r in M.by_weights(stored)(train).collect():
        assert all(abs(r[f"prob_{n}"] - own[r.id][f"prob_{n}"]) < 1e-9 for n in LABELS)
    scorer = review_scorer(spark, stored, positive=0.0, negative=0.0)
    scored = train.select("label", scorer(F.col("features")).alias("s")).collect()
    assert sum(r.label == r.s.sentiment for r in scored) >= 85
    other, _ = M.trained(train, hidden=(5,), max_iter=1)
    kept = tables.read_weights(spark, path)
    assert [w.shape for w, _ in kept.layers] == [(4, 6), (6, 4), (4, 3)]


def test_fits_of_one_model_run_side_by_side(spark):
    import threading

    from opinara.session import at_once

    meet = threading.Barrier(3, timeout=30)  # breaks unless all three are there together
    assert at_once(spark, [lambda k=k: (meet.wait(), spark.range(k).count())[1] for k in (3, 1, 2)]) == [3, 1, 2]
    assert at_once(spark, []) == []
