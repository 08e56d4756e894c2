import pytest
from pyspark.sql import functions as F

from opinara.operators import evaluation as E


@pytest.fixture(scope="module")
def predictions(spark):
    a = (F.col("id") * 37) % 101 + 1
    b = (F.col("id") * 53) % 97 + 1
    c = (F.col("id") * 71) % 89 + 1
    rows = spark.range(2000).select(
        "id", F.lit("x").alias("category"), (F.col("id") % 3).cast("int").alias("y"),
        *[(part / (a + b + c)).alias(f"prob_{n}") for part, n in ((a, "negative"), (b, "neutral"), (c, "positive"))],
    )
    return E.with_prediction(rows).cache()


def brute(rows, decide):
    cells = [[0] * 3 for _ in range(3)]
    for r in rows:
        cells[r["y"]][decide(r)] += 1
    recall = [cells[c][c] / sum(cells[c]) if sum(cells[c]) else 0 for c in range(3)]
    f1 = []
    for c in range(3):
        both = sum(cells[c]) + sum(row[c] for row in cells)
        f1.append(2 * cells[c][c] / both if both else 0)
    return sum(f1) / 3, recall


def test_metrics_against_brute_force(predictions):
    macro, recall = brute(predictions.collect(), lambda r: r["pred"])
    got = E.overall(E.confusion(predictions)).first()
    assert got["macro_f1"] == pytest.approx(macro, abs=1e-6)
    assert got["negative_recall"] == pytest.approx(recall[0], abs=1e-6)


@pytest.mark.parametrize("rule", ["symmetric", "asymmetric"])
def test_sweep_against_brute_force(predictions, rule):
    rows = predictions.collect()
    swept = {r["threshold"]: r for r in E.threshold_sweep(predictions, rule).collect()}
    for t, row in swept.items():
        def decide(r):
            if r["lead"] < t and (rule == "symmetric" or r["pred"] == 2):
                return 1
            return r["pred"]

        macro, recall = brute(rows, decide)
        assert row["macro_f1"] == pytest.approx(macro, abs=1e-6) and row["neutral_recall"] == pytest.approx(recall[1], abs=1e-6)
    if rule == "asymmetric":
        assert len({r["negative_recall"] for r in swept.values()}) == 1


def test_single_class_slice(spark):
    rows = spark.createDataFrame([(1, 1), (1, 0), (1, 1), (1, 2)], "y int, pred int")
    cells = E.confusion(rows)
    honest = E.honest_report(cells).first()
    assert honest["classes_present"] == 1 and honest["neutral_recall"] == 0.5 and honest["macro_f1"] is None
    drift = E.neutral_drift(cells).first()
    assert (drift["neutral_to_negative"], drift["neutral_to_positive"]) == (0.25, 0.25)
    empty = E.neutral_drift(E.confusion(rows.filter("y = 0"))).first()
    assert empty["neutral_to_negative"] is None and empty["neutral_recall"] == 0.0
    report = {r["label"]: r for r in E.class_report(cells).collect()}
    assert report["negative"]["precision"] == 0.0 and report["neutral"]["support"] == 4


def test_gate(spark):
    cells = [("test", 80, 20, 0, 10, 80, 10, 0, 10, 90), ("frozen", 0, 0, 0, 60, 30, 10, 0, 0, 0)]
    df = spark.createDataFrame(cells, "eval_set string, " + ", ".join(f"{c} long" for c in E.CELLS))
    gate = E.quality_gate(df).first()
    assert (gate["negative_recall"], gate["frozen_recall"], gate["publish"]) == (0.8, 0.3, True)
    assert E.quality_gate(df, frozen_floor=0.31).first()["publish"] is False


def test_misses_and_pairs(spark):
    rows = [(1, "a", 1, 0, 0.1), (2, "a", 1, 2, 0.15), (3, "b", 1, 0, 0.2), (4, "b", 1, 1, 0.9), (5, "b", 0, 0, 0.9)]
    df = spark.createDataFrame(rows, "id int, category string, y int, pred int, lead double")
    misses = E.neutral_misses(df)
    assert tuple(E.miss_summary(misses).first()) == (3, 2, 1, 0.666667, True)
    assert [r["id"] for r in E.confident_misses(misses).collect()] == [3]
    errors = E.error_frame(df)
    assert {tuple(r) for r in E.confusion_pairs(errors).collect()} == {("neutral", "negative", 2), ("neutral", "positive", 1)}
    assert [tuple(r) for r in E.accuracy_by_category(errors).collect()] == [("a", 0.0), ("b", 0.666667)]
    best = E.best_by(spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", 0.1)], "model string, f1 double"), "model", "f1")
    assert tuple(best.first()) == ("a", 0.5)
