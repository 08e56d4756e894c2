"""Classification metrics from nine counters.

Every metric is a function of the 3x3 confusion counts, so a table of predictions is read
once, aggregated to one row per evaluation set, and never collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.functions.scores import argmax, margin, margin_bucket, probabilities
from opinara.schema import (
    GATE_FROZEN_RECALL,
    GATE_NEGATIVE_RECALL,
    LABELS,
    MARGIN_SWEEP,
    NEGATIVE_MARGIN,
    UNCERTAIN_MARGIN,
)

CLASSES = range(len(LABELS))
CELLS = [f"n{actual}{predicted}" for actual in CLASSES for predicted in CLASSES]


def cell_counts(weight: str | None = None) -> list[Column]:
    """Nine counters n<actual><predicted> over columns ``y`` and ``pred``."""
    amount = F.lit(1) if weight is None else F.col(weight)
    return [
        F.coalesce(F.sum(F.when((F.col("y") == a) & (F.col("pred") == p), amount)), F.lit(0)).cast("long").alias(f"n{a}{p}")
        for a in CLASSES
        for p in CLASSES
    ]


def confusion(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per evaluation set with all nine cells."""
    return predictions.groupBy(*by).agg(*cell_counts())


def confusion_grid(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Long form: actual, predicted, count, zeros included."""
    rows = [
        F.struct(F.lit(LABELS[a]).alias("actual"), F.lit(LABELS[p]).alias("predicted"), F.col(f"n{a}{p}").alias("count"))
        for a in CLASSES
        for p in CLASSES
    ]
    return cells.select(*by, F.inline(F.array(*rows)))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def _actual(c: int) -> Column:
    return sum((F.col(f"n{c}{p}") for p in CLASSES), F.lit(0))


def _predicted(c: int) -> Column:
    return sum((F.col(f"n{a}{c}") for a in CLASSES), F.lit(0))


def recall(c: int) -> Column:
    return _ratio(F.col(f"n{c}{c}"), _actual(c))


def precision(c: int) -> Column:
    return _ratio(F.col(f"n{c}{c}"), _predicted(c))


def f1(c: int) -> Column:
    return _ratio(2.0 * F.col(f"n{c}{c}"), _actual(c) + _predicted(c))


def macro_f1() -> Column:
    """Mean F1 over the classes that occur, as truth or as prediction."""
    occurs = [F.when(_actual(c) + _predicted(c) > 0, 1).otherwise(0) for c in CLASSES]
    return _ratio(sum((f1(c) for c in CLASSES), F.lit(0.0)), sum(occurs, F.lit(0)))


def accuracy() -> Column:
    return _ratio(sum((F.col(f"n{c}{c}") for c in CLASSES), F.lit(0)), sum((_actual(c) for c in CLASSES), F.lit(0)))


def class_report(cells: DataFrame, by: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """Per class: precision, recall, F1, support."""
    rows = [
        F.struct(
            F.lit(LABELS[c]).alias("label"),
            F.round(precision(c), digits).alias("precision"),
            F.round(recall(c), digits).alias("recall"),
            F.round(f1(c), digits).alias("f1"),
            _actual(c).cast("long").alias("support"),
        )
        for c in CLASSES
    ]
    return cells.select(*by, F.inline(F.array(*rows)))


def overall(cells: DataFrame, by: Sequence[str] = (), digits: int = 6) -> DataFrame:
    return cells.select(
        *by,
        F.round(accuracy(), digits).alias("accuracy"),
        F.round(macro_f1(), digits).alias("macro_f1"),
        F.round(f1(1), digits).alias("neutral_f1"),
        F.round(recall(0), digits).alias("negative_recall"),
        F.round(recall(1), digits).alias("neutral_recall"),
    )


def neutral_drift(cells: DataFrame, by: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """Where neutral rows go when they are missed; null without neutral rows."""
    def rate(p: int) -> Column:
        return F.when(_actual(1) > 0, F.round(F.col(f"n1{p}") / _actual(1), digits))

    return cells.select(
        *by,
        F.round(macro_f1(), digits).alias("macro_f1"),
        F.round(recall(1), digits).alias("neutral_recall"),
        F.round(precision(1), digits).alias("neutral_precision"),
        rate(0).alias("neutral_to_negative"),
        rate(2).alias("neutral_to_positive"),
    )


def honest_report(cells: DataFrame, by: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """Macro F1 and precision only where all three classes occur as truth."""
    present = sum((F.when(_actual(c) > 0, 1).otherwise(0) for c in CLASSES), F.lit(0))
    complete = present == len(LABELS)
    return cells.select(
        *by,
        present.cast("int").alias("classes_present"),
        F.round(recall(1), digits).alias("neutral_recall"),
        F.when(complete, F.round(macro_f1(), digits)).alias("macro_f1"),
        F.when(complete, F.round(precision(1), digits)).alias("neutral_precision"),
    )


def with_prediction(scored: DataFrame) -> DataFrame:
    """Adds ``pred`` and ``lead`` from the probability columns."""
    return scored.withColumns({"pred": argmax(probabilities()), "lead": margin(probabilities())})


def threshold_sweep(
    predictions: DataFrame,
    rule: str,
    thresholds: Sequence[float] = MARGIN_SWEEP,
    by: Sequence[str] = (),
    digits: int = 6,
) -> DataFrame:
    """Metrics at every threshold in one pass.

    A rule only asks whether the lead is below the threshold, so rows are first counted per
    (y, pred, number of thresholds the lead reaches); thresholds multiply those few counts.
    """
    if rule not in ("symmetric", "asymmetric"):
        raise ValueError(rule)
    steps = sorted(thresholds)
    reached = sum((F.when(F.col("lead") >= t, 1).otherwise(0) for t in steps), F.lit(0))
    unsure_negative = F.col("lead") < NEGATIVE_MARGIN
    counts = (
        predictions.select(*by, "y", "pred", reached.alias("reached"), unsure_negative.alias("unsure"))
        .groupBy(*by, "y", "pred", "reached", "unsure")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    grid = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.lit(i).alias("step")) for i, t in enumerate(steps)])
    at = counts.select("*", F.inline(grid))
    below = F.col("reached") <= F.col("step")
    if rule == "symmetric":
        decided = F.when(below, 1).otherwise(F.col("pred"))
    else:
        decided = F.when((F.col("pred") == 2) & below, 1).when((F.col("pred") == 0) & F.col("unsure"), 1)
        decided = decided.otherwise(F.col("pred"))
    cells = at.withColumn("pred", decided).groupBy(*by, "threshold").agg(*cell_counts("n"))
    return overall(cells, [*by, "threshold"], digits)


def neutral_misses(predictions: DataFrame) -> DataFrame:
    """Neutral rows predicted as something else, with their margin bucket."""
    missed = predictions.filter((F.col("y") == 1) & (F.col("pred") != 1))
    return missed.withColumn("bucket", margin_bucket(F.col("lead")))


def miss_summary(misses: DataFrame, majority: float = 0.6, digits: int = 6) -> DataFrame:
    unsure, total = F.count_if(F.col("lead") <= UNCERTAIN_MARGIN), F.count(F.lit(1))
    return misses.agg(
        total.alias("misses"),
        unsure.alias("uncertain"),
        F.count_if(F.col("lead") > UNCERTAIN_MARGIN).alias("confident"),
        F.when(total > 0, F.round(unsure / total, digits)).alias("uncertain_share"),
        F.when(total > 0, unsure / total > majority).alias("mostly_uncertain"),
    )


def confident_misses(misses: DataFrame) -> DataFrame:
    return misses.filter(F.col("lead") > UNCERTAIN_MARGIN).orderBy(F.desc("lead"), "id")


def quality_gate(
    cells: DataFrame, negative_floor: float = GATE_NEGATIVE_RECALL, frozen_floor: float = GATE_FROZEN_RECALL
) -> DataFrame:
    """Publish only when negative recall on the test set and neutral recall on the frozen set both hold.

    ``cells`` has one row per ``eval_set`` ("test", "frozen"). Recalls use the plain argmax.
    """
    negative = F.max(F.when(F.col("eval_set") == "test", recall(0)))
    frozen = F.max(F.when(F.col("eval_set") == "frozen", recall(1)))
    gates = cells.agg(negative.alias("_negative"), frozen.alias("_frozen"))
    holds_negative, holds_frozen = F.col("_negative") >= negative_floor, F.col("_frozen") >= frozen_floor
    return gates.select(
        F.round("_negative", 6).alias("negative_recall"),
        F.round("_frozen", 6).alias("frozen_recall"),
        holds_negative.alias("holds_negative"),
        holds_frozen.alias("holds_frozen"),
        (holds_negative & holds_frozen).alias("publish"),
    )


def error_frame(predictions: DataFrame) -> DataFrame:
    """Actual and predicted names with a flag for every row."""
    name = {c: LABELS[c] for c in CLASSES}

    def named(column: str) -> Column:
        return F.when(F.col(column) == 0, name[0]).when(F.col(column) == 1, name[1]).when(F.col(column) == 2, name[2])

    return predictions.select(
        "id", "category", named("y").alias("actual"), named("pred").alias("predicted"), (F.col("y") == F.col("pred")).alias("correct")
    )


def confusion_pairs(errors: DataFrame) -> DataFrame:
    return errors.filter(~F.col("correct")).groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("count"))


def accuracy_by_category(errors: DataFrame) -> DataFrame:
    rate = F.round(F.avg(F.col("correct").cast("double")), 6).alias("accuracy")
    return errors.groupBy("category").agg(rate).orderBy("accuracy", "category")


def best_by(results: DataFrame, name: str, metric: str) -> DataFrame:
    """The winning row's name and metric; ties go to the first name."""
    return results.agg(F.min_by(F.struct(name, metric), F.struct(-F.col(metric), F.col(name))).alias("best")).select("best.*")
