"""Corrections to a gated new model: trust gates, relabelling, training, evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.functions.vectors import DenseWeights
from opinara.operators import corrections as C
from opinara.operators.evaluation import confusion, quality_gate
from opinara.operators.models import Predictor, logistic, trained
from opinara.session import cut
from opinara.sources.tables import write_weights


def verdicts(votes: DataFrame, known_ids: DataFrame, order: list[str]) -> DataFrame:
    flagged = C.flag_sessions(votes)
    return C.route(C.ballots(flagged, order, ["confidence_margin"]), known_ids.distinct())  # a repeated id must not repeat a verdict


def publish(spark: SparkSession, weights: DenseWeights, gate: DataFrame, path: str) -> bool:
    """Store the weights where the scorer reads them, if both gates hold; else leave what is there."""
    row = gate.first()
    passed = bool(row["publish"])
    if passed:
        write_weights(spark, weights, path)
    return passed


def _rounds(dataset: DataFrame, routed: DataFrame, new_features: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Relabelled training rows with accepted new texts, and the rows that judge."""
    relabelled = cut(C.apply_verdicts(dataset, routed).withColumnRenamed("review_id", "id"))
    train = relabelled.filter("split = 'train'").select(F.col("id").cast("string").alias("id"), "label", "features")
    if new_features is not None:
        fresh = C.new_training_rows(routed).join(new_features, "id")
        train = train.unionByName(fresh.select("id", "label", "features"))
    return train, relabelled.filter("split IN ('test', 'frozen')").withColumnRenamed("split", "eval_set")


def retrain(
    dataset: DataFrame, routed: DataFrame, new_features: DataFrame | None = None, fit: Callable[[DataFrame], Predictor] = logistic
) -> tuple[Predictor, DataFrame]:
    """Train on the relabelled training rows; returns the model and its gate row.

    ``dataset`` has review_id, label, split (train, test, frozen), features. ``new_features`` holds
    vectors of accepted new texts (id, features); they join the training rows only.
    """
    train, held = _rounds(dataset, routed, new_features)
    predict = fit(train)
    return predict, quality_gate(confusion(predict(held), ["eval_set"]))


def renew(
    dataset: DataFrame,
    routed: DataFrame,
    path: str,
    new_features: DataFrame | None = None,
    fit: Callable[[DataFrame], tuple[Predictor, DenseWeights]] = trained,
    floors: dict[str, float] | None = None,
) -> tuple[bool, DenseWeights, DataFrame]:
    """The whole round: relabel, train the network, judge it, and store its weights only if both gates hold.

    Returns whether they were stored, the weights, and the gate row. A failed gate leaves what ``path`` holds.
    """
    train, held = _rounds(dataset, routed, new_features)
    predict, weights = fit(train)
    gate = cut(quality_gate(confusion(predict(held), ["eval_set"]), **(floors or {})))
    return publish(dataset.sparkSession, weights, gate, path), weights, gate
