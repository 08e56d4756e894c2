"""Candidate sentiment models on Spark ML, and the experiments built from them.

Training rows carry id, features (array<float>), label, and optionally weight. Every model is
turned into the same prediction table: id, y, pred and three probabilities.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.ml import Model
from pyspark.ml.classification import (
    LinearSVC,
    LogisticRegression,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.functions.vectors import DenseWeights, dense_forward
from opinara.functions.scores import argmax, asymmetric_rule, label_id, margin
from opinara.operators import boosting, linear, network
from opinara.operators.evaluation import confusion, overall
from opinara.operators.ranking import hash_key, resident, small_side, with_hash_cuts
from opinara.operators.splits import class_weights, row_weights
from opinara.schema import LABELS, NEGATIVE_RECALL_FLOOR
from opinara.session import at_once, cut

TOLERANCE = 1e-4  # a fit stops here; every further iteration is a pass over the training rows

Predictor = Callable[[DataFrame], DataFrame]


def _vectors(df: DataFrame) -> DataFrame:
    return df.withColumns({"vec": array_to_vector("features"), "y": label_id(F.col("label")).cast("double")})


def _weighted(train: DataFrame) -> DataFrame:
    """Balanced class weights unless the rows bring their own; three weight rows are broadcast."""
    if "weight" in train.columns:
        return train
    weights = class_weights(train).select("label", F.col("class_weight").alias("weight"))
    return train.join(F.broadcast(weights), "label")


def _prepared(train: DataFrame) -> DataFrame:
    return resident(_vectors(_weighted(train)).select("id", "vec", "y", "weight"))


def _tabulate(rows: DataFrame, probs: Column) -> DataFrame:
    """Prediction table from an array of three probabilities."""
    keep = [c for c in ("id", "category", "eval_set") if c in rows.columns]
    shaped = rows.select(*keep, F.col("y").cast("int").alias("y"), probs.alias("p"))
    return shaped.select(
        *keep,
        "y",
        argmax(F.col("p")).alias("pred"),
        margin(F.col("p")).alias("lead"),
        *[F.col("p")[i].alias(f"prob_{name}") for i, name in enumerate(LABELS)],
    )


def _from_probabilities(model: Model) -> Predictor:
    def predict(rows: DataFrame) -> DataFrame:
        return _tabulate(model.transform(_vectors(rows)), vector_to_array("probability"))

    return predict


def logistic(train: DataFrame, max_iter: int = 100) -> Predictor:
    """Class-weighted multinomial logistic regression."""
    data = _prepared(train)
    try:
        model = LogisticRegression(
            featuresCol="vec", labelCol="y", weightCol="weight", family="multinomial", maxIter=max_iter, regParam=1e-4, tol=TOLERANCE
        ).fit(data)
    finally:
        data.unpersist()
    return _from_probabilities(model)


def trained(train: DataFrame, hidden: Sequence[int] = (256, 128), max_iter: int = 25, seed: int = 42) -> tuple[Predictor, DenseWeights]:
    """A network d-256-128-3 with ReLU, dropout, class and row weights, as a model and as weights that can be stored."""
    rows = _weighted(train).select("id", "features", label_id(F.col("label")).alias("y"), "weight")
    weights = network.fit(rows, len(LABELS), hidden, max_iter, seed)
    return by_weights(weights), weights


def perceptron(train: DataFrame, hidden: Sequence[int] = (256, 128), max_iter: int = 25, seed: int = 42) -> Predictor:
    return trained(train, hidden, max_iter, seed)[0]


def by_weights(weights: DenseWeights) -> Predictor:
    """Predictions of stored weights, by the scorer's own forward pass."""

    def predict(rows: DataFrame) -> DataFrame:
        forward = dense_forward(rows.sparkSession, weights)
        return _tabulate(_vectors(rows).withColumn("_p", forward(F.col("features"))), F.col("_p"))

    return predict


def boosted_trees(train: DataFrame, trees: int = 300, depth: int = 6, step: float = 0.1) -> Predictor:
    """One boosted softmax ensemble over all classes."""
    rows = _weighted(train).select("features", label_id(F.col("label")).alias("y"), "weight")
    model = boosting.fit(rows, len(LABELS), trees, depth, step)

    def predict(rows: DataFrame) -> DataFrame:
        score = boosting.probabilities(rows.sparkSession, model)
        return _tabulate(_vectors(rows).withColumn("_p", score(F.col("features"))), F.col("_p"))

    return predict


def calibrated_svc(train: DataFrame, folds: int = 3, max_iter: int = 50, seed: int = 42) -> Predictor:
    """Linear SVC per class with sigmoid calibration on held-out folds; folds are averaged.

    The calibration is a logistic regression on the margin of the fold the SVC did not see. All fits run at
    once: each is a row of short jobs that wait for one another.
    """
    fold = F.pmod(F.conv(F.substring(hash_key(F.col("id"), seed), 1, 8), 16, 10).cast("long"), F.lit(folds))
    parts = resident(_vectors(_weighted(train)).select("vec", "y", "weight", fold.alias("fold")))

    def fit(f: int, c: int) -> tuple[np.ndarray, float, float, float]:
        binary = parts.withColumn("b", (F.col("y") == c).cast("double"))
        svc = LinearSVC(featuresCol="vec", labelCol="b", weightCol="weight", maxIter=max_iter, tol=TOLERANCE).fit(binary.filter(F.col("fold") != f))
        held = svc.transform(binary.filter(F.col("fold") == f))
        lead = array_to_vector(F.array(vector_to_array("rawPrediction")[1]))
        sigmoid = LogisticRegression(featuresCol="m", labelCol="b", maxIter=max_iter, tol=TOLERANCE).fit(held.select(lead.alias("m"), "b"))
        return svc.coefficients.toArray(), float(svc.intercept), float(sigmoid.coefficients[0]), float(sigmoid.intercept)

    jobs = [(lambda f=f, c=c: fit(f, c)) for f in range(folds) for c in range(len(LABELS))]
    try:
        found = at_once(train.sparkSession, jobs)
    finally:
        parts.unpersist()
    fitted = [found[f * len(LABELS) : (f + 1) * len(LABELS)] for f in range(folds)]

    def predict(rows: DataFrame) -> DataFrame:
        def probability(w: np.ndarray, b: float, slope: float, shift: float) -> Column:
            terms = F.zip_with("features", F.lit([float(x) for x in w]), lambda x, y: x * y)
            lead = F.aggregate(terms, F.lit(float(b)), lambda acc, x: acc + x)
            return 1.0 / (1.0 + F.exp(-(lead * slope + shift)))

        scored = _vectors(rows)
        for f, per_class in enumerate(fitted):
            scored = scored.withColumn(f"_f{f}", F.array(*[probability(*parts) for parts in per_class]))
        shares = [
            [F.col(f"_f{f}")[c] / reduce(lambda a, b: a + b, [F.col(f"_f{f}")[i] for i in range(len(LABELS))]) for f in range(folds)]
            for c in range(len(LABELS))
        ]
        return _tabulate(scored, F.array(*[reduce(lambda a, b: a + b, s) / folds for s in shares]))

    return predict


def metrics(predictions: DataFrame, rule: bool = False, by: Sequence[str] = ()) -> DataFrame:
    if rule:
        predictions = predictions.withColumn("pred", asymmetric_rule(F.col("pred"), F.col("lead")))
    return overall(confusion(predictions, by), by)


def compare_models(predictors: dict[str, Predictor], test: DataFrame, rule: bool = True) -> DataFrame:
    """One metric row per model on the same test rows."""
    rows = [metrics(predict(test), rule).select(F.lit(name).alias("model"), "*") for name, predict in predictors.items()]
    return reduce(DataFrame.unionByName, rows)


def upweight_sweep(
    train: DataFrame,
    evaluation: DataFrame,
    registry: DataFrame,
    factors: Sequence[float] = (4.0, 6.0, 8.0, 10.0),
    floor: float = NEGATIVE_RECALL_FLOOR,
    fit: Callable[[DataFrame], Predictor] = perceptron,
) -> DataFrame:
    """Per factor: negative recall on test and neutral recall on frozen, blank below the floor.

    ``evaluation`` carries ``eval_set`` ("test", "frozen"). The factors' models are fitted at once.
    """

    def one(factor: float) -> DataFrame:
        predict = fit(row_weights(train, registry, factor))
        per_set = metrics(predict(evaluation), by=["eval_set"])
        negative = F.max(F.when(F.col("eval_set") == "test", F.col("negative_recall")))
        frozen = F.max(F.when(F.col("eval_set") == "frozen", F.col("neutral_recall")))
        return per_set.agg(negative.alias("_n"), frozen.alias("_f")).withColumn("upweight_factor", F.lit(float(factor)))

    out = at_once(train.sparkSession, [(lambda factor=factor: one(factor)) for factor in factors])
    holds = F.coalesce((F.col("_n") >= floor) & (F.col("_f") > 0), F.lit(False))
    return reduce(DataFrame.unionByName, out).select(
        "upweight_factor",
        holds.alias("satisfied_floor"),
        F.when(holds, F.col("_n")).alias("negative_recall"),
        F.when(holds, F.col("_f")).alias("frozen_recall"),
    )


def _measured(fits: dict[int, np.ndarray], test: DataFrame, models: Column) -> DataFrame:
    """Metrics of each model on the test rows that ``models`` lists it for, by ``model``."""
    asked = _vectors(test).withColumn("model", F.explode(models))
    scored = linear.predictions(asked, fits).withColumn("eval_set", F.col("model").cast("string"))
    return metrics(_tabulate(scored.drop("category"), F.col("probs")), by=["eval_set"]).withColumn("model", F.col("eval_set").cast("int")).drop("eval_set")


def _taught(rows: DataFrame, models: Column) -> DataFrame:
    return rows.select("features", label_id(F.col("label")).alias("y"), F.lit(1.0).alias("weight"), models.alias("models"))


def quality_vs_quantity(verified: DataFrame, raw: DataFrame, test: DataFrame, sizes: Sequence[int], max_iter: int = 100, seed: int = 42) -> DataFrame:
    """Verified rows against raw rows at equal size, raw at ten times the size, and both together.

    Samples are nested, the first rows by hash, and drawn once; all models are fitted in the same passes.
    """
    spark = test.sparkSession
    verified, raw = cut(verified), cut(raw)
    n_verified, n_raw = verified.count(), raw.count()
    named, of_verified, of_raw = [], [], []  # (name, rows); (model, rows it takes)

    def add(name: str, from_verified: int, from_raw: int) -> None:
        of_verified.append((len(named), from_verified))
        of_raw.append((len(named), from_raw))
        named.append((len(named), name, from_verified + from_raw))

    for size in dict.fromkeys(s for s in [*sizes, n_verified] if s <= n_verified):
        add("verified_only", size, 0)
        if size <= n_raw:
            add("raw_only", 0, size)
        add("raw_ten_times", 0, min(size * 10, n_raw))
        add("verified_plus_raw", n_verified, min(size, n_raw))

    def with_models(rows: DataFrame, wanted: list[tuple[int, int]]) -> DataFrame:
        joined, inside = with_hash_cuts(rows, hash_key(F.col("id"), seed), {str(m): F.lit(n) for m, n in wanted})
        return _taught(joined, F.array_compact(F.array(*[F.when(inside[str(m)], F.lit(m)) for m, n in wanted])))

    taught = with_models(verified, of_verified).unionByName(with_models(raw, of_raw))
    fits = linear.fit_all(taught, len(named), len(LABELS), max_iter)
    found = _measured(fits, test, F.array(*[F.lit(m) for m, _, _ in named]))
    table = spark.createDataFrame(named, "model int, training string, train_size long")
    return table.join(found, "model").drop("model")


def category_curves(
    train: DataFrame,
    test: DataFrame,
    categories: Sequence[str],
    fractions: Sequence[float] = (0.25, 0.5, 0.75, 1.0),
    minimum: tuple[int, int, int] = (200, 50, 50),
    max_iter: int = 100,
    seed: int = 42,
) -> DataFrame:
    """Macro F1 of a category by training size; ``minimum`` guards train, test and sample sizes.

    A category's samples are nested, the first rows by hash, and all are drawn at once; all categories and
    sizes are fitted in the same passes.
    """
    spark = train.sparkSession
    min_train, min_test, min_sample = minimum
    parts = len(fractions)
    counts = train.groupBy("category").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_train)
    held = test.groupBy("category").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") >= min_test)
    wanted = set(categories)
    eligible = [(r.category, k * parts, r.n) for k, r in enumerate(r for r in counts.join(held, "category").orderBy("category").collect() if r.category in wanted)]
    curves = [(base + j, category, int(n * f)) for category, base, n in eligible for j, f in enumerate(fractions) if int(n * f) >= min_sample]
    if not curves:
        return spark.createDataFrame([], "category string, train_size long, macro_f1 double")
    table = small_side(spark.createDataFrame([(c, base, [int(n * f) >= min_sample for f in fractions]) for c, base, n in eligible], "category string, base int, used array<boolean>"))
    rows = train.join(table, "category")
    joined, inside = with_hash_cuts(rows, hash_key(F.col("id"), seed), {str(j): F.floor(F.col("total") * f) for j, f in enumerate(fractions)}, ["category"])
    own = [F.when(F.col("used")[j] & inside[str(j)], F.col("base") + j) for j in range(parts)]
    fits = linear.fit_all(_taught(joined, F.array_compact(F.array(*own))), len(eligible) * parts, len(LABELS), max_iter)
    asked = F.array_compact(F.array(*[F.when(F.col("used")[j], F.col("base") + j) for j in range(parts)]))
    found = _measured(fits, test.join(table, "category"), asked)
    sizes = spark.createDataFrame(curves, "model int, category string, train_size long")
    return sizes.join(found, "model").select("category", "train_size", "macro_f1")
