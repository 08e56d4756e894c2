"""Labels for fitting, and the small logistic model that turns evidence into a probability."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm import tables

MAX_LABELLED = 50_000  # labelled documents that take part in fitting
CALIBRATION_FOLD = 4  # of the folds that may be learned from, this one is kept for the logistic model


def training_labels(labels: DataFrame, column: str, limit: int = MAX_LABELLED) -> DataFrame:
    """doc_id, label and fold of at most ``limit`` labelled ids outside the held-out fold, by hash order."""
    found = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    found = found.agg(F.max(F.col(column).cast("int")).alias("label")).withColumn("fold", tables.fold_of()).where("fold <> 0")
    return found.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 100, penalty: float = 1e-3) -> np.ndarray:
    """Weights, the last one constant, by damped Newton steps on scaled columns; classes weigh alike."""
    mean, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    ridge = penalty * np.append(np.ones(x.shape[1]), 1e-3)

    def loss(w: np.ndarray) -> float:
        return float(weight @ np.logaddexp(0, np.where(y == 1, -1, 1) * (z @ w)) + ridge @ (w * w) / 2)

    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (weight * (p - y)) + ridge * w
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(ridge), slope)
        size, now = 1.0, loss(w)
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w -= size * step
        if size <= 1e-6 or np.abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / spread, w[-1] - (w[:-1] * mean / spread).sum())
