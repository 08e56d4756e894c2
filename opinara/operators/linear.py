"""Many multinomial logistic models at once: all move in the same passes over the rows.

A row says which models it teaches. One pass holds each row against the weights of all its models and
adds up losses and gradients per model; each model then takes a step of L-BFGS on the driver, with a
backtracking search whose trials are passes too, and drops out when it has settled. Weights of all
models go to every task; where they would pass ``BLOCK_BYTES``, models are fitted in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.operators.ranking import resident

RIDGE = 1e-4
MEMORY = 10
BLOCK_BYTES = 64 << 20
TOLERANCE = 1e-6


class Search:
    """L-BFGS for one model: ``trial`` are the weights to try next."""

    def __init__(self, size: int, max_iter: int, tol: float) -> None:
        self.trial, self.left, self.tol = np.zeros(size), max_iter, tol
        self.at: np.ndarray | None = None
        self.done = max_iter < 1
        self.moves: list[tuple[np.ndarray, np.ndarray]] = []

    @property
    def weights(self) -> np.ndarray:
        return self.trial if self.at is None else self.at

    def _direction(self) -> np.ndarray:
        d, kept = -self.slope, []
        for s, y in reversed(self.moves):
            a = (s @ d) / (s @ y)
            d = d - a * y
            kept.append(a)
        if self.moves:
            s, y = self.moves[-1]
            d = d * ((s @ y) / (y @ y))
        else:
            d = d / max(np.linalg.norm(d), 1.0)
        for (s, y), a in zip(self.moves, reversed(kept), strict=True):
            d = d + (a - (y @ d) / (s @ y)) * s
        return d

    def take(self, value: float, slope: np.ndarray) -> None:
        """What the objective and its gradient are at ``trial``."""
        if self.at is not None:
            if not value <= self.value + 1e-4 * self.step * self.fall:
                self.step /= 2
                self.done = self.step < 1e-12
                self.trial = self.at + self.step * self.line
                return
            move, turn = self.trial - self.at, slope - self.slope
            if move @ turn > 1e-12 * (turn @ turn):
                self.moves = [*self.moves[-MEMORY + 1 :], (move, turn)]
            settled = self.value - value <= self.tol * max(abs(value), 1e-3)
            self.left -= 1
        else:
            settled = False
        self.at, self.value, self.slope = self.trial, value, slope
        self.done = settled or self.left < 1 or np.abs(slope).max() < 1e-9
        self.line, self.step = self._direction(), 1.0
        self.fall = float(self.slope @ self.line)
        self.trial = self.at + self.line


def _pass(members: DataFrame, trials: dict[int, np.ndarray], scale: np.ndarray, factors: dict[int, np.ndarray], classes: int) -> dict[int, tuple[float, np.ndarray, float]]:
    """Loss, gradient and weight of the rows of each model."""
    shared = members.sparkSession.sparkContext.broadcast((trials, scale, {m: factors[m] for m in trials if m in factors}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, spread, factor = shared.value
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            n = batch.num_rows
            x = batch.column("features").flatten().to_numpy().reshape(n, -1) / spread
            x = np.column_stack([x, np.ones(n)])
            y, weight = batch.column("y").to_numpy(), batch.column("weight").to_numpy()
            lists = batch.column("models")
            owner = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
            model = lists.flatten().to_numpy()
            order = np.argsort(model, kind="stable")
            heads = np.flatnonzero(np.diff(model[order], prepend=-1))
            for own in np.split(order, heads[1:]):
                number = int(model[own[0]]) if len(own) else -1
                if number not in weights or number not in factor:
                    continue
                rows = owner[own]
                some, target = x[rows], y[rows]
                mass = weight[rows] * factor[number][target]
                z = some @ weights[number].reshape(-1, classes)
                z -= z.max(axis=1, keepdims=True)
                logs = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
                at = np.arange(len(rows))
                error = np.exp(logs)
                error[at, target] -= 1
                part = np.concatenate([[-(mass @ logs[at, target]), mass.sum()], (some.T @ (error * mass[:, None])).ravel()])
                sums[number] = sums[number] + part if number in sums else part
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))], ["model", "sums"])

    parts = members.mapInArrow(run, "model int, sums array<double>").groupBy("model").agg(Summarizer.sum(array_to_vector("sums")).alias("sums"))
    found = {r.model: r.sums.toArray() for r in parts.collect()}
    return {m: (float(v[0]), v[2:], float(v[1])) for m, v in found.items()}


def fit_all(rows: DataFrame, count: int, classes: int, max_iter: int = 100, tol: float = TOLERANCE, balanced: bool = True) -> dict[int, np.ndarray]:
    """Weights (features + 1 x classes, constants last) of the models 0 to count - 1 that have rows.

    Rows have features, y (0 to classes - 1), weight and models (numbers of the models they teach, null or
    empty for none). If ``balanced``, the classes that a model has weigh alike. Rows with a null or a hole, or another width than most, take no part.
    """
    good = rows.where("y IS NOT NULL AND weight > 0 AND size(models) > 0").where(F.forall("features", lambda v: v.isNotNull() & (F.abs(v) < float("inf"))))
    widths = good.groupBy(F.size("features").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    if not widths or widths[0].w < 1:
        return {}
    width = widths[0].w
    narrow = good.where(F.size("features") == width)
    members = resident(narrow.select(F.col("features").cast("array<double>").alias("features"), F.col("y").cast("int").alias("y"), F.col("weight").cast("double").alias("weight"), F.col("models").cast("array<int>").alias("models")))
    try:
        spread = np.array(members.agg(vector_to_array(Summarizer.std(array_to_vector("features"))).alias("s")).first().s)
        scale = np.where(spread > 0, spread, 1.0)
        shares = members.select(F.explode("models").alias("model"), "y", "weight").groupBy("model", "y").agg(F.sum("weight").alias("w")).collect()
        factors: dict[int, np.ndarray] = {}
        for r in shares:  # a number for each model and class
            factors.setdefault(r.model, np.zeros(classes))[r.y] = r.w
        for m, w in factors.items():
            factors[m] = np.where(w > 0, w.sum() / (np.count_nonzero(w) * np.where(w > 0, w, 1)), 0) if balanced else np.ones(classes)
        size = (width + 1) * classes
        at_once = max(BLOCK_BYTES // (8 * size), 1)
        out: dict[int, np.ndarray] = {}
        for first in range(0, count, at_once):
            out |= _settled(members, range(first, min(first + at_once, count)), scale, factors, size, classes, max_iter, tol)
    finally:
        members.unpersist()
    return out


def _settled(members: DataFrame, numbers: Sequence[int], scale: np.ndarray, factors: dict[int, np.ndarray], size: int, classes: int, max_iter: int, tol: float) -> dict[int, np.ndarray]:
    searches = {m: Search(size, max_iter, tol) for m in numbers}
    held = np.ones((size // classes, classes))
    held[-1] = 0  # constants are free
    seen: set[int] = set()
    live = set(searches)
    while live:
        found = _pass(members, {m: searches[m].trial for m in live}, scale, factors, classes)
        seen |= found.keys()
        live &= found.keys()  # a model without rows has no weights
        for m, (loss, gradient, mass) in found.items():
            w = searches[m].trial
            ridge = RIDGE * held.ravel()
            searches[m].take(loss / mass + float(ridge @ (w * w)) / 2, gradient / mass + ridge * w)
            if searches[m].done:
                live.discard(m)
    unscale = np.append(scale, 1.0)[:, None]
    return {m: searches[m].weights.reshape(-1, classes) / unscale for m in sorted(seen)}


def predictions(rows: DataFrame, models: dict[int, np.ndarray], number: str = "model") -> DataFrame:
    """The rows with ``probs``, of the model that each names; null without that model or a whole vector of its width.

    The weights of all models go to the tasks: pass them in blocks where there are too many.
    """
    shared = rows.sparkSession.sparkContext.broadcast(models)

    @F.arrow_udf("array<double>")
    def score(features: pa.Array, model: pa.Array) -> pa.Array:
        own = shared.value
        out: list[list[float] | None] = [None] * len(features)
        sizes = np.diff(features.offsets.to_numpy())
        named = model.to_pylist()
        for m in {x for x in named if x in own}:
            at = [k for k, x in enumerate(named) if x == m and sizes[k] == len(own[m]) - 1 and features[k].is_valid and not features[k].values.null_count]
            if at:
                x = features.take(pa.array(at)).flatten().to_numpy().reshape(len(at), -1)
                z = x @ own[m][:-1] + own[m][-1]
                odds = np.exp(z - z.max(axis=1, keepdims=True))
                for k, p in zip(at, (odds / odds.sum(axis=1, keepdims=True)).tolist(), strict=True):
                    out[k] = p
        return pa.array(out, pa.list_(pa.float64()))

    return rows.withColumn("probs", score(F.col("features").cast("array<double>"), F.col(number).cast("int")))
