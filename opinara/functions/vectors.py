"""Arrow functions over embedding columns: nearest centroid and the dense classifier.

Models reach the tasks as broadcast variables. Their size is set by the model (clusters x
dimensions, layer widths), never by the number of reviews, and is checked before broadcasting.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from opinara.schema import FALLBACK_SCOPE, LABELS, NEGATIVE_MARGIN, OTHER_ISSUE, PER_CATEGORY, POSITIVE_MARGIN

MODEL_BYTES_LIMIT = 512 * 1024 * 1024

ISSUE_TYPE = "struct<cluster_id:int,issue_tag:string,issue_distance:double,cluster_source:string>"
SCORE_TYPE = "struct<sentiment:string,confidence_margin:double,prob_negative:double,prob_neutral:double,prob_positive:double>"


@dataclass(frozen=True)
class CentroidSet:
    """Centroids of one scope, with a name and a cut-off distance per cluster."""

    matrix: np.ndarray
    names: tuple[str | None, ...]
    thresholds: tuple[float | None, ...]

    @property
    def nbytes(self) -> int:
        return int(self.matrix.nbytes)


@dataclass(frozen=True)
class DenseWeights:
    """(weight, bias) per layer, weight shaped (inputs, outputs); ReLU or a sigmoid between layers."""

    layers: tuple[tuple[np.ndarray, np.ndarray], ...] = field(default_factory=tuple)
    activation: str = "relu"

    @property
    def nbytes(self) -> int:
        return int(sum(w.nbytes + b.nbytes for w, b in self.layers))


def _broadcast(spark: SparkSession, value, nbytes: int):
    if nbytes > MODEL_BYTES_LIMIT:
        raise ValueError(f"model of {nbytes} bytes exceeds the broadcast limit of {MODEL_BYTES_LIMIT}")
    return spark.sparkContext.broadcast(value)


def _matrix(column: pa.Array, width: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers that hold a vector of the given width and finite values, those vectors as a 2-d array).

    Other rows are left out, so they get no result instead of a wrong one. Without a model there is no
    width; then only the rows matter.
    """
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    if width is None:
        rows = np.flatnonzero(sizes >= 0)
        return rows, np.zeros((len(rows), 0))
    rows = np.flatnonzero(sizes == width)
    values = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), width)
    sound = np.isfinite(values).all(axis=1)
    return rows[sound], values[sound]


def _width(sets: dict[str, CentroidSet]) -> int | None:
    return next((s.matrix.shape[1] for s in sets.values()), None)


def _forward(x: np.ndarray, weights: DenseWeights) -> np.ndarray:
    *hidden, (last_w, last_b) = weights.layers
    for w, b in hidden:
        x = x @ w + b
        x = np.maximum(x, 0.0) if weights.activation == "relu" else 1.0 / (1.0 + np.exp(-np.clip(x, -500.0, 500.0)))
    logits = x @ last_w + last_b
    logits -= logits.max(axis=1, keepdims=True)
    exps = np.exp(logits)
    return exps / exps.sum(axis=1, keepdims=True)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and distance to the closest centroid; the distance is taken directly."""
    halved = x @ centroids.T - 0.5 * (centroids**2).sum(axis=1)
    index = halved.argmax(axis=1)
    return index, np.linalg.norm(x - centroids[index], axis=1)


def _tag(x: np.ndarray, scopes: np.ndarray, sets: dict[str, CentroidSet]):
    n = len(x)
    cluster, distance = np.zeros(n, dtype=np.int64), np.zeros(n)
    tags = np.full(n, OTHER_ISSUE, dtype=object)
    known = np.array([scope in sets and scope != FALLBACK_SCOPE for scope in scopes], dtype=bool)
    sources = np.where(known, PER_CATEGORY, FALLBACK_SCOPE).astype(object)
    effective = np.where(known, scopes, FALLBACK_SCOPE)
    fallback = sets.get(FALLBACK_SCOPE) or (sets[sorted(sets)[0]] if sets else None)
    for scope in set(effective.tolist()):
        chosen = sets.get(scope, fallback)
        if chosen is None or not len(chosen.matrix):
            cluster[effective == scope] = -1
            continue
        rows = np.flatnonzero(effective == scope)
        index, gap = _nearest(x[rows], chosen.matrix)
        cluster[rows], distance[rows] = index, gap
        limits = np.array([np.inf if limit is None else limit for limit in chosen.thresholds])
        names = np.array([name or OTHER_ISSUE for name in chosen.names], dtype=object)
        tags[rows] = np.where(gap > limits[index], OTHER_ISSUE, names[index])
    return cluster, tags, distance, sources


def _spread(rows: np.ndarray, values: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """Values back at their row numbers, null elsewhere."""
    numeric = not pa.types.is_string(kind)
    full = np.zeros(n, dtype=kind.to_pandas_dtype()) if numeric else np.full(n, "", dtype=object)
    full[rows] = values
    missing = np.ones(n, dtype=bool)
    missing[rows] = False
    return pa.array(full, type=kind, mask=missing)


def issue_tagger(spark: SparkSession, sets: dict[str, CentroidSet]):
    """Column function (embedding, category) -> nearest issue; null without a vector of the centroids' width."""
    shared = _broadcast(spark, sets, sum(s.nbytes for s in sets.values()))

    @F.arrow_udf(ISSUE_TYPE)
    def tag(embedding: pa.Array, category: pa.Array) -> pa.Array:
        rows, x = _matrix(embedding, _width(shared.value))
        scopes = np.array(category.to_pylist(), dtype=object)[rows]
        cluster, tags, distance, sources = _tag(x, scopes, shared.value)
        n = len(embedding)
        return pa.StructArray.from_arrays(
            [
                _spread(rows, cluster, n, pa.int32()),
                _spread(rows, tags, n, pa.string()),
                _spread(rows, distance, n, pa.float64()),
                _spread(rows, sources, n, pa.string()),
            ],
            names=["cluster_id", "issue_tag", "issue_distance", "cluster_source"],
        )

    return tag


def dense_forward(spark: SparkSession, weights: DenseWeights):
    """Column function embedding -> class probabilities."""
    shared = _broadcast(spark, weights, weights.nbytes)

    @F.arrow_udf("array<double>")
    def forward(embedding: pa.Array) -> pa.Array:
        rows, x = _matrix(embedding, shared.value.layers[0][0].shape[0])
        n, width = len(embedding), len(LABELS)
        full, missing = np.zeros((n, width)), np.ones(n, dtype=bool)
        if len(rows):
            full[rows], missing[rows] = _forward(x, shared.value), False
        offsets = pa.array(np.arange(0, n * width + 1, width, dtype=np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(full.ravel()), mask=pa.array(missing))

    return forward


def review_scorer(spark: SparkSession, weights: DenseWeights, positive: float = POSITIVE_MARGIN, negative: float = NEGATIVE_MARGIN):
    """Column function embedding -> sentiment, margin and probabilities; null without a vector of the network's width."""
    shared = _broadcast(spark, weights, weights.nbytes)

    @F.arrow_udf(SCORE_TYPE)
    def score(embedding: pa.Array) -> pa.Array:
        model, n = shared.value, len(embedding)
        rows, x = _matrix(embedding, model.layers[0][0].shape[0])
        probs = _forward(x, model) if len(rows) else np.zeros((0, len(LABELS)))
        ranked = np.sort(probs, axis=1)
        margins = ranked[:, -1] - ranked[:, -2]
        predicted = probs.argmax(axis=1) if len(rows) else np.zeros(0, dtype=int)
        unsure = ((predicted == 2) & (margins < positive)) | ((predicted == 0) & (margins < negative))
        names = np.array(LABELS, dtype=object)[np.where(unsure, 1, predicted)]
        return pa.StructArray.from_arrays(
            [
                _spread(rows, names, n, pa.string()),
                _spread(rows, margins, n, pa.float64()),
                *[_spread(rows, probs[:, i], n, pa.float64()) for i in range(len(LABELS))],
            ],
            names=[part.split(":")[0] for part in SCORE_TYPE[len("struct<") : -1].split(",")],
        )

    return score


def distance_between(a: Column, b: Column) -> Column:
    """Euclidean distance of two array columns, inside the JVM."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) ** 2)
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))
