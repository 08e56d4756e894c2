"""Many k-means fits at once: every scope, number of clusters and start moves in the same passes.

A run is a scope (a category, or all rows), a number of clusters and a seed. One pass over the rows
holds each of them against the centres of all runs of its scope and returns sums per run and cluster, so
an iteration is one job however many runs there are; a run that has settled drops out. Starts come from
k-means||: a few passes draw rows by their distance from what is drawn already, the draws are weighted
by the rows nearest to them and clustered on the driver. Whether a row is drawn follows from its hash,
the run and the round, so partitions and retries don't matter.

Centres of all runs go to every task and back to the driver. Where those of all scopes would pass
``BLOCK_BYTES``, scopes are dealt into blocks by hash that are fitted one after the other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.operators.ranking import ROWS_PER_TASK

ROUNDS = 3  # of drawing starts
MORE_ROUNDS = 10  # for runs with fewer draws than clusters
DRAWS = 2  # expected draws of a round, for each cluster
MAX_ITER = 300
BLOCK_BYTES = 64 << 20  # centres of all runs in work
CELLS = 1 << 19  # distances in work at once
PARTIAL = "run int, n binary, cost double, total binary"
CELLS_PER_TASK = 1 << 20  # distances of a pass below which an extra task costs more than it saves


class Run(NamedTuple):
    scope: str | None
    k: int
    seed: int

    def salt(self, turn: int) -> int:
        return zlib.crc32(f"{self.scope}|{self.k}|{self.seed}|{turn}".encode())


class Fit(NamedTuple):
    run: Run
    centers: np.ndarray
    sizes: np.ndarray  # rows nearest to each centre
    inertia: float
    iterations: int

    def clusterCenters(self) -> list[np.ndarray]:
        return list(self.centers)


class Model(NamedTuple):
    """Centres of many runs: for each scope its runs, where their centres start, and the centres themselves."""

    runs: dict[str | None, list[int]]
    edges: dict[str | None, np.ndarray]
    centers: dict[str | None, np.ndarray]

    @staticmethod
    def of(runs: Sequence[Run], centers: dict[int, np.ndarray]) -> Model:
        by_scope: dict[str | None, list[int]] = {}
        for n in centers:
            by_scope.setdefault(runs[n].scope, []).append(n)
        edges = {s: np.append(0, np.cumsum([len(centers[n]) for n in own])) for s, own in by_scope.items()}
        return Model(by_scope, edges, {s: np.concatenate([centers[n] for n in own]) for s, own in by_scope.items()})


def _chunks(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[tuple[str | None, np.ndarray, np.ndarray, np.ndarray]]:
    """Scope, row hashes, vectors and their closeness to all centres of the scope, some rows at once.

    The closeness of x to c is x.c - c.c/2, half of what x.x exceeds the squared distance by: the nearest centre has
    the greatest. It lies in memory that the caller may write over.
    """
    halves = {s: (c * c).sum(axis=1) / 2 for s, c in model.centers.items()}
    for batch in batches:
        codes = batch.column("scope").dictionary_encode()
        number = codes.indices.fill_null(len(codes.dictionary)).to_numpy()
        for code, scope in enumerate([*codes.dictionary.to_pylist(), None]):
            at = np.flatnonzero(number == code)
            if not len(at) or scope not in model.runs:
                continue
            part = batch.take(pa.array(at)) if len(at) < batch.num_rows else batch
            keys = part.column("key").to_numpy()
            centers = model.centers[scope]
            x = part.column("features").flatten().to_numpy().reshape(-1, centers.shape[1])
            step = max(CELLS // len(centers), 1)
            for k in range(0, len(x), step):
                some = x[k : k + step]
                close = some @ centers.T
                close -= halves[scope]
                yield scope, keys[k : k + step], some, close


def _squares(x: np.ndarray, close: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * close, 0)


def _sums(members: DataFrame, runs: Sequence[Run], centers: dict[int, np.ndarray], totals: bool = True) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """For each run: rows and, unless not asked for, sum of vectors of each cluster, and the inertia."""
    shared = members.sparkSession.sparkContext.broadcast(Model.of(runs, centers))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        rows = {s: np.zeros(len(c), np.int64) for s, c in model.centers.items()}
        sums = {s: np.zeros(c.shape) for s, c in model.centers.items()}
        cost = {s: np.zeros(len(c)) for s, c in model.centers.items()}
        for scope, _, x, close in _chunks(batches, model):
            edges, n = model.edges[scope], len(rows[scope])
            nearest = np.empty((len(x), len(edges) - 1), np.intp)
            for j, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                nearest[:, j] = low + close[:, low:high].argmax(axis=1)
            near = _squares(x, np.take_along_axis(close, nearest, axis=1))
            cost[scope] += np.bincount(nearest.ravel(), near.ravel(), n)
            rows[scope] += np.bincount(nearest.ravel(), minlength=n)
            if totals:
                close.fill(0)
                np.put_along_axis(close, nearest, 1, axis=1)
                sums[scope] += close.T @ x
        for scope, own in model.runs.items():
            edges = model.edges[scope]
            yield _partial((n, rows[scope][low:high], cost[scope][low:high].sum(), sums[scope][low:high]) for n, low, high in zip(own, edges[:-1], edges[1:], strict=True))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: dict[int, tuple] = {}
        for batch in batches:
            for part in batch.to_pylist():
                n, cost, total = np.frombuffer(part["n"], np.int64), part["cost"], np.frombuffer(part["total"])
                more = whole.get(part["run"], (0, 0.0, 0.0))
                whole[part["run"]] = (more[0] + n, more[1] + cost, more[2] + total)
        yield _partial((run, *sums) for run, sums in whole.items())

    parts = members.mapInArrow(add, PARTIAL).repartition("run").mapInArrow(merge, PARTIAL)
    found = {row.run: (np.frombuffer(row.n, np.int64), np.frombuffer(row.total), row.cost) for row in parts.collect()}
    return {n: (found[n][0], found[n][1].reshape(-1, c.shape[1]), found[n][2]) for n, c in centers.items()}


def _partial(sums: Iterable[tuple]) -> pa.RecordBatch:
    """Rows of ``PARTIAL``: a run's clusters as bytes, which pass between tasks unread."""
    rows = [(run, n.tobytes(), float(cost), total.tobytes()) for run, n, cost, total in sums]
    kinds = (pa.int32(), pa.binary(), pa.float64(), pa.binary())
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds, strict=True)], ["run", "n", "cost", "total"])


def _uniform(keys: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys.view(np.uint64) + np.uint64(salt) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def _drawn(members: DataFrame, runs: Sequence[Run], centers: dict[int, np.ndarray], rate: dict[int, float], turn: int) -> tuple[dict[int, float], dict[int, np.ndarray]]:
    """Inertia of each run, and rows drawn with probability rate * squared distance."""
    salts = {n: runs[n].salt(turn) for n in centers}
    shared = members.sparkSession.sparkContext.broadcast((Model.of(runs, centers), rate, salts))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, rates, salt = shared.value
        cost = {n: 0.0 for own in model.runs.values() for n in own}
        for scope, keys, x, close in _chunks(batches, model):
            squares = _squares(x, np.maximum.reduceat(close, model.edges[scope][:-1], axis=1))
            for n, near in zip(model.runs[scope], squares.T, strict=True):
                cost[n] += float(near.sum())
                hit = np.flatnonzero(_uniform(keys, salt[n]) < rates[n] * near) if rates[n] else []
                if len(hit):
                    yield pa.RecordBatch.from_arrays([pa.array([n] * len(hit), pa.int32()), pa.nulls(len(hit), pa.float64()), pa.array(list(x[hit]), pa.list_(pa.float64()))], ["run", "cost", "vector"])
        yield pa.RecordBatch.from_arrays([pa.array(list(cost), pa.int32()), pa.array(list(cost.values()), pa.float64()), pa.nulls(len(cost), pa.list_(pa.float64()))], ["run", "cost", "vector"])

    total, found = dict.fromkeys(centers, 0.0), {n: [] for n in centers}
    for row in members.mapInArrow(draw, "run int, cost double, vector array<double>").collect():
        if row.vector is None:
            total[row.run] += row.cost
        else:
            found[row.run].append(row.vector)
    return total, {n: np.array(sorted(v)) for n, v in found.items() if v}


def _spread(points: np.ndarray, weights: np.ndarray, run: Run) -> np.ndarray:
    """k of some weighted points by k-means++, moved to the means of what is nearest to them."""
    rng = np.random.default_rng(run.salt(-1))
    chosen = [int(rng.choice(len(points), p=weights / weights.sum()))]
    far = ((points - points[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < run.k and (weights * far).sum() > 0:
        chosen.append(int(rng.choice(len(points), p=weights * far / (weights * far).sum())))
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    centers = points[chosen]
    for _ in range(30):
        nearest = ((points[:, None, :] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
        moved = centers.copy()
        for c in range(len(centers)):
            own = nearest == c
            if weights[own].sum() > 0:
                moved[c] = (points[own] * weights[own, None]).sum(axis=0) / weights[own].sum()
        if np.allclose(moved, centers, rtol=0, atol=1e-12):
            break
        centers = moved
    return centers


def _starts(members: DataFrame, runs: Sequence[Run], seeds: Sequence[int]) -> dict[int, np.ndarray]:
    first = [F.min_by("features", F.xxhash64("key", F.lit(seed))).alias(f"s{k}") for k, seed in enumerate(seeds)]
    firsts = {row.scope: row for row in members.groupBy("scope").agg(*first).collect()}
    centers = {n: np.array([firsts[r.scope][f"s{seeds.index(r.seed)}"]]) for n, r in enumerate(runs)}
    cost, _ = _drawn(members, runs, centers, dict.fromkeys(centers, 0.0), 0)
    for turn in range(1, ROUNDS + MORE_ROUNDS + 1):
        open_runs = {n for n in centers if cost[n] > 0 and (turn <= ROUNDS or len(centers[n]) < runs[n].k)}
        if not open_runs:
            break
        now, new = _drawn(members, runs, {n: centers[n] for n in open_runs}, {n: DRAWS * runs[n].k / cost[n] for n in open_runs}, turn)
        cost |= now
        for n, rows in new.items():
            centers[n] = np.unique(np.concatenate([centers[n], rows]), axis=0)
    weights = _sums(members, runs, centers, totals=False)
    return {n: _spread(centers[n], weights[n][0].astype(float), runs[n]) for n in centers}


def _dealt(rows: DataFrame, centers: int) -> DataFrame:
    """Rows kept for the passes in equal parts, so many that all cores have work, however few pieces were read.

    A row costs each pass as much as there are centres, so a small table may be worth many tasks; beyond one a core
    there are only as many as rows want, as each sends the sums of all clusters.
    """
    count, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(count // ROWS_PER_TASK, min(cores - 1, count * centers // CELLS_PER_TASK)) + 1).persist(StorageLevel.MEMORY_AND_DISK)


def _fit_block(members: DataFrame, runs: Sequence[Run], seeds: Sequence[int], spread: dict, max_iter: int, tol: float) -> list[Fit]:
    centers = _starts(members, runs, seeds)
    done = dict.fromkeys(centers, 0)
    moving = set(centers)
    for turn in range(1, max_iter + 1):
        if not moving:
            break
        for n, (rows, total, _) in _sums(members, runs, {n: centers[n] for n in moving}).items():
            moved = np.where(rows[:, None] > 0, total / np.maximum(rows, 1)[:, None], centers[n])
            shift = float(((moved - centers[n]) ** 2).sum())
            centers[n], done[n] = moved, turn
            if shift <= tol * spread[runs[n].scope]:
                moving.discard(n)
    last = _sums(members, runs, centers)
    return [Fit(run, centers[n], last[n][0], last[n][2], done[n]) for n, run in enumerate(runs)]


def fit(
    rows: DataFrame, ks: Sequence[int], seeds: Sequence[int], scope: Column | None = None, key: str | None = None, max_iter: int = MAX_ITER, tol: float = 1e-4
) -> Iterator[Fit]:
    """All fits of rows with ``features``, for each value of ``scope`` (or all rows), k and seed.

    A run ends when the squares of its centres' moves sum to no more than ``tol`` times the mean variance of
    a component, or after ``max_iter`` moves. A cluster that loses its rows keeps its centre. A scope of
    fewer different vectors than k has as many clusters as those. Rows whose vector is null, has a null or a number
    that is not finite, or another width than most, take no part. Without rows there are no fits.
    """
    seeds = list(seeds)
    named = F.lit(None).cast("string") if scope is None else scope.cast("string")
    hashed = F.xxhash64(*[F.col(c) for c in ([key] if key else []) + ["features"]])
    usable = rows.where(F.forall("features", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))
    widths = usable.where(F.size("features") > 0).groupBy(F.size("features").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    if not widths:
        return
    width = widths[0].w
    narrow = usable.where(F.size("features") == width).select(named.alias("scope"), hashed.alias("key"), F.col("features").cast("array<double>").alias("features"))
    members = _dealt(narrow, sum(ks) * len(seeds))
    try:
        scopes = members.select("scope").distinct().count() if scope is not None else 1
        size = scopes * sum(ks) * len(seeds) * width * 8 * (ROUNDS * DRAWS + 1)
        blocks = max(min(-(-size // BLOCK_BYTES), scopes), 1)
        for block in range(blocks):
            part = members if blocks == 1 else members.where(F.pmod(F.xxhash64("scope"), F.lit(blocks)) == block)
            v = array_to_vector("features")
            spread = {r.scope: float(r.v.toArray().mean()) for r in part.groupBy("scope").agg(Summarizer.variance(v).alias("v")).collect()}
            runs = [Run(s, k, seed) for s in sorted(spread, key=lambda s: (s is not None, s)) for k in ks for seed in seeds]
            if runs:
                yield from _fit_block(part, runs, seeds, spread, max_iter, tol)
    finally:
        members.unpersist()


def best(fits: Iterator[Fit]) -> dict[tuple[str | None, int], Fit]:
    """The fit of least inertia of each scope and k; among equal ones the smaller seed."""
    found: dict[tuple[str | None, int], Fit] = {}
    for one in fits:
        at = (one.run.scope, one.run.k)
        if at not in found or (one.inertia, one.run.seed) < (found[at].inertia, found[at].run.seed):
            found[at] = one
    return found
