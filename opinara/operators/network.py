"""A feed-forward network with ReLU, dropout, row weights and early stopping, trained block by block.

Rows are dealt into blocks by the hash of their id. An epoch is one pass: each block starts from the same
weights and moments, goes through its rows in mini-batches in an order of its own, and the outcomes
are averaged, weighted by rows. Weights are averaged in pieces, so that no task adds up whole networks of
all blocks. Every tenth row, by hash, is not learned from; the same pass counts how the weights it started
from do on these. The weights of the best count are kept, and training stops when it doesn't get better.

Orders and dropped units follow from seed, epoch and block, and blocks from ids: retries repeat them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.functions.vectors import DenseWeights
from opinara.session import cut

BLOCK_ROWS = 1 << 16
BATCH = (16, 256)  # a hundredth of the rows, within these
LEAST_STEPS = 400  # mini-batches of an epoch; a small block is gone through several times
HELD_OUT = 10  # one of so many rows tells when to stop
PIECE = 4096  # numbers that are averaged together
RATE, DECAY, DROPOUT = 1e-3, 1e-4, 0.3
BETAS, EPSILON = (0.9, 0.999), 1e-8
PATIENCE, SLOWER_AFTER = 5, 2

Layers = list[tuple[np.ndarray, np.ndarray]]


class State(NamedTuple):
    """All weights in one row, and their first and second moments."""

    weights: np.ndarray
    first: np.ndarray
    second: np.ndarray


def layers(flat: np.ndarray, sizes: Sequence[int]) -> Layers:
    """Views of a row of weights: for each layer the matrix (inputs x outputs) and the biases."""
    out, at = [], 0
    for inputs, outputs in zip(sizes, sizes[1:], strict=False):
        out.append((flat[at : at + inputs * outputs].reshape(inputs, outputs), flat[at + inputs * outputs : at + (inputs + 1) * outputs]))
        at += (inputs + 1) * outputs
    return out


def start(sizes: Sequence[int], seed: int) -> State:
    rng = np.random.default_rng(seed)
    parts = [rng.uniform(-1, 1, (inputs + 1) * outputs) / np.sqrt(inputs) for inputs, outputs in zip(sizes, sizes[1:], strict=False)]
    flat = np.concatenate(parts)
    return State(flat, np.zeros(len(flat)), np.zeros(len(flat)))


def forward(x: np.ndarray, net: Layers) -> np.ndarray:
    for w, b in net[:-1]:
        x = np.maximum(x @ w + b, 0)
    z = x @ net[-1][0] + net[-1][1]
    odds = np.exp(z - z.max(axis=1, keepdims=True))
    return odds / odds.sum(axis=1, keepdims=True)


def slope(x: np.ndarray, y: np.ndarray, weight: np.ndarray, flat: np.ndarray, sizes: Sequence[int], masks: Sequence[np.ndarray]) -> tuple[np.ndarray, float]:
    """Gradient of the weighted mean cross-entropy, and its sum; ``masks`` scale the hidden units."""
    net = layers(flat, sizes)
    kept = [x]
    for (w, b), mask in zip(net[:-1], masks, strict=True):
        kept.append(np.maximum(kept[-1] @ w + b, 0) * mask)
    p = forward(kept[-1], net[-1:])
    rows = np.arange(len(y))
    loss = -float(weight @ np.log(np.maximum(p[rows, y], 1e-300)))
    p[rows, y] -= 1
    back = p * (weight / weight.sum())[:, None]
    out = np.empty_like(flat)
    into = layers(out, sizes)
    for k in range(len(net) - 1, -1, -1):
        into[k][0][:] = kept[k].T @ back
        into[k][1][:] = back.sum(axis=0)
        if k:
            back = (back @ net[k][0].T) * (kept[k] > 0) * masks[k - 1]
    return out, loss


def epoch(x: np.ndarray, y: np.ndarray, weight: np.ndarray, state: State, steps: int, sizes: Sequence[int], batch: int, rate: float, dropout: float, rng: np.random.Generator) -> tuple[State, float, int]:
    """AdamW on mini-batches of some rows. The new state, the sum of losses of a sweep and the steps done."""
    flat, first, second = (part.copy() for part in state)
    sweeps, total = -(-LEAST_STEPS // -(-len(y) // batch)), 0.0
    orders = [rng.permutation(len(y)) for _ in range(sweeps)]
    for rows in (order[k : k + batch] for order in orders for k in range(0, len(y), batch)):
        masks = [(rng.random((len(rows), size)) >= dropout) / (1 - dropout) for size in sizes[1:-1]]
        gradient, loss = slope(x[rows], y[rows], weight[rows], flat, sizes, masks)
        total, steps = total + loss / sweeps, steps + 1
        flat *= 1 - rate * DECAY
        first += (1 - BETAS[0]) * (gradient - first)
        second += (1 - BETAS[1]) * (gradient * gradient - second)
        flat -= rate * (first / (1 - BETAS[0] ** steps)) / (np.sqrt(second / (1 - BETAS[1] ** steps)) + EPSILON)
    return State(flat, first, second), total, steps


def macro_f1(cells: np.ndarray) -> float:
    """Mean F1 of the classes that occur, from counts by class and prediction."""
    hits, named, real = np.diag(cells), cells.sum(axis=0), cells.sum(axis=1)
    scores = 2 * hits / np.maximum(named + real, 1)
    return float(scores[real > 0].mean()) if (real > 0).any() else 0.0


def _dealt(rows: DataFrame, key: str, blocks: int) -> DataFrame:
    """One row for each block: its rows one after the other, those for learning first."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None

        def out() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            x = table["features"].combine_chunks().flatten().to_numpy().astype("<f8").tobytes()
            values = [now, table.num_rows, int(np.count_nonzero(table["held"].to_numpy())), x, table["y"].to_numpy().astype("<i4").tobytes(), table["weight"].to_numpy().astype("<f8").tobytes()]
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["block", "n", "held", "x", "y", "weight"])

        for batch in batches:
            number = batch.column("block").to_numpy()
            edges = np.append(0, np.flatnonzero(np.diff(number)) + 1) if batch.num_rows else []
            for a, b in zip(edges, [*edges[1:], batch.num_rows], strict=True) if batch.num_rows else ():
                if now is not None and number[a] != now:
                    yield out()
                    held = []
                now = int(number[a])
                held.append(batch.slice(int(a), int(b - a)))
        if held:
            yield out()

    hashed = F.xxhash64(F.lit(key), "key")
    placed = rows.withColumn("block", F.pmod(hashed, F.lit(blocks)).cast("int")).withColumn("held", F.pmod(F.xxhash64("key"), F.lit(HELD_OUT)) == 0)
    sorted_rows = placed.repartition(blocks, "block").sortWithinPartitions("block", "held", "key", "y")
    return cut(sorted_rows.mapInArrow(pack, "block int, n int, held int, x binary, y binary, weight binary"))


def fit(
    rows: DataFrame, classes: int, hidden: Sequence[int] = (256, 128), epochs: int = 25, seed: int = 42, rate: float = RATE, dropout: float = DROPOUT
) -> DenseWeights:
    """Weights from rows with id, features, y (0 to classes - 1) and weight.

    Rows with a null, a vector with a hole or another width than most take no part. A table so small that no row is
    held out is judged by its own rows. Without rows there is an error.
    """
    good = rows.where("y IS NOT NULL AND weight > 0").where(F.forall("features", lambda v: v.isNotNull() & (F.abs(v) < float("inf"))))
    widths = good.groupBy(F.size("features").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    if not widths or widths[0].w < 1:
        raise ValueError("no rows with a vector")
    width, count = widths[0].w, widths[0]["count"]
    sizes = [width, *hidden, classes]
    narrow = good.where(F.size("features") == width).select(F.col("id").cast("string").alias("key"), F.col("features").cast("array<double>").alias("features"), F.col("y").cast("int").alias("y"), F.col("weight").cast("double").alias("weight"))
    blocks = _dealt(narrow, str(seed), -(-count // BLOCK_ROWS))
    batch = min(max(count // 100, BATCH[0]), BATCH[1])
    state, steps, best, kept, waited = start(sizes, seed), 0, -1.0, None, 0
    least, stalled = np.inf, 0
    for number in range(epochs + 1):
        cells, new, loss, steps = _pass(blocks, state, steps, sizes, batch, rate, dropout, seed, number, number < epochs)
        score = macro_f1(cells)
        if (score > best and number) or kept is None:  # untrained weights are only a last resort
            best, kept, waited = score if number else -1.0, state.weights, 0
        elif number:
            waited += 1
        if waited >= PATIENCE or new is None:
            break
        state = new
        if loss < least * (1 - 1e-4):
            least, stalled = loss, 0
        else:
            stalled += 1
            if stalled > SLOWER_AFTER:
                rate, stalled = rate / 2, 0
    return DenseWeights(tuple((w.copy(), b.copy()) for w, b in layers(kept, sizes)), "relu")


def _pass(
    blocks: DataFrame, state: State, steps: int, sizes: Sequence[int], batch: int, rate: float, dropout: float, seed: int, number: int, learns: bool
) -> tuple[np.ndarray, State | None, float, int]:
    """Counts of the weights so far on the rows held out; the averaged state after an epoch, its loss, steps."""
    classes = sizes[-1]
    shared = blocks.sparkSession.sparkContext.broadcast(state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old = shared.value
        cells, total, loss, done, most = np.zeros((2, classes, classes)), np.zeros(3 * len(old.weights)), 0.0, 0, 0
        for part in batches:
            for block, n, held, *packed in zip(*(part.column(c).to_pylist() for c in ("block", "n", "held", "x", "y", "weight")), strict=True):
                x, y, weight = np.frombuffer(packed[0], "<f8").reshape(n, -1), np.frombuffer(packed[1], "<i4"), np.frombuffer(packed[2], "<f8")
                learned = n - held
                said = forward(x, layers(old.weights, sizes)).argmax(axis=1)
                np.add.at(cells[0], (y[learned:], said[learned:]), 1)
                np.add.at(cells[1], (y[:learned], said[:learned]), 1)
                if learns and learned:
                    rng = np.random.default_rng([seed, number, block])
                    new, own, after = epoch(x[:learned], y[:learned], weight[:learned], old, steps, sizes, batch, rate, dropout, rng)
                    total += learned * np.concatenate(new)
                    loss, done, most = loss + own, done + learned, max(most, after)
        facts = np.concatenate([cells.ravel(), [loss, done]])
        pieces = [facts, *(total[k : k + PIECE] for k in range(0, len(total) if done else 0, PIECE))]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(pieces) - 1), pa.int32()), pa.array([most] * len(pieces), pa.int64()), pa.array(pieces, pa.list_(pa.float64()))], ["piece", "steps", "sums"])

    merged = blocks.mapInArrow(run, "piece int, steps long, sums array<double>").groupBy("piece")
    rows = merged.agg(F.max("steps").alias("steps"), Summarizer.sum(array_to_vector("sums")).alias("sums")).orderBy("piece").collect()
    facts = rows[0].sums.toArray()
    cells = facts[: 2 * classes * classes].reshape(2, classes, classes)
    done = facts[-1]
    judged = cells[0] if cells[0].sum() else cells[1]
    if not done:
        return judged, None, 0.0, steps
    mean = np.concatenate([r.sums.toArray() for r in rows[1:]]) / done
    return judged, State(*np.split(mean, 3)), float(facts[-2] / done), rows[0].steps
