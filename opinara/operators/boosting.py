"""Boosted trees for several classes: one softmax ensemble whose leaves hold a value for each class.

Features are cut into ``BINS`` bins by their quantiles, once, and rows are kept as blocks of bin numbers. A
level of a tree is one pass: each block sends its rows down the tree so far and adds up gradients and
curvatures by node, feature and bin; sums are merged by feature, the best cut of each node is found where
the feature's sums are, and the driver picks one of them for each node. All classes share the pass and the tree.

A task remembers the scores of the blocks it has seen and the number of trees in them, and adds the trees
that are missing; one that starts anew adds all. So a lost executor costs time but changes nothing. A table
of up to ``BLOCK_ROWS`` rows needs no merging, and its trees are grown by the same code in one task without a job
for each level; a larger one is cut into smaller blocks, which are dealt evenly to the cores.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.session import cut

BINS = 64
BLOCK_ROWS = 1 << 17  # rows that one task takes on alone
SHARES = 8  # blocks of a larger table have a share of that
TASK_BLOCKS = 64  # of one task, at most
CHUNK_ROWS = 1 << 13  # rows that are summed at once
RIDGE = 1.0
LEAST_CURVATURE = 1.0  # of each side of a cut, over all classes


class Tree(NamedTuple):
    """Nodes by heap order from 1 on: the feature and the last bin that go left (-1: a leaf), and what a leaf adds."""

    feature: np.ndarray
    last: np.ndarray
    value: np.ndarray

    @staticmethod
    def empty(depth: int, classes: int) -> Tree:
        size = 2 << depth
        return Tree(np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros((size, classes)))

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node at which each row ends."""
        at, rows = np.ones(len(bins), np.int64), np.arange(len(bins))
        while True:
            feature = self.feature[at[rows]]
            rows = rows[feature >= 0]
            if not len(rows):
                return at
            feature = self.feature[at[rows]]
            at[rows] = 2 * at[rows] + (bins[rows, feature] > self.last[at[rows]])


class Ensemble(NamedTuple):
    edges: np.ndarray  # features x (BINS - 1), ascending
    trees: list[Tree]
    classes: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        bins = binned(x, self.edges)
        out = np.zeros((len(x), self.classes))
        for tree in self.trees:
            out += tree.value[tree.nodes(bins)]
        return out


class Cut(NamedTuple):
    """The best cut of a node: what it gains, and gradients and curvatures of its left side and of all rows."""

    gain: float
    feature: int
    last: int
    left: np.ndarray
    total: np.ndarray


class Block(NamedTuple):
    bins: np.ndarray  # rows x features; each feature's numbers lie together
    y: np.ndarray
    weight: np.ndarray


def binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """How many edges of its feature lie below each value."""
    out = np.empty(x.shape, np.uint8, "F")
    for f in range(x.shape[1]):
        out[:, f] = np.searchsorted(edges[f], x[:, f], "left")
    return out


def softmax(scores: np.ndarray) -> np.ndarray:
    odds = np.exp(scores - scores.max(axis=1, keepdims=True))
    return odds / odds.sum(axis=1, keepdims=True)


def sums(block: Block, scores: np.ndarray, tree: Tree, active: Sequence[int]) -> np.ndarray:
    """Gradients and curvatures by active node, feature and bin."""
    classes = scores.shape[1]
    features = block.bins.shape[1]
    number = np.full(len(tree.feature), -1, np.int64)
    number[list(active)] = np.arange(len(active))
    node = number[tree.nodes(block.bins)]
    out = np.zeros((features, 2 * classes, len(active) * BINS))
    cells = np.empty(CHUNK_ROWS, np.int64)
    for start in range(0, len(node), CHUNK_ROWS):  # some rows, and of these one feature at a time: what is summed stays in the processor's cache
        rows = start + np.flatnonzero(node[start : start + CHUNK_ROWS] >= 0)
        if not len(rows):
            continue
        whole = len(rows) == len(node[start : start + CHUNK_ROWS])
        p = softmax(scores[rows])
        weight = block.weight[rows, None]
        gradient = weight * (p - np.eye(classes)[block.y[rows]])
        parts = np.concatenate([gradient, weight * 2 * p * (1 - p)], axis=1).T.copy()
        first, cell = node[rows] * BINS, cells[: len(rows)]
        for f in range(features):
            np.add(first, block.bins[start : start + CHUNK_ROWS, f] if whole else block.bins[rows, f], out=cell)
            for k, part in enumerate(parts):
                out[f, k] += np.bincount(cell, part, len(active) * BINS)
    return out.reshape(features, 2 * classes, len(active), BINS).transpose(2, 0, 3, 1)


def best_cut(hist: np.ndarray, first_feature: int = 0) -> Cut:
    """The best cut of one node from its sums by feature and bin; among equal ones the first."""
    classes = hist.shape[2] // 2
    left = np.cumsum(hist, axis=1)
    total = left[0, -1]

    def worth(x: np.ndarray) -> np.ndarray:
        return (x[..., :classes] ** 2 / (x[..., classes:] + RIDGE)).sum(axis=-1)

    right = total - left
    gain = worth(left) + worth(right) - worth(total)
    enough = (left[..., classes:].sum(axis=-1) >= LEAST_CURVATURE) & (right[..., classes:].sum(axis=-1) >= LEAST_CURVATURE)
    gain = np.where(enough, gain, 0.0)
    feature, last = np.unravel_index(int(gain.argmax()), gain.shape)
    return Cut(float(gain[feature, last]), first_feature + int(feature), int(last), left[feature, last], total)


def grown(cuts: Callable[[Tree, Sequence[int]], list[Cut]], depth: int, classes: int, step: float) -> Tree:
    """A tree, level by level, from the best cuts of the nodes of each level."""
    tree, active = Tree.empty(depth, classes), [1]

    def value(part: np.ndarray) -> np.ndarray:
        return -step * part[:classes] / (part[classes:] + RIDGE)

    for _ in range(depth):
        below = []
        for node, found in zip(active, cuts(tree, active), strict=True):
            if node == 1:
                tree.value[1] = value(found.total)
            if found.gain > 1e-9:
                tree.feature[node], tree.last[node] = found.feature, found.last
                tree.value[2 * node], tree.value[2 * node + 1] = value(found.left), value(found.total - found.left)
                below += [2 * node, 2 * node + 1]
        active = below
        if not active:
            break
    return tree


_scores: dict[tuple[str, int], tuple[int, np.ndarray]] = {}


def _scored(name: str, number: int, block: Block, trees: Sequence[Tree], classes: int) -> np.ndarray:
    """Scores of a block after all trees; what this worker has of it is taken up."""
    for old in [key for key in _scores if key[0] != name]:
        del _scores[old]
    done, scores = _scores.get((name, number), (0, None))
    scores = np.zeros((len(block.y), classes)) if scores is None or done > len(trees) else scores
    for tree in trees[done if done <= len(trees) else 0 :]:
        scores = scores + tree.value[tree.nodes(block.bins)]
    _scores[name, number] = (len(trees), scores)
    return scores


def _blocks(edges: np.ndarray, block_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, held, size, made = len(edges), [], 0, 0
        place = TaskContext.get().partitionId() << 32

        def out() -> pa.RecordBatch:
            bins, y, weight = (np.concatenate(x) for x in zip(*held, strict=True))
            values = [place + made, len(y), bins.tobytes("F"), y.astype(np.uint8).tobytes(), weight.astype("<f8").tobytes()]
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["block", "n", "bins", "y", "weight"])

        for batch in batches:
            x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            y, weight = batch.column("y").to_numpy(), batch.column("weight").to_numpy()
            for k in range(0, len(x), block_rows):
                part = slice(k, k + block_rows)
                if held and size + len(y[part]) > block_rows:
                    yield out()
                    held, size, made = [], 0, made + 1
                held.append((binned(x[part], edges), y[part], weight[part]))
                size += len(y[part])
        if held:
            yield out()

    return run


def _read(batches: Iterator[pa.RecordBatch], features: int) -> Iterator[tuple[int, Block]]:
    for batch in batches:
        for number, n, bins, y, weight in zip(*(batch.column(c).to_pylist() for c in ("block", "n", "bins", "y", "weight")), strict=True):
            yield number, Block(np.frombuffer(bins, np.uint8).reshape(features, n).T, np.frombuffer(y, np.uint8), np.frombuffer(weight, "<f8"))


def _in_one_task(blocks: DataFrame, features: int, classes: int, trees: int, depth: int, step: float) -> list[Tree]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in _read(batches, features):
            scores, out = np.zeros((len(block.y), classes)), []
            for _ in range(trees):
                tree = grown(lambda now, active: [best_cut(h) for h in sums(block, scores, now, active)], depth, classes, step)
                scores = scores + tree.value[tree.nodes(block.bins)]
                out.append(tree)
            columns = [pa.array(range(trees), pa.int32()), pa.array([t.feature for t in out], pa.list_(pa.int32())), pa.array([t.last for t in out], pa.list_(pa.int32())), pa.array([t.value.ravel() for t in out], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["number", "feature", "last", "value"])

    rows = blocks.mapInArrow(run, "number int, feature array<int>, last array<int>, value array<double>").orderBy("number").collect()
    return [Tree(np.array(r.feature, np.int32), np.array(r.last, np.int32), np.array(r["value"]).reshape(-1, classes)) for r in rows]


def _level(spark: SparkSession, blocks: DataFrame, name: str, features: int, classes: int, trees: Sequence[Tree]) -> Callable[[Tree, Sequence[int]], list[Cut]]:
    """The best cuts of a level over all blocks."""

    def cuts(tree: Tree, active: Sequence[int]) -> list[Cut]:
        shared = spark.sparkContext.broadcast((trees, tree, list(active)))

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            done, now, nodes = shared.value
            total = np.zeros((len(nodes), features, BINS, 2 * classes))
            for number, block in _read(batches, features):
                total += sums(block, _scored(name, number, block, done, classes), now, nodes)
            parts = [np.ascontiguousarray(total[:, f]).tobytes() for f in range(features)]
            yield pa.RecordBatch.from_arrays([pa.array(range(features), pa.int32()), pa.array(parts, pa.binary())], ["feature", "part"])

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nodes, whole = shared.value[2], {}
            for batch in batches:
                for f, part in zip(batch.column("feature").to_pylist(), batch.column("part"), strict=True):
                    own = np.frombuffer(part.as_buffer()).reshape(len(nodes), 1, BINS, 2 * classes)
                    whole[f] = whole[f] + own if f in whole else own
            found = [(node, best_cut(hist[k], f)) for f, hist in sorted(whole.items()) for k, node in enumerate(nodes)]
            columns = [pa.array([node for node, _ in found], pa.int32()), pa.array([c.gain for _, c in found], pa.float64())]
            columns += [pa.array(part, pa.int32()) for part in ([c.feature for _, c in found], [c.last for _, c in found])]
            sides = [pa.array([x.tolist() for x in side], pa.list_(pa.float64())) for side in ([c.left for _, c in found], [c.total for _, c in found])]
            yield pa.RecordBatch.from_arrays([*columns, *sides], ["node", "gain", "feature", "last", "left", "total"])

        merged = blocks.mapInArrow(add, "feature int, part binary").repartition(min(features, spark.sparkContext.defaultParallelism), "feature")
        rows = merged.mapInArrow(choose, "node int, gain double, feature int, last int, left array<double>, total array<double>").collect()
        shared.unpersist()
        best: dict[int, Cut] = {}
        for r in sorted(rows, key=lambda r: (r.node, -r.gain, r.feature)):  # one row for each node and feature
            best.setdefault(r.node, Cut(r.gain, r.feature, r["last"], np.array(r.left), np.array(r.total)))
        return [best[node] for node in active]

    return cuts


def fit(rows: DataFrame, classes: int, trees: int = 300, depth: int = 6, step: float = 0.1) -> Ensemble:
    """Boosted trees from rows with features, y (0 to classes - 1) and weight; those with nulls take no part.

    All vectors have the width of the first. Without rows the ensemble has no trees.
    """
    good = rows.where("features IS NOT NULL AND y IS NOT NULL AND weight > 0").select(F.col("features").cast("array<double>").alias("features"), F.col("y").cast("int").alias("y"), F.col("weight").cast("double").alias("weight"))
    first = good.select(F.size("features").alias("w")).first()
    if first is None:
        return Ensemble(np.zeros((0, BINS - 1)), [], classes)
    good = good.where((F.size("features") == first.w) & F.forall("features", lambda x: x.isNotNull()))
    names = [f"f{k}" for k in range(first.w)]
    wide = good.select(*[F.col("features")[k].alias(name) for k, name in enumerate(names)])
    edges = np.array(wide.approxQuantile(names, [k / BINS for k in range(1, BINS)], 0.25 / BINS)).reshape(first.w, BINS - 1)
    count, spark = good.count(), rows.sparkSession
    alone = count <= BLOCK_ROWS
    block_rows = BLOCK_ROWS if alone else max(BLOCK_ROWS // SHARES, 1)
    blocks = good.coalesce(1 if alone else count // block_rows).mapInArrow(_blocks(edges, block_rows), "block long, n int, bins binary, y binary, weight binary")
    if alone:
        return Ensemble(edges, _in_one_task(cut(blocks), first.w, classes, trees, depth, step), classes)
    tasks = min(max(spark.sparkContext.defaultParallelism, count // (block_rows * TASK_BLOCKS)), -(-count // block_rows))
    blocks = cut(blocks.repartition(tasks))
    name, made = uuid.uuid4().hex, []
    for _ in range(trees):
        made.append(grown(_level(spark, blocks, name, first.w, classes, list(made)), depth, classes, step))
    return Ensemble(edges, made, classes)


def probabilities(spark: SparkSession, model: Ensemble):
    """Column function features -> class probabilities; null without a whole vector of the model's width."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("array<double>")
    def score(features: pa.Array) -> pa.Array:
        own = shared.value
        width = len(own.edges)
        sizes = np.diff(features.offsets.to_numpy())
        values = features.values.slice(features.offsets[0].as_py(), features.offsets[len(features)].as_py() - features.offsets[0].as_py())
        holes = np.append(0, np.cumsum(values.is_null().to_numpy(zero_copy_only=False)))
        ends = np.append(0, np.cumsum(sizes))
        good = (sizes == width) & (np.diff(holes[ends]) == 0) & features.is_valid().to_numpy(zero_copy_only=False)
        flat = values.fill_null(0).to_numpy().astype(np.float64)
        x = flat[np.repeat(good, sizes)].reshape(-1, width)
        out = np.zeros((len(sizes), own.classes))
        if len(x):
            out[good] = softmax(own.scores(x))
        offsets = pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * own.classes)
        return pa.ListArray.from_arrays(offsets, pa.array(out.ravel()), mask=pa.array(~good))

    return score
