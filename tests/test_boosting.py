import numpy as np
import pytest
from pyspark.sql import functions as F

from opinara.operators import boosting as B


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(600, 5))
    y = np.where(x[:, 0] * x[:, 1] > 0.3, 2, np.where(x[:, 2] > 0, 1, 0))  # no linear model can tell
    data = [(x[i].tolist(), int(y[i]), 1.0 + (i % 3)) for i in range(600)]
    return spark.createDataFrame(data, "features array<double>, y int, weight double").repartition(4).cache()


def loss(rows, model):
    data = rows.collect()
    p = B.softmax(model.scores(np.array([r.features for r in data])))
    return float(np.mean([r.weight * -np.log(p[k, r.y]) for k, r in enumerate(data)])), float(np.mean([p[k].argmax() == r.y for k, r in enumerate(data)]))


def test_loss_falls_and_trees_learn(rows):
    losses = [loss(rows, B.fit(rows, 3, trees=n, depth=4, step=0.3)) for n in (0, 5, 40)]
    assert losses[0][0] > losses[1][0] > losses[2][0] and losses[2][1] > 0.97


def test_blocks_give_the_same_trees(rows, monkeypatch):
    whole = B.fit(rows, 3, trees=3, depth=3)
    monkeypatch.setattr(B, "BLOCK_ROWS", 150)
    parts = B.fit(rows, 3, trees=3, depth=3)
    assert np.array_equal(whole.edges, parts.edges)
    for a, b in zip(whole.trees, parts.trees, strict=True):
        assert np.array_equal(a.feature, b.feature) and np.array_equal(a.last, b.last) and np.allclose(a.value, b.value)


def test_best_cut_against_all_cuts():
    rng = np.random.default_rng(3)
    bins = rng.integers(0, B.BINS, (80, 4)).astype(np.uint8)
    block = B.Block(bins, rng.integers(0, 3, 80), rng.uniform(0.5, 2, 80))
    scores = rng.normal(size=(80, 3))
    hist = B.sums(block, scores, B.Tree.empty(1, 3), [1])[0]
    p = B.softmax(scores)
    g = block.weight[:, None] * (p - np.eye(3)[block.y])
    h = block.weight[:, None] * 2 * p * (1 - p)
    worth = lambda rows: (g[rows].sum(axis=0) ** 2 / (h[rows].sum(axis=0) + B.RIDGE)).sum()
    best = max(
        (worth(left) + worth(~left) - worth(np.ones(80, bool)), -f, -b)
        for f in range(4)
        for b in range(B.BINS)
        if h[left := bins[:, f] <= b].sum() >= 1 and h[~left].sum() >= 1
    )
    found = B.best_cut(hist)
    assert np.isclose(found.gain, best[0]) and (found.feature, found.last) == (-best[1], -best[2])


def test_scores_are_taken_up_or_made_anew():
    rng = np.random.default_rng(5)
    block = B.Block(rng.integers(0, B.BINS, (50, 3)).astype(np.uint8), rng.integers(0, 3, 50), np.ones(50))
    trees = []
    for _ in range(4):
        scores = B._scored("x", 1, block, trees, 3)
        trees.append(B.grown(lambda t, a: [B.best_cut(s) for s in B.sums(block, scores, t, a)], 2, 3, 0.3))
    taken = B._scored("x", 1, block, trees, 3)
    assert np.allclose(taken, B._scored("y", 1, block, trees, 3)) and ("x", 1) not in B._scores
    assert np.allclose(B._scored("y", 1, block, trees[:2], 3), B._scored("z", 1, block, trees[:2], 3))


def test_odd_vectors(spark, rows):
    model = B.fit(rows, 3, trees=2, depth=2)
    score = B.probabilities(spark, model)
    odd = spark.createDataFrame([(None,), ([],), ([1.0] * 4,), ([1.0, None, 1.0, 1.0, 1.0],), ([float("nan")] * 5,), ([1.0] * 5,)], "features array<double>")
    found = [r.p for r in odd.coalesce(1).select(score(F.col("features")).alias("p")).collect()]
    assert found[:4] == [None] * 4 and all(abs(sum(p) - 1) < 1e-9 for p in found[4:])
    mixed = rows.unionByName(spark.createDataFrame([(None, 1, 1.0), ([1.0, None, 1.0, 1.0, 1.0], 1, 1.0), ([1.0] * 5, None, 1.0)], rows.schema))
    assert len(B.fit(mixed, 3, trees=1, depth=2).trees) == 1
    assert B.fit(rows.where("y = 7"), 3).trees == []


def test_a_hundred_thousand_rows_need_no_job_for_each_level(spark, monkeypatch):
    monkeypatch.setattr(B, "_level", lambda *a: pytest.fail("a job for a level"))
    rows = spark.range(100_000).select(F.array((F.col("id") % 7).cast("double"), (F.col("id") % 11).cast("double")).alias("features"), F.when(F.col("id") % 7 > 3, 1).otherwise(0).alias("y"), F.lit(1.0).alias("weight"))
    tree = B.fit(rows, 2, trees=2, depth=2).trees[0]
    assert tree.feature[1] == 0 and (tree.value[2] * tree.value[3] < 0).all()


def test_blocks_are_dealt_to_many_tasks(spark, rows, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_ROWS", 300)
    tasks, level = [], B._level
    monkeypatch.setattr(B, "_level", lambda session, blocks, *a: (tasks.append(blocks.rdd.getNumPartitions()), level(session, blocks, *a))[1])
    B.fit(rows.coalesce(1), 3, trees=1, depth=1)
    assert tasks[0] > 1
