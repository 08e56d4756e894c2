import numpy as np
import pytest

from opinara.operators import models as M
from opinara.operators import network as N
from opinara.plans import retraining
from opinara.sources import tables


def rings(spark, n=300):
    """Two classes by distance from the middle, which no linear model tells apart, and a rare third."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, 2)) * 1.5
    y = np.where(np.hypot(*x.T) < 1.5, 0, 1)
    y[x[:, 0] > 2.2] = 2
    return spark.createDataFrame([(k, x[k].tolist(), int(y[k]), 1.0) for k in range(n)], "id long, features array<double>, y int, weight double")


def test_gradient_against_differences():
    rng = np.random.default_rng(1)
    sizes = [4, 5, 3, 3]
    flat = N.start(sizes, 3).weights
    x, y, weight = rng.normal(size=(12, 4)), rng.integers(0, 3, 12), rng.uniform(0.5, 3, 12)
    masks = [(rng.random((12, k)) > 0.3) / 0.7 for k in (5, 3)]
    gradient, loss = N.slope(x, y, weight, flat, sizes, masks)
    for k in range(0, len(flat), 3):
        step = np.zeros(len(flat))
        step[k] = 1e-6
        up, down = (N.slope(x, y, weight, flat + s * step, sizes, masks)[1] / weight.sum() for s in (1, -1))
        assert abs((up - down) / 2e-6 - gradient[k]) < 1e-6


def test_learns_what_is_not_linear(spark):
    rows = rings(spark)
    weights = N.fit(rows, 3, (16, 8))
    data = rows.collect()
    said = N.forward(np.array([r.features for r in data]), list(weights.layers)).argmax(axis=1)
    assert weights.activation == "relu" and np.mean(said == [r.y for r in data]) > 0.9


def test_partitions_change_nothing_and_blocks_are_averaged(spark, monkeypatch):
    rows = rings(spark, 200)
    one = N.fit(rows.repartition(5), 3, (6, 4), epochs=2)
    two = N.fit(rows.coalesce(1), 3, (6, 4), epochs=2)
    assert all(np.allclose(a, b) for x, y in zip(one.layers, two.layers) for a, b in zip(x, y))
    monkeypatch.setattr(N, "BLOCK_ROWS", 60)
    many = N.fit(rows, 3, (6, 4), epochs=2)
    again = N.fit(rows.repartition(3), 3, (6, 4), epochs=2)
    assert all(np.allclose(a, b) for x, y in zip(many.layers, again.layers) for a, b in zip(x, y))


def test_row_weights_count(spark):
    rows = spark.createDataFrame([(k, [1.0], k % 2, 9.0 if k % 2 else 1.0) for k in range(120)], "id long, features array<double>, y int, weight double")
    p = N.forward(np.array([[1.0]]), list(N.fit(rows, 2, (4,), epochs=6, dropout=0.0).layers))[0]
    assert 0.8 < p[1] < 0.97  # nine to one


def test_odd_rows(spark):
    rows = [(1, [1.0, 2.0], 0, 1.0), (1, [1.0, 2.0], 0, 1.0), (2, None, 1, 1.0), (3, [1.0, None], 1, 1.0), (None, [2.0, 1.0], 1, 1.0), (5, [1.0], 1, 1.0), (6, [0.0, 1.0], None, 1.0), (7, [float("nan"), 1.0], 1, 1.0)]
    frame = spark.createDataFrame(rows, "id long, features array<double>, y int, weight double")
    assert [w.shape for w, _ in N.fit(frame, 3, (3, 2), epochs=1).layers] == [(2, 3), (3, 2), (2, 3)]
    with pytest.raises(ValueError, match="vector"):
        N.fit(frame.where("id = 2"), 3)


def test_a_failed_gate_leaves_the_old_weights(spark, tmp_path):
    names = ["negative", "neutral", "positive"]
    rng = np.random.default_rng(2)
    rows = [(k, names[k % 3], "train" if k % 5 else ("frozen" if k % 3 == 1 else "test"), (np.eye(3)[k % 3] * 2 + rng.normal(0, 0.4, 3)).tolist()) for k in range(240)]
    dataset = spark.createDataFrame(rows, "review_id long, label string, split string, features array<double>")
    votes = spark.createDataFrame([], "review_id long, session_id string, manual_label string, date string, confidence_margin double")
    routed = retraining.verdicts(votes, dataset.select("review_id"), ["date", "session_id"])
    path = str(tmp_path / "weights")
    fit = lambda train: M.trained(train, hidden=(8, 4), max_iter=4)
    stored, weights, gate = retraining.renew(dataset, routed, path, fit=fit, floors={"negative_floor": 0.5, "frozen_floor": 0.2})
    assert stored and gate.first()["publish"]
    kept = tables.read_weights(spark, path)
    assert all(np.allclose(a, b) for x, y in zip(kept.layers, weights.layers) for a, b in zip(x, y))
    other = lambda train: M.trained(train, hidden=(3,), max_iter=1)
    stored, _, gate = retraining.renew(dataset, routed, path, fit=other, floors={"negative_floor": 1.1, "frozen_floor": 0.2})
    assert not stored and not gate.first()["publish"]
    assert [w.shape for w, _ in tables.read_weights(spark, path).layers] == [(3, 8), (8, 4), (4, 3)]
