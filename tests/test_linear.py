import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from opinara.operators import linear as L


def table(spark, n=400):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(n, 3)) * [1.0, 5.0, 0.2]
    y = (x @ np.array([[1.0, -1, 0], [0.1, 0.2, -0.3], [2, 0, -3]]) + rng.gumbel(size=(n, 3)) * 0.7).argmax(axis=1)
    rows = [(k, x[k].tolist(), int(y[k]), 1.0, [0] if k % 2 else [0, 1]) for k in range(n)]
    return spark.createDataFrame(rows, "id int, features array<double>, y int, weight double, models array<int>").repartition(3)


def objective(data, w, classes=3):
    """The same sum as the fit minimises, with features scaled by their deviation over all rows."""
    x = np.array([r.features for r in data])
    scale = x.std(axis=0, ddof=1)
    y = np.array([r.y for r in data])
    own = np.bincount(y, minlength=classes)
    mass = (len(y) / (np.count_nonzero(own) * np.maximum(own, 1)))[y]
    z = np.column_stack([x, np.ones(len(x))]) @ w
    logs = z - np.log(np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)) - z.max(axis=1, keepdims=True)
    return -(mass @ logs[np.arange(len(y)), y]) / mass.sum() + L.RIDGE * ((w[:-1] * scale[:, None]) ** 2).sum() / 2


def test_least_objective_and_the_known_fit(spark):
    rows = table(spark)
    data = rows.collect()
    fits = L.fit_all(rows, 2, 3, tol=1e-10)
    assert sorted(fits) == [0, 1]
    best = objective(data, fits[0])
    rng = np.random.default_rng(1)
    assert all(objective(data, fits[0] + rng.normal(size=(4, 3)) * 0.02) >= best for _ in range(50))
    own = np.bincount([r.y for r in data], minlength=3)
    vectors = rows.withColumn("vec", array_to_vector("features")).withColumn("w", F.element_at(F.array(*[F.lit(float(len(data) / (3 * n))) for n in own]), F.col("y") + 1))
    model = LogisticRegression(featuresCol="vec", labelCol="y", weightCol="w", family="multinomial", regParam=L.RIDGE, tol=1e-9, maxIter=200).fit(vectors)
    theirs = np.vstack([model.coefficientMatrix.toArray().T, model.interceptVector.toArray()])
    centred = lambda w: w - w.mean(axis=1, keepdims=True)
    assert np.allclose(centred(fits[0]), centred(theirs), atol=5e-2)


def test_models_don_t_touch_each_other_and_blocks_change_nothing(spark, monkeypatch):
    rows = table(spark)
    both = L.fit_all(rows, 2, 3)
    alone = L.fit_all(rows.withColumn("models", F.array_remove("models", 0)), 2, 3)
    assert list(alone) == [1] and objective([r for r in rows.collect() if 1 in r.models], alone[1]) - objective([r for r in rows.collect() if 1 in r.models], both[1]) < 1e-4
    monkeypatch.setattr(L, "BLOCK_BYTES", 1)
    parts = L.fit_all(rows, 2, 3)
    assert all(np.allclose(both[m], parts[m]) for m in both)


def test_predictions_and_odd_rows(spark):
    rows = table(spark, 60)
    odd = spark.createDataFrame([(1, None, 0, 1.0, [0]), (2, [1.0, None, 2.0], 0, 1.0, [0]), (3, [1.0], 0, 1.0, [0]), (4, [1.0, 2.0, 3.0], None, 1.0, [0]), (5, [1.0, 2.0, 3.0], 0, 1.0, None)], rows.schema)
    fits = L.fit_all(rows.unionByName(odd), 3, 3, max_iter=5)
    assert sorted(fits) == [0, 1]
    asked = rows.unionByName(odd).coalesce(1).withColumn("model", F.col("id") % 3)
    for r in L.predictions(asked, fits).collect():
        if r.features is None or None in r.features or len(r.features) != 3 or r.model == 2:
            assert r.probs is None
        else:
            z = np.append(r.features, 1.0) @ fits[r.model]
            assert np.allclose(r.probs, np.exp(z - z.max()) / np.exp(z - z.max()).sum())
    assert L.fit_all(odd.where("id = 1"), 1, 3) == {}
