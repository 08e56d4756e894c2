import numpy as np
import pytest
from pyspark.sql import functions as F

from opinara.functions.vectors import CentroidSet, DenseWeights, dense_forward, issue_tagger
from opinara.operators import clustering as K
from opinara.operators import scoring
from opinara.schema import CENTROIDS, FALLBACK_SCOPE


def blobs(spark, n=600, k=4, dim=6, categories=("a", "b", "tiny"), seed=3):
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, 5, (k, dim))
    rows = []
    for i in range(n):
        c = i % k
        category = categories[0] if i % 3 < 2 else (categories[1] if i % 50 else categories[2])
        rows.append((i, category, c, [float(np.float32(x)) for x in centers[c] + rng.normal(0, 0.2, dim)], f"word{c} common text{i % 5}"))
    return spark.createDataFrame(rows, "id int, category string, truth int, features array<float>, text string"), centers


CENTROID_ROWS = [
    (FALLBACK_SCOPE, 0, "zero", 1.0, [0.0, 0.0]),
    (FALLBACK_SCOPE, 1, "ten", 1.0, [10.0, 0.0]),
    (FALLBACK_SCOPE, 2, None, 1.0, [0.0, 10.0]),
    ("Books", 0, "pages", 2.0, [1.0, 1.0]),
    ("Books", 1, "binding", None, [5.0, 5.0]),
]


def test_tagging_rules(spark):
    rows = [
        (1, "Toys", [0.5, 0.0]), (2, "Toys", [8.0, 0.0]), (3, "Toys", [0.0, 10.0]), (4, "Books", [1.0, 2.0]),
        (5, "Books", [9.0, 9.0]), (6, "", [9.5, 0.0]), (7, None, [9.0, 0.0]), (8, "Books", None), (9, "Books", [1.0, -1.5]),
    ]
    reviews = spark.createDataFrame(rows, "id int, category string, features array<float>")
    got = {r["id"]: r for r in K.tag_issues(reviews, spark.createDataFrame(CENTROID_ROWS, CENTROIDS)).collect()}
    tags = {i: (r["issue_tag"], r["cluster_source"]) for i, r in got.items()}
    assert tags == {
        1: ("zero", FALLBACK_SCOPE), 2: ("other", FALLBACK_SCOPE), 3: ("other", FALLBACK_SCOPE), 4: ("pages", "per_category"),
        5: ("binding", "per_category"), 6: ("ten", FALLBACK_SCOPE), 7: ("ten", FALLBACK_SCOPE), 8: (None, None), 9: ("other", "per_category"),
    }
    assert got[2]["issue_distance"] == 2.0 and got[7]["issue_distance"] == 1.0  # exactly on the threshold stays


def test_no_centroids_at_all(spark):
    reviews = spark.createDataFrame([(1, "a", [1.0])], "id int, category string, features array<float>")
    row = K.tag_issues(reviews, spark.createDataFrame([], CENTROIDS)).first()
    assert (row["issue_tag"], row["issue_distance"], row["cluster_source"]) == ("other", 0.0, FALLBACK_SCOPE)


def test_blocks_give_the_same_tags(spark, monkeypatch):
    rows, _ = blobs(spark)
    centroids = K.label_centroids(rows, "truth", F.col("category")).unionByName(K.label_centroids(rows, "truth", F.lit(FALLBACK_SCOPE)))
    want = sorted(map(tuple, K.tag_issues(rows, centroids).select("id", "issue_tag", "issue_distance").collect()))
    monkeypatch.setattr(K, "MODEL_BYTES_LIMIT", 400)
    assert K.category_blocks(centroids) > 1
    assert sorted(map(tuple, K.tag_issues(rows, centroids).select("id", "issue_tag", "issue_distance").collect())) == want


def test_nearest_against_numpy(spark):
    rng = np.random.default_rng(0)
    matrix = rng.normal(size=(15, 32))
    x = rng.normal(size=(500, 32)).astype(np.float32)
    df = spark.createDataFrame([(i, "c", v.tolist()) for i, v in enumerate(x)], "id int, category string, features array<float>")
    tag = issue_tagger(spark, {FALLBACK_SCOPE: CentroidSet(matrix, tuple(str(i) for i in range(15)), (None,) * 15)})
    for r in df.select("id", tag(F.col("features"), F.col("category")).alias("t")).collect():
        gaps = np.linalg.norm(matrix - x[r["id"]].astype(float), axis=1)
        assert r["t"]["cluster_id"] == gaps.argmin() and r["t"]["issue_distance"] == pytest.approx(gaps.min(), rel=1e-12)


def test_forward_against_numpy(spark):
    weights = scoring.fixed_weights(8, hidden=(5, 4))
    x = np.random.default_rng(1).normal(size=(50, 8)).astype(np.float32)
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(50, None)]
    df = spark.createDataFrame(data, "id int, features array<float>")
    got = {r["id"]: r["p"] for r in df.select("id", dense_forward(spark, weights)(F.col("features")).alias("p")).collect()}
    (w1, b1), (w2, b2), (w3, b3) = weights.layers
    h = np.maximum(np.maximum(x @ w1 + b1, 0) @ w2 + b2, 0) @ w3 + b3
    want = np.exp(h - h.max(1, keepdims=True))
    want /= want.sum(1, keepdims=True)
    assert got[50] is None
    assert np.allclose([got[i] for i in range(50)], want)


def test_fused_scoring_equals_separate_steps(spark):
    from opinara.functions import scores

    rows, _ = blobs(spark)
    centroids = K.label_centroids(rows, "truth", F.lit(FALLBACK_SCOPE), 0.5)
    weights = DenseWeights(((np.random.default_rng(2).normal(size=(6, 3)), np.zeros(3)),))
    fused = scoring.score_reviews(rows.select("id", "category", "features"), weights, centroids)
    probs = dense_forward(spark, weights)(F.col("features"))
    apart = rows.select("id", "category", "features", probs.alias("p"))
    apart = apart.withColumn("d", scores.asymmetric_rule(scores.argmax(F.col("p")), scores.margin(F.col("p"))))
    masked = apart.withColumn("features", F.when(F.col("d") == 0, F.col("features")))
    tagged = K.tag_issues(masked, centroids).select("id", scores.label_name(F.col("d")).alias("s"), F.col("issue_tag").alias("t"))
    both = fused.join(tagged, "id").collect()
    assert len(both) == 600 and {r["sentiment"] for r in both} >= {"negative", "neutral"}
    assert all(r["sentiment"] == r["s"] and r["issue_tag"] == r["t"] for r in both)


def test_clusters_recover_blobs(spark):
    rows, centers = blobs(spark)
    model = K.fit_global(rows, k=4, seeds=(1, 2))
    found = np.array(model.clusterCenters())
    assert all(np.linalg.norm(found - c, axis=1).min() < 0.2 for c in centers)
    curve = [r["inertia"] for r in K.inertia_sweep(rows, ks=(2, 4), max_iter=5).orderBy("k").collect()]
    assert curve[0] > curve[1]


def test_category_clusters(spark):
    rows, _ = blobs(spark)
    centroids = K.fit_per_category(rows, k=4, gate=100, max_iter=5)
    sizes = {r["scope"]: r["count"] for r in centroids.groupBy("scope").count().collect()}
    assert sizes == {"a": 4, "b": 4}  # the small category is below the gate
    tagged = K.tag_issues(rows.filter("category IN ('a', 'b')"), centroids)
    start = K.fit_per_category(rows, k=4, gate=100, max_iter=0)
    before = K.tag_issues(rows.filter("category IN ('a', 'b')"), start).agg(F.avg(F.col("issue_distance") ** 2)).first()[0]
    assert tagged.agg(F.avg(F.col("issue_distance") ** 2)).first()[0] <= before + 1e-9


def test_terms_and_worksheet(spark):
    rows, _ = blobs(spark, n=60)
    named = rows.withColumnRenamed("truth", "cluster_id")
    terms = K.cluster_terms(named, top=3, stop_words=["common"])
    first = {r["cluster_id"]: r["term"] for r in terms.filter("rank = 1").collect()}
    assert first == {c: f"word{c}" for c in range(4)}
    assert terms.filter("term LIKE '%common%'").isEmpty()
    scoped = K.cluster_terms(named, top=1, scope=["category"], min_cluster=2)
    assert {r["term"][:4] for r in scoped.collect()} <= {"word", "comm", "text"} and scoped.select("category").distinct().count() >= 2
    sheet = K.naming_worksheet(terms)
    assert sheet.count() == 4 and {r["size"] for r in sheet.collect()} == {15}
    with pytest.raises(ValueError, match="name"):
        K.check_names(sheet)
    filled = K.apply_names(sheet, {c: f"issue {c}" for c in range(4)})
    K.check_names(filled)
    centroids = K.label_centroids(named, "cluster_id", F.lit(FALLBACK_SCOPE))
    ready = K.named_centroids(centroids, filled.withColumn("scope", F.lit(FALLBACK_SCOPE)), 0.7)
    assert {(r["name"], r["threshold"]) for r in ready.collect()} == {(f"issue {c}", 0.7) for c in range(4)}
    samples = K.cluster_samples(named, n=2, chars=5).orderBy("cluster_id", "sample").collect()
    assert [(r["cluster_id"], r["id"]) for r in samples] == [(0, 0), (0, 4), (1, 1), (1, 5), (2, 2), (2, 6), (3, 3), (3, 7)]
    assert K.cluster_terms(named.filter("id < 0")).count() == 0


def test_calibration(spark):
    rows, _ = blobs(spark)
    named = rows.withColumnRenamed("truth", "cluster_id")
    centroids = K.label_centroids(named, "cluster_id", F.lit(FALLBACK_SCOPE))
    distances = K.own_distance(named, centroids)
    values = [r["distance"] for r in distances.collect()]
    for r in K.calibrate(distances).collect():
        assert r["distance"] == pytest.approx(np.quantile(values, r["p"]), abs=1e-6)
    compared = K.compare_clusterings(named, K.label_centroids(named, "cluster_id", F.col("category"), 0.7).unionByName(
        K.label_centroids(named, "cluster_id", F.lit(FALLBACK_SCOPE), 0.7))).first()
    assert compared["own_clusters"] == 600 and compared["distance_reduction"] > 0


def test_vectors_of_other_widths_get_no_tag(spark):
    centroids = spark.createDataFrame([(FALLBACK_SCOPE, 0, [0.0, 0.0]), (FALLBACK_SCOPE, 1, [9.0, 9.0])], "scope string, cluster_id int, centroid array<double>")
    sets = {FALLBACK_SCOPE: CentroidSet(np.array([r.centroid for r in centroids.collect()]), ("low", "high"), (None, None))}
    tag = issue_tagger(spark, sets)
    rows = [(1, [1.0]), (2, [9.0, 8.0, 7.0]), (3, [8.0, 9.0]), (4, [float("nan"), 0.0]), (5, None), (6, [None, 1.0])]
    frame = spark.createDataFrame(rows, "id int, v array<double>").select("id", tag(F.col("v"), F.lit("x")).alias("t"))
    assert {r.id: r.t and r.t.issue_tag for r in frame.collect()} == {1: None, 2: None, 3: "high", 4: None, 5: None, 6: None}


def test_all_starts_in_the_same_passes(spark):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from opinara.operators import kmeans

    rng = np.random.default_rng(4)
    data = [(i, f"c{i % 3 if i % 7 else 0}", rng.normal(size=6).tolist()) for i in range(1500)]
    rows = spark.createDataFrame(data, "id long, category string, features array<double>")
    fits = list(kmeans.fit(rows, (3, 6), (1, 2, 3), F.col("category"), "id"))
    assert sorted(f.run for f in fits) == sorted(kmeans.Run(c, k, s) for c in ("c0", "c1", "c2") for k in (3, 6) for s in (1, 2, 3))
    for one in fits:
        x = np.array([v for _, c, v in data if c == one.run.scope])
        squares = ((x[:, None, :] - one.centers[None]) ** 2).sum(axis=2)
        assert np.isclose(one.inertia, squares.min(axis=1).sum())
        assert one.sizes.tolist() == np.bincount(squares.argmin(axis=1), minlength=one.run.k).tolist()
        means = np.array([x[squares.argmin(axis=1) == c].mean(axis=0) for c in range(one.run.k)])
        assert ((means - one.centers) ** 2).sum() < 1e-2 * one.run.k  # settled: centres are means
    best = kmeans.best(iter(fits))
    for (scope, k), one in best.items():
        theirs = rows.filter(F.col("category") == scope).select(array_to_vector("features").alias("features"))
        assert one.inertia <= 1.03 * min(KMeans(k=k, seed=s, maxIter=100).fit(theirs).summary.trainingCost for s in (1, 2, 3))


def test_blocks_of_scopes_change_nothing(spark, monkeypatch):
    from opinara.operators import kmeans

    rows, _ = blobs(spark)
    whole = {f.run: f for f in kmeans.fit(rows, (4,), (1, 2), F.col("category"))}
    monkeypatch.setattr(kmeans, "BLOCK_BYTES", 1)
    parts = {f.run: f for f in kmeans.fit(rows, (4,), (1, 2), F.col("category"))}
    assert whole.keys() == parts.keys() and all(np.allclose(whole[r].centers, parts[r].centers) for r in whole)


def test_few_and_odd_vectors(spark):
    from opinara.operators import kmeans

    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [1.0]), (8, [0.0, 1.0])]
    frame = spark.createDataFrame([(i, None, v) for i, v in rows], "id long, category string, features array<double>")
    (one,) = kmeans.fit(frame, (5,), (1,), F.col("category"), "id")
    assert one.run.scope is None and one.inertia == 0 and sorted(one.sizes.tolist()) == [2, 2]
    assert list(kmeans.fit(frame.where("id = 4"), (5,), (1,))) == []
    with pytest.raises(ValueError, match="vector"):
        K.fit_global(frame.where("id = 4"))


def test_large_centroid_tables_score_and_compare_alike(spark, monkeypatch):
    rows, _ = blobs(spark)
    own = K.label_centroids(rows, "truth", F.col("category"), 0.5)
    centroids = K.label_centroids(rows, "truth", F.lit(FALLBACK_SCOPE), 0.5).unionByName(own)
    weights = DenseWeights(((np.random.default_rng(2).normal(size=(6, 3)), np.zeros(3)),))

    def outcome():
        scored = scoring.score_reviews(rows.select("id", "category", "features"), weights, centroids)
        return sorted(scored.drop("features").collect(), key=lambda r: r.id), K.compare_clusterings(rows, centroids).collect()

    whole = outcome()
    assert {r.cluster_source for r in whole[0] if r.sentiment == "negative"} and all(r.issue_tag is None for r in whole[0] if r.sentiment != "negative")
    monkeypatch.setattr(K, "MODEL_BYTES_LIMIT", 300)
    assert K.category_blocks(centroids) > 2 and outcome() == whole


def test_large_texts_are_dealt_to_many_tasks(spark, monkeypatch):
    rows = spark.range(40).select("id", (F.col("id") % 2).cast("int").alias("cluster_id"), F.concat_ws(" ", F.lit("alpha beta"), F.concat(F.lit("w"), F.col("id") % 5)).alias("text")).coalesce(1)
    whole = sorted(map(tuple, K.cluster_terms(rows, top=3).collect()))
    monkeypatch.setattr(K, "PIECE_BYTES", 100)
    assert K._pieces(rows).rdd.getNumPartitions() >= 5
    assert sorted(map(tuple, K.cluster_terms(rows, top=3).collect())) == whole and len(whole) == 6


def test_rows_of_one_piece_are_shared_by_the_cores(spark, monkeypatch):
    from opinara.operators import kmeans

    rows, _ = blobs(spark, n=3000)
    seen, sums = set(), kmeans._sums
    monkeypatch.setattr(kmeans, "CELLS_PER_TASK", 100_000, raising=False)
    monkeypatch.setattr(kmeans, "_sums", lambda members, *rest, **more: seen.add(members.rdd.getNumPartitions()) or sums(members, *rest, **more))
    assert [len(fit.centers) for fit in kmeans.fit(rows.coalesce(1), (30,), range(5), max_iter=2)] == [30] * 5
    assert seen == {5}  # 450,000 distances a pass
    seen.clear()
    list(kmeans.fit(rows.coalesce(1), (2,), (1,), max_iter=2))
    assert seen == {1}


def test_sums_against_numpy(spark, monkeypatch):
    from opinara.operators import kmeans

    monkeypatch.setattr(kmeans, "CELLS", 50)
    rng = np.random.default_rng(4)
    x, scope = rng.normal(size=(300, 6)), rng.integers(0, 2, 300)
    data = [(None if s else "a", i, v.tolist()) for i, (s, v) in enumerate(zip(scope, x, strict=True))]
    members = spark.createDataFrame(data, "scope string, key long, features array<double>").repartition(3)
    runs = [kmeans.Run(s, k, 1) for s in ("a", None) for k in (1, 3, 4)]
    centers = {n: rng.normal(size=(run.k, 6)) for n, run in enumerate(runs)}
    centers[5][3] = 100.0  # nothing is near
    for n, (count, total, cost) in kmeans._sums(members, runs, centers).items():
        own = x[scope == (0 if runs[n].scope else 1)]
        gaps = ((own[:, None] - centers[n][None]) ** 2).sum(axis=2)
        nearest = gaps.argmin(axis=1)
        assert count.tolist() == np.bincount(nearest, minlength=runs[n].k).tolist()
        assert np.allclose(total, [own[nearest == c].sum(axis=0) for c in range(runs[n].k)]) and cost == pytest.approx(gaps.min(axis=1).sum())
