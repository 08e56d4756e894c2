import pytest
from pyspark.sql import functions as F

from opinara.operators import curation, splits


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


@pytest.fixture(scope="module")
def data(spark):
    label = F.when(F.col("id") % 10 < 6, "positive").when(F.col("id") % 10 < 9, "negative").otherwise("neutral")
    return spark.range(3000).select("id", label.alias("label"), F.concat(F.lit("c"), F.col("id") % 3).alias("category")).cache()


def test_audit_rules(spark):
    rows = [(1, "mislabel", "negative"), (2, None, "neutral"), (3, "odd", "neutral"), (4, "model_wrong", "positive"),
            (5, "genuinely_mixed", "neutral"), (6, "mislabel", None), (7, "mislabel", "great")]
    audit = spark.createDataFrame(rows, "id int, manual_label string, corrected_label string")
    got = sorted(tuple(r) for r in curation.audit_violations(audit).collect())
    assert got == [(2, "not_reviewed"), (3, "unknown_bucket"), (4, "bucket_contradicts_label"), (6, "unknown_label"), (7, "unknown_label")]


def test_reaudit_rules(spark):
    rows = [(1, "mislabel_negative", None), (2, "", None), (3, "true_model_wrong_negative", None),
            (4, "true_model_wrong_positive", "odd"), (5, "true_model_wrong_positive", "ambiguous"), (6, "odd", None), (7, None, None)]
    reaudit = spark.createDataFrame(rows, "id int, primary_bucket string, error_subtype string")
    got = sorted(tuple(r) for r in curation.reaudit_violations(reaudit).collect())
    assert got == [(2, "not_reviewed"), (3, "missing_subtype"), (4, "unknown_subtype"), (6, "unknown_bucket"), (7, "not_reviewed")]
    changes = curation.reaudit_changes(reaudit).collect()
    assert [tuple(r) for r in changes] == [(1, "negative")]


def test_merge_keeps_the_first_label(spark):
    data = spark.createDataFrame([(1, "neutral"), (2, "neutral")], "id int, label string")
    change = spark.createDataFrame([(1, "negative")], "id int, new_label string")
    once = curation.merge_labels(data, change)
    twice = curation.merge_labels(once, spark.createDataFrame([(1, "positive")], "id int, new_label string"))
    got = {r["id"]: (r["original_label"], r["label"]) for r in twice.collect()}
    assert got == {1: ("neutral", "positive"), 2: ("neutral", "neutral")}
    assert [tuple(r) for r in curation.real_changes(data, once).collect()] == [(1, "neutral", "negative")]


def test_sets_and_alignment(spark):
    a, b = (spark.createDataFrame([(i,) for i in s], "id int") for s in ([1, 2, 3, 3], [3, 4]))
    assert ids(curation.id_union(a, b)) == [1, 2, 3, 4]
    assert ids(curation.id_difference(a, b)) == [1, 2]
    assert ids(curation.leaks(a, b)) == [3]
    assert ids(curation.append_new(b, a)) == [1, 2, 3, 4]
    assert ids(curation.append_distinct(a, b)) == [1, 2, 3, 4]
    got = {r["table"]: (r["missing"], r["repeated"]) for r in curation.alignment(a=a, b=b).collect()}
    assert got == {"a": (1, 1), "b": (2, 0)}


def test_duplicates(spark):
    texts = spark.createDataFrame([("x",), ("x",), ("x",), ("y",)], "text string")
    assert tuple(curation.duplicate_texts(texts).first()) == (4, 2, 0.5, True)


def test_stratified_split(data):
    split = splits.stratified_split(data).cache()
    assert split.count() == 3000 and split.select("id").distinct().count() == 3000
    sizes = {(r["split"], r["label"]): r["count"] for r in split.groupBy("split", "label").count().collect()}
    assert sizes[("test", "positive")] == 270 and sizes[("val", "positive")] == 270 and sizes[("train", "neutral")] == 210
    again = splits.stratified_split(data.repartition(5)).join(split.withColumnRenamed("split", "first"), "id")
    assert again.filter("split != first").isEmpty()


def test_resplit_never_leaks(data):
    reviewed, frozen = data.filter("id % 7 = 0"), data.filter("label = 'neutral' AND id % 4 = 1")
    split = splits.resplit_unreviewed(data, reviewed, frozen).cache()
    assert split.count() == 3000
    assert tuple(splits.leak_counts(split, reviewed, frozen).first()) == (0, 0, 0)
    assert ids(split.filter("split = 'frozen'")) == ids(frozen)
    eligible = 3000 - curation.id_union(reviewed, frozen).count()
    tested = split.filter("split = 'test'").count()
    assert eligible * 0.2 <= tested <= eligible * 0.2 + 3
    report = splits.split_report(split).agg(F.sum("count"), F.round(F.sum("pct_of_all"), 2)).first()
    assert tuple(report) == (3000, 100.0)
    bad = splits.leak_counts(splits.stratified_split(data), reviewed, frozen).first()
    assert bad["reviewed_in_test"] > 0 and bad["frozen_in_train"] > 0


def test_samples(data):
    reviewed = data.filter("id % 2 = 0")
    sample = splits.review_sample(data, reviewed, 250)
    assert sample.count() == 250 and sample.filter("id % 2 = 0").isEmpty()
    assert splits.review_sample(data.limit(100), reviewed, 250).filter("id % 2 = 0").isEmpty()
    held = {r["part"]: r["count"] for r in splits.holdout(data).groupBy("part").count().collect()}
    assert held == {"val": 240, "fit": 2760}
    per = splits.sized_sample(data, 400, strata=["category"]).groupBy("category").count().collect()
    assert sorted(r["count"] for r in per) == [400] * 3
    assert splits.sized_sample(data, 5000).count() == 3000
    curve = splits.fraction_samples(data).groupBy("fraction").count().collect()
    assert {r["fraction"]: r["count"] for r in curve} == {0.25: 750, 0.5: 1500, 0.75: 2250, 1.0: 3000}


def test_frozen_slice(spark):
    rows = [(i, ("genuinely_mixed", "mislabel_negative", "true_model_wrong_positive")[i % 3]) for i in range(900)]
    frozen = splits.freeze_hard_cases(spark.createDataFrame(rows, "id int, primary_bucket string"))
    assert frozen.count() == 300 and frozen.filter("primary_bucket = 'mislabel_negative'").isEmpty()


def test_weights(spark, data):
    got = {r["label"]: r["class_weight"] for r in splits.class_weights(data).collect()}
    assert got == pytest.approx({"positive": 3000 / (3 * 1800), "negative": 3000 / (3 * 900), "neutral": 3000 / (3 * 300)})
    registry = spark.createDataFrame(
        [(1, "true_model_wrong_negative", ""), (2, "x", "mixed_but_neutral | hm"), (3, "x", None), (4, "genuinely_mixed", "")],
        "id long, audit_status string, notes string",
    )
    weights = {r["id"]: r["weight"] / r["class_weight"] for r in splits.row_weights(data, registry, 4.0).filter("id < 6").collect()}
    assert weights == {0: 1.0, 1: 4.0, 2: 4.0, 3: 1.0, 4: 1.0, 5: 1.0}
