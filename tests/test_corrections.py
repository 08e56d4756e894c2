import pytest
from pyspark.sql import functions as F

from opinara.operators import corrections as C
from opinara.plans import retraining

VOTES = "review_id string, session_id string, manual_label string, date string, confidence_margin double"


def votes_of(spark, *rows):
    return spark.createDataFrame([(*r, "2025-01-01", 0.2) if len(r) == 3 else r for r in rows], VOTES)


def routed(spark, votes, known):
    ids = spark.createDataFrame([(k,) for k in known], "review_id string")
    return {r["review_id"]: r for r in retraining.verdicts(votes, ids, ["date", "session_id"]).collect()}


def test_sessions_of_three_equal_votes_are_dropped_and_two_are_kept(spark):
    votes = votes_of(
        spark, ("a", "s1", "positive"), ("b", "s1", "positive"), ("c", "s1", "positive"),
        ("a", "s2", "positive"), ("b", "s2", "positive"),
        ("a", "s3", "negative"), ("b", "s3", "neutral"), ("c", "s3", "positive"),
        ("a", "", "negative"), ("b", "", "negative"), ("c", "", "negative"), ("c", None, "negative"),
    )
    got = [tuple(r) for r in C.suspicious_sessions(votes).collect()]
    assert got == [("s1", 3, 1.0)]
    gate = C.volume_gate(votes, 10).first()
    assert (gate["loaded"], gate["remaining"], gate["enough_loaded"], gate["enough_remaining"]) == (12, 9, True, False)


def test_exactly_seventy_percent_is_not_suspicious(spark):
    rows = [(f"r{i}", "s", "positive" if i < 7 else "negative") for i in range(10)]
    assert C.suspicious_sessions(votes_of(spark, *rows)).count() == 0


def test_routing(spark):
    votes = votes_of(
        spark,
        ("known", "s1", "negative"), ("known", "s2", "negative"), ("known", "s3", "neutral"),
        ("tie", "s1", "positive"), ("tie", "s4", "negative"),
        ("lonely", "s5", "positive"), ("lonely", "s5", "positive", "2025-01-02", 0.1),
        ("blank", "", "positive"), ("blank", "", "positive"),
        ("sure", "s6", "positive", "2025-01-01", 0.71), ("sure", "s7", "positive", "2025-01-02", 0.1),
        ("edge", "s6", "neutral", "2025-01-01", 0.70), ("edge", "s7", "neutral", "2025-01-01", 0.70),
        ("new", "s8", "neutral"), ("new", "s9", "neutral"),
        ("x1", "bad", "positive"), ("x2", "bad", "positive"), ("x3", "bad", "positive"),
    )
    got = routed(spark, votes, ["known", "tie", "lonely", "sure", "edge", "x1"])
    assert {k: r["status"] for k, r in got.items()} == {
        "known": "applied", "tie": "excluded_tie", "lonely": "deferred_volume", "blank": "deferred_volume",
        "sure": "applied_flagged", "edge": "applied", "new": "new_text",
        "x1": "excluded_session", "x2": "excluded_session", "x3": "excluded_session",
    }
    assert got["known"]["new_label"] == "negative" and got["tie"]["new_label"] is None
    assert got["sure"]["new_label"] == "positive"


def test_only_training_rows_are_relabelled(spark):
    data = spark.createDataFrame([("a", "neutral", "train"), ("b", "neutral", "test"), ("c", "neutral", "train")],
                                 "review_id string, label string, split string")
    verdicts = spark.createDataFrame(
        [("a", "applied", "negative"), ("b", "applied", "negative"), ("n", "new_text", "positive")], "review_id string, status string, new_label string"
    )
    got = {r["review_id"]: (r["label"], r["outcome"]) for r in C.apply_verdicts(data, verdicts).collect()}
    assert got == {"a": ("negative", "relabelled"), "b": ("neutral", "blocked"), "c": ("neutral", "untouched")}
    assert [tuple(r) for r in C.new_training_rows(verdicts).collect()] == [("new_n", "positive", "train")]


@pytest.fixture
def merged(spark):
    reviews = spark.createDataFrame(
        [("r1", "b1", "text 1", "negative", 0.25), ("r2", "b1", "text 2", "positive", 0.9)],
        "review_id string, batch_id string, text string, sentiment string, confidence_margin double",
    )
    stored = "correction_id string, review_id string, batch_id string, text string, label string, manual_label string, date string, session_id string, confidence_margin double"
    existing = spark.createDataFrame(
        [("c1", "r1", "b1", "text 1", "negative", "neutral", "2025-01-01", "s1", 0.25),
         ("c2", "r1", "b1", "text 1", "negative", "neutral", "2025-01-02", "s2", 0.25)], stored)
    incoming = spark.createDataFrame(
        [("r1", "s1", "positive", "2025-02-01"), ("r1", "s1", "neutral", "2025-01-15"), ("r1", "s9", "positive", "2025-02-02"),
         ("r2", "", "neutral", "2025-02-03"), ("r2", "s1", "positive", "2025-02-03"), ("zz", "s1", "positive", "2025-02-03")],
        "review_id string, session_id string, manual_label string, date string")
    return C.merge_corrections(incoming, existing, reviews)


def test_merge(merged):
    kept, rejects = merged
    rows = {(r["review_id"], r["session_id"]): r for r in kept.collect()}
    assert len(rows) == 4
    assert rows["r1", "s1"]["correction_id"] == "c1" and rows["r1", "s1"]["manual_label"] == "positive"
    assert rows["r1", "s2"]["manual_label"] == "neutral"  # untouched
    assert rows["r1", "s9"]["confidence_margin"] == 0.25
    assert rows["r2", ""]["label"] == "positive"
    assert {(r["review_id"], r["reason"]) for r in rejects.collect()} == {("r2", "NO_OP"), ("zz", "NOT_FOUND")}


def test_blank_session_replaces_the_first_correction(spark, merged):
    kept, _ = merged
    reviews = spark.createDataFrame([("r1", "b1", "text 1", "negative", 0.25)],
                                    "review_id string, batch_id string, text string, sentiment string, confidence_margin double")
    vote = spark.createDataFrame([("r1", None, "neutral", "2025-03-01")], "review_id string, session_id string, manual_label string, date string")
    again, _ = C.merge_corrections(vote, kept, reviews)
    rows = {r["correction_id"]: r for r in again.filter("review_id = 'r1'").collect()}
    assert len(rows) == 3 and rows["c2"]["session_id"] == "" and rows["c2"]["date"] == "2025-03-01"


def test_listing(spark):
    rows = spark.createDataFrame(
        [("1", "r1", "b", "negative", "positive", "2025-01-02", 0.1), ("2", "r9", "", "neutral", "positive", "2025-01-01", 0.2),
         ("3", "r1", None, "negative", "neutral", None, 0.3)],
        "correction_id string, review_id string, batch_id string, label string, manual_label string, date string, confidence_margin double")
    reviews = spark.createDataFrame([("r1", 0.8, "Books")], "review_id string, confidence_margin double, category string")
    got = {r["correction_id"]: (r["confidence_margin"], r["category"]) for r in C.with_review_fields(rows, reviews).collect()}
    assert got == {"1": (0.8, "Books"), "2": (0.2, None), "3": (0.8, "Books")}
    assert tuple(C.correction_totals(rows).first()) == (3, 1)
    assert [r["correction_id"] for r in C.correction_list(rows).collect()] == ["3", "2", "1"]
    assert [r["correction_id"] for r in C.correction_list(rows, original="negative", ascending=False).collect()] == ["1", "3"]
    assert C.invalid_labels(rows.withColumn("manual_label", F.lit("great"))).count() == 3


def test_one_review_with_most_votes(spark):
    """A single review holding most of the votes stays exact."""
    votes = spark.range(20_000).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("r"), F.col("id"))).alias("review_id"),
        F.concat(F.lit("s"), F.col("id") % 997).alias("session_id"),
        F.when(F.col("id") % 5 < 3, "negative").otherwise("positive").alias("manual_label"),
        F.lit("2025-01-01").alias("date"), F.lit(0.1).alias("confidence_margin"),
    )
    got = routed(spark, votes, ["hot"])["hot"]
    kept = C.flag_sessions(votes).filter("review_id = 'hot' AND NOT suspicious")
    assert got["votes"] == kept.count() and got["sessions"] == kept.select("session_id").distinct().count()
    assert got["majority"] == "negative"


def test_a_no_op_vote_takes_nothing_back(spark):
    reviews = spark.createDataFrame([(1, "b", "t", "negative", 0.4)], "review_id long, batch_id string, text string, sentiment string, confidence_margin double")
    none = spark.createDataFrame([], "correction_id string, review_id long, batch_id string, text string, label string, manual_label string, date string, session_id string, confidence_margin double")
    votes = [(1, "s", "positive", "2024-01-01"), (1, "s", "negative", "2024-01-02"), (1, "s", "negative", "2024-01-02"), (9, None, "neutral", "2024-01-03")]
    incoming = spark.createDataFrame(votes, "review_id long, session_id string, manual_label string, date string")
    merged, rejects = C.merge_corrections(incoming, none, reviews)
    assert [(r.review_id, r.manual_label, r.date) for r in merged.collect()] == [(1, "positive", "2024-01-01")]
    assert sorted((r.review_id, r.reason) for r in rejects.collect()) == [(1, "NO_OP"), (1, "NO_OP"), (9, "NOT_FOUND")]
