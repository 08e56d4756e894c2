"""Rollups and reads on the rows the original's endpoint tests use."""

import pytest
from pyspark.sql import functions as F

from opinara.operators import feed, reports, rollups

COUNTS = "batch_id string, category string, week string, positive long, neutral long, negative long"


@pytest.fixture(scope="module")
def trend(spark):
    rows = [
        ("b", "Electronics", "2025-W03", 10, 5, 3), ("b", "Electronics", "2025-W04", 8, 4, 2),
        ("b", "Electronics", "2025-W05", 12, 3, 1), ("b", "Books", "2025-W03", 7, 2, 1), ("b", "Books", "2025-W04", 5, 3, 0),
        ("b", "Books", "unknown", 1, 0, 0), ("other", "Books", "2025-W03", 99, 0, 0),
    ]
    return spark.createDataFrame(rows, COUNTS)


@pytest.fixture(scope="module")
def issues(spark):
    rows = [
        ("b", "battery_drain", "cross_category_fallback", "2025-W03", 5),
        ("b", "battery_drain", "cross_category_fallback", "2025-W05", 3),
        ("b", "sizing_fit", "cross_category_fallback", "2025-W03", 2),
        ("b", "sizing_fit", "per_category", "2025-W03", 2),
    ]
    return spark.createDataFrame(rows, "batch_id string, issue_tag string, cluster_source string, week string, count long")


def test_trend_weeks(trend):
    got = reports.trend_report(trend, "b", "2025-01-13", "2025-01-19").collect()
    assert [(r["week"], r["positive"], r["neutral"], r["negative"]) for r in got] == [("2025-W03", 17, 7, 4)]
    weeks = [r["week"] for r in reports.trend_report(trend, "b").collect()]
    assert weeks == ["2025-W03", "2025-W04", "2025-W05", "unknown"]
    # the unknown week passes a lower bound and fails an upper one
    assert "unknown" in [r["week"] for r in reports.trend_report(trend, "b", "2025-01-13").collect()]
    assert "unknown" not in [r["week"] for r in reports.trend_report(trend, "b", "", "2025-02-28").collect()]
    with pytest.raises(ValueError, match="MISSING_PARAM"):
        reports.trend_report(trend, "")
    with pytest.raises(ValueError, match="INVALID_DATE"):
        reports.trend_report(trend, "b", "soon")


def test_category_summary_by_week(trend):
    got = {r["category"]: r for r in reports.category_summary(trend, trend, "b", "2025-01-13", "2025-01-19").collect()}
    assert got["Electronics"]["total"] == 18 and got["Electronics"]["positive"] == 10
    assert got["Books"]["total"] == 10


def test_category_ranking_and_headline(spark, issues):
    totals = spark.createDataFrame([("b", "Books", 3, 2, 15), ("b", "Electronics", 20, 5, 5), ("b", "Empty", 0, 0, 0)],
                                   "batch_id string, category string, positive long, neutral long, negative long")
    summary = reports.category_summary(None, totals, "b")
    got = [(r["category"], r["sentiment_score"]) for r in summary.collect()]
    assert got == [("Electronics", 0.5), ("Empty", 0.0), ("Books", -0.6)]
    head = reports.headline(summary, reports.issue_distribution(issues, "b")).first()
    assert (head["total_reviews"], head["pct_negative"], head["top_issue"]) == (50, 40.0, "battery_drain")
    alerts = [r["category"] for r in reports.negative_share_alerts(summary).collect()]
    assert alerts == ["Books"]


def test_issues(issues):
    week = {(r["issue_tag"], r["cluster_source"]): r["count"]
            for r in reports.issue_distribution(issues, "b", "2025-01-13", "2025-01-19").collect()}
    assert week[("battery_drain", "cross_category_fallback")] == 5 and week[("sizing_fit", "per_category")] == 2
    everything = reports.issue_distribution(issues, "b").collect()
    assert [(r["issue_tag"], r["count"]) for r in everything] == [("battery_drain", 8), ("sizing_fit", 2), ("sizing_fit", 2)]
    assert [r["pct"] for r in reports.issue_shares(reports.issue_distribution(issues, "b")).orderBy(F.desc("count")).collect()] == [67, 17, 17]


def make_reviews(spark, count=10):
    rows = []
    for i in range(count):
        sentiment = ("negative", "neutral", "positive")[i % 3]
        tag = "general_dissatisfaction" if sentiment == "negative" else None
        extra = {"rating": "4", "helpful_votes": "10", "category": "Shadow"} if i == 0 else None
        rows.append((f"rev-{i}", "b", f"Review text {i}", ("Electronics", "Books")[i % 2], f"2025-01-{15 + i:02d}",
                     sentiment, 0.5 + i * 0.05, tag, None, extra))
    schema = ("review_id string, batch_id string, text string, category string, review_date string, sentiment string, "
              "confidence_margin double, issue_tag string, cluster_source string, extra map<string,string>")  # fmt: skip
    return spark.createDataFrame(rows, schema)


def test_feed_pages(spark):
    rows = make_reviews(spark)
    scoped = feed.feed_filter(rows, "b")
    for shallow in (10_000, 0):
        first = feed.feed_page(scoped, 1, 3, shallow).collect()
        assert [r["review_date"] for r in first] == ["2025-01-24", "2025-01-23", "2025-01-22"]
        assert first[0]["total"] == 10 and first[0]["total_pages"] == 4
        assert feed.feed_page(scoped, 4, 3, shallow).count() == 1
        assert feed.feed_page(scoped, 5, 3, shallow).count() == 0
    assert feed.feed_filter(rows, "b", sentiment="negative", category="Electronics").count() == 2
    assert feed.feed_filter(rows, "b", date_from="2025-01-15", date_to="2025-01-16").count() == 2
    assert feed.feed_filter(rows, "b", issue_tag="general_dissatisfaction", min_confidence=0.8).count() == 2
    assert feed.get_review(rows, "rev-1", "other").count() == 0
    with pytest.raises(ValueError):
        feed.feed_page(scoped, 1, 101)


def test_deep_pages_of_one_crowded_day(spark):
    rows = spark.range(5000).select(
        F.col("id").alias("review_id"), F.lit("b").alias("batch_id"),
        F.when(F.col("id") % 10 < 7, "2025-01-02").otherwise("2025-01-01").alias("review_date"),
    )
    whole = [r["review_id"] for r in rows.orderBy(F.desc("review_date"), "review_id").collect()]
    for page in (1, 30, 70, 100):
        got = [r["review_id"] for r in feed.feed_page(rows, page, 50, shallow_rows=0).collect()]
        assert got == whole[(page - 1) * 50 : page * 50]


def test_extra_values_win(spark):
    flat = feed.flatten_extra(make_reviews(spark), ["rating", "category"]).orderBy("review_id").collect()
    assert flat[0]["category"] == "Shadow" and flat[0]["rating"] == "4"
    assert flat[1]["category"] == "Books" and flat[1]["rating"] is None


def test_fused_rollups_equal_single_ones(spark):
    rows = make_reviews(spark, 12).withColumn("review_date", F.when(F.col("review_id") == "rev-4", "").otherwise(F.col("review_date")))
    rows = rows.withColumn("sentiment", F.when(F.col("review_id") == "rev-5", "odd").otherwise(F.col("sentiment")))
    parts = rollups.split_rollups(rollups.all_rollups(rows))
    for name, single in (
        ("trend_weekly", rollups.trend_weekly(rows)), ("category_totals", rollups.category_totals(rows)), ("issue_weekly", rollups.issue_weekly(rows))
    ):
        assert sorted(map(tuple, parts[name].select(*single.columns).collect())) == sorted(map(tuple, single.collect()))
    assert {r["week"] for r in parts["trend_weekly"].collect()} == {"2025-W03", "2025-W04", "unknown"}
    assert {r["cluster_source"] for r in parts["issue_weekly"].collect()} == {"cross_category_fallback"}


def test_batches(spark):
    rows = [("a", "done", 100, 100, "10.5"), ("b", "done", 10, 10, None), ("c", "pending", 100, 0, None)]
    batches = spark.createDataFrame(rows, "batch_id string, status string, total_reviews long, processed_count long, processing_duration_seconds string")
    batches = batches.withColumn("filename", F.lit("f.csv"))
    assert tuple(reports.batch_stats(batches).first()) == (2, 10.5)
    assert reports.batch_stats(batches.filter("status = 'pending'")).first()["avg_processing_time_seconds"] is None
    assert reports.batch_status(batches, "c").first()["progress_pct"] == 0.0
    assert reports.batch_status(batches, "zzz").count() == 0


def test_alerts_compare_calendar_weeks(spark):
    rows = [("b", "c", w, 0, 0, n) for w, n in [("2024-W01", 10), ("2024-W02", 20), ("2024-W09", 60), ("unknown", 99)]]
    trend = spark.createDataFrame(rows, "batch_id string, category string, week string, positive long, neutral long, negative long")
    assert [(r.week, r.growth_pct) for r in reports.negative_spikes(trend, 50.0).collect()] == [("2024-W02", 100.0)]
    counts = [("b", "t", "s", w, n) for w, n in [("2024-W52", 50), ("2025-W01", 52), ("2025-W04", 60)]]
    issues = spark.createDataFrame(counts, "batch_id string, issue_tag string, cluster_source string, week string, count long")
    assert [(r.week, r.growth) for r in reports.growing_issues(issues).collect()] == [("2025-W04", 60)]


def test_days_without_a_date_are_no_days(spark):
    rows = [("b", d) for d in ["", "2024-02-31", "2024-01-01", "2024-01-01", "2024-01-02", *["2024-01-03"] * 5]]
    found = reports.volume_surges(spark.createDataFrame(rows, "batch_id string, review_date string"), 2.5).collect()
    assert [(r.review_date, r.volume, r.mean_before) for r in found] == [("2024-01-03", 5, 1.5)]


def test_page_after_reaches_reviews_without_a_date(spark):
    from opinara.operators import feed

    rows = spark.createDataFrame([(1, "2024-01-02"), (2, None), (3, "2024-01-01"), (4, None)], "review_id long, review_date string")
    assert [r.review_id for r in feed.feed_after(rows, "2024-01-02", 1).collect()] == [3, 2, 4]
    assert [r.review_id for r in feed.feed_after(rows, None, 2).collect()] == [4]
