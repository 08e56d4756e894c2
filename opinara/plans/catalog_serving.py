"""Queries for filters, rollups, reports, the feed and alerts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from opinara.functions import cleaning, scores, weeks
from opinara.operators import clustering, feed, reports, rollups
from opinara.operators.ranking import exact_percentiles
from opinara.plans import driver_views as V
from opinara.plans.catalog import query
from opinara.plans.oracle_views import with_views
from opinara.session import run_folder
from opinara.sources import tables

FEED = ["review_id", "batch_id", "category", "review_date", "sentiment", "confidence_margin", "issue_tag"]
FEED_SQL = ", ".join(FEED)
NEWEST = "ORDER BY review_date DESC, review_id"
SUMS = (
    "CAST(sum(positive) AS BIGINT) AS positive, CAST(sum(neutral) AS BIGINT) AS neutral, "
    "CAST(sum(negative) AS BIGINT) AS negative"
)
SUMMARY = f"""summary AS (SELECT *, CASE WHEN total > 0 THEN round((positive - negative) / total, 4) ELSE 0.0E0 END AS sentiment_score
FROM (SELECT *, positive + neutral + negative AS total FROM
  (SELECT category, {SUMS} FROM cats WHERE batch_id = 'b1' GROUP BY category)))"""
SPREAD = """spread AS (SELECT issue_tag, cluster_source, CAST(sum(count) AS BIGINT) AS count FROM issues
WHERE batch_id = 'b1' GROUP BY issue_tag, cluster_source)"""


def _plus(sql: str, extra: str) -> str:
    """Add one more common table to a statement that already starts with WITH."""
    head, body = sql.rsplit(")\n", 1)
    return f"{head}),\n{extra}\n{body}"


def _summary(spark, folder):
    return reports.category_summary(V.trend(spark, folder), V.cats(spark, folder), "b1")


def _spread(spark, folder):
    return reports.issue_distribution(V.issues(spark, folder), "b1")


def _reviews(where: str, tail: str = "", fields: str = FEED_SQL) -> str:
    return with_views(f"SELECT {fields} FROM reviews WHERE {where} {tail}", "reviews")


# --- filters ---


@query("f1_batch_scope", _reviews("batch_id = 'b1'"))
def f1(spark, folder):
    return feed.feed_filter(V.reviews(spark, folder), "b1").select(*FEED)


@query("f2_combined_filters", _reviews("batch_id = 'b1' AND sentiment = 'negative' AND category = 'error' AND issue_tag = 'issue_3'"))
def f2(spark, folder):
    return feed.feed_filter(V.reviews(spark, folder), "b1", "negative", "error", "issue_3").select(*FEED)


@query("f3_day_range", _reviews("batch_id = 'b1' AND review_date >= '2024-01-10' AND review_date <= '2024-01-15'"))
def f3(spark, folder):
    rows = feed.feed_filter(V.reviews(spark, folder), "b1", date_from="2024-01-10", date_to="2024-01-15")
    return rows.select(*FEED)


@query("f4_week_range", with_views("SELECT * FROM trend WHERE week >= '2024-W02' AND week <= '2024-W03'", "trend"))
def f4(spark, folder):
    return reports.in_weeks(V.trend(spark, folder), "2024-01-10", "2024-01-18")


@query("f5_rollup_category", with_views("SELECT * FROM trend WHERE batch_id = 'b2' AND category = 'click'", "trend"))
def f5(spark, folder):
    return feed.category_in(reports.in_batch(V.trend(spark, folder), "b2"), ["click"])


@query(
    "f6_valid_dates",
    with_views(
        """SELECT review_date, TRY_CAST(nullif(review_date, '') AS DATE) IS NOT NULL AS valid, count(*) AS rows
FROM reviews GROUP BY ALL""",
        "reviews",
    ),
)
def f6(spark, folder):
    valid = weeks.iso_date(F.col("review_date")).isNotNull()
    return V.reviews(spark, folder).groupBy("review_date", valid.alias("valid")).agg(F.count(F.lit(1)).alias("rows"))


@query("f7_point_lookup", _reviews("review_id = 42 AND batch_id = 'b' || (SELECT CAST(user_id % 4 AS VARCHAR) FROM events WHERE event_id = 42)"))
def f7(spark, folder):
    rows = V.reviews(spark, folder)
    owner = rows.filter("review_id = 42").select("batch_id").first()
    return feed.get_review(rows, 42, owner["batch_id"]).select(*FEED)


@query(
    "f8_flatten_extra",
    with_views(
        "SELECT review_id, CASE WHEN k % 3 = 0 THEN 'shadow' ELSE category END AS category, CAST(k AS VARCHAR) AS rating FROM reviews",
        "reviews",
    ),
)
def f8(spark, folder):
    shadow = F.when(F.col("k") % 3 == 0, "shadow")
    extra = F.create_map(F.lit("rating"), F.col("k").cast("string"), F.lit("category"), shadow)
    rows = V.reviews(spark, folder).select("review_id", "category", extra.alias("extra"))
    return feed.flatten_extra(rows, ["category", "rating"])


@query("f9_min_confidence", _reviews("batch_id = 'b1' AND confidence_margin >= 0.85"))
def f9(spark, folder):
    return feed.feed_filter(V.reviews(spark, folder), "b1", min_confidence=0.85).select(*FEED)


@query("f10_with_sentiment", _plus(with_views("SELECT category, negative, total FROM summary WHERE negative > 0", "cats"), SUMMARY))
def f10(spark, folder):
    return reports.with_sentiment(_summary(spark, folder), "negative").select("category", "negative", "total")


@query("f12_preset_window", _reviews("batch_id = 'b0' AND review_date >= '2024-01-21' AND review_date <= '2024-01-28'"))
def f12(spark, folder):
    start, end = weeks.preset_range("7d", date(2024, 1, 28))
    return feed.feed_filter(V.reviews(spark, folder), "b0", date_from=start, date_to=end).select(*FEED)


@query("f13_category_set", _reviews("category IN ('view', 'purchase')"))
def f13(spark, folder):
    return feed.category_in(V.reviews(spark, folder), ["view", "purchase"]).select(*FEED)


@query(
    "f17_volume_gate",
    with_views(
        """SELECT review_id, category, issue_tag FROM reviews WHERE sentiment = 'negative' AND category IN
(SELECT category FROM reviews WHERE sentiment = 'negative' GROUP BY category HAVING count(*) >= 500)""",
        "reviews",
    ),
)
def f17(spark, folder):
    negatives = V.reviews(spark, folder).filter("sentiment = 'negative'").select("review_id", "category", "issue_tag")
    return clustering.in_eligible(negatives)


# --- rollups and reports ---


@query("a1_trend_weekly", with_views("SELECT * FROM trend", "trend"))
def a1(spark, folder):
    return V.trend(spark, folder)


@query("a2_category_totals", with_views("SELECT * FROM cats", "cats"))
def a2(spark, folder):
    return V.cats(spark, folder)


@query("a3_issue_weekly", with_views("SELECT * FROM issues", "issues"))
def a3(spark, folder):
    return V.issues(spark, folder)


ALL_ROLLUPS = with_views(
    """SELECT 'trend' AS kind, batch_id, category, week, NULL AS issue_tag, NULL AS cluster_source, positive, neutral, negative,
  unlabelled, positive + neutral + negative + unlabelled AS count FROM trend
UNION ALL SELECT 'category', batch_id, category, NULL, NULL, NULL, positive, neutral, negative, unlabelled,
  positive + neutral + negative + unlabelled FROM cats
UNION ALL SELECT 'issue', batch_id, NULL, week, issue_tag, cluster_source, 0, 0, count, 0, count FROM issues""",
    "trend", "cats", "issues",
)


@query("a4_all_rollups", ALL_ROLLUPS)
def a4(spark, folder):
    return rollups.all_rollups(V.reviews(spark, folder))


@query("a5_rebuild_rollups", with_views("SELECT * FROM issues", "issues"))
def a5(spark, folder):
    path = run_folder(spark, "rebuild")
    built = rollups.split_rollups(rollups.all_rollups(V.reviews(spark, folder)))
    tables.rebuild_rollups(built, path)
    tables.rebuild_rollups(built, path)
    return tables.read_table(spark, f"{path}/issue_weekly").select(*built["issue_weekly"].columns)


@query("a6_trend_report", with_views(f"SELECT week, {SUMS} FROM trend WHERE batch_id = 'b1' GROUP BY week", "trend"))
def a6(spark, folder):
    return reports.trend_report(V.trend(spark, folder), "b1")


@query(
    "a7_category_summary",
    _plus(with_views("SELECT category, positive, neutral, negative, total, sentiment_score FROM summary", "cats"), SUMMARY),
)
def a7(spark, folder):
    return _summary(spark, folder)


@query(
    "a7_category_summary_weeks",
    with_views(
        f"""SELECT *, round((positive - negative) / total, 4) AS sentiment_score FROM
(SELECT *, positive + neutral + negative AS total FROM
  (SELECT category, {SUMS} FROM trend WHERE batch_id = 'b1' AND week >= '2024-W02' AND week <= '2024-W03' GROUP BY category))""",
        "trend",
    ),
)
def a7_weeks(spark, folder):
    return reports.category_summary(V.trend(spark, folder), V.cats(spark, folder), "b1", "2024-01-10", "2024-01-18")


@query("a8_issue_distribution", _plus(with_views("SELECT * FROM spread", "issues"), SPREAD))
def a8(spark, folder):
    return _spread(spark, folder)


@query(
    "a8_issue_distribution_category",
    with_views(
        """SELECT issue_tag, cluster_source, CAST(sum(count) AS BIGINT) AS count FROM issues_by_category
WHERE batch_id = 'b1' AND category = 'view' GROUP BY ALL""",
        "issues_by_category",
    ),
)
def a8_category(spark, folder):
    return reports.issue_distribution(V.issues_by_category(spark, folder), "b1", category="view")


@query(
    "a9_batch_stats",
    with_views(
        """SELECT count(*) FILTER (status = 'done') AS batches_processed,
  round(avg(CAST(processing_duration_seconds AS DOUBLE)) FILTER (status = 'done'), 2) AS avg_processing_time_seconds FROM batches""",
        "batches",
    ),
)
def a9(spark, folder):
    return reports.batch_stats(V.batches(spark, folder))


@query(
    "a10_batch_status",
    with_views(
        """SELECT batch_id, status, total_reviews, processed_count, filename,
  round(processed_count * 100.0E0 / total_reviews, 1) AS progress_pct, processing_duration_seconds
FROM batches WHERE batch_id = 'u7'""",
        "batches",
    ),
)
def a10(spark, folder):
    return reports.batch_status(V.batches(spark, folder), "u7")


@query(
    "a11_batch_outcomes",
    with_views(
        """SELECT b.batch_id, coalesce(n, 0) AS processed_count, CASE WHEN n > 0 THEN 'done' ELSE 'failed' END AS status
FROM batches b LEFT JOIN (SELECT session_id, count(*) AS n FROM reviews WHERE confidence_margin >= 0.98 GROUP BY session_id) r
  ON r.session_id = b.batch_id""",
        "batches", "reviews",
    ),
)
def a11(spark, folder):
    scored = V.reviews(spark, folder).filter("confidence_margin >= 0.98")
    return reports.batch_outcomes(scored.select(F.col("session_id").alias("batch_id")), V.batches(spark, folder))


@query(
    "a13_headline",
    _plus(
        _plus(
            with_views(
                """SELECT CAST(sum(total) AS BIGINT) AS total_reviews, round(sum(negative) * 100.0E0 / sum(total), 1) AS pct_negative,
  (SELECT issue_tag FROM spread ORDER BY count DESC, issue_tag, cluster_source LIMIT 1) AS top_issue FROM summary""",
                "cats", "issues",
            ),
            SUMMARY,
        ),
        SPREAD,
    ),
)
def a13(spark, folder):
    return reports.headline(_summary(spark, folder), _spread(spark, folder))


@query(
    "a14_sentiment_distribution",
    _plus(
        with_views(
            """SELECT name, CAST(n AS BIGINT) AS count, CAST(floor(n * 100.0E0 / t + 0.5) AS BIGINT) AS pct FROM
(SELECT unnest(['POSITIVE', 'NEUTRAL', 'NEGATIVE']) AS name, unnest([sum(positive), sum(neutral), sum(negative)]) AS n,
   sum(total) AS t FROM summary)""",
            "cats",
        ),
        SUMMARY,
    ),
)
def a14(spark, folder):
    return reports.sentiment_distribution(_summary(spark, folder))


@query(
    "a15_issue_shares",
    _plus(
        with_views(
            "SELECT *, CAST(floor(count * 100.0E0 / (SELECT sum(count) FROM spread) + 0.5) AS BIGINT) AS pct FROM spread", "issues"
        ),
        SPREAD,
    ),
)
def a15(spark, folder):
    return reports.issue_shares(_spread(spark, folder))


@query(
    "a16_label_distribution",
    with_views("SELECT label, count(*) AS count, round(count(*) / (SELECT count(*) FROM dataset), 6) AS share FROM dataset GROUP BY label", "dataset"),
)
def a16(spark, folder):
    return reports.label_distribution(V.dataset(spark, folder))


@query(
    "a19_describe_margin",
    with_views(
        """SELECT unnest(['count', 'mean', 'std', 'min', 'max', '25%', '50%', '75%']) AS statistic,
  unnest([CAST(count(lead) AS DOUBLE), round(avg(lead), 6), round(stddev_samp(lead), 6), round(min(lead), 6), round(max(lead), 6),
    round(quantile_cont(lead, 0.25), 6), round(quantile_cont(lead, 0.5), 6), round(quantile_cont(lead, 0.75), 6)]) AS value
FROM predictions WHERE y = 1 AND pred <> 1""",
        "predictions",
    ),
)
def a19(spark, folder):
    return clustering.describe(V.predictions(spark, folder).filter("y = 1 AND pred != 1"), "lead")


@query(
    "a19_percentiles_by_category",
    with_views(
        """SELECT category, unnest([0.5E0, 0.9E0, 0.99E0]) AS p,
  unnest([round(quantile_cont(lead, 0.5), 6), round(quantile_cont(lead, 0.9), 6), round(quantile_cont(lead, 0.99), 6)]) AS percentile
FROM predictions GROUP BY category""",
        "predictions",
    ),
)
def a19_category(spark, folder):
    found = exact_percentiles(V.predictions(spark, folder), "lead", (0.5, 0.9, 0.99), by=["category"])
    return found.withColumn("percentile", F.round("percentile", 6))


@query("a21_emoji_prevalence", "SELECT count(*) AS rows, count(*) FILTER (regexp_matches(text, '[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{1F1E0}-\\x{1F1FF}]')) AS with_emoji, round(100.0E0 * count(*) FILTER (regexp_matches(text, '[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{1F1E0}-\\x{1F1FF}]')) / count(*), 4) AS emoji_pct FROM documents")
def a21(spark, folder):
    hit = F.count_if(cleaning.has_emoji(F.col("text")))
    total = F.count(F.lit(1))
    return V.documents(spark, folder).agg(
        total.alias("rows"), hit.alias("with_emoji"), F.round(hit * 100.0 / total, 4).alias("emoji_pct")
    )


# --- feed, ranks, limits ---


PAGE = """, CAST(t AS BIGINT) AS total, CAST(ceil(t / {limit}.0E0) AS BIGINT) AS total_pages
FROM (SELECT *, count(*) OVER () AS t FROM reviews WHERE batch_id = 'b1') ORDER BY review_date DESC, review_id
LIMIT {limit} OFFSET {offset}"""


@query("w1_feed_page", with_views("SELECT " + FEED_SQL + PAGE.format(limit=20, offset=40), "reviews"))
def w1(spark, folder):
    filtered = feed.feed_filter(V.reviews(spark, folder), "b1")
    return feed.feed_page(filtered, 3, 20).select(*FEED, "total", "total_pages")


@query("w1_feed_page_deep", with_views("SELECT " + FEED_SQL + PAGE.format(limit=50, offset=1950), "reviews"))
def w1_deep(spark, folder):
    filtered = feed.feed_filter(V.reviews(spark, folder), "b1")
    return feed.feed_page(filtered, 40, 50, shallow_rows=1000).select(*FEED, "total", "total_pages")


@query(
    "w1_feed_after",
    _reviews("batch_id = 'b1' AND (review_date < '2024-01-20' OR (review_date = '2024-01-20' AND review_id > 5000))", f"{NEWEST} LIMIT 20"),
)
def w1_after(spark, folder):
    return feed.feed_after(feed.feed_filter(V.reviews(spark, folder), "b1"), "2024-01-20", 5000).select(*FEED)


@query(
    "w2_category_ranks",
    _plus(with_views("SELECT category, sentiment_score, CAST(rank() OVER (ORDER BY sentiment_score DESC) AS INTEGER) AS rank FROM summary", "cats"), SUMMARY),
)
def w2(spark, folder):
    return reports.category_ranks(_summary(spark, folder)).select("category", "sentiment_score", "rank")


@query("w3_top_issues", _plus(with_views("SELECT * FROM spread ORDER BY count DESC, issue_tag, cluster_source LIMIT 8", "issues"), SPREAD))
def w3(spark, folder):
    return reports.top_issues(_spread(spark, folder))


# --- scalar functions over reviews ---


@query("x5_week_label", with_views("SELECT review_id, week FROM reviews", "reviews"))
def x5(spark, folder):
    return V.reviews(spark, folder).select("review_id", weeks.week_label(F.col("review_date")).alias("week"))


@query(
    "x6_composite_keys",
    with_views(
        """SELECT review_id, category || '#' || review_date AS category_key,
  CASE WHEN issue_tag IS NOT NULL THEN issue_tag || '#' || review_date END AS issue_key FROM reviews""",
        "reviews",
    ),
)
def x6(spark, folder):
    issue = F.when(F.col("issue_tag").isNotNull(), weeks.composite_key(F.col("issue_tag"), F.col("review_date")))
    category = weeks.composite_key(F.col("category"), F.col("review_date"))
    return V.reviews(spark, folder).select("review_id", category.alias("category_key"), issue.alias("issue_key"))


@query("x7_import_packed_issues", with_views("SELECT batch_id, issue_tag, cluster_source, week, count FROM issues", "issues"))
def x7_issues(spark, folder):
    return rollups.import_packed(V.packed(spark, folder))["issue_weekly"]


@query("x7_import_packed_trend", with_views("SELECT batch_id, category, week, positive, neutral, negative FROM trend", "trend"))
def x7_trend(spark, folder):
    return rollups.import_packed(V.packed(spark, folder))["trend_weekly"]


@query("x7_import_packed_categories", with_views("SELECT batch_id, category, positive, neutral, negative FROM cats", "cats"))
def x7_categories(spark, folder):
    return rollups.import_packed(V.packed(spark, folder))["category_totals"]


@query(
    "x20_label_codes",
    with_views("SELECT id, CASE label WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1 ELSE 2 END AS code, label AS name FROM dataset", "dataset"),
)
def x20(spark, folder):
    coded = V.dataset(spark, folder).select("id", scores.label_id(F.col("label")).alias("code"))
    return coded.select("id", "code", scores.label_name(F.col("code")).alias("name"))


@query(
    "x21_label_from_stars",
    with_views(
        """SELECT review_id, k % 6 AS stars, CASE WHEN k % 6 IN (1, 2) THEN 'negative' WHEN k % 6 = 3 THEN 'neutral'
  WHEN k % 6 IN (4, 5) THEN 'positive' END AS label FROM reviews""",
        "reviews",
    ),
)
def x21(spark, folder):
    rows = V.reviews(spark, folder).select("review_id", (F.col("k") % 6).alias("stars"))
    return rows.withColumn("label", scores.label_from_stars(F.col("stars")))


@query(
    "x22_display",
    """SELECT doc_id, replace(lang || '_' || source, '_', ' ') AS title,
  CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '…' ELSE text END AS shown FROM documents""",
)
def x22(spark, folder):
    title = scores.tag_title(F.concat("lang", F.lit("_"), "source"))
    return V.documents(spark, folder).select("doc_id", title.alias("title"), scores.shorten(F.col("text"), 80).alias("shown"))


@query(
    "x23_number_or_zero",
    "SELECT event_id, coalesce(TRY_CAST(substr(props, 7, 1) AS DOUBLE), 0.0E0) AS digit, coalesce(TRY_CAST(event_type AS DOUBLE), 0.0E0) AS word FROM events",
)
def x23(spark, folder):
    events = V.table(spark, folder, "events")
    return events.select(
        "event_id",
        scores.number_or_zero(F.substring("props", 7, 1)).alias("digit"),
        scores.number_or_zero(F.col("event_type")).alias("word"),
    )


# --- documented for the first release, not coded in the original ---


SCORED = f"""SELECT *, round((positive - negative) / total, 4) AS sentiment_score FROM
(SELECT *, positive + neutral + negative AS total FROM
  (SELECT batch_id, category, week, {SUMS} FROM trend WHERE week <> 'unknown' GROUP BY ALL))"""


@query(
    "p1_score_deltas",
    with_views(
        f"""SELECT batch_id, category, week, total, sentiment_score,
  round(sentiment_score - lag(sentiment_score) OVER (PARTITION BY batch_id, category ORDER BY week), 4) AS score_delta FROM ({SCORED})""",
        "trend",
    ),
)
def p1(spark, folder):
    return reports.score_deltas(V.trend(spark, folder))


@query(
    "p2_trend_percentages",
    with_views(
        f"""SELECT week, total, round(positive * 100.0E0 / total, 2) AS positive_pct, round(neutral * 100.0E0 / total, 2) AS neutral_pct,
  round(negative * 100.0E0 / total, 2) AS negative_pct FROM
(SELECT *, positive + neutral + negative AS total FROM (SELECT week, {SUMS} FROM trend WHERE batch_id = 'b1' GROUP BY week))""",
        "trend",
    ),
)
def p2(spark, folder):
    return reports.trend_percentages(reports.trend_report(V.trend(spark, folder), "b1"))


def _monday(week: str) -> str:
    return f"date_trunc('week', CAST(substr({week}, 1, 4) || '-01-04' AS DATE)) + INTERVAL 7 DAY * (CAST(substr({week}, 7, 2) AS INT) - 1)"


LAST_WEEK = f"{_monday('week')} - INTERVAL 7 DAY = {_monday('lag(week) OVER w')}"


@query(
    "p3_negative_spikes",
    with_views(
        f"""SELECT * FROM (SELECT batch_id, category, week, previous, negative,
  round((negative - previous) * 100.0E0 / nullif(previous, 0), 2) AS growth_pct FROM
  (SELECT *, CASE WHEN {LAST_WEEK} THEN lag(negative) OVER w END AS previous FROM ({SCORED})
   WINDOW w AS (PARTITION BY batch_id, category ORDER BY week))) WHERE growth_pct >= 10""",
        "trend",
    ),
)
def p3(spark, folder):
    return reports.negative_spikes(V.trend(spark, folder), 10.0)


@query(
    "p4_growing_issues",
    with_views(
        f"""SELECT * FROM (SELECT batch_id, issue_tag, week, count,
  count - CASE WHEN lag(week) OVER w IS NOT NULL THEN coalesce(CASE WHEN {LAST_WEEK} THEN lag(count) OVER w END, 0) END AS growth FROM
  (SELECT batch_id, issue_tag, week, CAST(sum(count) AS BIGINT) AS count FROM issues WHERE week <> 'unknown' GROUP BY ALL)
  WINDOW w AS (PARTITION BY batch_id, issue_tag ORDER BY week))
WHERE growth >= 15""",
        "issues",
    ),
)
def p4(spark, folder):
    return reports.growing_issues(V.issues(spark, folder))


@query(
    "p5_negative_share_alerts",
    _plus(
        with_views("SELECT category, negative, total, round(negative / total, 4) AS negative_share FROM summary WHERE negative / total > 0.25", "cats"),
        SUMMARY,
    ),
)
def p5(spark, folder):
    return reports.negative_share_alerts(_summary(spark, folder), 0.25)


@query(
    "p6_low_score_alerts",
    _plus(
        with_views(
            "SELECT * FROM (SELECT category, round((sentiment_score + 1) * 50.0E0, 2) AS score_100 FROM summary) WHERE score_100 < 65", "cats"
        ),
        SUMMARY,
    ),
)
def p6(spark, folder):
    return reports.low_score_alerts(_summary(spark, folder), 65.0)


@query(
    "p6_volume_surges",
    with_views(
        """SELECT batch_id, review_date, volume, round(m, 4) AS mean_before FROM
(SELECT *, avg(volume) OVER (PARTITION BY batch_id ORDER BY review_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM
  (SELECT batch_id, review_date, count(*) AS volume FROM reviews WHERE TRY_CAST(review_date AS DATE) IS NOT NULL GROUP BY ALL)) WHERE volume > m * 1.1""",
        "reviews",
    ),
)
def p6_volume(spark, folder):
    return reports.volume_surges(V.reviews(spark, folder), 1.1)


@query(
    "p7_top_issue_per_category",
    with_views(
        """SELECT batch_id, category, issue_tag, count FROM
(SELECT *, row_number() OVER (PARTITION BY batch_id, category ORDER BY count DESC, issue_tag) AS place FROM
  (SELECT batch_id, category, issue_tag, CAST(sum(count) AS BIGINT) AS count FROM issues_by_category WHERE week = '2024-W03' GROUP BY ALL))
WHERE place = 1""",
        "issues_by_category",
    ),
)
def p7(spark, folder):
    return reports.top_issue_per_category(V.issues_by_category(spark, folder), "2024-W03")


@query(
    "p8_confidence_by_category",
    with_views(
        """SELECT *, avg_confidence < 0.5 AS low_confidence FROM
(SELECT batch_id, category, round(avg(confidence_margin), 4) AS avg_confidence FROM reviews GROUP BY ALL)""",
        "reviews",
    ),
)
def p8(spark, folder):
    return reports.confidence_by_category(V.reviews(spark, folder), 0.5)


@query("p9_feed_by_margin", _reviews("batch_id = 'b1'", "ORDER BY confidence_margin DESC, review_id LIMIT 50"))
def p9(spark, folder):
    return feed.feed_by_margin(feed.feed_filter(V.reviews(spark, folder), "b1"), 50).select(*FEED)


@query(
    "p10_issues_by_category",
    with_views(
        """SELECT category, issue_tag, cluster_source, CAST(sum(count) AS BIGINT) AS count FROM issues_by_category
WHERE batch_id = 'b1' GROUP BY ALL""",
        "issues_by_category",
    ),
)
def p10(spark, folder):
    return reports.issue_counts_by_category(V.issues_by_category(spark, folder), "b1")
