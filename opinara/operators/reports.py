"""Dashboard reads over the rollup tables, and rule-based alerts.

Rollups are already grouped by batch, category, tag and week, so windows here run over one
row per week or day of a category, never over reviews.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara.functions.weeks import iso_date, week_of_parameter, week_start
from opinara.schema import LABELS

SHOWN = tuple(reversed(LABELS))


def in_weeks(df: DataFrame, date_from: str = "", date_to: str = "") -> DataFrame:
    """Whole ISO weeks around the dates, compared as labels ("unknown" sorts after digits)."""
    if date_from:
        df = df.filter(F.col("week") >= week_of_parameter(date_from))
    if date_to:
        df = df.filter(F.col("week") <= week_of_parameter(date_to))
    return df


def in_batch(df: DataFrame, batch_id: str) -> DataFrame:
    if not batch_id:
        raise ValueError("MISSING_PARAM: batch_id is required")
    return df.filter(F.col("batch_id") == batch_id)


def _total() -> Column:
    return sum((F.col(name) for name in SHOWN), F.lit(0))


def _sums() -> list[Column]:
    return [F.sum(name).cast("long").alias(name) for name in SHOWN]


def score(total: Column) -> Column:
    raw = (F.col("positive") - F.col("negative")) / total
    return F.when(total > 0, F.round(raw, 4)).otherwise(0.0)


def trend_report(
    trend: DataFrame, batch_id: str, date_from: str = "", date_to: str = "", category: str = ""
) -> DataFrame:
    rows = in_weeks(in_batch(trend, batch_id), date_from, date_to)
    if category:
        rows = rows.filter(F.col("category") == category)
    return rows.groupBy("week").agg(*_sums()).orderBy("week")


def trend_percentages(report: DataFrame) -> DataFrame:
    """Weekly shares of the three classes, in percent with two decimals."""
    total = _total()
    shares = [F.when(total > 0, F.round(F.col(n) * 100.0 / total, 2)).otherwise(0.0).alias(f"{n}_pct") for n in SHOWN]
    return report.select("week", total.cast("long").alias("total"), *shares).orderBy("week")


def category_summary(
    trend: DataFrame, totals: DataFrame, batch_id: str, date_from: str = "", date_to: str = ""
) -> DataFrame:
    """Categories by score. Without dates the smaller per-category table answers."""
    if date_from or date_to:
        rows = in_weeks(in_batch(trend, batch_id), date_from, date_to).groupBy("category").agg(*_sums())
    else:
        rows = in_batch(totals, batch_id).groupBy("category").agg(*_sums())
    summed = rows.withColumn("total", _total().cast("long"))
    scored = summed.withColumn("sentiment_score", score(F.col("total")))
    return scored.orderBy(F.desc("sentiment_score"), "category")


def category_ranks(summary: DataFrame) -> DataFrame:
    """Rank by score; one row per category, so a single window is enough."""
    return summary.withColumn("rank", F.rank().over(Window.orderBy(F.desc("sentiment_score"))))


def with_sentiment(summary: DataFrame, sentiment: str) -> DataFrame:
    return summary if sentiment == "all" else summary.filter(F.col(sentiment) > 0)


def issue_distribution(
    issues: DataFrame, batch_id: str, date_from: str = "", date_to: str = "", category: str = ""
) -> DataFrame:
    """Counts per tag and source. A category filter needs the rollup that keeps categories."""
    rows = in_weeks(in_batch(issues, batch_id), date_from, date_to)
    if category:
        rows = rows.filter(F.col("category") == category)
    counts = rows.groupBy("issue_tag", "cluster_source").agg(F.sum("count").cast("long").alias("count"))
    return counts.orderBy(F.desc("count"), "issue_tag", "cluster_source")


def issue_counts_by_category(issues: DataFrame, batch_id: str) -> DataFrame:
    rows = in_batch(issues, batch_id).groupBy("category", "issue_tag", "cluster_source")
    return rows.agg(F.sum("count").cast("long").alias("count"))


def top_issues(distribution: DataFrame, n: int = 8) -> DataFrame:
    return distribution.orderBy(F.desc("count"), "issue_tag", "cluster_source").limit(n)


def issue_shares(distribution: DataFrame) -> DataFrame:
    """Integer share of all tagged complaints; half rounds up."""
    everything = F.sum("count").over(Window.partitionBy())
    return distribution.withColumn("pct", F.floor(F.col("count") * 100.0 / everything + 0.5).cast("long"))


def headline(summary: DataFrame, distribution: DataFrame) -> DataFrame:
    """Total, share of negatives with one decimal, and the largest issue, as one row."""
    rank = F.struct((-F.col("count")).alias("n"), "issue_tag", "cluster_source")
    both = summary.select("total", "negative", F.lit(None).cast("string").alias("tag"), F.lit(None).alias("rank")).unionByName(
        distribution.select(
            F.lit(0).cast("long").alias("total"),
            F.lit(0).cast("long").alias("negative"),
            F.col("issue_tag").alias("tag"),
            rank.alias("rank"),
        )
    )
    sums = both.agg(
        F.coalesce(F.sum("total"), F.lit(0)).cast("long").alias("total_reviews"),
        F.sum("negative").alias("_negative"),
        F.min_by("tag", "rank").alias("top_issue"),
    )
    share = F.round(F.col("_negative") * 100.0 / F.col("total_reviews"), 1)
    return sums.select(
        "total_reviews", F.when(F.col("total_reviews") > 0, share).otherwise(0.0).alias("pct_negative"), "top_issue"
    )


def sentiment_distribution(summary: DataFrame) -> DataFrame:
    """Three rows with counts and integer percentages."""
    sums = summary.agg(*[F.coalesce(F.sum(name), F.lit(0)).cast("long").alias(name) for name in SHOWN])
    grand = F.greatest(_total(), F.lit(1))
    rows = [
        F.struct(
            F.lit(name.upper()).alias("name"),
            F.col(name).alias("count"),
            F.floor(F.col(name) * 100.0 / grand + 0.5).cast("long").alias("pct"),
        )
        for name in SHOWN
    ]
    return sums.select(F.inline(F.array(*rows)))


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Counts and shares per label value."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    share = F.round(F.col("count") / F.sum("count").over(Window.partitionBy()), 6)
    return counts.withColumn("share", share)


def batch_stats(batches: DataFrame) -> DataFrame:
    done = F.col("status") == "done"
    seconds = F.col("processing_duration_seconds").cast("double")
    return batches.agg(
        F.count_if(done).alias("batches_processed"),
        F.round(F.avg(F.when(done, seconds)), 2).alias("avg_processing_time_seconds"),
    )


def batch_status(batches: DataFrame, batch_id: str) -> DataFrame:
    share = F.col("processed_count") * 100.0 / F.col("total_reviews")
    return in_batch(batches, batch_id).select(
        "batch_id",
        "status",
        F.coalesce("total_reviews", F.lit(0)).alias("total_reviews"),
        F.coalesce("processed_count", F.lit(0)).alias("processed_count"),
        F.coalesce("filename", F.lit("")).alias("filename"),
        F.when(F.col("total_reviews") > 0, F.round(share, 1)).otherwise(0.0).alias("progress_pct"),
        "processing_duration_seconds",
    )


def batch_outcomes(reviews: DataFrame, batches: DataFrame) -> DataFrame:
    """Final status per batch: done as soon as one review was processed."""
    processed = reviews.groupBy("batch_id").agg(F.count(F.lit(1)).alias("processed"))
    counted = F.coalesce("processed", F.lit(0))
    return batches.join(processed, "batch_id", "left").select(
        "batch_id", counted.cast("long").alias("processed_count"), F.when(counted > 0, "done").otherwise("failed").alias("status")
    )


# --- period comparisons and alerts: described for the first release, not coded in the original ---


def weekly_scores(trend: DataFrame) -> DataFrame:
    sums = trend.groupBy("batch_id", "category", "week").agg(*_sums()).withColumn("total", _total().cast("long"))
    return sums.withColumn("sentiment_score", score(F.col("total")))


def _previous(name: str, *keys: str) -> Column:
    return F.lag(name).over(Window.partitionBy(*keys).orderBy("week"))


def score_deltas(trend: DataFrame) -> DataFrame:
    """Score per category and week with its change since the week before it on record."""
    scored = weekly_scores(trend.filter("week != 'unknown'"))
    before = _previous("sentiment_score", "batch_id", "category")
    return scored.withColumn("score_delta", F.round(F.col("sentiment_score") - before, 4)).select(
        "batch_id", "category", "week", "total", "sentiment_score", "score_delta"
    )


def _week_before(name: str, *keys: str) -> Column:
    """The value of the calendar week before, null if that week is not on record."""
    follows = F.date_sub(week_start(F.col("week")), 7) == week_start(_previous("week", *keys))
    return F.when(follows, _previous(name, *keys))


def negative_spikes(trend: DataFrame, growth_pct: float) -> DataFrame:
    """Weeks in which a category's negatives grew by at least the given percentage over last week."""
    scored = weekly_scores(trend.filter("week != 'unknown'"))
    grown = scored.withColumn("previous", _week_before("negative", "batch_id", "category"))
    change = (F.col("negative") - F.col("previous")) * 100.0 / F.col("previous")
    return (
        grown.withColumn("growth_pct", F.when(F.col("previous") > 0, F.round(change, 2)))
        .filter(F.col("growth_pct") >= growth_pct)
        .select("batch_id", "category", "week", "previous", "negative", "growth_pct")
    )


def growing_issues(issues: DataFrame, min_growth: int = 15) -> DataFrame:
    """Tags seen at least ``min_growth`` times more than last week; a tag's first week has none before."""
    weekly = issues.filter("week != 'unknown'").groupBy("batch_id", "issue_tag", "week")
    counts = weekly.agg(F.sum("count").cast("long").alias("count"))
    keys = ("batch_id", "issue_tag")
    known = _previous("week", *keys).isNotNull()
    before = F.when(known, F.coalesce(_week_before("count", *keys), F.lit(0)))
    return counts.withColumn("growth", F.col("count") - before).filter(F.col("growth") >= min_growth)


def negative_share_alerts(summary: DataFrame, share: float = 0.3) -> DataFrame:
    hit = (F.col("total") > 0) & (F.col("negative") / F.col("total") > share)
    ratio = F.round(F.col("negative") / F.col("total"), 4).alias("negative_share")
    return summary.filter(hit).select("category", "negative", "total", ratio)


def low_score_alerts(summary: DataFrame, threshold: float = 35.0) -> DataFrame:
    """Categories whose score, put on a 0-100 scale, lies below the threshold."""
    scaled = F.round((F.col("sentiment_score") + 1) * 50.0, 2)
    return summary.withColumn("score_100", scaled).filter(F.col("score_100") < threshold).select("category", "score_100")


def volume_surges(reviews: DataFrame, factor: float = 2.5) -> DataFrame:
    """Days whose volume exceeds ``factor`` times the mean of all earlier days of the batch.

    Reviews without a valid date belong to no day.
    """
    day = iso_date(F.col("review_date"))
    days = reviews.groupBy("batch_id", day.alias("_day")).agg(F.count(F.lit(1)).alias("volume")).filter("_day IS NOT NULL")
    days = days.withColumn("review_date", F.col("_day").cast("string"))
    earlier = Window.partitionBy("batch_id").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    return (
        days.withColumn("_mean", F.avg("volume").over(earlier))
        .filter(F.col("volume") > F.col("_mean") * factor)
        .select("batch_id", "review_date", "volume", F.round("_mean", 4).alias("mean_before"))
    )


def top_issue_per_category(issues_by_category: DataFrame, week: str) -> DataFrame:
    counts = (
        issues_by_category.filter(F.col("week") == week)
        .groupBy("batch_id", "category", "issue_tag")
        .agg(F.sum("count").cast("long").alias("count"))
    )
    best = F.min_by(F.struct("issue_tag", "count"), F.struct((-F.col("count")).alias("n"), "issue_tag"))
    return counts.groupBy("batch_id", "category").agg(best.alias("best")).select("batch_id", "category", "best.*")


def confidence_by_category(reviews: DataFrame, low: float) -> DataFrame:
    """Mean margin per category, with a badge where predictions are less reliable."""
    means = reviews.groupBy("batch_id", "category").agg(F.round(F.avg("confidence_margin"), 4).alias("avg_confidence"))
    return means.withColumn("low_confidence", F.col("avg_confidence") < low)
