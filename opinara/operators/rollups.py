"""Weekly, category and issue counters over a review table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.functions.weeks import unpack_category, unpack_issue, unpack_trend, week_label
from opinara.schema import FALLBACK_SCOPE, LABELS

TREND_KEYS = ["batch_id", "category", "week"]
CATEGORY_KEYS = ["batch_id", "category"]
ISSUE_KEYS = ["batch_id", "issue_tag", "cluster_source", "week"]


def sentiment_counts(weight: str | None = None) -> list[Column]:
    """Positive, neutral and negative counts; other values are kept apart in ``unlabelled``."""
    amount = F.lit(1) if weight is None else F.col(weight)

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, amount)), F.lit(0)).cast("long")

    known = F.coalesce(F.col("sentiment").isin(*LABELS), F.lit(False))
    return [total(F.col("sentiment") == name).alias(name) for name in reversed(LABELS)] + [
        total(~known).alias("unlabelled")
    ]


def with_week(reviews: DataFrame) -> DataFrame:
    return reviews.withColumn("week", week_label(F.col("review_date")))


def trend_weekly(reviews: DataFrame) -> DataFrame:
    return with_week(reviews).groupBy(*TREND_KEYS).agg(*sentiment_counts())


def category_totals(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy(*CATEGORY_KEYS).agg(*sentiment_counts())


def tagged(reviews: DataFrame) -> DataFrame:
    """Reviews that carry an issue; a missing source counts as the fallback one."""
    held = reviews.filter(F.col("issue_tag").isNotNull() & (F.col("issue_tag") != ""))
    return held.withColumn("cluster_source", F.coalesce("cluster_source", F.lit(FALLBACK_SCOPE)))


def issue_weekly(reviews: DataFrame, by_category: bool = False) -> DataFrame:
    keys = ISSUE_KEYS + (["category"] if by_category else [])
    return with_week(tagged(reviews)).groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def review_cube(reviews: DataFrame) -> DataFrame:
    """The finest counts all three rollups add up from: one scan, one shuffle of group rows."""
    source = F.when(F.col("issue_tag") != "", F.coalesce("cluster_source", F.lit(FALLBACK_SCOPE)))
    cells = with_week(reviews).withColumns(
        {"issue_tag": F.nullif(F.col("issue_tag"), F.lit("")), "cluster_source": source}
    )
    keys = [*TREND_KEYS, "sentiment", "issue_tag", "cluster_source"]
    return cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def all_rollups(reviews: DataFrame) -> DataFrame:
    """The three rollups in one frame, told apart by ``kind``; keys outside a rollup are null."""
    cols = ["batch_id", "category", "week", "issue_tag", "cluster_source"]
    grouped = (
        review_cube(reviews)
        .groupingSets([[F.col(c) for c in keys] for keys in (TREND_KEYS, CATEGORY_KEYS, ISSUE_KEYS)], *cols)
        .agg(
            F.grouping("category").alias("_no_category"),
            F.grouping("week").alias("_no_week"),
            *sentiment_counts("n"),
            F.sum("n").alias("count"),
        )
    )
    kind = F.when(F.col("_no_category") == 1, "issue").when(F.col("_no_week") == 1, "category").otherwise("trend")
    return (
        grouped.withColumn("kind", kind)
        .filter((F.col("kind") != "issue") | F.col("issue_tag").isNotNull())
        .select("kind", *cols, *reversed(LABELS), "unlabelled", "count")
    )


def split_rollups(rollups: DataFrame) -> dict[str, DataFrame]:
    """Typed tables back out of the fused frame."""
    counts = [*reversed(LABELS), "unlabelled"]
    return {
        "trend_weekly": rollups.filter("kind = 'trend'").select(*TREND_KEYS, *counts),
        "category_totals": rollups.filter("kind = 'category'").select(*CATEGORY_KEYS, *counts),
        "issue_weekly": rollups.filter("kind = 'issue'").select(*ISSUE_KEYS, "count"),
    }


def import_packed(packed: DataFrame) -> dict[str, DataFrame]:
    """Typed rollups from a table of packed ``agg_type`` keys; keys of any other shape are dropped."""
    counts = [F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name) for name in reversed(LABELS)]
    trend = packed.withColumn("key", unpack_trend(F.col("agg_type"))).filter("key IS NOT NULL")
    category = packed.withColumn("category", unpack_category(F.col("agg_type"))).filter("category IS NOT NULL")
    issue = packed.withColumn("key", unpack_issue(F.col("agg_type"))).filter("key IS NOT NULL")
    return {
        "trend_weekly": trend.select("batch_id", "key.category", "key.week", *counts),
        "category_totals": category.select("batch_id", "category", *counts),
        "issue_weekly": issue.groupBy("batch_id", "key.issue_tag", "key.cluster_source", "key.week").agg(
            F.sum(F.coalesce(F.col("count"), F.lit(0))).cast("long").alias("count")
        ),
    }
