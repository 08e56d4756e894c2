"""The given tables shaped like reviews, predictions, corrections and audits.

Each function has a SQL twin of the same name in ``oracle_views``. Shapes only: every view keeps
all rows of its table. A few dates are blank or impossible on purpose, as uploads have them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.functions.scores import label_id
from opinara.functions.weeks import composite_key
from opinara.operators import curation, rollups
from opinara.operators.evaluation import with_prediction
from opinara.schema import FALLBACK_SCOPE, LABELS, PER_CATEGORY
from opinara.session import spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _text(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("string")


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    return review_shape(table(spark, folder, "events"))


def review_shape(events: DataFrame) -> DataFrame:
    rows = events.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    day = _text(F.col("ts").cast("date"))
    sentiment = (
        F.when(F.col("value") >= 69, "negative").when(F.col("value") >= 34, "neutral").otherwise("positive")
    )
    negative = F.col("sentiment") == "negative"
    return rows.select(
        F.col("event_id").alias("review_id"),
        F.concat(F.lit("b"), _text(F.col("user_id") % 4)).alias("batch_id"),
        F.concat(F.lit("u"), _text("user_id")).alias("session_id"),
        F.col("event_type").alias("category"),
        F.when(F.col("event_id") % 97 == 0, "").when(F.col("event_id") % 101 == 0, "2024-13-45").otherwise(day).alias("review_date"),
        "k",
        (F.col("k") / F.lit(100.0)).alias("confidence_margin"),
        sentiment.alias("sentiment"),
        "ts",
    ).withColumns(
        {
            "issue_tag": F.when(negative, F.concat(F.lit("issue_"), _text(F.col("k") % 8))),
            "cluster_source": F.when(negative, F.when(F.col("k") % 2 == 0, PER_CATEGORY).otherwise(FALLBACK_SCOPE)),
        }
    )


def trend(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.trend_weekly(reviews(spark, folder))


def cats(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.category_totals(reviews(spark, folder))


def issues(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.issue_weekly(reviews(spark, folder))


def issues_by_category(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.issue_weekly(reviews(spark, folder), by_category=True)


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    rows = reviews(spark, folder)
    parts = {"a": (37, 101), "b": (53, 97), "c": (71, 89)}
    rows = rows.withColumns({n: F.col("review_id") * m % q + 1 for n, (m, q) in parts.items()})
    total = F.col("a") + F.col("b") + F.col("c")
    y = label_id(F.col("sentiment"))
    scored = rows.select(
        F.col("review_id").alias("id"),
        "category",
        y.alias("y"),
        F.when((y == 1) & (F.col("review_id") % 5 == 0), "frozen").otherwise("test").alias("eval_set"),
        *[(F.col(n) / total).alias(f"prob_{label}") for n, label in zip("abc", LABELS)],
    )
    return with_prediction(scored)


def votes(spark: SparkSession, folder: str) -> DataFrame:
    rows = reviews(spark, folder)
    session = F.concat("session_id", F.lit("_"), _text(F.col("k") % 5))
    return rows.select(
        F.when(F.col("review_id") % 40 == 0, F.col("review_id")).otherwise(F.floor(F.col("review_id") / 5)).alias("review_id"),
        F.when(F.col("review_id") % 17 != 0, session).alias("session_id"),
        F.col("sentiment").alias("manual_label"),
        F.col("review_date").alias("date"),
        "confidence_margin",
        F.col("review_id").alias("vote_id"),
    )


def known_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Training texts: every category but two, whose reviews count as new texts."""
    return reviews(spark, folder).filter("category NOT IN ('purchase', 'view')").select("review_id")


def corrections(spark: SparkSession, folder: str) -> DataFrame:
    """Stored corrections: one row per vote, with the text column filled from the documents' ids."""
    shaped = votes(spark, folder)
    label = F.when(F.col("vote_id") % 3 == 0, "negative").when(F.col("vote_id") % 3 == 1, "neutral").otherwise("positive")
    return shaped.select(
        _text("vote_id").alias("correction_id"),
        "review_id",
        F.when(F.col("vote_id") % 19 != 0, F.concat(F.lit("b"), _text(F.col("vote_id") % 4))).alias("batch_id"),
        F.concat(F.lit('said "'), _text("vote_id"), F.lit('", then\nleft')).alias("text"),
        label.alias("label"),
        "manual_label",
        "date",
        F.coalesce("session_id", F.lit("")).alias("session_id"),
        "confidence_margin",
    )


def dataset(spark: SparkSession, folder: str) -> DataFrame:
    return reviews(spark, folder).select(F.col("review_id").alias("id"), "category", F.col("sentiment").alias("label"))


def audit(spark: SparkSession, folder: str) -> DataFrame:
    """A filled-in audit of the neutral rows, with some mistakes in it."""
    rows = reviews(spark, folder).filter("sentiment = 'neutral'")
    k = F.col("k")
    bucket = (
        F.when(k == 98, "no_such_bucket")
        .when(k == 99, F.lit(None).cast("string"))
        .when(k % 3 == 0, "mislabel")
        .when(k % 3 == 1, "genuinely_mixed")
        .otherwise("model_wrong")
    )
    label = (
        F.when(k == 95, "meh")
        .when(k == 94, "negative")
        .when(k % 3 != 0, "neutral")
        .when(k % 2 == 0, "negative")
        .otherwise("positive")
    )
    return rows.select(
        F.col("review_id").alias("id"),
        F.col("sentiment").alias("actual_label"),
        bucket.alias("manual_label"),
        label.alias("corrected_label"),
    )


def clean_audit(spark: SparkSession, folder: str) -> DataFrame:
    rows = audit(spark, folder)
    return curation.without_ids(rows, curation.audit_violations(rows))


def reaudit(spark: SparkSession, folder: str) -> DataFrame:
    rows = reviews(spark, folder).filter("sentiment = 'neutral'")
    k = F.col("k")
    bucket = (
        F.when(k == 97, "")
        .when(k == 96, "no_such_bucket")
        .when(k % 5 == 0, "mislabel_negative")
        .when(k % 5 == 1, "mislabel_positive")
        .when(k % 5 == 2, "genuinely_mixed")
        .when(k % 5 == 3, "true_model_wrong_negative")
        .otherwise("true_model_wrong_positive")
    )
    subtype = (
        F.when(k == 93, "no_such_subtype")
        .when(k == 88, F.lit(None).cast("string"))
        .when(k % 4 == 0, "mixed_but_neutral")
        .when(k % 4 == 1, "weak_sentiment")
        .when(k % 4 == 2, "ambiguous")
        .otherwise("hedged_sentiment")
    )
    return rows.select(
        F.col("review_id").alias("id"),
        F.col("sentiment").alias("actual_label"),
        bucket.alias("primary_bucket"),
        subtype.alias("error_subtype"),
        F.when(k % 6 != 0, F.concat(F.lit("note "), _text(k))).alias("notes"),
    )


def clean_reaudit(spark: SparkSession, folder: str) -> DataFrame:
    rows = reaudit(spark, folder)
    return curation.without_ids(rows, curation.reaudit_violations(rows))


def registry(spark: SparkSession, folder: str) -> DataFrame:
    """What was reviewed in the first round: the audited rows of two categories."""
    first_round = reviews(spark, folder).filter("category IN ('click', 'view')").select(F.col("review_id").alias("id"))
    first = clean_audit(spark, folder).join(first_round, "id", "left_semi")
    return curation.audit_registry_rows(first)


def full_registry(spark: SparkSession, folder: str) -> DataFrame:
    return curation.append_new(registry(spark, folder), curation.reaudit_registry_rows(clean_reaudit(spark, folder)))


def batches(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    user = F.col("user_id")
    per_user = rows.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_reviews"),
        F.count_if(F.col("k") >= 10).alias("processed_count"),
        F.sum("k").alias("seconds"),
    )
    status = F.when(user % 5 == 0, "pending").when(user % 5 == 1, "processing").when(user % 5 == 2, "failed").otherwise("done")
    return per_user.select(
        F.concat(F.lit("u"), _text(user)).alias("batch_id"),
        F.concat(F.lit("u"), _text(user), F.lit(".csv")).alias("filename"),
        "total_reviews",
        "processed_count",
        status.alias("status"),
        F.when(user % 7 != 0, _text("seconds")).alias("processing_duration_seconds"),
    )


def packed(spark: SparkSession, folder: str) -> DataFrame:
    """Rollups under packed keys; issue keys of the fallback source in the older three-part form."""
    none = F.lit(None).cast("long")
    counts = ["positive", "neutral", "negative"]
    trends = trend(spark, folder).select(
        "batch_id", composite_key(F.lit("TREND"), F.col("category"), F.col("week")).alias("agg_type"), *counts, none.alias("count")
    )
    totals = cats(spark, folder).select(
        "batch_id", composite_key(F.lit("CAT"), F.col("category")).alias("agg_type"), *counts, none.alias("count")
    )
    tag, source, week = F.col("issue_tag"), F.col("cluster_source"), F.col("week")
    key = F.when(source == FALLBACK_SCOPE, composite_key(F.lit("ISSUE"), tag, week)).otherwise(
        composite_key(F.lit("ISSUE"), tag, source, week)
    )
    held = issues(spark, folder).select("batch_id", key.alias("agg_type"), *[none.alias(c) for c in counts], "count")
    return trends.unionByName(totals).unionByName(held)


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as complaints: the cluster is the table's label, four categories by id."""
    rows = table(spark, folder, "embeddings")
    sentiment = F.when(F.col("label") % 3 == 0, "negative").when(F.col("label") % 3 == 1, "neutral").otherwise("positive")
    return rows.select(
        F.col("vec_id").alias("id"),
        F.concat(F.lit("c"), _text(F.col("vec_id") % 4)).alias("category"),
        sentiment.alias("label"),
        F.col("label").alias("cluster_id"),
        F.col("embedding").alias("features"),
    )


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """Ids and texts of all documents, ready for heavy per-row work."""
    return spread(documents(spark, folder).select("doc_id", "text"))


def clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the cluster of the embedding that shares their id."""
    held = texts(spark, folder).withColumnRenamed("doc_id", "id")
    return vectors(spark, folder).join(held, "id")
