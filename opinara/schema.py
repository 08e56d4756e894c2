"""Label domain, thresholds and table schemas shared by every module."""

from pyspark.sql import types as T

# The label domain in encoder order (0, 1, 2).
LABELS = ("negative", "neutral", "positive")
LABEL_IDS = {"negative": 0, "neutral": 1, "positive": 2}

# Margins of the confidence rule and of the miss analysis.
POSITIVE_MARGIN = 0.30
NEGATIVE_MARGIN = 0.0
UNCERTAIN_MARGIN = 0.15
MARGIN_SWEEP = (0.0, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5)

# Issue tagging.
FALLBACK_SCOPE = "cross_category_fallback"
PER_CATEGORY = "per_category"
OTHER_ISSUE = "other"
ISSUE_DISTANCE = 0.70
CLUSTER_VOLUME_GATE = 500

# Trust gates for corrections and quality gates for a new model.
MIN_CORRECTIONS = 10
MIN_SESSIONS = 2
SESSION_MIN_VOTES = 3
SESSION_DOMINANCE = 0.70
HIGH_CONFIDENCE = 0.70
GATE_NEGATIVE_RECALL = 0.7915
GATE_FROZEN_RECALL = 0.2967
NEGATIVE_RECALL_FLOOR = 0.75

# Audit vocabularies.
AUDIT_BUCKETS = ("mislabel", "genuinely_mixed", "model_wrong")
REAUDIT_BUCKETS = (
    "mislabel_negative",
    "mislabel_positive",
    "genuinely_mixed",
    "true_model_wrong_negative",
    "true_model_wrong_positive",
)
ERROR_SUBTYPES = (
    "factual_neutral",
    "weak_sentiment",
    "hedged_sentiment",
    "mixed_but_neutral",
    "ambiguous",
    "sarcasm_or_context",
)

# The column order of a corrections export.
CORRECTION_EXPORT = (
    "text",
    "label",
    "manual_label",
    "date",
    "review_id",
    "batch_id",
    "correction_source_session_id",
    "confidence_margin",
)

UNKNOWN_WEEK = "unknown"

REVIEWS = T.StructType(
    [
        T.StructField("review_id", T.StringType(), False),
        T.StructField("batch_id", T.StringType(), False),
        T.StructField("text", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("review_date", T.StringType()),
        T.StructField("processed_at", T.TimestampType()),
        T.StructField("sentiment", T.StringType()),
        T.StructField("confidence_margin", T.DoubleType()),
        T.StructField("prob_negative", T.DoubleType()),
        T.StructField("prob_neutral", T.DoubleType()),
        T.StructField("prob_positive", T.DoubleType()),
        T.StructField("issue_tag", T.StringType()),
        T.StructField("issue_distance", T.DoubleType()),
        T.StructField("cluster_source", T.StringType()),
        T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
    ]
)

BATCHES = T.StructType(
    [
        T.StructField("batch_id", T.StringType(), False),
        T.StructField("filename", T.StringType()),
        T.StructField("uploaded_at", T.TimestampType()),
        T.StructField("total_reviews", T.LongType()),
        T.StructField("processed_count", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("column_mapping", T.MapType(T.StringType(), T.StringType())),
        T.StructField("csv_columns", T.ArrayType(T.StringType())),
        T.StructField("processing_duration_seconds", T.DoubleType()),
    ]
)

CORRECTIONS = T.StructType(
    [
        T.StructField("correction_id", T.StringType(), False),
        T.StructField("review_id", T.StringType(), False),
        T.StructField("batch_id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("manual_label", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("confidence_margin", T.DoubleType()),
    ]
)

REGISTRY = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("round", T.StringType()),
        T.StructField("sampling_strategy", T.StringType()),
        T.StructField("old_label", T.StringType()),
        T.StructField("manual_label", T.StringType()),
        T.StructField("audit_status", T.StringType()),
        T.StructField("notes", T.StringType()),
    ]
)

CENTROIDS = T.StructType(
    [
        T.StructField("scope", T.StringType(), False),
        T.StructField("cluster_id", T.IntegerType(), False),
        T.StructField("name", T.StringType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("centroid", T.ArrayType(T.DoubleType()), False),
    ]
)
