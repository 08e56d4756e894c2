"""Label audits: validation, merging, registry, id sets and data checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.schema import AUDIT_BUCKETS, ERROR_SUBTYPES, LABELS, REAUDIT_BUCKETS, REGISTRY

REGISTRY_COLUMNS = REGISTRY.fieldNames()


def preserve_original(df: DataFrame) -> DataFrame:
    """Keep the first label ever seen; later rounds leave it alone."""
    return df if "original_label" in df.columns else df.withColumn("original_label", F.col("label"))


def apply_labels(df: DataFrame, changes: DataFrame) -> DataFrame:
    """Overwrite ``label`` where ``changes`` (id, new_label) names the row."""
    unique = changes.groupBy("id").agg(F.max("new_label").alias("new_label"))
    return df.join(unique, "id", "left").withColumn("label", F.coalesce("new_label", "label")).drop("new_label")


def real_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows whose label differs between two states of a table."""
    joined = before.select("id", F.col("label").alias("label_before")).join(
        after.select("id", F.col("label").alias("label_after")), "id"
    )
    return joined.filter("label_before != label_after")


def without_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("id"), "id", "left_anti")


def with_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("id"), "id", "left_semi")


def id_union(*sets: DataFrame) -> DataFrame:
    first, *rest = [s.select("id") for s in sets]
    for other in rest:
        first = first.unionByName(other)
    return first.distinct()


def id_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    return without_ids(left.select("id").distinct(), right)


def leaks(guarded: DataFrame, test: DataFrame) -> DataFrame:
    """Guarded ids found in the test set; must be empty."""
    return guarded.select("id").distinct().join(test.select("id"), "id", "left_semi")


def append_new(registry: DataFrame, incoming: DataFrame) -> DataFrame:
    return registry.unionByName(without_ids(incoming, registry))


def append_distinct(log: DataFrame, ids: DataFrame) -> DataFrame:
    return log.select("id").unionByName(ids.select("id")).dropDuplicates(["id"])


def pool(*parts: tuple[str, DataFrame]) -> DataFrame:
    """Training pools put together, each row marked with its origin."""
    first, *rest = [df.withColumn("pool", F.lit(name)) for name, df in parts]
    for other in rest:
        first = first.unionByName(other)
    return first


def alignment(**tables: DataFrame) -> DataFrame:
    """Per table: ids missing from it and ids it holds more than once; aligned tables give zeros.

    Counts per id are added up, so a repeated id never multiplies rows.
    """
    names = list(tables)
    marked = None
    for name, df in tables.items():
        part = df.select("id", *[F.lit(int(name == other)).alias(other) for other in names])
        marked = part if marked is None else marked.unionByName(part)
    per_id = marked.groupBy("id").agg(*[F.sum(name).alias(name) for name in names])
    sums = per_id.agg(
        *[F.count_if(F.col(name) == 0).alias(f"missing_{name}") for name in names],
        *[F.count_if(F.col(name) > 1).alias(f"repeated_{name}") for name in names],
    )
    rows = [
        F.struct(F.lit(n).alias("table"), F.col(f"missing_{n}").alias("missing"), F.col(f"repeated_{n}").alias("repeated"))
        for n in names
    ]
    return sums.select(F.inline(F.array(*rows)))


def duplicate_texts(df: DataFrame, text: str = "text", limit: float = 0.02) -> DataFrame:
    """Surplus copies, their rate, and whether the rate is high enough to leak across splits.

    Texts are grouped by digest, so the shuffle carries 32 bytes per text.
    """
    copies = df.groupBy(F.sha2(F.col(text), 256).alias("digest")).agg(F.count(F.lit(1)).alias("n"))
    rows, extra = F.sum("n"), F.sum(F.col("n") - 1)
    return copies.agg(
        rows.cast("long").alias("rows"),
        extra.cast("long").alias("duplicates"),
        F.round(extra / rows, 6).alias("rate"),
        (extra / rows > limit).alias("too_many"),
    )


def _blank(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) == ""


def _violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    found = F.array_compact(F.array(*[F.when(condition, F.lit(rule)) for rule, condition in rules.items()]))
    return df.select("id", F.explode(found).alias("rule"))


def audit_violations(audit: DataFrame) -> DataFrame:
    """(id, rule) for every audit row that must not be merged; empty when the file is ready."""
    bucket, label = F.col("manual_label"), F.col("corrected_label")
    unchanged = bucket.isin("genuinely_mixed", "model_wrong")
    return _violations(
        audit,
        {
            "not_reviewed": bucket.isNull(),
            "unknown_bucket": bucket.isNotNull() & ~bucket.isin(*AUDIT_BUCKETS),
            "unknown_label": label.isNull() | ~label.isin(*LABELS),
            "bucket_contradicts_label": unchanged & ~label.eqNullSafe("neutral"),
        },
    )


def reaudit_violations(reaudit: DataFrame) -> DataFrame:
    bucket = F.col("primary_bucket")
    model_wrong = F.coalesce(bucket.startswith("true_model_wrong"), F.lit(False))
    return _violations(
        reaudit,
        {
            "not_reviewed": _blank("primary_bucket"),
            "unknown_bucket": ~_blank("primary_bucket") & ~bucket.isin(*REAUDIT_BUCKETS),
            "missing_subtype": model_wrong & _blank("error_subtype"),
            "unknown_subtype": model_wrong & ~_blank("error_subtype") & ~F.col("error_subtype").isin(*ERROR_SUBTYPES),
        },
    )


def bucket_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("bucket")).agg(F.count(F.lit(1)).alias("count"))


def audit_changes(audit: DataFrame) -> DataFrame:
    return audit.filter("manual_label = 'mislabel'").select("id", F.col("corrected_label").alias("new_label"))


def reaudit_changes(reaudit: DataFrame) -> DataFrame:
    """Only mislabelled rows change; the bucket names the new label."""
    return reaudit.filter(F.col("primary_bucket").startswith("mislabel_")).select(
        "id", F.replace("primary_bucket", F.lit("mislabel_"), F.lit("")).alias("new_label")
    )


def merge_labels(dataset: DataFrame, changes: DataFrame) -> DataFrame:
    return apply_labels(preserve_original(dataset), changes)


def audit_registry_rows(audit: DataFrame) -> DataFrame:
    return audit.select(
        "id",
        F.lit("confidence_audit").alias("round"),
        F.lit("confidently_wrong_neutral").alias("sampling_strategy"),
        F.col("actual_label").alias("old_label"),
        F.col("corrected_label").alias("manual_label"),
        F.col("manual_label").alias("audit_status"),
        F.lit("").alias("notes"),
    )


def reaudit_registry_rows(reaudit: DataFrame) -> DataFrame:
    notes = F.concat(F.coalesce("error_subtype", F.lit("")), F.lit(" | "), F.coalesce("notes", F.lit("")))
    return reaudit.select(
        "id",
        F.lit("model_wrong_reaudit").alias("round"),
        F.lit("model_wrong_confidence_audit").alias("sampling_strategy"),
        F.col("actual_label").alias("old_label"),
        F.col("primary_bucket").alias("manual_label"),
        F.col("primary_bucket").alias("audit_status"),
        notes.alias("notes"),
    )


def upweight_targets(registry: DataFrame) -> DataFrame:
    """Ids whose training weight is raised: miscalibrated negatives and mixed-but-neutral texts."""
    mixed = F.coalesce(F.col("notes").contains("mixed_but_neutral"), F.lit(False))
    hit = (F.col("audit_status") == "true_model_wrong_negative") | mixed
    return registry.filter(hit).select("id").distinct()
