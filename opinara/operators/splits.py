"""Splits, samples and row weights, all in reproducible hash order.

Random draws become "the first n rows of a stratum by hash of the id", found exactly without
sorting a stratum (see ``ranking.hash_cuts``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara.operators.curation import id_union, upweight_targets, with_ids, without_ids
from opinara.operators.ranking import hash_key, take_first_by_hash, with_hash_cuts
from opinara.schema import LABELS
from opinara.session import cut

REVIEW_SAMPLE = 250
FROZEN_ROWS = 300
HARD_BUCKETS = ("genuinely_mixed", "true_model_wrong_negative", "true_model_wrong_positive")


def percent(pct: float) -> Column:
    """That share of a stratum, rounded up."""
    return F.ceil(F.col("total") * pct / 100.0)


def stratified_split(
    df: DataFrame, test_pct: float = 15, val_pct: float = 15, seed: int = 42, label: str = "label"
) -> DataFrame:
    """Adds ``split``: test, val or train, with equal label shares in each."""
    quotas = {"test": percent(test_pct), "val": percent(test_pct) + percent(val_pct)}
    joined, inside = with_hash_cuts(df, hash_key(F.col("id"), seed), quotas, [label])
    split = F.when(inside["test"], "test").when(inside["val"], "val").otherwise("train")
    return joined.select(*df.columns, split.alias("split"))


def resplit_unreviewed(
    df: DataFrame, reviewed: DataFrame, frozen: DataFrame | None = None, test_pct: float = 20, seed: int = 123
) -> DataFrame:
    """Test rows come only from texts nobody reviewed; reviewed rows train; frozen rows do neither."""
    excluded = reviewed.select("id", F.lit("train").alias("forced"))
    if frozen is not None:
        excluded = without_ids(excluded, frozen).unionByName(frozen.select("id", F.lit("frozen").alias("forced")))
    forced = cut(excluded.groupBy("id").agg(F.min("forced").alias("forced")))
    marked = df.join(forced, "id", "left")
    joined, inside = with_hash_cuts(marked, hash_key(F.col("id"), seed), {"test": percent(test_pct)}, ["label", "forced"])
    split = F.coalesce("forced", F.when(inside["test"], "test").otherwise("train"))
    return joined.select(*df.columns, split.alias("split"))


def split_report(splits: DataFrame) -> DataFrame:
    """Size per split and label with the label's share of the split and of everything."""
    counts = splits.groupBy("split", "label").agg(F.count(F.lit(1)).alias("count"))
    in_split = F.sum("count").over(Window.partitionBy("split"))
    overall = F.sum("count").over(Window.partitionBy())
    return counts.select(
        "split",
        "label",
        "count",
        F.round(F.col("count") * 100.0 / in_split, 4).alias("pct_of_split"),
        F.round(F.col("count") * 100.0 / overall, 4).alias("pct_of_all"),
    )


def leak_counts(splits: DataFrame, reviewed: DataFrame, frozen: DataFrame) -> DataFrame:
    """Reviewed ids in test, and frozen ids in train or test; all must be zero."""
    guarded = id_union(reviewed).withColumn("reviewed", F.lit(1)).unionByName(
        id_union(frozen).withColumn("reviewed", F.lit(0))
    )
    flags = guarded.groupBy("id").agg(F.max("reviewed").alias("reviewed"), F.min("reviewed").alias("not_frozen"))
    joined = splits.select("id", "split").join(flags, "id")
    frozen_row = F.col("not_frozen") == 0
    return joined.agg(
        F.count_if((F.col("reviewed") == 1) & (F.col("split") == "test")).alias("reviewed_in_test"),
        F.count_if(frozen_row & (F.col("split") == "test")).alias("frozen_in_test"),
        F.count_if(frozen_row & (F.col("split") == "train")).alias("frozen_in_train"),
    )


def review_sample(train: DataFrame, reviewed: DataFrame, n: int = REVIEW_SAMPLE, seed: int = 42) -> DataFrame:
    """Rows to read next: n training rows nobody reviewed, or all of them when fewer are left."""
    return without_ids(train, reviewed).orderBy(hash_key(F.col("id"), seed), "id").limit(n)


def freeze_hard_cases(reaudit: DataFrame, size: int = FROZEN_ROWS, seed: int = 77) -> DataFrame:
    hard = reaudit.filter(F.col("primary_bucket").isin(*HARD_BUCKETS))
    return hard.orderBy(hash_key(F.col("id"), seed), "id").limit(size)


def holdout(train: DataFrame, pct: float = 8, seed: int = 42) -> DataFrame:
    """Adds ``part``: val for an exact share of the rows, fit for the rest."""
    quota = {"val": F.floor(F.col("total") * pct / 100.0)}
    joined, inside = with_hash_cuts(train, hash_key(F.col("id"), seed), quota)
    return joined.select(*train.columns, F.when(inside["val"], "val").otherwise("fit").alias("part"))


def sized_sample(df: DataFrame, size: int, seed: int = 42, strata: Sequence[str] = ()) -> DataFrame:
    """Exactly ``size`` rows per stratum, or the whole stratum when it is smaller."""
    quota = F.least(F.lit(size).cast("long"), F.col("total"))
    return take_first_by_hash(df, hash_key(F.col("id"), seed), quota, strata)


def fraction_samples(
    df: DataFrame, fractions: Sequence[float] = (0.25, 0.5, 0.75, 1.0), seed: int = 42, strata: Sequence[str] = ("category",)
) -> DataFrame:
    """Nested samples for a learning curve: each row once per fraction it belongs to."""
    names = {f"{fraction:g}": fraction for fraction in fractions}
    quotas = {name: F.floor(F.col("total") * fraction) for name, fraction in names.items()}
    joined, inside = with_hash_cuts(df, hash_key(F.col("id"), seed), quotas, strata)
    member = F.array_compact(F.array(*[F.when(inside[name], F.lit(value)) for name, value in names.items()]))
    return joined.select(*df.columns, F.explode(member).alias("fraction"))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """n / (k * n_c) over the labels present; at most one row per known label."""
    counts = df.filter(F.col(label).isin(*LABELS)).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy()
    weight = F.sum("n").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("n"))
    return counts.select(label, F.col("n").alias("rows"), weight.alias("class_weight"))


def row_weights(train: DataFrame, registry: DataFrame, factor: float) -> DataFrame:
    """Class weight, times ``factor`` for rows the audits single out. At most three weight rows are broadcast."""
    targets = upweight_targets(registry).withColumn("targeted", F.lit(True))
    weighted = train.join(F.broadcast(class_weights(train).drop("rows")), "label").join(targets, "id", "left")
    raised = F.when(F.col("targeted"), F.lit(float(factor))).otherwise(1.0)
    return weighted.withColumn("weight", F.col("class_weight") * raised).drop("targeted")


def verified_and_raw(train: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Training rows a human verified, and the untouched rest."""
    return with_ids(train, registry), without_ids(train, registry)
