"""From uploaded rows to stored reviews and rollups."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.functions.cleaning import clean_or_raw
from opinara.functions.vectors import DenseWeights
from opinara.operators.ranking import small_side
from opinara.operators.rollups import all_rollups, split_rollups
from opinara.operators.scoring import score_reviews
from opinara.schema import BATCHES, REVIEWS
from opinara.session import cut
from opinara.sources.tables import write_by, write_reviews, write_rollups
from opinara.sources.uploads import ColumnMapping, keyed_rows, mapped


def prepare(upload: DataFrame, mapping: ColumnMapping, batch_id: str) -> DataFrame:
    """Mapped rows with a content id, so that a repeated run writes the same reviews."""
    keyed = keyed_rows(upload, F.lit(batch_id))
    fields = keyed.select(F.col("key").alias("review_id"), *mapped(upload.columns, mapping, lambda c: F.col("row").getField(c)))
    return fields.select(
        "review_id",
        F.lit(batch_id).alias("batch_id"),
        "text",
        "category",
        "review_date",
        F.coalesce("extra", F.create_map().cast("map<string,string>")).alias("extra"),
        clean_or_raw(F.col("text")).alias("clean_text"),
    )


def enrich(prepared: DataFrame, weights: DenseWeights, centroids: DataFrame, at: datetime | None = None) -> DataFrame:
    """Score rows that already carry ``features``; the result has the stored review columns."""
    scored = score_reviews(prepared, weights, centroids)
    stamped = scored.withColumn("processed_at", F.lit(at or datetime.now(timezone.utc).replace(tzinfo=None)))
    return stamped.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in REVIEWS])


def store(reviews: DataFrame, path: str) -> dict[str, DataFrame]:
    """Write reviews, then build rollups from what was written, so both agree after any retry."""
    write_reviews(reviews, f"{path}/reviews")
    batches = small_side(reviews.select("batch_id").distinct())
    written = reviews.sparkSession.read.parquet(f"{path}/reviews").join(batches, "batch_id", "left_semi")
    tables = split_rollups(cut(all_rollups(written)))
    write_rollups(tables, path, [row.batch_id for row in batches.collect()])
    return tables


def record_batch(
    upload: DataFrame, mapping: ColumnMapping, batch_id: str, path: str, filename: str, started: datetime, ended: datetime | None = None
) -> DataFrame:
    """Write and return the batch's own row: how many rows came, how many are stored, and how long it took.

    Its status is done if as many reviews are stored as rows came, else failed.
    """
    spark = upload.sparkSession
    total = upload.count()
    processed = spark.read.parquet(f"{path}/reviews").filter(F.col("batch_id") == batch_id).count()
    ended = ended or datetime.now(timezone.utc).replace(tzinfo=None)
    used = {name: column for name, column in (("text", mapping.text), ("category", mapping.category), ("date", mapping.date)) if column}
    status = "done" if processed == total else "failed"
    row = (batch_id, filename, started, total, processed, status, used, list(upload.columns), (ended - started).total_seconds())
    record = spark.createDataFrame([row], BATCHES)
    write_by(record, f"{path}/batches", "batch_id")
    return record
