"""Writing and reading result tables."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Sequence
from urllib.parse import unquote

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.functions.vectors import DenseWeights
from opinara.schema import CENTROIDS, CORRECTION_EXPORT
from opinara.sources.uploads import csv_options


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_by(df: DataFrame, path: str, *keys: str) -> None:
    """Replace exactly the partitions present in the frame; others stay.

    Rows are sorted by the keys within tasks, not shuffled to one task per key, so one very large
    batch is written by many tasks.
    """
    (
        df.sortWithinPartitions(*keys)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys)
        .parquet(path)
    )


def write_reviews(reviews: DataFrame, path: str) -> None:
    write_by(reviews, path, "batch_id")


def _files(spark: SparkSession, path: str):
    """The folder and its file system, by Hadoop's public interface."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def folders(spark: SparkSession, path: str, name: str = "") -> list[str]:
    """Names of what lies in a folder, or just the given one; none if there is no folder."""
    folder, files = _files(spark, path)
    found = [entry.getPath().getName() for entry in files.listStatus(folder)] if files.exists(folder) else []
    return [x for x in found if x == name or not name and x[:1] not in "._"]


def delete(spark: SparkSession, path: str) -> None:
    folder, files = _files(spark, path)
    files.delete(folder, True)


def drop_batches(spark: SparkSession, path: str, batches: Iterable[str]) -> None:
    """Remove the batches' partitions below a table's folder, where there are any."""
    gone = {f"batch_id={batch}" for batch in batches}
    for name in folders(spark, path):
        if unquote(name) in gone:
            delete(spark, f"{path}/{name}")


def write_rollups(tables: dict[str, DataFrame], path: str, batches: Sequence[str] = ()) -> None:
    """One folder per rollup table; a re-run replaces its batches and so never counts twice.

    ``batches`` are those of this run: what an earlier run left of them goes, even from tables in
    which they have no rows any more.
    """
    for name, df in tables.items():
        if batches:
            left = df.select("batch_id").distinct().collect()  # some of this run's batches
            drop_batches(df.sparkSession, f"{path}/{name}", set(batches) - {row.batch_id for row in left})
        write_by(df, f"{path}/{name}", "batch_id")


def rebuild_rollups(tables: dict[str, DataFrame], path: str) -> None:
    """Full overwrite: batches that no longer exist disappear too."""
    for name, df in tables.items():
        df.write.mode("overwrite").partitionBy("batch_id").parquet(f"{path}/{name}")


def write_csv(df: DataFrame, path: str) -> None:
    options = csv_options()
    df.write.mode("overwrite").options(
        header="true", quote=options["quote"], escape=options["escape"], emptyValue="", quoteAll="true",
        ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false",
    ).csv(path)


def export_corrections(corrections: DataFrame, path: str) -> None:
    """The eight agreed columns in their order; anything else is left out."""
    named = corrections
    if "correction_source_session_id" not in named.columns:
        named = named.withColumnRenamed("session_id", "correction_source_session_id")
    write_csv(named.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in CORRECTION_EXPORT]), path)


def write_splits(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def write_weights(spark: SparkSession, weights: DenseWeights, path: str) -> None:
    """Store a classifier: one row per layer and input, and one for the biases (input -1)."""
    rows = [
        (n, weights.activation, k, [float(x) for x in values])
        for n, (matrix, bias) in enumerate(weights.layers)
        for k, values in [(-1, bias), *enumerate(matrix)]
    ]
    spark.createDataFrame(rows, "layer int, activation string, input int, weights array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def read_weights(spark: SparkSession, path: str) -> DenseWeights:
    rows = spark.read.parquet(path).orderBy("layer", "input").collect()  # as many as the network has inputs
    layers = []
    for _, group in itertools.groupby(rows, key=lambda r: r.layer):
        bias, *matrix = [np.array(r.weights) for r in group]
        layers.append((np.array(matrix), bias))
    return DenseWeights(tuple(layers), rows[0].activation)


def write_centroids(centroids: DataFrame, path: str) -> None:
    """Store a centroid table; every name must be filled in."""
    blank = centroids.filter(F.trim(F.coalesce("name", F.lit(""))) == "")
    if not blank.isEmpty():
        raise ValueError("centroids without a name cannot be exported")
    centroids.select(*CENTROIDS.fieldNames()).write.mode("overwrite").parquet(path)


def read_centroids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CENTROIDS).parquet(path)
