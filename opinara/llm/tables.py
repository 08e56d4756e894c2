"""The driver's tables as the operators of this package take them."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.session import run_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def released(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """The same work on batches; at its end the worker gives free memory back, as Spark keeps it for other tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
            trim(0)

    return run


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold_of(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo the folds; a null id counts as empty text. Fold 0 is held out."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write the frame to a fresh shared folder and go on from there: lineage ends, columns prune."""
    path = run_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def borders(df: DataFrame, column: str, pieces: int) -> list[int]:
    """Values that cut a whole-number column into pieces of about equal row counts; may repeat."""
    if pieces < 2:
        return []
    found = df.select(F.col(column).cast("double").alias("v")).na.drop().approxQuantile("v", [k / pieces for k in range(1, pieces)], 0.1 / pieces)
    return sorted(int(x) for x in found)


def pieces_of(values: pa.Array, cut: Sequence[int], spread: int) -> np.ndarray:
    """The piece of each value; copies of a value that fills several pieces go to all of these by turns."""
    numbers = values.fill_null(0).to_numpy()
    low, high = (np.searchsorted(np.array(cut, np.int64), numbers, side) for side in ("left", "right"))
    place = low + (spread + np.arange(len(numbers))) % np.maximum(high - low, 1)
    return np.where(values.is_null().to_numpy(zero_copy_only=False), 0, place)
