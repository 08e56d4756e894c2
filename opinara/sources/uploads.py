"""Review files as they arrive: reading, checking, mapping columns, stable ids."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinara.sources import csv_ranges

# Header names taken for the text, date and category column.
TEXT_NAMES = ("text", "review", "reviews", "sentiment")
DATE_NAMES = ("date", "created_at", "timestamp")
CATEGORY_NAMES = ("category", "categories", "tag")

PREVIEW_ROWS = 5
COPIES_PER_CHUNK = 10_000

CHECK = T.StructType(
    [
        T.StructField("ok", T.BooleanType(), False),
        T.StructField("error_code", T.StringType()),
        T.StructField("message", T.StringType()),
    ]
)


@dataclass(frozen=True)
class ColumnMapping:
    """Which columns of an upload hold the text, the category and the date."""

    text: str
    category: str = ""
    date: str = ""


def csv_options(multi_line: bool = True) -> dict[str, str]:
    """Quoted fields may hold separators, quotes (doubled) and line breaks; blanks stay blank strings."""
    return {
        "header": "true",
        "multiLine": str(multi_line).lower(),
        "quote": '"',
        "escape": '"',
        "encoding": "UTF-8",
        "emptyValue": "",
        "nullValue": "\u0000",
        "ignoreLeadingWhiteSpace": "false",
        "ignoreTrailingWhiteSpace": "false",
        "mode": "PERMISSIVE",
    }


def read_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Every value a string, missing cells blank.

    Files are read in byte ranges, so one large file is many tasks. ``multi_line`` allows line breaks
    in quoted fields, at the price of two more passes over the text.
    """
    options = csv_options(multi_line)
    raw = csv_ranges.read(spark, path, options) if multi_line else spark.read.options(**options).csv(path)
    return raw.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in raw.columns])


def _verdict(spark: SparkSession, code: str | None = None, message: str | None = None) -> DataFrame:
    return spark.createDataFrame([(code is None, code, message)], CHECK)


def check_upload(spark: SparkSession, path: str, mapping: ColumnMapping, multi_line: bool = True) -> DataFrame:
    """One row: is the file usable, and if not, why."""
    if not path.rstrip("/").lower().endswith(".csv"):
        return _verdict(spark, "INVALID_FILE_TYPE", "File must be a CSV")
    try:
        lines = spark.read.text(path)
    except AnalysisException:
        return _verdict(spark, "EMPTY_FILE", "CSV file is empty")
    if lines.filter(F.trim("value") != "").isEmpty():
        return _verdict(spark, "EMPTY_FILE", "CSV file is empty")
    if not lines.filter(~F.is_valid_utf8("value")).isEmpty():
        return _verdict(spark, "INVALID_ENCODING", "File must be UTF-8 encoded")
    rows = read_csv(spark, path, multi_line)
    if not rows.columns:
        return _verdict(spark, "INVALID_CSV", "CSV has no header row")
    for name in (mapping.text, mapping.category, mapping.date):
        if name and name not in rows.columns:
            return _verdict(spark, "MISSING_COLUMN", f"Column '{name}' not found. Available: {rows.columns}")
    if rows.isEmpty():
        return _verdict(spark, "EMPTY_CSV", "CSV has headers but no data rows")
    return _verdict(spark)


def detect_columns(columns: list[str]) -> ColumnMapping:
    """Guess the mapping from header names; the first column holds the text when none is named so."""

    def first(names: tuple[str, ...], default: str) -> str:
        return next((c for c in columns if c.lower() in names), default)

    return ColumnMapping(first(TEXT_NAMES, columns[0]), first(CATEGORY_NAMES, ""), first(DATE_NAMES, ""))


def mapped(columns: list[str], mapping: ColumnMapping, value: Callable[[str], Column]) -> list[Column]:
    """text, category, review_date and a map of everything else; absent category and date are blank."""
    used = {name for name in (mapping.text, mapping.category, mapping.date) if name}
    rest = [c for c in columns if c not in used]

    def blank_or(name: str) -> Column:
        return F.coalesce(value(name).cast("string"), F.lit("")) if name else F.lit("")

    extra = F.create_map(*[x for c in rest for x in (F.lit(c), value(c).cast("string"))]) if rest else F.lit(None).cast("map<string,string>")
    return [
        value(mapping.text).cast("string").alias("text"),
        blank_or(mapping.category).alias("category"),
        blank_or(mapping.date).alias("review_date"),
        extra.alias("extra"),
    ]


def map_columns(df: DataFrame, mapping: ColumnMapping) -> DataFrame:
    return df.select(*mapped(df.columns, mapping, lambda c: F.col(f"`{c}`")))


def preview(df: DataFrame, *order: str, rows: int = PREVIEW_ROWS) -> DataFrame:
    return df.orderBy(*order).limit(rows)


def keyed_rows(df: DataFrame, *salt: Column) -> DataFrame:
    """(key, row): every row as a struct, whatever its columns are called, with a stable key.

    The key comes from the content and the salt; equal rows are told apart by a running number. They
    are counted by digest, then written out again from the count in chunks, so that even a row with
    billions of copies never gathers in one task. A re-run gives the same keys.
    """
    content = F.to_json(F.struct(F.struct(*[F.col(f"`{c}`") for c in df.columns]), *salt), {"ignoreNullFields": "false"})
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.md5(content).alias("digest"))
    counted = rows.groupBy("digest").agg(F.any_value("row").alias("row"), F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("long")
    few = counted.filter(F.col("n") <= COPIES_PER_CHUNK).withColumn("chunk", zero)
    many = counted.filter(F.col("n") > COPIES_PER_CHUNK)
    last_chunk = F.floor((F.col("n") - 1) / COPIES_PER_CHUNK)
    # A stated number of partitions: the few rows here grow when written out, which AQE can't foresee.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = many.withColumn("chunk", F.explode(F.sequence(zero, last_chunk))).repartition(tasks, "digest", "chunk")
    start = F.col("chunk") * COPIES_PER_CHUNK
    stop = F.least(F.col("n"), start + COPIES_PER_CHUNK) - 1
    copies = few.unionByName(spread).withColumn("copy", F.explode(F.sequence(start, stop)))
    return copies.select(F.md5(F.concat_ws("#", "digest", F.col("copy").cast("string"))).alias("key"), "row")


def with_content_ids(df: DataFrame, name: str = "id") -> DataFrame:
    """A stable id per row from its content, in a column of its own."""
    if name in df.columns:
        raise ValueError(f"there is a column {name} already")
    return keyed_rows(df).select(F.col("key").alias(name), "row.*")


def ensure_id(df: DataFrame) -> DataFrame:
    return df if "id" in df.columns else with_content_ids(df)
