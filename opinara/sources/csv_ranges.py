"""CSV files read in many pieces, though quoted fields may hold line breaks.

Spark's text reader deals out the lines of a file by byte ranges. A line starts either a record or
inside a quoted field, so what a range does to that state is one of four functions of it. The first
pass finds the function of each range, a window composes them along each file, and the second pass
cuts every range into records from the state it truly starts in. Records across a border are put
together from their pieces, which are all that is shuffled.

One row of some 60 bytes a range is broadcast, below a millionth of a large file. Both passes must
see the same ranges; a range that the first has not seen raises an error. Lines end with a line feed
or with carriage return and line feed; a file whose lines end with a bare carriage return is one line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BATCH_BYTES = 4_000_000

# Whether a line leaves a quoted field open; a quote within an unquoted field has no meaning.
_REST = rb'(?:"(?:[^"]+|"")*+"[^,]*+,|[^",][^,]*+,|,)*+"(?:[^"]+|"")*+\Z'
_OPENS = re.compile(_REST)
_STAYS_OPEN = re.compile(rb'(?:[^"]+|"")*+(?:\Z|"[^,]*+,' + _REST + rb")")

SCANNED = "file string, start long, from_start boolean, from_quoted boolean, closes boolean, blank boolean"
PARTS = "file string, owner long, start long, header boolean, record binary"


def open_after(line: bytes, inside: bool) -> bool:
    """Is a quoted field open at the end of the line?"""
    if b'"' not in line:
        return inside
    return (_STAYS_OPEN if inside else _OPENS).match(line) is not None


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """file, start of the range, line; in the order of the file within each range."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.md5("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line")
    )


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[dict, list[bytes]]]:
    """The rows of a batch by range: the columns of the first row, and all lines."""
    starts, files = batch.column("start").to_pylist(), batch.column("file").to_pylist()
    begin = 0
    for n in range(1, len(starts) + 1):
        if n == len(starts) or starts[n] != starts[begin] or files[n] != files[begin]:
            row = {name: batch.column(name)[begin].as_py() for name in batch.schema.names if name != "line"}
            yield row, batch.column("line").slice(begin, n - begin).to_pylist()
            begin = n


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each range does to the state it starts in."""
    names = [field.split()[0] for field in SCANNED.split(", ")]
    kinds = [pa.string(), pa.int64(), *[pa.bool_()] * 4]
    at, outside, inside, closes, blank = None, False, True, False, True

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*at, outside, inside, closes, blank), kinds, strict=True)], names)

    for batch in batches:
        for row, lines in _runs(batch):
            if at != (row["file"], row["start"]):
                if at is not None:
                    yield done()
                at, outside, inside, closes, blank = (row["file"], row["start"]), False, True, False, True
            blank = blank and all(line in (b"", b"\r") for line in lines)
            for line in lines:
                if b'"' in line:
                    same = outside == inside
                    outside = open_after(line, outside)
                    inside = outside if same else open_after(line, inside)
                    closes = closes or not inside
    if at is not None:
        yield done()


def ranges(lines: DataFrame) -> DataFrame:
    """file, start, inside, owner and header of each range.

    ``inside``: it starts in a quoted field. ``owner``: the range in which the record of that field
    begins. ``header``: it holds the first record of its file.
    """
    along = Window.partitionBy("file").orderBy("start")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    # A range keeps the state, turns it round, or ends alike from both; what counts is the last of the
    # latter before a range, and how often the state was turned since.
    turns = (F.col("from_start") & ~F.col("from_quoted")).cast("long")
    alike = F.when(F.col("from_start") == F.col("from_quoted"), F.struct("from_start", "turned"))
    placed = lines.mapInArrow(_scan, SCANNED).withColumn("turned", F.sum(turns).over(along))
    placed = placed.withColumns({"anchor": F.last(alike, ignorenulls=True).over(before), "so_far": F.lag("turned", 1, 0).over(along)})
    odd = (F.col("so_far") - F.coalesce(F.col("anchor.turned"), F.lit(0))) % 2 == 1
    placed = placed.withColumn("inside", F.coalesce(F.col("anchor.from_start"), F.lit(False)) != odd)
    open_at_end = F.when(F.col("inside"), F.col("from_quoted")).otherwise(F.col("from_start"))
    begins = open_at_end & (~F.col("inside") | F.col("closes"))
    first = F.min(F.when(~F.col("blank"), F.col("start"))).over(Window.partitionBy("file"))
    return placed.select(
        "file", "start", "inside", F.last(F.when(begins, F.col("start")), ignorenulls=True).over(before).alias("owner"),
        F.coalesce(F.col("start") == first, F.lit(False)).alias("header"),
    )


def _records(pieces: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records of each range, or the pieces of those that cross its borders."""
    names = [field.split()[0] for field in PARTS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
    rows: list[tuple] = []
    size = 0
    at, row, parts, inside, owner, header = None, None, [], False, None, False

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def put(crosses: bool) -> None:
        nonlocal size, header, owner
        record = b"\n".join(parts)
        if crosses == pieces:
            rows.append((at[0], owner if crosses else None, at[1], header and owner in (None, at[1]), record))
            size += len(record)
        if owner in (None, at[1]) and record not in (b"", b"\r"):
            header = False
        parts.clear()
        owner = None

    def end() -> None:
        """The range is over: what is open goes on in the next one."""
        nonlocal owner
        if parts:
            owner = at[1] if owner is None else owner
            put(True)

    for batch in batches:
        for row, lines in _runs(batch):
            if at != (row["file"], row["start"]):
                end()
                if row["inside"] is None:
                    raise RuntimeError("byte ranges changed between two passes; fix spark.sql.files.minPartitionNum")
                at, inside, header = (row["file"], row["start"]), row["inside"], row["header"]
                owner = row["owner"] if inside else None
            for line in lines:
                inside = open_after(line, inside)
                parts.append(line)
                if not inside:
                    put(owner is not None)
                    if size > BATCH_BYTES:
                        yield flush()
                        rows, size = [], 0
    end()
    if rows:
        yield flush()


def records(lines: DataFrame) -> DataFrame:
    """record: the text of every record but each file's first."""
    placed = lines.join(F.broadcast(ranges(lines)), ["file", "start"], "left").select("file", "start", "inside", "owner", "header", "line")
    whole = placed.mapInArrow(partial(_records, False), PARTS).where(~F.col("header")).select(F.col("record").cast("string").alias("record"))
    parts = placed.mapInArrow(partial(_records, True), PARTS)
    ordered = F.array_sort(F.collect_list(F.struct("start", F.col("record").cast("string").alias("text"))))
    joined = parts.groupBy("file", "owner").agg(ordered.alias("parts"), F.bool_or("header").alias("header"))
    crossing = joined.where(~F.col("header")).select(F.array_join(F.col("parts")["text"], "\n").alias("record"))
    ended = F.when(F.endswith("record", F.lit("\r")), F.expr("left(record, length(record) - 1)")).otherwise(F.col("record"))
    return whole.unionByName(crossing).select(ended.alias("record")).where("record <> ''")


def read(spark: SparkSession, path: str, options: dict[str, str]) -> DataFrame:
    """All records of the files, every value a string; the first file names the columns."""
    columns = spark.read.options(**options).csv(path).columns
    if not columns:
        return spark.createDataFrame([], "")
    # A line break inside the header hides from Spark that lines end with carriage return and line feed.
    columns[-1] = columns[-1].removesuffix("\r")
    schema = ", ".join(f"`{name.replace('`', '``')}` STRING" for name in columns)
    return records(lines_of(spark, path)).select(F.from_csv("record", schema, options).alias("row")).select("row.*")
