"""Reviews as a stream: incremental enrichment, counters, weekly windows, exactly-once rows."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from opinara.operators.rollups import TREND_KEYS, sentiment_counts, with_week
from opinara.sources import tables
from opinara.sources.uploads import csv_options

BUCKETS = 64
MANIFEST = "buckets int, schema string, versions map<int, string>"


def csv_stream(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """New CSV files of a folder, every column a string."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.readStream.schema(schema).options(**csv_options()).csv(folder)


def utc_instant(wall_clock: Column) -> Column:
    """A zone-free time read as UTC; event time must be an instant, whatever zone the session shows."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), wall_clock.cast("timestamp_ntz")).cast("timestamp")


def utc_wall_clock(instant: Column) -> Column:
    """The UTC clock reading of an instant."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz"))


def review_key(*columns: str) -> Column:
    """A key that is the same whenever the same row is read again."""
    return F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def _owner(checkpoint: str) -> str:
    """A name for what one checkpoint's stream writes; another checkpoint counts its batches anew."""
    return hashlib.md5(checkpoint.encode()).hexdigest()


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(path) if tables.folders(spark, path) else None


def store_once(stream: DataFrame, path: str, checkpoint: str, key: str = "review_id") -> StreamingQuery:
    """Write each review once, however late it comes and however often.

    A micro-batch is held against the keys that are stored, except its own on a retry, and writes its
    own folder. Nothing is held as state, so nothing first seen late is lost. ``read_once`` reads it.
    """
    owner = _owner(checkpoint)

    def write(rows: DataFrame, batch: int) -> None:
        fresh, stored = rows.dropDuplicates([key]), _stored(rows.sparkSession, path)
        if stored is not None:
            others = stored.where((F.col("owner") != owner) | (F.col("batch") != batch))
            fresh = fresh.join(others.select(key), key, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path}/owner={owner}/batch={batch}")

    writer = stream.writeStream.option("checkpointLocation", checkpoint)
    return writer.foreachBatch(write).trigger(availableNow=True).start()


def read_once(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("owner", "batch")


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write each row once; the file sink's log makes a repeated micro-batch harmless."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start()


def running_counters(stream: DataFrame) -> DataFrame:
    """Weekly sentiment counters as streaming state, one entry per batch, category and week."""
    return with_week(stream).groupBy(*TREND_KEYS).agg(*sentiment_counts())


def upsert_counters(
    counters: DataFrame, path: str, checkpoint: str, keys: Sequence[str] = TREND_KEYS, buckets: int = BUCKETS
) -> StreamingQuery:
    """Keep a counter table current from update-mode output.

    Rows lie in buckets by a hash of their keys, and a manifest names the version of each bucket. A
    micro-batch writes the buckets anew that hold its keys, then a manifest that replaces the one before
    as a whole; a micro-batch that is repeated writes its own versions again. A checkpoint has a generation
    of its own, later ones win, so a stream that starts over after a lost checkpoint replaces what the lost
    one had counted. The two latest manifests and what they name stay, for readers of the one before.
    ``buckets`` counts for a new table; an existing one keeps its number.
    """
    spark, owner = counters.sparkSession, _owner(checkpoint)
    known = [name.split("-") for name in tables.folders(spark, f"{path}/manifests")]
    generations = {int(g) for g, _, _ in known}
    generation = next((int(g) for g, o, _ in known if o == owner), max(generations, default=-1) + 1)
    on = list(keys)

    def write(changed: DataFrame, batch: int) -> None:
        session, own = changed.sparkSession, (generation, batch)
        earlier = sorted(v for v in _manifests(session, path) if v[:2] < own)
        before = _manifest(session, path, earlier[-1][2]) if earlier else None
        count = before["buckets"] if before else buckets
        versions = dict(before["versions"]) if before else {}
        version = f"{generation}-{owner}-{batch}"
        dealt = changed.withColumn("bucket", F.pmod(F.xxhash64(*on), F.lit(count)).cast("int")).persist()
        touched = sorted(row.bucket for row in dealt.select("bucket").distinct().collect())  # one row a bucket at most
        if touched:
            old = _rows(session, path, changed.schema, {b: versions[b] for b in touched if b in versions})
            kept = old.join(dealt.select("bucket", *on), ["bucket", *on], "left_anti")
            whole = dealt.unionByName(kept).repartition(len(touched), "bucket")
            whole.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/{version}")
        dealt.unpersist()
        versions |= dict.fromkeys(touched, version)
        manifest = session.createDataFrame([(count, changed.schema.json(), versions)], MANIFEST)
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifests/{version}")
        for _, _, name in earlier[:-1]:
            tables.delete(session, f"{path}/manifests/{name}")
        named = {(v, b) for m in ((before or {}).get("versions", {}), versions) for b, v in m.items()}
        for name in {v[2] for v in earlier} | set(tables.folders(session, f"{path}/data")):
            there = {int(x.split("=")[1]) for x in tables.folders(session, f"{path}/data/{name}")}
            left = {b for b in there if (name, b) in named}
            for bucket in there - left if left else ():
                tables.delete(session, f"{path}/data/{name}/bucket={bucket}")
            if not left:
                tables.delete(session, f"{path}/data/{name}")

    writer = counters.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    return writer.foreachBatch(write).trigger(availableNow=True).start()


def _manifests(spark: SparkSession, path: str) -> list[tuple[int, int, str]]:
    """Generation, micro-batch and name of each complete manifest."""
    parts = [(name.split("-"), name) for name in tables.folders(spark, f"{path}/manifests")]
    return [(int(g), int(b), name) for (g, _, b), name in parts if tables.folders(spark, f"{path}/manifests/{name}", "_SUCCESS")]


def _manifest(spark: SparkSession, path: str, name: str) -> dict:
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifests/{name}").first().asDict()


def _rows(spark: SparkSession, path: str, schema: T.StructType, versions: dict[int, str]) -> DataFrame:
    """The rows of the named versions of buckets, and the bucket of each."""
    whole = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])
    places: dict[str, list[str]] = {}
    for bucket, version in versions.items():
        places.setdefault(f"{path}/data/{version}", []).append(f"bucket={bucket}")
    if not places:
        return spark.createDataFrame([], whole)
    # Each version is a table of its own to Spark, which takes several without a common root for an error.
    parts = [spark.read.schema(whole).option("basePath", base).parquet(*[f"{base}/{b}" for b in own]) for base, own in places.items()]
    return reduce(DataFrame.unionByName, [part.select(*whole.names) for part in parts])


def read_counters(spark: SparkSession, path: str) -> DataFrame:
    found = _manifest(spark, path, max(_manifests(spark, path))[2])
    return _rows(spark, path, T.StructType.fromJson(json.loads(found["schema"])), found["versions"]).drop("bucket")


WEEK_KEYS = ("week_start", "category")


def weekly_windows(stream: DataFrame, event_time: str = "ts") -> DataFrame:
    """Tumbling weeks that start on Monday (the epoch was a Thursday), for update mode.

    State is one row per week and category and is kept, so late rows always count.
    """
    week = F.window(event_time, "7 days", startTime="4 days")
    grouped = stream.groupBy(week.alias("window"), "category")
    return grouped.agg(*sentiment_counts()).withColumn("week_start", F.col("window.start")).drop("window")


def append_counted(stream: DataFrame, path: str, checkpoint: str, progress: str) -> StreamingQuery:
    """Write each micro-batch to its own folder, and rows seen and rows scored beside it.

    Both are observed while the rows are written, so nothing is read again, and stored, so they outlive
    the query; a repeated micro-batch replaces its own counts.
    """
    owner = _owner(checkpoint)

    def write(rows: DataFrame, batch: int) -> None:
        folder, seen = f"owner={owner}/batch={batch}", Observation()
        counted = rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count("sentiment").alias("scored"))
        counted.write.mode("overwrite").parquet(f"{path}/{folder}")
        report = rows.sparkSession.createDataFrame([(seen.get["rows"], seen.get["scored"])], "rows long, scored long")
        report.coalesce(1).write.mode("overwrite").parquet(f"{progress}/{folder}")

    writer = stream.writeStream.option("checkpointLocation", checkpoint)
    return writer.foreachBatch(write).trigger(availableNow=True).start()


def progress_of(spark: SparkSession, progress: str) -> DataFrame:
    """micro_batch, rows and scored of every micro-batch there has been."""
    return spark.read.parquet(progress).select(F.col("batch").cast("long").alias("micro_batch"), "rows", "scored")


def finish(query: StreamingQuery) -> StreamingQuery:
    """Wait for everything available to be processed; raises what the query raised."""
    query.awaitTermination()
    return query
