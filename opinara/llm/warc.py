"""Write pages as WARC archives and read archives back by verified chains of record boundaries.

Writing: one record per page; of pages with equal payloads of SHARED bytes or more, that with the
smallest id is a response and the others are revisits that refer to it. Files are written by Spark's
text sink, record after record, so they can lie in any store that Spark writes to.

Reading: tasks cut their byte ranges at the magic line, wherever it occurs, and emit each occurrence
as a candidate: where it starts and, by its Content-Length, where the next record should start. A
candidate may be a piece of some payload. In its own range a task follows successors to the first one
beyond the range; from the start of each file, pointer jumping over these exits finds the ranges'
reachable entries, and in a range what lies on the path from its entry is a record. All else is payload,
and is put back into the record that holds it.

Null html is an empty payload, a null url an empty target. Rows without an id are records without
one; repeated rows each have their record, and all rows with the smallest id are responses. No pages
give an archive without records.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opinara.llm import tables
from opinara.operators.ranking import small_side
from opinara.session import run_folder

MAGIC = "WARC/1.1\r\n"
SHARED = 100
#: Fixed values of the format.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record(page_id: Column, url: Column, payload: Column, digest: Column, size: Column, refers: Column) -> Column:
    text = lambda x: F.lit(x)
    is_revisit = refers.isNotNull()
    urn = lambda key: F.concat(text("<urn:page:"), F.coalesce(key.cast("string"), text("")), text(">"))
    http = F.concat(text("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), text("\r\n\r\n"))
    length = F.octet_length(http) + F.when(is_revisit, 0).otherwise(size)
    link = F.concat(text("WARC-Refers-To: "), urn(refers), text(f"\r\nWARC-Profile: {PROFILE}\r\n"))
    return F.concat(
        text(f"{MAGIC}WARC-Type: "), F.when(is_revisit, "revisit").otherwise("response"),
        text("\r\nWARC-Record-ID: "), urn(page_id), text("\r\nWARC-Target-URI: "), F.translate(F.coalesce(url, text("")), "\r\n", "  "),
        text(f"\r\nWARC-Date: {DATE}\r\nWARC-Payload-Digest: sha256:"), digest, text("\r\n"), F.when(is_revisit, link).otherwise(""),
        text("Content-Type: application/http;msgtype=response\r\nContent-Length: "), length.cast("string"), text("\r\n\r\n"),
        http, F.when(is_revisit, "").otherwise(payload), text("\r\n\r"),
    )


def write_archives(pages: DataFrame, folder: str) -> None:
    """One uncompressed WARC file per task, below ``folder``, from page_id, url and html."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"),
        F.sha2(payload.cast("binary"), 256).alias("digest"), F.octet_length(payload).cast("long").alias("size"),
    )
    shared = rows.where(F.col("size") >= SHARED).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    shared = small_side(shared.where((F.col("n") > 1) & F.col("first").isNotNull()).select("digest", "first"))
    joined = rows.join(shared, "digest", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    record = _record(F.col("page_id"), F.col("url"), F.col("payload"), F.col("digest"), F.col("size"), refers)
    joined.select(record.alias("value")).write.option("lineSep", "\n").text(folder)


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = spark.read.option("lineSep", MAGIC).text(folder)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.col("value").cast("binary").alias("value"))


def _field(head: bytes, name: bytes) -> str | None:
    for line in head.split(b"\r\n"):
        key, colon, value = line.partition(b":")
        if colon and key.strip().lower() == name:
            return value.strip().decode("utf-8", "replace")
    return None


def _whole(text: str | None) -> int | None:
    return int(text) if text is not None and text.isascii() and text.isdigit() else None


def _page(urn: str | None) -> int | None:
    body = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(body) if body.removeprefix("-").isdigit() else None


CANDIDATE = pa.schema([
    ("file", pa.string()), ("range", pa.int64()), ("at", pa.int64()), ("size", pa.int64()), ("next", pa.int64()), ("exit", pa.int64()),
    ("first", pa.int64()), ("last", pa.int64()), ("starts", pa.bool_()), ("record_type", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()),
    ("uri", pa.string()), ("body_at", pa.int64()), ("body_end", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
])
CANDIDATE_ROW = (
    "file string, range long, at long, size long, next long, exit long, first long, last long, starts boolean, record_type string, "
    "page_id long, refers_to long, uri string, body_at long, body_end long, payload_bytes long, payload_digest string"
)


def _parse(value: bytes, at: int) -> dict:
    """A candidate's fields; ``at`` and ``next`` are places behind the magic, counted from the range's
    first row. Without a readable header it has no successor."""
    import hashlib

    end = value.find(b"\r\n\r\n")
    head = value[: max(end, 0)]
    length = _whole(_field(head, b"content-length"))
    out = {"at": at, "size": len(value) + len(MAGIC), "next": -1, "starts": True}
    if end < 0 or length is None:
        return out
    body_at, body_end = end + 4, end + 4 + length
    http = value.find(b"\r\n\r\n", body_at, body_end)
    http_head = b""
    if (_field(head, b"content-type") or "").startswith("application/http") and http >= 0:
        http_head, body_at = value[body_at:http], http + 4
    kind = _field(head, b"warc-type")
    out |= {"next": at + body_end + 4 + len(MAGIC), "record_type": kind, "page_id": _page(_field(head, b"warc-record-id")), "uri": _field(head, b"warc-target-uri")}
    if kind == "revisit":
        digest = (_field(head, b"warc-payload-digest") or "").removeprefix("sha256:")
        return out | {"refers_to": _page(_field(head, b"warc-refers-to")), "payload_bytes": _whole(_field(http_head, b"content-length")), "payload_digest": digest}
    out |= {"body_at": body_at, "body_end": body_end, "payload_bytes": body_end - body_at}
    if len(value) >= body_end:
        out["payload_digest"] = hashlib.sha256(memoryview(value)[body_at:body_end]).hexdigest()
    return out


def _follow(rows: list[dict], end: int) -> None:
    """Adds exits, and places in a walk of the forest that successors inside the range make: a
    candidate lies on the path from another if its span [first, last] holds the other's first."""
    place = {r["at"]: n for n, r in enumerate(rows) if r["starts"]}
    up = [place.get(r["next"], -1) if r["next"] < end else -1 for r in rows]
    below = [1] * len(rows)
    for n, p in enumerate(up):
        if p >= 0:
            below[p] += below[n]
    free, roots = [0] * len(rows), 0
    for n in range(len(rows) - 1, -1, -1):
        r, p = rows[n], up[n]
        if p >= 0:
            r["exit"], r["first"] = rows[p]["exit"], free[p]
            free[p] += below[n]
        else:
            r["exit"], r["first"] = (r["next"] if r["next"] >= end else -1), roots
            roots += below[n]
        r["last"], free[n] = r["first"] + below[n] - 1, r["first"] + 1


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, rows, at = None, [], 0

    def flush() -> pa.RecordBatch:
        _follow(rows, at)
        return pa.RecordBatch.from_pylist([r | {"file": now[0], "range": now[1]} for r in rows], schema=CANDIDATE)

    for batch in batches:
        for file, start, value in zip(*(batch.column(c) for c in ("file", "range", "value")), strict=True):
            key = (file.as_py(), start.as_py())
            if key != now:
                if rows:
                    yield flush()
                now, rows, at = key, [], 0
            data = value.as_py()
            if key[1] == 0 and not rows:  # what stands before the first magic of the file
                rows.append({"at": 0, "size": len(data) + len(MAGIC), "next": -1, "starts": False})
            else:
                rows.append(_parse(data, at))
            at += len(data) + len(MAGIC)
    if rows:
        yield flush()


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, record_type, refers_to, uri, payload_bytes, payload_digest, file and offset of every record."""
    found = tables.stored(_lines(spark, folder).mapInArrow(_candidates, CANDIDATE_ROW), "warc-candidates")
    before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = found.groupBy("file", "range").agg(F.sum("size").alias("bytes"))
    ranges = ranges.select("file", "range", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    placed = found.join(ranges, ["file", "range"])
    real = lambda c: F.when(F.col(c) >= 0, F.col("base") + F.col(c))
    placed = placed.withColumns({"node": F.col("base") + F.col("at"), "next": real("next"), "exit": real("exit")})
    placed = tables.stored(placed, "warc-placed")
    entries = _reached(placed).select("file", "range", F.col("first").alias("entry"))
    records = placed.where("starts").join(entries, ["file", "range"]).where("entry BETWEEN first AND last")
    records = tables.stored(records.drop("entry"), "warc-records")
    torn = records.where("record_type <> 'revisit' AND payload_digest IS NULL AND body_end IS NOT NULL")
    if torn.limit(1).count():
        mended = _mended(spark, folder, placed, torn)
        records = records.join(mended, ["file", "node"], "left").withColumn("payload_digest", F.coalesce("payload_digest", "mended"))
    offset = F.col("node") - len(MAGIC)
    return records.select("page_id", "record_type", "refers_to", "uri", "payload_bytes", "payload_digest", "file", offset.alias("offset"))


def _reached(placed: DataFrame) -> DataFrame:
    """The candidate by which the chain of its file's records enters a range, for every range it enters."""
    roots = placed.where((F.col("node") == len(MAGIC)) & F.col("starts")).select("file", "node")
    targets = placed.where("exit IS NOT NULL").select("file", F.col("exit").alias("node")).distinct()
    nodes = placed.where("starts").select("file", "range", "node", "exit", "first")
    jumps = tables.stored(nodes.join(roots.unionByName(targets).distinct(), ["file", "node"], "left_semi"), "warc-jumps")
    step, reached = jumps.select("file", "node", "exit"), tables.stored(roots, "warc-reached")
    size = reached.count()
    while size:
        onward = reached.join(step, ["file", "node"]).select("file", F.col("exit").alias("node"))
        onward = onward.join(jumps.select("file", "node"), ["file", "node"], "left_semi")
        reached = tables.stored(reached.unionByName(onward).distinct(), "warc-reached")
        grown = reached.count()
        if grown == size:
            break
        size = grown
        hop = step.select("file", F.col("node").alias("exit"), F.col("exit").alias("_to"))
        step = step.join(hop, ["file", "exit"]).select("file", "node", F.col("_to").alias("exit"))
        step = tables.stored(step, "warc-steps")
    return jumps.join(reached, ["file", "node"], "left_semi")


def _mended(spark: SparkSession, folder: str, placed: DataFrame, torn: DataFrame) -> DataFrame:
    """file, node and digest of records whose payload holds the magic: its pieces, read again and joined."""
    torn = torn.select("file", "node", "body_at", "body_end")
    own = torn.select("file", "node", F.struct("node", "body_at", "body_end").alias("record"))
    in_file = Window.partitionBy("file").orderBy("node").rowsBetween(Window.unboundedPreceding, 0)
    pieces = placed.join(own, ["file", "node"], "left").withColumn("record", F.last("record", True).over(in_file))
    pieces = pieces.where(F.col("node") - len(MAGIC) < F.col("record.node") + F.col("record.body_end")).select("file", "range", "at", "node", "record")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = None, 0
        for batch in batches:
            places = []
            for file, start, value in zip(batch.column("file").to_pylist(), batch.column("range").to_pylist(), batch.column("value"), strict=True):
                if (file, start) != now:
                    now, at = (file, start), 0
                places.append(at)
                at += len(value.as_buffer()) + len(MAGIC)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], [*batch.schema.names, "at"])

    lines = _lines(spark, folder).mapInArrow(numbered, "file string, range long, value binary, at long")
    parts = lines.join(small_side(pieces), ["file", "range", "at"]).groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("node", "value"))).alias("parts"))
    magic = F.lit(MAGIC).cast("binary")
    joined = F.aggregate(F.slice(F.col("parts"), 2, F.greatest(F.size("parts") - 1, F.lit(0))), F.get("parts", F.lit(0))["value"], lambda a, x: F.concat(a, magic, x["value"]))
    body = F.substring(joined, (F.col("record.body_at") + 1).cast("int"), (F.col("record.body_end") - F.col("record.body_at")).cast("int"))
    return parts.select("file", F.col("record.node").alias("node"), F.sha2(body, 256).alias("mended"))


def archive_digests(pages: DataFrame) -> DataFrame:
    """Write all pages to fresh archives, read them back; one row per record."""
    spark = pages.sparkSession
    folder = run_folder(spark, "warc")
    write_archives(pages, folder)
    return read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ARCHIVE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM f
"""
