"""Token ids in Huffman-coded files: one canonical, length-limited code for the whole table.

Texts are encoded to ids once and stored. Ids are counted over all documents, the counts give every
id a code of at most ``max_bits`` bits, documents are coded where they lie, and only their bits are
shuffled into ascending order. A file row (a segment) holds some whole documents: their ids, their
lengths, their bits, and the bit offset of every block. A block is at most BLOCK ids of one document
and is decoded without the ones before it, so that all blocks of a segment are decoded in step, each
by the same table of ``2 ** max_bits`` entries.

Null texts count as empty and have the end id alone. Rows without an id come first; equal ids keep
all their rows, in any order among themselves. An empty table gives no segments and no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.llm import tables
from opinara.llm.encoding import encoder
from opinara.session import run_folder

BLOCK = 512  # ids that are decoded one after the other
SEGMENT = 1 << 18  # ids of a row of a file, but for a single longer document
SHARD = 1 << 23  # ids of one task's file
MAX_SHARDS = 20_000  # files; beyond these, files get longer, so what is known of each fits in a driver
END_ID = 2
MAX_BITS = 16


def binaries(data: bytes | np.ndarray, edges: np.ndarray) -> pa.Array:
    """Neighbouring pieces of some bytes as binary values."""
    packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data)])
    return packed.cast(pa.binary())


def _flat(values: pa.Array) -> np.ndarray:
    """The bytes of all binary values, one after the other; there are no nulls."""
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(values.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]


def token_ids(docs: DataFrame, tokenizer: str, end_id: int | None = END_ID) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and tally of every document.

    The tally is null but in the last row of each task, which has how often each id occurs in all
    rows of the task, as little-endian 64-bit numbers.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        total, waiting = np.zeros(0, np.int64), None

        def out(doc_ids: pa.Array, counts: np.ndarray, ids: np.ndarray, last: bool) -> pa.RecordBatch:
            tally = [None] * (len(counts) - 1) + [total.astype("<i8").tobytes() if last else None]
            columns = [doc_ids, pa.array(counts, pa.int64()), binaries(ids.astype("<u4").tobytes(), np.append(0, np.cumsum(counts) * 4)), pa.array(tally, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "tally"])

        for batch in batches:
            for first, ids, counts in own.texts(batch.column("text")):
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(counts), end_id)
                    counts = counts + 1
                found = np.bincount(ids, minlength=len(total))
                found[: len(total)] += total
                total = found
                if waiting:
                    yield out(*waiting, False)
                waiting = (batch.column("doc_id").slice(first, len(counts)), counts, ids)
        if waiting:
            yield out(*waiting, True)
        own.rest()

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tables.text_of().alias("text"))
    return narrow.mapInArrow(tables.released(encode), "doc_id long, n_tokens long, ids binary, tally binary")


def id_counts(ids: DataFrame) -> dict[int, int]:
    """How often each id occurs in all rows; at most one entry per word of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for value in batch.column("tally"):
                own = np.frombuffer(value.as_buffer(), "<i8")
                total = np.append(total, np.zeros(max(len(own) - len(total), 0), np.int64))
                total[: len(own)] += own
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    summed = ids.select("tally").where("tally IS NOT NULL").mapInArrow(tables.released(count), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return {row.id: row.n for row in summed.collect()}


def code_lengths(counts: dict[int, int], max_bits: int = MAX_BITS) -> dict[int, int]:
    """Bits of each id by package-merge: the shortest code whose longest word has max_bits bits."""
    ids = sorted(counts, key=lambda k: (counts[k], k))
    if len(ids) < 2:
        return dict.fromkeys(ids, 1)
    if len(ids) > 1 << max_bits:
        raise ValueError(f"{len(ids)} ids need more than {max_bits} bits")
    leaves = np.array([counts[k] for k in ids], np.int64)
    packages, from_leaf = np.zeros(0, np.int64), []
    for _ in range(max_bits):
        both = np.concatenate([leaves, packages])
        order = np.argsort(both, kind="stable")
        from_leaf.append(order < len(leaves))
        both = both[order][: len(both) // 2 * 2]
        packages = both[::2] + both[1::2]
    lengths, take = np.zeros(len(ids), np.int64), 2 * len(ids) - 2
    for leaf in reversed(from_leaf):
        used = int(np.count_nonzero(leaf[:take]))
        lengths[:used] += 1
        take = 2 * (take - used)
    return dict(zip(ids, lengths.tolist(), strict=True))


class Code:
    """The canonical code of some lengths: shorter words first, among equals the smaller id first."""

    def __init__(self, lengths: dict[int, int], max_bits: int = MAX_BITS) -> None:
        self.max_bits = max_bits
        size = max(lengths, default=0) + 1
        self.words, self.bits = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.symbol, self.taken = np.zeros(1 << max_bits, np.uint32), np.ones(1 << max_bits, np.int64)
        at = 0
        for symbol, bits in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
            self.words[symbol], self.bits[symbol] = at >> (max_bits - bits), bits
            step = 1 << (max_bits - bits)
            self.symbol[at : at + step], self.taken[at : at + step] = symbol, bits
            at += step

    def encode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """The bits of some documents, each from a whole byte; the byte after each; the bit offset,
        within its document, of each block; blocks per document."""
        bits = self.bits[ids]
        ends = np.append(0, np.cumsum(bits))
        edges = np.append(0, np.cumsum(counts))
        sizes = (np.diff(ends[edges]) + 7) // 8
        bytes_to = np.append(0, np.cumsum(sizes))
        at = ends[:-1] + np.repeat(bytes_to[:-1] * 8 - ends[edges[:-1]], counts)
        word = at >> 5
        shifted = self.words[ids] << (64 - (at & 31) - bits).astype(np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out = np.zeros(int(bytes_to[-1]) // 4 + 3, np.uint64)
        out[word[first]] += np.add.reduceat(shifted >> np.uint64(32), first)
        out[word[first] + 1] += np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), first)
        per_doc = -(-counts // BLOCK)
        step = np.arange(per_doc.sum()) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
        starts = np.repeat(edges[:-1], per_doc) + step * BLOCK
        return out.astype(">u4").tobytes()[: int(bytes_to[-1])], bytes_to, ends[starts] - np.repeat(ends[edges[:-1]], per_doc), per_doc

    def decode(self, payload: bytes, offsets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Ids of all blocks, one after the other; offsets are their first bits, counts their ids."""
        data = np.frombuffer(payload + b"\0" * 8, np.uint8).astype(np.uint32)
        windows = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
        out = np.zeros(int(counts.sum()), np.uint32)
        order = np.argsort(-counts, kind="stable")
        at, place = offsets[order].astype(np.int64), (np.cumsum(counts) - counts)[order]
        active = np.searchsorted(-counts[order], -np.arange(1, int(counts.max(initial=0)) + 1), "right")
        down = 32 - self.max_bits
        for n in active.tolist():  # the longest blocks come first: in step k the first n have a k-th id
            here = at[:n]
            code = (windows[here >> 3] << (here & 7).astype(np.uint32)) >> np.uint32(down)
            out[place[:n]] = self.symbol[code]
            here += self.taken[code]
            place[:n] += 1
        return out


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = END_ID, max_bits: int = MAX_BITS) -> None:
    """Write the ids of all documents below ``folder`` in ascending doc_id order: code and segments."""
    if max_bits > 24:
        raise ValueError("a word of the code has 24 bits at most")
    spark = docs.sparkSession
    ids = tables.stored(token_ids(docs, tokenizer, end_id), "token-ids")
    counts = id_counts(ids)
    lengths = code_lengths(counts, max_bits)
    rows = [(k, bits, max_bits) for k, bits in sorted(lengths.items())]
    spark.createDataFrame(rows, "id long, bits int, max_bits int").coalesce(1).write.parquet(f"{folder}/code")
    shards = min(-(-sum(counts.values()) // SHARD) or 1, MAX_SHARDS)
    cut = tables.borders(ids, "doc_id", shards)
    code = spark.sparkContext.broadcast(lengths)

    def to_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = Code(code.value, max_bits), 0
        for batch in batches:
            doc_ids, sizes = batch.column("doc_id"), batch.column("n_tokens").to_numpy(zero_copy_only=False)
            shard = tables.pieces_of(doc_ids, cut, seen)
            upto = np.cumsum(sizes)
            first = 0
            while first < len(doc_ids):
                last = max(first + 1, int(np.searchsorted(upto, upto[first] - sizes[first] + SEGMENT, "right")))
                flat = _flat(batch.column("ids").slice(first, last - first)).view("<u4")
                payload, edges, offsets, per_doc = own.encode(flat, sizes[first:last])
                to = np.append(0, np.cumsum(per_doc))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard[first:last], pa.int32()),
                        doc_ids.slice(first, last - first),
                        pa.array(sizes[first:last], pa.int64()),
                        binaries(payload, edges),
                        binaries(offsets.astype("<i8").tobytes(), to * 8),
                    ],
                    ["shard", "doc_id", "n_tokens", "payload", "blocks"],
                )
                first = last
            seen += len(doc_ids)

    def to_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, place, held, size = -1, 0, [], 0

        def flush() -> pa.RecordBatch:
            at = np.cumsum([0] + [len(h[2]) for h in held[:-1]]) * 8
            blocks = [(np.frombuffer(h[3], "<i8") + a).astype("<i8").tobytes() for h, a in zip(held, at, strict=True)]
            values = [shard, place, size, [h[0] for h in held], [h[1] for h in held], b"".join(h[2] for h in held), b"".join(blocks)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, SEGMENTS, strict=True)], schema=SEGMENTS)

        for batch in batches:
            for own, *doc in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "n_tokens", "payload", "blocks")), strict=True):
                if held and (own != shard or size + doc[1] > SEGMENT):
                    yield flush()
                    held, size, place = [], 0, place + size
                if own != shard:
                    shard, place = own, 0
                held.append(doc)
                size += doc[1]
        if held:
            yield flush()

    bits = ids.drop("tally").mapInArrow(tables.released(to_bits), "shard int, doc_id long, n_tokens long, payload binary, blocks binary")
    dealt = bits.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "n_tokens", "payload")
    dealt.mapInArrow(tables.released(to_segments), SEGMENT_ROW).write.option("compression", "none").parquet(f"{folder}/segments")


SEGMENT_ROW = "shard int, place long, n_ids long, doc_ids array<long>, sizes array<long>, payload binary, blocks binary"
SEGMENTS = pa.schema([
    ("shard", pa.int32()), ("place", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
    ("sizes", pa.list_(pa.int64())), ("payload", pa.binary()), ("blocks", pa.binary()),
])


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids, as the files have them."""
    rows = spark.read.parquet(f"{folder}/code").collect()
    code = spark.sparkContext.broadcast({r.id: r.bits for r in rows})
    max_bits = rows[0].max_bits if rows else MAX_BITS
    segments = spark.read.schema(SEGMENT_ROW).parquet(f"{folder}/segments")
    totals = segments.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()  # MAX_SHARDS rows at most
    before, base = 0, {}
    for row in totals:
        base[row.shard] = before
        before += row.n

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Code(code.value, max_bits)
        for batch in batches:
            for row in range(batch.num_rows):
                shard, place, doc_ids, sizes, payload, blocks = (batch.column(c)[row].as_py() for c in ("shard", "place", "doc_ids", "sizes", "payload", "blocks"))
                counts = np.array(sizes, np.int64)
                per_doc = -(-counts // BLOCK)
                in_block = np.full(int(per_doc.sum()), BLOCK, np.int64)
                filled = per_doc > 0
                in_block[np.cumsum(per_doc)[filled] - 1] = counts[filled] - (per_doc[filled] - 1) * BLOCK
                ids = own.decode(payload, np.frombuffer(blocks, "<i8"), in_block)
                edges = np.append(0, np.cumsum(counts))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids, pa.int64()),
                        pa.array(edges[:-1] + base[shard] + place, pa.int64()),
                        pa.array(sizes, pa.int64()),
                        binaries(ids.astype("<u4").tobytes(), edges * 4),
                    ],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    return segments.drop("n_ids").mapInArrow(tables.released(decode), "doc_id long, start long, n_tokens long, ids binary")


def token_file_digests(docs: DataFrame, tokenizer: str, end_id: int | None = END_ID) -> DataFrame:
    """Write all documents to fresh files, read them back; doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    folder = run_folder(spark, "token-files")
    write_token_files(docs, folder, tokenizer, end_id)
    return read_token_files(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
