"""Pack documents into sequences of at most ``size`` tokens: best fit, then local search by swaps.

A document's ids end with ``end_id``; only longer ones than a sequence are cut, into whole sequences
behind a first piece that takes the rest. Whole pieces fill a sequence each. The others are dealt at
random into groups of about GROUP pieces, and each group is packed by one task: best fit, longest
first, then moves between the bins that are not full. Documents move out of the emptiest bins, alone
or in exchange for a shorter one, one or two at a time, as long as that raises the sum of squared
fills; it ends when no bin can be saved or no move is left. A group wastes less than one bin, so
dealing costs next to nothing.

Null texts count as empty and are the end id alone; null and repeated ids are documents of their own.
An empty table gives no rows.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm import tables
from opinara.llm.encoding import encoder

SIZE = 2048
END_ID = 0
GROUP = 20_000  # pieces that one task packs


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian unsigned 32-bit) of every piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in batches:
            for first, ids, counts in own.texts(batch.column("text")):
                ids = np.insert(ids, np.cumsum(counts), end_id)
                counts = counts + 1
                per_doc = -(-counts // size)
                doc = np.repeat(np.arange(len(counts)), per_doc)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
                rest = (counts - (per_doc - 1) * size)[doc]
                start = np.where(piece > 0, rest + (piece - 1) * size, 0)
                length = np.where(piece > 0, size, rest)
                edges = np.append(0, np.cumsum(length) * 4)
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(edges), pa.py_buffer(ids.astype("<u4").tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(doc + first)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), packed.cast(pa.binary())],
                    ["doc_id", "piece", "start", "length", "ids"],
                )
        own.rest()

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tables.text_of().alias("text"))
    return narrow.mapInArrow(tables.released(cut), "doc_id long, piece int, start long, length long, ids binary")


def best_fit(lengths: Sequence[int], size: int) -> list[list[int]]:
    """Bins of places in ``lengths``: longest first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    by_gap: dict[int, list[int]] = {}
    gaps: list[int] = []  # ascending, those that some bin has
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        at = bisect.bisect_left(gaps, lengths[k])
        if at == len(gaps):
            gap, b = size, len(bins)
            bins.append([])
        else:
            gap = gaps[at]
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                del by_gap[gap], gaps[at]
        bins[b].append(k)
        if gap := gap - lengths[k]:
            if gap not in by_gap:
                by_gap[gap] = []
                bisect.insort(gaps, gap)
            by_gap[gap].append(b)
    return bins


def improve(bins: list[list[int]], lengths: Sequence[int], size: int) -> list[list[int]]:
    """Swap documents between bins that are not full until none can be emptied; drop the empty ones.

    One step takes the best move out of a bin, the donor: one or two of its documents go to another
    bin, against nothing or one shorter document, such that they fit and squared fills gain. Each
    round offers all bins, emptier ones first, and a donor moves as long as it can; a round without
    a move is the last, as is one that reaches the least number of bins there can be.
    """
    least = max(-(-sum(lengths) // size), sum(2 * x > size for x in lengths))
    full = [b for b in bins if sum(lengths[k] for k in b) == size]
    loose = [list(b) for b in bins if sum(lengths[k] for k in b) < size]
    if not loose or len(bins) == least:
        return bins
    fills = np.array([sum(lengths[k] for k in b) for b in loose], np.int64)
    docs = np.array([k for b in loose for k in b], np.int64)
    at = {k: n for n, k in enumerate(docs.tolist())}
    # What can come back for a donor's documents: each document of a loose bin, or nothing.
    back = np.append(np.array(lengths, np.int64)[docs], np.zeros(len(loose), np.int64))
    place = np.append(np.repeat(np.arange(len(loose)), [len(b) for b in loose]), np.arange(len(loose)))
    used, moved = len(bins), True
    while moved and used > least:
        moved = False
        for donor in np.argsort(fills, kind="stable").tolist():
            while loose[donor] and fills[donor] < size and (move := _best_move(loose[donor], lengths, fills, back, place, donor, size)):
                out, choice, gain = move
                moved = True
                target = int(place[choice])
                for k in out:
                    loose[donor].remove(k)
                    place[at[k]] = target
                if choice < len(docs):
                    returned = int(docs[choice])
                    loose[target].remove(returned)
                    loose[donor].append(returned)
                    place[choice] = donor
                loose[target].extend(out)
                fills[donor] -= gain
                fills[target] += gain
            used = len(full) + sum(map(bool, loose)) if not loose[donor] else used
            if used == least:
                break
    return full + [b for b in loose if b]


def _best_move(
    own: list[int], lengths: Sequence[int], fills: np.ndarray, back: np.ndarray, place: np.ndarray, donor: int, size: int
) -> tuple[list[int], int, int] | None:
    """The move out of the donor that shifts most tokens: its documents, what comes back, the shift."""
    offers: dict[int, list[int]] = {}
    for n, k in enumerate(own):
        offers.setdefault(lengths[k], [k])
        for other in own[n + 1 :]:
            offers.setdefault(lengths[k] + lengths[other], [k, other])
    sums = np.array(sorted(offers), np.int64)
    fill = fills[place]
    pick = np.searchsorted(sums, back + size - fill, "right") - 1
    shift = np.where(pick >= 0, sums[pick] - back, 0)
    shift[(shift <= 0) | (fill == 0) | (fill + shift <= fills[donor]) | (place == donor)] = 0
    best = int(np.argmax(shift))
    return (offers[int(sums[pick[best]])], best, int(shift[best])) if shift[best] else None


def pack(cut: DataFrame, size: int = SIZE, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to stored pieces with a ``length`` up to ``size``."""
    place = {"sequence_id": "long", "offset": "long"}
    if clash := [c for c in cut.columns if c in place]:
        raise ValueError(f"columns {clash} would be written over")
    whole = cut.where(F.col("length") == size)
    whole = whole.withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    small = cut.where(F.col("length") < size)
    groups, names = -(-small.count() // group) or 1, cut.columns
    dealt = small.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int").alias("_group"), F.struct(*cut.columns).alias("_row"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        number = rows["_group"][0].as_py()
        lengths = pc.struct_field(rows["_row"], "length").to_pylist()
        bins = improve(best_fit(lengths, size), lengths, size)
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for b, docs in enumerate(bins):
            at = 0
            for k in docs:
                sequence[k], offset[k] = (number << 32) + b, at
                at += lengths[k]
        flat = rows["_row"].combine_chunks()
        columns = [*(flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat).flatten(), pa.array(sequence), pa.array(offset)]
        yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])

    packed = dealt.repartitionById(groups, F.col("_group")).mapInArrow(tables.released(fill), whole.schema)
    return packed.unionByName(whole)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and ids: the pieces of every sequence joined in the order of their offsets, from packed rows with ids."""
    joined = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.aggregate(joined, F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of all documents; its ids if wanted."""
    columns = ["doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), *["ids"] * with_ids]
    return pack(tables.stored(pieces(docs, tokenizer, size, end_id).select(*columns), "pieces"), size)
