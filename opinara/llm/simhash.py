"""Near-duplicate documents by 64-bit SimHash, found with a grid join on counts of set bits.

A fingerprint is cut into segments, and the counts of set bits of its segments are a point in a small
space. Flipping one bit moves the point by one step, so the Manhattan distance of two points is at
most the Hamming distance of their fingerprints: a lower bound. Points lie in a grid of cells two
steps wide; a fingerprint is sent to its own cell and to every later cell that holds points within
``distance`` steps of it, and in each cell the visitors are held exactly against the points that live there.

Only distinct fingerprints take part, so a group of exact copies is one point. A cell with many points
is split into blocks of some thousand of them, each of which all visitors of the cell come to. A
task keeps one block, joins the points that a visitor links and reports a spanning tree of what it
found instead of all pairs, so groups of near copies stay linear in the output and lose no link.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.llm import tables
from opinara.llm.components import components

WORDS = 4
DISTANCE = 4
SEGMENTS = 6
SEED = 42
BLOCK = 4096  # points of one cell that a task holds at once
VISITORS = 512  # held against a block in one step
BASE = 2 ** 6  # cells per segment that a cell's number leaves room for


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, text_key (a hash of the text) and fingerprint (64 bits as a long) of every document.

    A null text is empty; texts without words have fingerprint zero.
    """

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh64_intdigest
        for batch in batches:
            out = np.zeros(batch.num_rows, np.uint64)
            for row, value in enumerate(batch.column("text")):
                tokens = value.as_buffer().to_pybytes().lower().split()
                if not tokens:
                    continue
                text = b" ".join(tokens)
                ends = list(itertools.accumulate(map(len, tokens)))
                last = max(len(tokens) - words, 0)
                starts = [0, *(e + k + 1 for k, e in enumerate(ends[:last]))]
                stops = [e + k for k, e in enumerate(ends)][min(words, len(tokens)) - 1 :]
                hashes = np.fromiter((digest(text[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, last + 1)
                set_bits = np.zeros(64, np.int64)
                for k in range(0, len(hashes), 1 << 16):
                    part = hashes[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
                    set_bits += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
                out[row] = np.packbits(2 * set_bits > len(hashes)).view(">u8")[0]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(out.view(np.int64))], ["doc_id", "text_key", "fingerprint"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(tables.text_of()).alias("text_key"), tables.text_of().alias("text"))
    return narrow.mapInArrow(tables.released(prints), "doc_id long, text_key long, fingerprint long")


def segment_masks(segments: int) -> list[int]:
    """Masks, as signed longs, of segments whose widths differ by one bit at most."""
    edges = [64 * k // segments for k in range(segments + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(edges)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _counts(point: Column, segments: int) -> list[Column]:
    return [F.bit_count(point.bitwiseAND(F.lit(m))) for m in segment_masks(segments)]


def cell_of(point: Column, segments: int) -> Column:
    out = F.lit(0).cast("long")
    for count in _counts(point, segments):
        out = out * BASE + F.shiftright(count, 1) + BASE // 4
    return out


def later_cells(distance: int, segments: int) -> list[list[int]]:
    """For each pattern of odd counts, what to add to a cell's number to get the cells in reach that
    are not earlier ones, its own included.

    From an even count the cell before is one step away, the cell behind two, and so on by turns; from
    an odd count it is the other way round.
    """
    moves = [0]
    for k in range(distance):
        moves.append((1 + k // 2) * (-1 if k % 2 == 0 else 1))

    def walk(left: int, segment: int) -> Iterator[tuple[int, ...]]:
        if segment == segments:
            yield ()
            return
        for cost in range(left + 1):
            for rest in walk(left - cost, segment + 1):
                yield (moves[cost], *rest)

    paths = list(walk(distance, 0))
    out = []
    for pattern in range(1 << segments):
        signs = [-1 if pattern >> (segments - 1 - k) & 1 else 1 for k in range(segments)]
        steps = {sum(s * d * BASE ** (segments - 1 - k) for k, (s, d) in enumerate(zip(signs, path, strict=True))) for path in paths}
        out.append(sorted(x for x in steps if x >= 0))
    return out


def links(points: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """Pairs (a, b) of distinct ``fingerprint`` values that connect just what pairs within the distance do."""
    own = F.col("fingerprint")
    odd = F.lit(0)
    for count in _counts(own, segments):
        odd = odd * 2 + (count % 2)
    homes = points.select(own, cell_of(own, segments).alias("cell"))
    # At most one row per cell of the grid: 6 ** 6 for six segments of eleven bits at most.
    blocks = homes.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    blocks = F.broadcast(blocks) if segments <= SEGMENTS else blocks
    reach = F.array(*[F.array(*[F.lit(x) for x in steps]) for steps in later_cells(distance, segments)])
    visitors = points.select(own, cell_of(own, segments).alias("_own"), F.explode(F.element_at(reach, (odd + 1).cast("int"))).alias("_step"))
    visitors = visitors.select("fingerprint", (F.col("_own") + F.col("_step")).alias("cell")).join(blocks, "cell")
    visitors = visitors.select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("visits"), "fingerprint")
    homes = homes.join(blocks, "cell").select("cell", F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("visits"), "fingerprint")
    dealt = homes.unionByName(visitors).repartition("cell", "block").sortWithinPartitions("cell", "block", "visits")
    return dealt.mapInArrow(tables.released(_linked(distance)), "a long, b long")


def _linked(distance: int):
    class Block:
        """The points of a block and which of them are known to be joined."""

        def __init__(self) -> None:
            self.points = np.zeros(0, np.uint64)
            self.label = np.zeros(0, np.int64)

        def add(self, points: np.ndarray) -> None:
            self.points = np.append(self.points, points)
            self.label = np.arange(len(self.points))

        def visit(self, visitors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Join what the visitors link; each visitor with a link and one point that it is linked to."""
            row, at = np.nonzero(np.bitwise_count(visitors[:, None] ^ self.points[None, :]) <= distance)
            first = np.flatnonzero(np.diff(row, prepend=-1))
            anchor = np.repeat(at[first], np.diff(np.append(first, len(row))))
            while True:
                a, b = self.label[at], self.label[anchor]
                differ = a != b
                if not differ.any():
                    break
                low, high = np.minimum(a, b)[differ], np.maximum(a, b)[differ]
                parent = np.arange(len(self.label))
                np.minimum.at(parent, high, low)
                while (parent[parent] != parent).any():
                    parent = parent[parent]
                self.label = parent[self.label]
            found, point = visitors[row[first]], self.points[at[first]]
            return found[found != point], point[found != point]

        def tree(self) -> tuple[np.ndarray, np.ndarray]:
            joined = np.flatnonzero(self.label != np.arange(len(self.label)))
            return self.points[joined], self.points[self.label[joined]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])

        now, block = None, Block()
        left, right = [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            cells, numbers, visits = (batch.column(c).to_numpy() for c in ("cell", "block", "visits"))
            points = batch.column("fingerprint").to_numpy().view(np.uint64)
            edges = np.flatnonzero((np.diff(cells, prepend=cells[0] - 1) != 0) | (np.diff(numbers, prepend=0) != 0) | (np.diff(visits, prepend=0) != 0))
            for start, stop in zip(edges, [*edges[1:], len(cells)], strict=True):
                key = (cells[start], numbers[start])
                if key != now:
                    a, b = block.tree()
                    left.append(a)
                    right.append(b)
                    now, block = key, Block()
                if not visits[start]:
                    block.add(points[start:stop])
                    continue
                for k in range(start, stop, VISITORS):
                    a, b = block.visit(points[k : min(k + VISITORS, stop)])
                    left.append(a)
                    right.append(b)
            if left:
                yield out(left, right)
                left, right = [], []
        a, b = block.tree()
        yield out([a], [b])

    return run


def classes(docs: DataFrame, distance: int = DISTANCE, words: int = WORDS, segments: int = SEGMENTS) -> DataFrame:
    """doc_id, text_key, fingerprint and root (longs) and component_id of every document: the smallest doc_id that links
    reach, its own included.

    A null text is empty, and texts without words share the fingerprint zero, which links like any
    other. Rows without an id get a component and don't name it, unless it has no other rows: then
    component_id is null. Repeated ids stay repeated rows. An empty table gives no rows.
    """
    if segments > 10:
        raise ValueError("a cell's number holds ten segments")
    own = tables.stored(fingerprints(docs, words), "fingerprints")
    points = tables.stored(own.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "points")
    roots = tables.stored(components(links(points.select("fingerprint"), distance, segments)).withColumnRenamed("v", "fingerprint"), "roots")
    rooted = points.join(roots, "fingerprint", "left").select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fingerprint", "root", "component_id")
    return own.join(named, "fingerprint").select("doc_id", "text_key", "fingerprint", "root", "component_id")


def first_of_each(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One document of each component, that with the smallest doc_id, with the columns it has.

    Of rows with that id and different texts the one with the smallest text_key stays, of rows equal
    in both any one. A component without ids keeps one row by the same rule.
    """
    return least_rows(docs, classes(docs, distance))


def least_rows(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The row that ``first_of_each`` keeps of each root, from doc_id, text_key and root of all rows."""
    order = F.struct(F.col("doc_id").isNull().alias("_blank"), F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("text_key").alias("_key"))
    chosen = found.groupBy("root").agg(F.min(order).alias("least")).select("least.*")
    keys = ["_blank", "_id", "_key"]
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    own_id = F.col("doc_id").cast("long")
    keyed = docs.select(own_id.isNull().alias("_blank"), F.coalesce(own_id, F.lit(0)).alias("_id"), F.xxhash64(tables.text_of()).alias("_key"), whole.alias("_row"))
    kept = keyed.join(chosen, keys, "left_semi").groupBy(*keys).agg(F.first("_row").alias("_row"))
    return kept.select("_row.*")
