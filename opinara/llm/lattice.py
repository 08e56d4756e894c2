"""Near-duplicate vectors by lattice hashing: random projections decoded to points of the E8 lattice.

Vectors of length one are projected to eight dimensions, once for each table, and decoded to the nearest
point of E8; vectors with the same point share a cell. A vector lives in its own cell and visits those of
the ``PROBES`` neighbouring points (E8 has 240) that are next nearest to its projection. In each cell
residents are held against each other and against the visitors by their exact cosine.

A pair may meet in several cells. A row carries its cells of all tables, so a pair is counted in the
first of all places at which it meets. A task reports sums of links and a spanning forest of what it
found, never pairs, so a group of near copies costs comparisons but no more rows than it has vectors and
visits. Equal vectors take part once, with their number. A cell of many residents is cut into blocks of
some ``BLOCK`` of them, which all visitors and the residents of earlier blocks come to.

With the defaults two vectors at a cosine of just 0.9 meet with a probability of 0.95, at 0.95 of 0.997,
and unrelated ones share a given cell with 0.0017. Smaller cells (a smaller ``scale``) compare fewer
unrelated vectors and need more tables for the same recall.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinara.llm import tables
from opinara.llm.components import components
from opinara.operators.ranking import small_side

COSINE = 0.9
TABLES = 6
PROBES = 2
SCALE = 1.75
BLOCK = 2048  # residents a task holds at once
VISITORS = 256  # held against them in one step


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            row = [0.0] * 8
            row[i], row[j] = a, b
            out.append(row)
    out += [list(half) for half in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in half) % 2 == 0]
    return np.array(out)


ROOTS = _roots()
_MIX = np.random.default_rng(8).integers(0, 1 << 62, 8, np.int64) * 2 + 1


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest whole vectors with an even sum."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    rest = x[odd] - near[odd]
    worst = np.abs(rest).argmax(axis=1)
    near[odd, worst] += np.where(rest[np.arange(len(odd)), worst] >= 0, 1, -1)
    return near


def nearest_points(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8: whole vectors with an even sum, or those moved by a half."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1))[:, None], whole, half)


def _number(points: np.ndarray, table: int) -> np.ndarray:
    """A cell's number in 32 bits; cells that share one are one cell."""
    with np.errstate(over="ignore"):
        sums = ((2 * points).astype(np.int64) * _MIX).sum(axis=-1) + np.int64(table + 1) * _MIX[0]
        mixed = (sums ^ (sums >> 29)) * _MIX[1]
    return (mixed >> 32).astype(np.int32)


def cells(units: np.ndarray, tables_: int = TABLES, probes: int = PROBES, scale: float = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Own cells (vectors x tables) and visited ones (vectors x tables x probes) of vectors of length one."""
    projections = np.random.default_rng([13, units.shape[1]]).normal(size=(tables_, units.shape[1], 8)) / scale
    own, visited = [], []
    for table in range(tables_):
        x = units @ projections[table]
        points = nearest_points(x)
        toward = (x - points) @ ROOTS.T  # the larger, the nearer is the neighbour
        near = np.argsort(-toward, axis=1, kind="stable")[:, :probes]
        own.append(_number(points, table))
        to = _number(points[:, None, :] + ROOTS[near], table)
        for k in range(1, probes):  # neighbours that share a number are visited once
            again = (to[:, :k] == to[:, k : k + 1]).any(axis=1)
            to[again, k] = own[-1][again]
        visited.append(to)
    return np.stack(own, axis=1), np.stack(visited, axis=1)


def _units(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # so that no square overflows
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _placed(tables_: int, probes: int, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column("width").to_numpy()
            for width in np.unique(widths).tolist():
                part = batch.filter(pa.array(widths == width))
                own, visited = cells(_units(_matrix(part.column("vector"), width)), tables_, probes, scale)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x[0].size), pa.array(x.ravel())) for x in (own, visited)]
                yield pa.RecordBatch.from_arrays([*part.columns, *lists], [*part.schema.names, "own", "visited"])

    return run


class Rows(NamedTuple):
    point: np.ndarray
    size: np.ndarray
    unit: np.ndarray
    own: np.ndarray
    visited: np.ndarray

    @staticmethod
    def of(batch: pa.RecordBatch, width: int, tables_: int, probes: int) -> Rows:
        return Rows(
            batch.column("point").to_numpy(),
            batch.column("size").to_numpy(),
            _units(_matrix(batch.column("vector"), width)),
            _matrix(batch.column("own"), tables_),
            _matrix(batch.column("visited"), tables_ * probes).reshape(-1, tables_, probes),
        )

    def take(self, at: np.ndarray | slice) -> Rows:
        return Rows(*(x[at] for x in self))


def _meet(a: Rows, b: Rows, table: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether pairs share their own cell in a table, the first visits that of the second, and the other way round."""
    own_a, own_b = a.own[:, table], b.own[:, table]
    return own_a == own_b, (a.visited[:, table] == own_b[:, None]).any(axis=1), (b.visited[:, table] == own_a[:, None]).any(axis=1)


class Block:
    """Residents of a block, what they are known to link, and which of them are joined."""

    def __init__(self, table: int, least: float) -> None:
        self.table, self.least = table, least
        self.parts: list[Rows] = []
        self.rows: Rows | None = None

    def add(self, rows: Rows) -> None:
        self.parts.append(rows)

    def settle(self) -> None:
        """All residents are there: hold them against each other, once."""
        if self.rows is not None or not self.parts:
            return
        self.rows = Rows(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))
        self.links = np.zeros(len(self.rows.point), np.int64)
        self.label = np.arange(len(self.rows.point))
        for k in range(0, len(self.rows.point), VISITORS):
            some = self.rows.take(slice(k, k + VISITORS))
            first, second = self._pairs(some, residents=True, before=k)
            self.links[k : k + VISITORS] += self._count(some, first, second)
            self._join(first + k, second)

    def _pairs(self, some: Rows, residents: bool, before: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a visitor and a resident (by place) that link and meet here first."""
        if before is None:
            stop = len(self.rows.point)
        else:
            stop = min(before + len(some.point), len(self.rows.point))
        close = some.unit @ self.rows.unit[:stop].T >= self.least
        if before is not None:  # each pair once: a later resident with an earlier one
            close &= np.arange(stop)[None, :] < np.arange(before, before + len(some.point))[:, None]
        first, second = np.nonzero(close)
        if not len(first):
            return first, second
        a, b = some.take(first), self.rows.take(second)
        here = a.point != b.point
        if not residents:
            together, _, back = _meet(a, b, self.table)
            here &= ~together & (~back | (a.point < b.point))
        for table in range(self.table):
            here &= ~np.logical_or.reduce(_meet(a, b, table))
        return first[here], second[here]

    def _count(self, some: Rows, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Add the visitors to the residents' links; the visitors' own links."""
        out = np.zeros(len(some.point), np.int64)
        np.add.at(out, first, self.rows.size[second])
        np.add.at(self.links, second, some.size[first])
        return out

    def _join(self, first: np.ndarray, second: np.ndarray) -> None:
        """Join residents in pairs, by places."""
        while True:
            a, b = self.label[first], self.label[second]
            differ = a != b
            if not differ.any():
                return
            parent = np.arange(len(self.label))
            np.minimum.at(parent, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
            while (parent[parent] != parent).any():
                parent = parent[parent]
            self.label = parent[self.label]

    def visit(self, some: Rows, residents: bool) -> list[tuple]:
        """Count the links of visitors; (point, linked point or none, links) of each that has any."""
        self.settle()
        if self.rows is None:
            return []
        first, second = self._pairs(some, residents)
        if not len(first):
            return []
        out = self._count(some, first, second)
        heads = np.flatnonzero(np.diff(first, prepend=-1))
        anchor = np.repeat(second[heads], np.diff(np.append(heads, len(first))))
        self._join(second, anchor)
        rows = first[heads]
        return [(some.point[rows], self.rows.point[second[heads]], out[rows])]

    def report(self) -> list[tuple]:
        self.settle()
        if self.rows is None:
            return []
        rows = np.flatnonzero((self.links > 0) | (self.label != np.arange(len(self.label))))
        return [(self.rows.point[rows], self.rows.point[self.label[rows]], self.links[rows])]


def _linked(tables_: int, probes: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in found])) for k in range(3)], ["a", "b", "links"])

        now, block, found = None, None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([batch.column(c).to_numpy().astype(np.int64) for c in ("width", "table", "cell", "block", "visits")])
            edges = np.append(0, np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1)
            for start, stop in zip(edges.tolist(), [*edges[1:].tolist(), batch.num_rows], strict=True):
                key, kind = tuple(keys[start, :4].tolist()), int(keys[start, 4])
                if key != now:
                    found += block.report() if block else []
                    now, block = key, Block(key[1], least)
                rows = Rows.of(batch.slice(start, stop - start), key[0], tables_, probes)
                if kind == 0:
                    block.add(rows)
                    continue
                for k in range(0, len(rows.point), VISITORS):
                    found += block.visit(rows.take(slice(k, k + VISITORS)), kind == 1)
            if found:
                yield out(found)
                found = []
        if block and (found := block.report()):
            yield out(found)

    return run


def links(points: DataFrame, least: float = COSINE, tables_: int = TABLES, probes: int = PROBES, scale: float = SCALE) -> DataFrame:
    """a, b, links: sums of links of point ``a`` to be added up; pairs (a, b) join all that pairs of links join.

    ``points`` have point, size, width and vector.
    """
    vector = points.schema["vector"].dataType.simpleString()
    placed = points.select("point", "size", "width", "vector").mapInArrow(_placed(tables_, probes, scale), f"point long, size long, width int, vector {vector}, own array<int>, visited array<int>")
    placed = tables.stored(placed, "lattice-cells")
    carried = ["width", "point", "size", "vector", "own", "visited"]
    homes = placed.select(*carried, F.posexplode("own").alias("table", "cell"))
    # Cells of more residents than a block holds: at most tables / BLOCK of the rows.
    crowded = homes.groupBy("width", "table", "cell").agg(F.count(F.lit(1)).alias("residents")).where(F.col("residents") > BLOCK)
    crowded = small_side(crowded.select("width", "table", "cell", F.ceil(F.col("residents") / BLOCK).cast("int").alias("blocks")))
    key = ["width", "table", "cell"]
    homes = homes.join(crowded, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    block = F.pmod(F.xxhash64("point"), F.col("blocks")).cast("int")
    homes = homes.withColumn("block", block)
    later = homes.where("block + 1 < blocks").withColumn("block", F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1)))
    visits = placed.select(*carried, F.posexplode("visited").alias("place", "cell")).withColumn("table", F.floor(F.col("place") / probes).cast("int"))
    visits = visits.join(crowded, key, "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    columns = [*carried, "table", "cell", "block"]
    dealt = homes.select(*columns, F.lit(0).alias("visits")).unionByName(later.select(*columns, F.lit(1).alias("visits"))).unionByName(visits.select(*columns, F.lit(2).alias("visits")))
    dealt = dealt.repartition(*key, "block").sortWithinPartitions(*key, "block", "visits")
    return dealt.mapInArrow(tables.released(_linked(tables_, probes, least)), "a long, b long, links long")


def _usable(vector: Column) -> Column:
    """The vector has numbers only, not all of them zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # not-a-number is above infinity
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def classes(
    vectors: DataFrame, least: float = COSINE, vec_id: str = "vec_id", embedding: str = "embedding", tables_: int = TABLES, probes: int = PROBES, scale: float = SCALE
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector.

    ``n_links`` counts the other vectors found at a cosine of ``least`` or more, equal ones among them;
    ``component_id`` is the smallest id that links reach, its own included, and ``kept`` says that it is its
    own. Null vectors, those of zeros and those with a null or a number that is not finite link with nothing,
    nor do vectors of different lengths link. Rows without an id link like others and don't name a component,
    whose id is null if it has no others; these are kept. Repeated rows are vectors like others. Other columns
    are not looked at. An empty table gives no rows.
    """
    if not 0 < least <= 1:
        raise ValueError("a cosine above 0")
    element = vectors.schema[embedding].dataType.elementType
    kind = element if isinstance(element, (T.FloatType, T.DoubleType)) else T.DoubleType()
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(T.ArrayType(kind)).alias("vector"))
    rows = rows.withColumn("usable", _usable(F.col("vector")))
    key = [F.xxhash64("vector").alias("key"), F.xxhash64(F.lit(13), "vector").alias("key2")]
    good = rows.where("usable")
    points = good.groupBy(*key).agg(F.first("vector").alias("vector"), F.count(F.lit(1)).alias("size"), F.min("vec_id").alias("first"))
    points = tables.stored(points.select("key", "key2", F.monotonically_increasing_id().alias("point"), "size", "first", F.size("vector").alias("width"), "vector"), "lattice-points")
    found = tables.stored(links(points, least, tables_, probes, scale), "lattice-links")
    roots = tables.stored(components(found.select("a", "b")).withColumnRenamed("v", "point"), "lattice-roots")
    counts = found.groupBy(F.col("a").alias("point")).agg(F.sum("links").alias("links"))
    rooted = points.drop("vector", "width").join(roots, "point", "left").withColumn("root", F.coalesce("root", "point"))
    least_ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least_ids, "root").join(counts, "point", "left")
    named = named.select("key", "key2", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    linked = good.select("vec_id", *key).join(named, ["key", "key2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
