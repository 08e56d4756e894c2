"""Shards of nearly equal bytes that never part equal texts, as a minimax contiguous partition.

Equal texts are an atomic group; groups are ordered by a 64-bit hash of the text, and shards are
contiguous runs of groups (two texts with one hash stay together, which breaks nothing). The smallest
capacity that some such partition keeps to is found by binary search; a candidate is checked greedily.

The driver doesn't see all groups. It sees atoms: sums over ranges of the hash. Cutting only between
atoms gives a capacity that surely works, cutting anywhere inside them one that no partition can beat.
While the two differ, the atoms that a cut may fall into are split sixteenfold, until they agree. Some
thousand atoms are known at a time, whatever the number of documents.

Null texts count as empty texts. Null, equal and repeated ids are rows like any other. Empty shards
occur if there are fewer groups than shards; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara.llm import tables

SHARDS = 24
ROW_BYTES = 8
FIRST_BITS, MORE_BITS = 12, 4
SLOT_ROWS = 10_000  # rows that are numbered together
_LOWEST = -(1 << 63)


def key_of(text: Column) -> Column:
    return F.xxhash64(text)


def size_of(text: Column) -> Column:
    return F.octet_length(text).cast("long") + ROW_BYTES


def _prefix(bits: int) -> Column:
    return F.shiftrightunsigned(F.col("key").bitwiseXOR(F.lit(_LOWEST)), 64 - bits)


class Atoms:
    """Ascending ranges of the hash: first key, bits of the prefix, bytes, groups."""

    def __init__(self, atoms: list[tuple[int, int, int, int]], shards: int) -> None:
        self.atoms, self.shards = atoms, shards
        self.ends = list(itertools.accumulate((a[2] for a in atoms), initial=0))
        self.total = self.ends[-1]

    def jump(self, start: int, capacity: int, inside: bool) -> int:
        """The furthest end of a shard from here; inside: atoms of several groups can be cut anywhere."""
        goal = start + capacity
        k = bisect.bisect_right(self.ends, goal) - 1
        if inside and k < len(self.atoms) and self.atoms[k][3] > 1:
            return goal
        return max(start, self.ends[k])

    def cuts(self, capacity: int, inside: bool = False) -> list[int]:
        at, out = 0, []
        for _ in range(self.shards):
            at = self.jump(at, capacity, inside)
            out.append(at)
        return out

    def capacity(self, inside: bool) -> int:
        low, high = -(-self.total // self.shards), self.total
        while low < high:
            middle = (low + high) // 2
            if self.cuts(middle, inside)[-1] >= self.total:
                high = middle
            else:
                low = middle + 1
        return low

    def unsure(self, low: int, high: int) -> list[int]:
        """Atoms of several groups that a cut may fall into, or that are large by themselves."""
        found = {k for k, a in enumerate(self.atoms) if a[3] > 1 and 8 * self.shards * a[2] > self.total}
        for a, b in zip(self.cuts(low), self.cuts(high, True), strict=True):
            first, last = bisect.bisect_right(self.ends, a) - 1, bisect.bisect_left(self.ends, b)
            found.update(k for k in range(max(first, 0), min(last, len(self.atoms))) if self.atoms[k][3] > 1)
        return sorted(found)

    def even_cuts(self, capacity: int) -> list[int]:
        """First keys of all shards but the first: as near to equal parts as the capacity allows."""
        backward, at = [], self.total
        for _ in range(self.shards - 1):
            at = self.ends[bisect.bisect_left(self.ends, at - capacity)]
            backward.append(at)
        at, keys = 0, []
        for k, least in enumerate(reversed(backward), 1):
            goal = self.total * k // self.shards
            n = bisect.bisect_left(self.ends, goal)
            near = self.ends[n] if n == 0 or self.ends[n] - goal <= goal - self.ends[n - 1] else self.ends[n - 1]
            at = max(min(max(near, least), self.jump(at, capacity, False)), at)
            n = bisect.bisect_left(self.ends, at)
            keys.append(self.atoms[n][0] if n < len(self.atoms) else None)
        return keys


def cut_keys(groups: DataFrame, shards: int = SHARDS) -> list[int | None]:
    """The first key of every shard but the first, from one row (key, bytes) per group; None: no key."""

    def counted(found: DataFrame, bits: int) -> list[tuple[int, int, int, int]]:
        sums = found.groupBy(_prefix(bits).alias("p")).agg(F.min("key").alias("key"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
        return sorted((r.key, bits, r.bytes, r.n) for r in sums.collect())

    atoms = Atoms(counted(groups, FIRST_BITS), shards)
    while True:
        low, high = atoms.capacity(True), atoms.capacity(False)
        if low == high:
            return atoms.even_cuts(high)
        split = atoms.unsure(low, high)
        parts = []
        for bits in {atoms.atoms[k][1] for k in split}:
            prefixes = [((atoms.atoms[k][0] - _LOWEST) >> (64 - bits)) for k in split if atoms.atoms[k][1] == bits]
            parts += counted(groups.where(_prefix(bits).isin(prefixes)), bits + MORE_BITS)
        gone = set(split)
        atoms = Atoms(sorted([a for k, a in enumerate(atoms.atoms) if k not in gone] + parts), shards)


def shard_of(key: Column, cuts: Sequence[int | None]) -> Column:
    shard = F.lit(0)
    for cut in cuts:
        if cut is not None:
            shard = shard + (key >= F.lit(cut)).cast("int")
    return shard


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: only the law `key` has it)."""
    text = tables.text_of()
    rows = docs.select(
        "doc_id", size_of(text).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), key_of(text).alias("key"),
        F.monotonically_increasing_id().alias("lane"),
    )
    rows = tables.stored(rows, "shard-rows")
    groups = tables.stored(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "shard-groups")
    cuts = cut_keys(groups, shards)
    total = groups.agg(F.sum("n")).first()[0] or 0
    buckets = -(-total // (shards * SLOT_ROWS)) or 1
    placed = rows.select(
        "doc_id", "size", "text_crc32", shard_of(F.col("key"), cuts).alias("shard"), "lane", F.pmod(F.xxhash64("lane"), F.lit(buckets)).alias("bucket")
    )
    sums = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    in_bucket = Window.partitionBy("shard", "bucket").orderBy("lane")
    numbered = placed.withColumn("rank", F.row_number().over(in_bucket) - 1).join(starts, ["shard", "bucket"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("rank")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write the documents below ``path``, one folder per shard, with the columns they have."""
    text = tables.text_of()
    groups = tables.stored(docs.select(size_of(text).alias("size"), key_of(text).alias("key")).groupBy("key").agg(F.sum("size").alias("bytes")), "shard-groups")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document")
    docs.select(whole, shard_of(key_of(text), cut_keys(groups, shards)).alias("shard")).write.partitionBy("shard").parquet(path)
