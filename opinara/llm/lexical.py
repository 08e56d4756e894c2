"""Ranked search of texts by words, on an index whose documents are grouped by equal normaliser.

A document's normaliser m depends on its length alone, so documents of about the same length form a
stratum. Within a stratum what a term adds to a score depends on its occurrences tf alone: postings are
ordered by term and tf, and the impact of a pair (term, tf) is computed once for all documents that
have it. The largest tf of each term bounds the score of any document in a stratum. For each item,
strata are visited by falling bounds, in waves that double, until no bound reaches the score of the
item's last place; the best strata of all are visited first, so that every task starts with a score to beat.

A stratum of many documents is cut into blocks of some ``BLOCK_DOCS`` by a hash, each with bounds of its
own. Items are read in parts of at most ``PART_TERMS`` different terms (one item at least); a part's terms
go to all tasks, and each part reads the documents once.

Scores are whole numbers and the results exact. A null text has no terms. An item without terms and
documents without any of its terms give no rows. Repeated documents are ranked each; so are null ids, behind
others of the same score. Repeated items each have their own ranks. Other columns are not looked at.
Without documents or items there are no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opinara.llm import tables

PLACES = 10
BLOCK_DOCS = 1024
PART_TERMS = 20_000
SCALE = 1_000_000_000
FIRST_BLOCKS = 4  # of each item, visited before all others
AT_ONCE = 256  # blocks whose bounds a task holds for all items of a part
PAIRS = 1 << 20  # scores in work at once

#: Bytes of terms, capital letters as small ones; all others as blanks.
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))

COUNTED = "doc_id long, n long, terms array<int>, tfs array<int>"
BLOCK = "m long, block long, docs array<long>, terms array<int>, tfs array<int>, ends array<int>, members array<int>"
FOUND = "item int, score long, doc_id long"


def words_of(text: pa.Scalar) -> list[bytes]:
    return text.as_buffer().to_pybytes().translate(_TERM).split() if text.is_valid else []


class Part(NamedTuple):
    """Some items: their ids, and the terms of all of them one after the other, as numbers of ``terms``."""

    ids: list[int | None]
    terms: dict[bytes, int]
    starts: np.ndarray
    wanted: np.ndarray


class Scorer(NamedTuple):
    starts: np.ndarray
    wanted: np.ndarray
    weights: np.ndarray  # by number of the term


def _parts(items: DataFrame) -> Iterator[Part]:
    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sorted(set(words_of(x))) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(own, pa.list_(pa.binary()))], ["item_id", "terms"])

    narrow = items.select(F.col("item_id").cast("long").alias("item_id"), tables.text_of().alias("text"))
    ids, terms, wanted, starts = [], {}, [], [0]
    for row in narrow.mapInArrow(distinct, "item_id long, terms array<binary>").toLocalIterator():
        new = sum(bytes(t) not in terms for t in row.terms)
        if ids and len(terms) + new > PART_TERMS:
            yield Part(ids, terms, np.array(starts), np.array(wanted, np.int64))
            ids, terms, wanted, starts = [], {}, [], [0]
        if row.terms:
            wanted += [terms.setdefault(bytes(t), len(terms)) for t in row.terms]
            ids.append(row.item_id)
            starts.append(len(wanted))
    if ids:
        yield Part(ids, terms, np.array(starts), np.array(wanted, np.int64))


def count_terms(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms of the text) and, for those of ``terms`` in it, their numbers and occurrences."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        size = max(len(number), 1)
        for batch in batches:
            total, held, own = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), []
            for row, text in enumerate(batch.column("text")):
                words = words_of(text)
                known = [number[w] for w in words if w in number]
                total[row], held[row] = len(words), len(known)
                own.append(np.array(known, np.int64))
            keys, times = np.unique(np.repeat(np.arange(batch.num_rows), held) * size + np.concatenate([*own, np.zeros(0, np.int64)]), return_counts=True)
            ends = np.append(0, np.cumsum(np.bincount(keys // size, minlength=batch.num_rows))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (keys % size, times)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total), *lists], ["doc_id", "n", "terms", "tfs"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tables.text_of().alias("text"))
    return narrow.mapInArrow(tables.released(run), COUNTED)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``BLOCK`` from counted documents that come ordered by m and block."""

    def block(m: int, number: int, rows: list[pa.RecordBatch]) -> tuple:
        sizes = np.concatenate([np.diff(r.column("terms").offsets.to_numpy()) for r in rows])
        terms, tfs = (np.concatenate([r.column(c).flatten().to_numpy() for r in rows]).astype(np.int64) for c in ("terms", "tfs"))
        member = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((member, -tfs, terms))
        terms, tfs, member = terms[order], tfs[order], member[order]
        ends = np.flatnonzero(np.append((np.diff(terms) != 0) | (np.diff(tfs) != 0), True)) + 1
        docs = pa.concat_arrays([r.column("doc_id") for r in rows])
        return m, number, docs, terms[ends - 1], tfs[ends - 1], ends, member

    def out(made: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*made, strict=True))
        arrays = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64())]
        for values, kind in zip(columns[2:], (pa.int64(), *[pa.int32()] * 4), strict=True):
            sizes = np.append(0, np.cumsum([len(v) for v in values])).astype(np.int32)
            arrays.append(pa.ListArray.from_arrays(pa.array(sizes), pa.concat_arrays([v if isinstance(v, pa.Array) else pa.array(v.astype(np.int32)) for v in values])))
        return pa.RecordBatch.from_arrays(arrays, ["m", "block", "docs", "terms", "tfs", "ends", "members"])

    now, waiting, made = None, [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        m, number = batch.column("m").to_numpy(), batch.column("block").to_numpy()
        edges = np.append(0, np.flatnonzero((np.diff(m) != 0) | (np.diff(number) != 0)) + 1)
        for start, stop in zip(edges.tolist(), [*edges[1:].tolist(), batch.num_rows], strict=True):
            key = (int(m[start]), int(number[start]))
            if key != now and waiting:
                made.append(block(*now, waiting))
                waiting = []
            now = key
            waiting.append(batch.slice(start, stop - start))
            if len(made) == AT_ONCE:
                yield out(made)
                made = []
    if waiting:
        made.append(block(*now, waiting))
    if made:
        yield out(made)


def _stratified(counted: DataFrame, documents: int, words: int) -> DataFrame:
    """The index: one row for each block of a stratum, from what ``count_terms`` gives."""
    # A row's number, not its content, so that repeated rows spread over blocks too.
    numbered = counted.withColumn("_row", F.monotonically_increasing_id())
    dealt = numbered.where("n > 0").withColumn("m", F.expr(f"10L + (90L * n * {documents}L) div {words}L")).where(F.size("terms") > 0)
    blocks = dealt.groupBy("m").agg(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS).alias("blocks"))
    dealt = dealt.join(blocks, "m").withColumn("block", F.pmod(F.xxhash64("_row"), F.col("blocks"))).drop("blocks", "_row")
    dealt = dealt.repartition("m", "block").sortWithinPartitions("m", "block")
    return tables.stored(dealt.mapInArrow(tables.released(_blocks), BLOCK), "lexical-index")


def impacts(weights: np.ndarray, tfs: np.ndarray, m: np.ndarray | int) -> np.ndarray:
    return weights * (SCALE * tfs // (1000 * tfs + 8 * m))


def _flat(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a list column."""
    lists = batch.column(column)
    offsets = lists.offsets.to_numpy()
    return offsets - offsets[0], lists.flatten().to_numpy().astype(np.int64)


def _bounds(batch: pa.RecordBatch, scorer: Scorer) -> np.ndarray:
    """For each block and item, a score no document of the block exceeds."""
    at, terms = _flat(batch, "terms")
    _, tfs = _flat(batch, "tfs")
    m = batch.column("m").to_numpy()
    out = np.zeros((batch.num_rows, len(scorer.starts) - 1), np.int64)
    largest = np.zeros(len(scorer.weights), np.int64)
    for k in range(batch.num_rows):
        own, best = terms[at[k] : at[k + 1]], tfs[at[k] : at[k + 1]]
        first = np.flatnonzero(np.diff(own, prepend=-1))  # of each term's tfs the largest comes first
        own = own[first]
        largest[own] = impacts(scorer.weights[own], best[first], int(m[k]))
        out[k] = np.add.reduceat(largest[scorer.wanted], scorer.starts[:-1])
        largest[own] = 0
    return out


class Best:
    """For each item the highest scores met so far, and the score to beat."""

    def __init__(self, floor: np.ndarray, places: int) -> None:
        self.floor, self.places = floor.copy(), places
        none = np.zeros(0, np.int64)
        self.item, self.score, self.blank, self.doc = none, none, none.astype(bool), none

    def add(self, item: np.ndarray, score: np.ndarray, blank: np.ndarray, doc: np.ndarray) -> None:
        self.item, self.score = np.append(self.item, item), np.append(self.score, score)
        self.blank, self.doc = np.append(self.blank, blank), np.append(self.doc, doc)
        order = np.lexsort((self.doc, self.blank, -self.score, self.item))
        item = self.item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        order = order[place < self.places]
        self.item, self.score, self.blank, self.doc = self.item[order], self.score[order], self.blank[order], self.doc[order]
        last = np.flatnonzero(place[place < self.places] == self.places - 1)
        self.floor[self.item[last]] = np.maximum(self.floor[self.item[last]], self.score[last])

    def rows(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.item.astype(np.int32)), pa.array(self.score), pa.array(self.doc, mask=self.blank)], ["item", "score", "doc_id"])


def _visit(batch: pa.RecordBatch, scorer: Scorer, best: Best) -> None:
    """Score the blocks for all items whose bounds allow it, by falling bounds."""
    bounds = _bounds(batch, scorer)
    order = np.argsort(-bounds, axis=0, kind="stable")
    first, size = 0, 1
    while first < len(order):
        wave = order[first : first + size]
        item = np.broadcast_to(np.arange(order.shape[1]), wave.shape)
        bound = bounds[wave, item]
        worth = (bound > 0) & (bound >= best.floor[item])
        if not worth.any():
            return
        blocks, items = wave[worth], item[worth]
        ranked = np.argsort(blocks, kind="stable")
        heads = np.flatnonzero(np.diff(blocks[ranked], prepend=-1))
        for own in np.split(ranked, heads[1:]):
            _score(batch.slice(int(blocks[own[0]]), 1), items[own], scorer, best)
        first, size = first + size, size * 2


def _score(block: pa.RecordBatch, items: np.ndarray, scorer: Scorer, best: Best) -> None:
    _, terms = _flat(block, "terms")
    _, tfs = _flat(block, "tfs")
    _, ends = _flat(block, "ends")
    _, members = _flat(block, "members")
    docs = block.column("docs").flatten()
    added = impacts(scorer.weights[terms], tfs, block.column("m")[0].as_py())  # once for each term and tf
    low = np.full(len(scorer.weights), 0)
    high = np.full(len(scorer.weights), 0)
    first = np.flatnonzero(np.diff(terms, prepend=-1))
    low[terms[first]], high[terms[first]] = first, np.append(first[1:], len(terms))
    starts = np.append(0, ends[:-1])
    step = max(PAIRS // max(len(docs), 1), 1)
    for k in range(0, len(items), step):
        own = items[k : k + step]
        sizes = scorer.starts[own + 1] - scorer.starts[own]
        row, term = np.repeat(np.arange(len(own)), sizes), scorer.wanted[_ranges(scorer.starts[own], sizes)]
        each = high[term] - low[term]  # the tfs of each wanted term
        row, run = np.repeat(row, each), _ranges(low[term], each)
        each = ends[run] - starts[run]
        place = np.repeat(row, each) * len(docs) + members[_ranges(starts[run], each)]
        scores = np.zeros(len(own) * len(docs), np.int64)
        np.add.at(scores, place, np.repeat(added[run], each))
        hit = np.flatnonzero(scores)
        hit = hit[scores[hit] >= best.floor[own[hit // len(docs)]]]
        if len(hit):
            doc = docs.take(pa.array(hit % len(docs)))
            best.add(own[hit // len(docs)], scores[hit], doc.is_null().to_numpy(zero_copy_only=False), doc.fill_null(0).to_numpy())


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many as its size says, one after the other."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - start, size)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(k, AT_ONCE)


def _ranked(index: DataFrame, scorer: Scorer, places: int) -> DataFrame:
    """item, score, doc_id of the highest places of each item."""
    spark = index.sparkSession
    shared = spark.sparkContext.broadcast(scorer)
    count = len(scorer.starts) - 1

    def first_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            bounds = _bounds(batch, shared.value)
            top = np.argsort(-bounds, axis=0, kind="stable")[:FIRST_BLOCKS]
            item = np.broadcast_to(np.arange(count), top.shape)
            real = bounds[top, item] > 0
            row = top[real]
            yield pa.RecordBatch.from_arrays(
                [pa.array(item[real].astype(np.int32)), pa.array(bounds[row, item[real]]), *(pa.array(batch.column(c).to_numpy()[row]) for c in ("m", "block"))], ["item", "bound", "m", "block"]
            )

    def search(floor: np.ndarray):
        lowest = spark.sparkContext.broadcast(floor)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(lowest.value, places)
            for batch in _pieces(batches):
                _visit(batch, shared.value, best)
            yield best.rows()

        return tables.released(run)

    chosen = index.select("m", "block", "terms", "tfs").mapInArrow(first_blocks, "item int, bound long, m long, block long")
    chosen = _first_of_each(chosen, [F.desc("bound"), "m", "block"], FIRST_BLOCKS).select("m", "block").distinct()
    # At most FIRST_BLOCKS blocks for each item of a part.
    some = index.join(F.broadcast(chosen), ["m", "block"], "left_semi").mapInArrow(search(np.zeros(count, np.int64)), FOUND)
    floor = np.zeros(count, np.int64)
    for row in _first_of_each(some, [F.desc("score"), F.asc_nulls_last("doc_id")], places, "place").where(F.col("place") == places).collect():
        floor[row.item] = row.score
    found = index.mapInArrow(search(floor), FOUND)
    return _first_of_each(found, [F.desc("score"), F.asc_nulls_last("doc_id")], places, "place")


def _first_of_each(rows: DataFrame, order: list, places: int, name: str = "_place") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col(name) <= places)


def search(docs: DataFrame, items: DataFrame, places: int = PLACES) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the ``places`` documents with the highest scores for each item.

    With N documents that have terms, L terms in all of them, n in one and df documents with a term:
    a term weighs floor(1000 ln((2 N + 2) / (2 df + 1))), m is 10 + 90 n N div L, and a document's score is the
    sum over the item's different terms of weight * (10^9 tf div (1000 tf + 8 m)). Equal scores by doc_id.
    """
    spark: SparkSession = docs.sparkSession
    found = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for part in _parts(items):
        counted = tables.stored(count_terms(docs, part.terms), "lexical-counts")
        documents, words = counted.where("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
        if not documents:
            return found
        weights = np.zeros(len(part.terms), np.int64)
        for row in counted.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
            weights[row.term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * row["count"] + 1)))
        scorer = Scorer(part.starts, part.wanted, weights)
        ids = spark.createDataFrame(list(enumerate(part.ids)), "item int, item_id long")
        ranked = _ranked(_stratified(counted, documents, words), scorer, places).join(F.broadcast(ids), "item")
        found = found.unionByName(ranked.select("item_id", F.col("place").alias("rank"), "doc_id", "score"))
    return found


SEARCH_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents WHERE text IS NOT NULL
), sized AS (
  SELECT r, doc_id, words, CAST(len(words) AS BIGINT) AS n FROM docs WHERE len(words) > 0
), totals AS (
  SELECT CAST(count(*) AS BIGINT) AS all_docs, CAST(sum(n) AS BIGINT) AS all_words FROM sized
), postings AS (
  SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(words) AS term FROM sized) GROUP BY r, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * all_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, totals GROUP BY term, all_docs
), wanted AS (
  SELECT DISTINCT i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS i, item_id, text FROM benchmark)
), scored AS (
  SELECT i, item_id, p.r, d.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * all_docs) // all_words)))) AS BIGINT) AS score
  FROM wanted JOIN postings p USING (term) JOIN weights USING (term) JOIN sized d ON d.r = p.r, totals
  GROUP BY i, item_id, p.r, d.doc_id
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
