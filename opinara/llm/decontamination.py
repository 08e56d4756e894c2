"""Documents that hold benchmark items, by a BM25 index of the items and block-max WAND.

The items are indexed by adjacent word pairs (an item of one word by that word). Every passage of every
document is a query: passages are 2 * stride words long and start every stride words, and a stride is
longer than the longest item, so an item never falls between two passages. All items above their
threshold are retrieved and then verified: the passage must hold MIN_OVERLAP of the item's distinct
five-word shingles, question and answer taken together; what it holds of each is reported. An item
of fewer words is one shingle.

Thresholds lose nothing: who holds 80 % of n shingles lacks at most 0.2 n pairs, so an item's threshold
is its full score less its 0.2 n largest weights. Weights are divided by it, and all thresholds are 1.
A passage whose pairs can't reach 1 even with each pair's largest weight is not evaluated further; the
others go through the postings, skipping blocks whose largest weights can't reach 1.

The index is broadcast in parts of about PART_WORDS words, each held against all documents.

Null and empty texts and items without words match nothing. Null ids are matched like others, repeated
ids give one row per id and item, with the largest overlap. Without items or documents there are no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.llm import hashedwords, tables

SHINGLE = 5
MIN_OVERLAP = 0.8
QUESTION_SHARE = 0.75  # of the words of an item whose answer has no column of its own
STRIDE = 64
SLACK = 1.25  # stride per word of the longest item
PART_WORDS = 500_000
POSTINGS = 32  # per block
K1, B = 1.2, 0.75
_FILTER_BITS = 22
_EPS = 1e-9


class Item:
    def __init__(self, item_id: int | None, words: np.ndarray, question: int) -> None:
        self.item_id = item_id
        self.length = min(SHINGLE, len(words))
        shingles = hashedwords.runs(words, self.length) if len(words) else np.zeros(0, np.uint64)
        self.shingles = np.unique(shingles)
        self.question = np.unique(shingles[: max(question - self.length + 1, 0)])
        self.answer = np.unique(shingles[max(question - self.length + 1, 0) :])  # all that hold a word of it
        self.terms, self.counts = np.unique(hashedwords.runs(words, min(2, len(words))) if len(words) else shingles, return_counts=True)


class Index:
    """Postings of the items' terms in blocks, with the largest weight of each term and block."""

    def __init__(self, items: Sequence[Item]) -> None:
        self.items = [i for i in items if len(i.terms)]
        self.single = any(i.length == 1 for i in self.items)
        self.terms, where = np.unique(np.concatenate([i.terms for i in self.items] or [np.zeros(0, np.uint64)]), return_inverse=True)
        owner = np.repeat(np.arange(len(self.items)), [len(i.terms) for i in self.items])
        frequency = np.bincount(where, minlength=len(self.terms))
        mean = np.mean([i.counts.sum() for i in self.items]) if self.items else 1.0
        weights, at = np.zeros(len(where)), 0
        for item in self.items:
            span = slice(at, at := at + len(item.terms))
            df = frequency[where[span]]
            tf = item.counts * (K1 + 1) / (item.counts + K1 * (1 - B + B * item.counts.sum() / mean))
            own = np.log1p((len(self.items) - df + 0.5) / (df + 0.5)) * tf
            lacking = math.floor((1 - MIN_OVERLAP) * len(item.shingles) + _EPS)
            weights[span] = own / np.sort(own)[: max(len(own) - lacking, 1)].sum()
        order = np.lexsort((owner, where))
        self.owner, self.weight = owner[order], weights[order]
        self.start = np.append(0, np.cumsum(frequency))
        self.largest = np.maximum.reduceat(self.weight, self.start[:-1]) if len(self.terms) else np.zeros(0)
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.terms >> np.uint64(64 - _FILTER_BITS)] = True

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the hashes that are terms, and the numbers of these."""
        maybe = np.flatnonzero(self.filter[hashes >> np.uint64(64 - _FILTER_BITS)])
        number = np.searchsorted(self.terms, hashes[maybe])
        number[number == len(self.terms)] = 0
        real = self.terms[number] == hashes[maybe] if len(self.terms) else np.zeros(0, bool)
        return maybe[real], number[real]

    def search(self, terms: Sequence[int]) -> list[tuple[int, float]]:
        """Numbers and scores of all items with a score of 1 or more for a passage with these terms."""
        lists = []
        for t in terms:
            owner, weight = self.owner[self.start[t] : self.start[t + 1]].tolist(), self.weight[self.start[t] : self.start[t + 1]].tolist()
            tops = [max(weight[k : k + POSTINGS]) for k in range(0, len(weight), POSTINGS)]
            lists.append([owner, weight, tops, float(self.largest[t]), 0])
        found = []
        while True:
            lists = sorted((x for x in lists if x[4] < len(x[0])), key=lambda x: x[0][x[4]])
            bound, pivot = 0.0, None
            for n, x in enumerate(lists):
                bound += x[3]
                if bound >= 1 - _EPS:
                    pivot = x[0][x[4]]
                    break
            if pivot is None:
                return found
            ahead = [x for x in lists if x[0][x[4]] <= pivot]
            blocks = [self._block(x, pivot) for x in ahead]
            if sum(x[2][b] for x, b in zip(ahead, blocks, strict=True) if b < len(x[2])) < 1 - _EPS:
                # No item up to the end of the nearest block, or to the next list's place, can reach 1.
                ends = [x[0][min((b + 1) * POSTINGS, len(x[0])) - 1] + 1 for x, b in zip(ahead, blocks, strict=True) if b < len(x[2])]
                onward = [x[0][x[4]] for x in lists[len(ahead) :][:1]]
                self._skip(ahead, max(pivot + 1, min([*ends, *onward], default=pivot + 1)))
            elif ahead[0][0][ahead[0][4]] == pivot:
                score = sum(x[1][x[4]] for x in ahead)
                if score >= 1 - _EPS:
                    found.append((pivot, score))
                self._skip(ahead, pivot + 1)
            else:
                self._skip(ahead, pivot)

    @staticmethod
    def _block(x: list, item: int) -> int:
        """The block of a list that could hold the item."""
        b = x[4] // POSTINGS
        while b < len(x[2]) and x[0][min((b + 1) * POSTINGS, len(x[0])) - 1] < item:
            b += 1
        return b

    @staticmethod
    def _skip(lists: list[list], item: int) -> None:
        for x in lists:
            while x[4] < len(x[0]) and x[0][x[4]] < item:
                x[4] += 1


def hits(index: Index, stride: int, texts: pa.Array) -> Iterator[tuple[int, Item, float, float, float, float]]:
    """Number of the text, item, score, overlap, question and answer overlap of each verified passage."""
    if not index.items:
        return
    for first, words, ends in hashedwords.blocks(texts):
        starts = np.append(0, ends[:-1])
        place, term = index.lookup(hashedwords.runs(words, 2))
        doc = np.searchsorted(ends, place, "right")
        whole = place + 1 < ends[doc]
        place, term, doc = place[whole], term[whole], doc[whole]
        if index.single:
            alone, number = index.lookup(hashedwords.runs(words, 1))
            place, term = np.append(place, alone), np.append(term, number)
            doc = np.append(doc, np.searchsorted(ends, alone, "right"))
        if not len(place):
            continue
        # Passages are numbered through all texts of the block.
        most = int((ends - starts).max()) // stride + 2
        passage = doc * most + (place - starts[doc]) // stride
        back = np.flatnonzero((place - starts[doc]) >= stride)
        passage, term = np.append(passage, passage[back] - 1), np.append(term, term[back])
        distinct = np.unique(passage * np.int64(len(index.terms)) + term)
        passage, term = distinct // len(index.terms), distinct % len(index.terms)
        begin = np.flatnonzero(np.diff(passage, prepend=-1))
        for k in np.flatnonzero(np.add.reduceat(index.largest[term], begin) >= 1 - _EPS).tolist():
            stop = begin[k + 1] if k + 1 < len(begin) else len(passage)
            number, step = divmod(int(passage[begin[k]]), most)
            low = starts[number] + step * stride
            own = words[low : min(low + 2 * stride, ends[number])]
            held: dict[int, np.ndarray] = {}
            for n, score in index.search(term[begin[k] : stop].tolist()):
                item = index.items[n]
                if item.length not in held:
                    held[item.length] = np.sort(hashedwords.runs(own, item.length))
                overlap = _share(item.shingles, held[item.length])
                if overlap >= MIN_OVERLAP - _EPS:
                    yield first + number, item, score, overlap, _share(item.question, held[item.length]), _share(item.answer, held[item.length])


def _share(shingles: np.ndarray, held: np.ndarray) -> float:
    if not len(shingles) or not len(held):
        return 0.0
    at = np.minimum(np.searchsorted(held, shingles), len(held) - 1)
    return float((held[at] == shingles).mean())


def _indexes(items: DataFrame) -> Iterator[tuple[Index, int]]:
    """Indexes of all parts of the items, and the stride for all of them."""
    texts = items.select(F.col("item_id").cast("long").alias("item_id"), _whole(items).alias("text"), _question(items).alias("question"))
    words = F.size(F.split(F.col("text"), "[^0-9A-Za-z\\x{80}-\\x{10FFFF}]+"))
    total, longest = texts.agg(F.sum(words), F.max(words)).first()
    parts = -(-(total or 0) // PART_WORDS)
    stride = max(STRIDE, math.ceil(SLACK * (longest or 0)))
    for part in range(parts):
        rows = texts.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").toArrow()
        found = []
        question = [len(w) for w in _each(rows["question"].combine_chunks())]
        for n, own in enumerate(_each(rows["text"].combine_chunks())):
            split = question[n] if rows["question"][n].is_valid else math.ceil(QUESTION_SHARE * len(own))
            found.append(Item(rows["item_id"][n].as_py(), own, split))
        yield Index(found), stride


def _each(texts: pa.Array) -> Iterator[np.ndarray]:
    texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) and texts.num_chunks else texts
    for _, words, ends in hashedwords.blocks(texts.fill_null("")) if len(texts) else ():
        yield from np.split(words, ends[:-1])


def _whole(items: DataFrame) -> Column:
    if {"question", "answer"} <= set(items.columns):
        return F.concat_ws(" ", tables.text_of("question"), tables.text_of("answer"))
    return tables.text_of()


def _question(items: DataFrame) -> Column:
    return tables.text_of("question") if {"question", "answer"} <= set(items.columns) else F.lit(None).cast("string")


FOUND = "doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double"


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, score, overlap, question_overlap, answer_overlap of all documents with an item."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tables.text_of().alias("text"))
    found = spark.createDataFrame([], FOUND)
    for index, stride in _indexes(items):
        shared = spark.sparkContext.broadcast(index)

        def search(batches: Iterator[pa.RecordBatch], shared=shared, stride=stride) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(batch.column("doc_id")[n].as_py(), item.item_id, *rest) for n, item, *rest in hits(shared.value, stride, batch.column("text"))]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
                kinds = [pa.int64(), pa.int64(), *[pa.float64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in FOUND.split(", ")])

        found = found.unionByName(texts.mapInArrow(tables.released(search), FOUND))
    best = F.max(F.struct("overlap", "score", "question_overlap", "answer_overlap")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "best.score", "best.overlap", "best.question_overlap", "best.answer_overlap"
    )


def keep(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no item, with the columns they have."""
    for index, stride in _indexes(items):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared, stride=stride) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                stay = np.ones(batch.num_rows, bool)
                stay[[n for n, *_ in hits(shared.value, stride, batch.column("text").cast(pa.string()).fill_null(""))]] = False
                yield batch.filter(pa.array(stay))

        docs = docs.mapInArrow(tables.released(clean), docs.schema)
    return docs
