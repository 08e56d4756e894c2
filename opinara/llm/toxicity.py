"""Toxicity by two class-conditional Kneser-Ney models over characters.

Texts are read as letters and gaps: lower case, whatever is no letter is a gap, one gap between words.
Both classes have their own counts of ORDER-grams (of labelled documents that have them); below that both back off to
the same lower orders, whose continuation counts (in how many contexts was this seen) come from all
documents, labelled or not. An expression that is rare in either class is so judged by parts that are
not; one that neither class has seen tells nothing but how open its context is in each class.

Likelihoods are compared per character: over each stretch of WINDOW characters and over the whole text.
A document's score is a logistic function of its most toxic stretch and its mean, fitted on labelled
documents that the counts did not use. Whole texts are read, twice: to count and to score.

Texts without letters, null and empty ones among them, have no stretches and the score 0. Null ids are
never labelled; repeated ids are scored row by row, a label holds for all rows of its id, and of
several labels of one id the largest holds. Without labels of both classes all scores are 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.llm import tables
from opinara.llm.labelled import CALIBRATION_FOLD, MAX_LABELLED, fit_logistic, training_labels

ORDER = 6
WINDOW = 16
DISCOUNT = 0.75  # of the shared orders
CLASS_DISCOUNT = 1.0  # of the class counts: a gram of a single document says no more than its parts
BLOCK = 2 << 20  # bytes; at most 32,768 texts of a block are told apart
PART = 1 << 21  # ratios of a broadcast part: 24 MB, and up to 17 MB to find them
_P = np.uint64(0x9E3779B97F4A7C15)

#: A byte's symbol: gap 0, letters 1 to 26, other bytes by their value; eight bits each.
_symbol = np.zeros(256, np.uint8)
_symbol[65:91] = _symbol[97:123] = np.arange(1, 27)
_symbol[128:] = np.arange(128, 256)


def symbols(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of texts: number of the first, symbols of all, and where each ends; a gap ends each."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK, "right")) - 1)
        at = offsets[first : last + 1] - offsets[first]
        marks = np.insert(_symbol[data[offsets[first] : offsets[last]]], at[1:], 0)
        ends = at[1:] + np.arange(1, last - first + 1)
        gap = marks == 0
        stay = ~gap
        stay[1:] |= ~gap[:-1]
        stay[ends - 1] = True
        yield first, marks[stay], np.cumsum(stay)[ends - 1]
        first = last


def grams(marks: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each symbol, it and the ORDER - 1 before it in its text as one number; gaps before a text."""
    padded = np.append(np.zeros(ORDER - 1, np.uint8), marks)
    out = np.zeros(len(marks), np.int64)
    for k in range(ORDER):
        out <<= 8
        out |= padded[k : k + len(marks)]
    starts = np.append(0, ends[:-1])
    for k in range(ORDER - 1):  # a text's first symbols have nothing of the text before
        here = starts[starts + k < ends] + k
        out[here] &= (1 << 8 * (k + 1)) - 1
    return out


def slot_of(codes: np.ndarray) -> np.ndarray:
    """Keys in scattered order; the factor is odd, so no two codes share one."""
    return codes.astype(np.uint64) * _P


def _large(texts: pa.Array) -> pa.Array:
    return texts.cast(pa.large_string())


def counts(docs: DataFrame) -> DataFrame:
    """code, n_all, n_toxic, n_plain of every ORDER-gram, from text and a nullable label."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column("label").fill_null(-1).to_numpy(zero_copy_only=False)
            for first, marks, ends in symbols(_large(batch.column("text"))):
                codes = grams(marks, ends)
                number = np.repeat(np.arange(len(ends), dtype=np.int32), np.diff(ends, prepend=0))
                label = labels[first : first + len(ends)].astype(np.int8)[number]
                # A class counts a gram once a document, so no document speaks for more than one.
                own = (number.astype(np.int64) % (1 << 15)) << 48 | codes
                for which, seen in ((-1, codes[label < 0]), (0, own[label == 0]), (1, own[label == 1])):
                    if which >= 0:
                        seen = pa.array(seen).unique().to_numpy() & ((1 << 48) - 1)
                    found = pa.array(seen).value_counts()
                    code, n = found.field("values"), found.field("counts")
                    none = pa.array(np.zeros(len(code), np.int64))
                    yield pa.RecordBatch.from_arrays([code, n, n if which == 1 else none, n if which == 0 else none], ["code", "n_all", "n_toxic", "n_plain"])

    found = docs.select("text", "label").mapInArrow(tables.released(count), "code long, n_all long, n_toxic long, n_plain long")
    return found.groupBy("code").agg(*[F.sum(c).alias(c) for c in ("n_all", "n_toxic", "n_plain")])


def _tail(order: int, column: str = "code") -> Column:
    """The last ``order`` symbols of a gram."""
    return F.col(column).bitwiseAND(F.lit((1 << 8 * order) - 1))


def _context(column: str = "code") -> Column:
    return F.shiftright(F.col(column), 8)


def ratios(counted: DataFrame) -> DataFrame:
    """code and log ratio (toxic to plain) of the grams that a class has seen, and of contexts.

    A gram's ratio is log p(symbol | context, toxic) - log p(symbol | context, plain). A context's,
    under code -1 - context, is for any symbol that neither class has seen there.
    """
    # Shared lower orders: p1 from the ways a symbol is preceded, then p2 and so on up to ORDER - 1.
    lower = counted.select(_tail(ORDER - 1).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("c"))
    shared = None
    tables_by_order: list[DataFrame] = []
    for order in range(ORDER - 1, 0, -1):
        tables_by_order.append(lower)
        lower = lower.groupBy(_tail(order - 1).alias("code")).agg(F.count(F.lit(1)).alias("c")) if order > 1 else lower
    for order, own in zip(range(1, ORDER), reversed(tables_by_order), strict=True):
        context = own.groupBy(_context().alias("context")).agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("kinds"))
        own = own.withColumn("context", _context()).join(context, "context")
        if shared is None:
            below = F.lit(1.0 / 256)
        else:
            own = own.withColumn("tail", _tail(order - 1)).join(shared.select(F.col("code").alias("tail"), F.col("p").alias("q")), "tail")
            below = F.col("q")
        p = (F.col("c") - DISCOUNT) / F.col("total") + DISCOUNT * F.col("kinds") / F.col("total") * below
        shared = own.select("code", p.alias("p"))
    classes = counted.where("n_toxic > 0 OR n_plain > 0").select("code", "n_toxic", "n_plain", _context().alias("context"), _tail(ORDER - 1).alias("tail"))
    opened = classes.groupBy("context").agg(
        F.sum("n_toxic").alias("t"), F.sum("n_plain").alias("o"), F.count_if(F.col("n_toxic") > 0).alias("tk"), F.count_if(F.col("n_plain") > 0).alias("ok")
    )

    def seen(n: str, total: str) -> Column:
        return F.when(F.col(total) > 0, F.greatest(F.col(n) - CLASS_DISCOUNT, F.lit(0.0)) / F.col(total)).otherwise(0.0)

    def left(kinds: str, total: str) -> Column:
        return F.when(F.col(total) > 0, CLASS_DISCOUNT * F.col(kinds) / F.col(total)).otherwise(1.0)

    full = classes.join(opened, "context").join(shared.withColumnRenamed("code", "tail"), "tail")
    ratio = F.log(seen("n_toxic", "t") + left("tk", "t") * F.col("p")) - F.log(seen("n_plain", "o") + left("ok", "o") * F.col("p"))
    rows = full.select("code", ratio.alias("ratio")).unionByName(opened.select((-1 - F.col("context")).alias("code"), F.log(left("tk", "t") / left("ok", "o")).alias("ratio")))
    return rows


def in_parts(rows: DataFrame) -> list[Broadcast]:
    """All ratios by key, in order of the keys, as broadcast parts of at most PART; one at least."""
    found = rows.select("code", F.col("ratio").cast("float")).toArrow()
    keys = slot_of(found["code"].to_numpy())
    order = np.argsort(keys)
    keys, values = keys[order], found["ratio"].to_numpy()[order]
    return [rows.sparkSession.sparkContext.broadcast((keys[k : k + PART], values[k : k + PART])) for k in range(0, max(len(keys), 1), PART)]


class Ratios:
    """Ratios by sorted keys, found by where the leading bits of a key start."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.keys, self.values = keys, values
        if len(keys):
            span = int(keys[-1]) - int(keys[0])
            self.shift = np.uint64(max(span.bit_length() - (len(keys) - 1).bit_length(), 0))
            slots = ((keys - keys[0]) >> self.shift).astype(np.int64)
            self.starts = np.append(0, np.cumsum(np.bincount(slots))).astype(np.int32)

    def find(self, keys: np.ndarray, out: np.ndarray) -> None:
        """Write the ratios of the keys that are here; nothing is written for others."""
        if not len(self.keys):
            return
        row = np.flatnonzero((keys >= self.keys[0]) & (keys <= self.keys[-1]))
        slots = ((keys[row] - self.keys[0]) >> self.shift).astype(np.int64)
        at, stop = self.starts[slots], self.starts[slots + 1]
        on = at < stop
        while on.any():
            row, at, stop = row[on], at[on], stop[on]
            hit = self.keys[at] == keys[row]
            out[row[hit]] = self.values[at[hit]]
            at = at + 1
            on = ~hit & (at < stop)


class Scorer:
    """Evidence in texts from ratios by key."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys)
        own = Ratios(keys[order], values[order])
        self.parts = lambda: iter([own])

    @classmethod
    def of(cls, parts: list[Broadcast]) -> Scorer:
        """A single part is held, of several one at a time."""
        if len(parts) == 1:
            return cls(*parts[0].value)

        def each() -> Iterator[Ratios]:
            for part in parts:
                own = Ratios(*part.value)
                if getattr(part, "_path", None):  # a worker reads it again from its file
                    part.__dict__.pop("_value", None)
                yield own

        out = cls(np.zeros(0, np.uint64), np.zeros(0, np.float32))
        out.parts = each
        return out

    def ratios(self, codes: np.ndarray) -> np.ndarray:
        """The ratio of each code, NaN where there is none."""
        keys, out = slot_of(codes), np.full(len(codes), np.nan, np.float32)
        for part in self.parts():
            part.find(keys, out)
        return out

    def evidence(self, texts: pa.Array) -> np.ndarray:
        """Of each text, the largest mean ratio of a stretch and the mean ratio of all characters; NaN without letters."""
        out = np.zeros((len(texts), 2))
        for first, marks, ends in symbols(texts):
            codes = grams(marks, ends)
            ratio = self.ratios(codes)
            new = np.flatnonzero(np.isnan(ratio))
            ratio[new] = np.nan_to_num(self.ratios(-1 - (codes[new] >> 8)))
            total = np.append(0.0, np.cumsum(ratio, dtype=np.float64))
            starts = np.append(0, ends[:-1])
            sizes = ends - starts
            # A stretch ends at each symbol and starts WINDOW symbols before, or at its text's start.
            stop = np.arange(1, len(marks) + 1)
            begin = np.maximum(stop - WINDOW, np.repeat(starts, sizes))
            best = np.maximum.reduceat((total[stop] - total[begin]) / WINDOW, starts)
            out[first : first + len(ends), 0] = best
            out[first : first + len(ends), 1] = (total[ends] - total[starts]) / sizes
            out[first : first + len(ends)][np.add.reduceat(marks > 0, starts) == 0] = np.nan
        return out


class Model(NamedTuple):
    """Ratios in broadcast parts, and the weights of peak, mean and constant; no weights: nothing is known."""

    table: list[Broadcast]
    weights: tuple[float, float, float] | None

    def logit(self, seen: np.ndarray) -> np.ndarray:
        none = np.full(len(seen), -np.inf)
        return np.where(np.isnan(seen[:, 0]), none, seen @ np.array(self.weights[:2]) + self.weights[2]) if self.weights else none


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> Model:
    """Counts over all documents, ratios from labelled ones, weights from the calibration fold's."""
    chosen = F.broadcast(tables.stored(training_labels(labels, "toxic", limit), "toxic-labels"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tables.text_of().alias("text"))
    labelled = texts.join(chosen, "doc_id", "left")
    counted = tables.stored(counts(labelled.withColumn("label", F.when(F.col("fold") != CALIBRATION_FOLD, F.col("label")))), "gram-counts")
    table = in_parts(ratios(counted))

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer.of(table)
        for batch in batches:
            seen = own.evidence(_large(batch.column("text")))
            yield pa.RecordBatch.from_arrays([pa.array(seen[:, 0]), pa.array(seen[:, 1]), batch.column("label")], ["peak", "mean", "label"])

    known = texts.join(chosen.where(F.col("fold") == CALIBRATION_FOLD), "doc_id").select("text", "label")
    known = known.mapInArrow(tables.released(evidence), "peak double, mean double, label int").where(~F.isnan("peak")).orderBy("label", "peak", "mean").toPandas()
    y = known["label"].to_numpy()
    both = 0 < y.sum() < len(y)
    return Model(table, tuple(fit_logistic(known[["peak", "mean"]].to_numpy(), y).tolist()) if both else None)


def score(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = fit(docs, labels, limit)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer.of(model.table)
        for batch in batches:
            logit = model.logit(own.evidence(_large(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(np.where(logit > -500, 1 / (1 + np.exp(-np.clip(logit, -500, 500))), 0.0))], ["doc_id", "held_out", "score"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (tables.fold_of() == 0).alias("held_out"), tables.text_of().alias("text"))
    scored = texts.mapInArrow(tables.released(judge), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """The documents whose score is below one half, with the columns they have."""
    model = fit(docs, labels, limit)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer.of(model.table)
        for batch in batches:
            logit = model.logit(own.evidence(_large(batch.column("text").cast(pa.string()).fill_null(""))))
            yield batch.filter(pa.array(logit < 0))

    return docs.mapInArrow(tables.released(clean), docs.schema)
