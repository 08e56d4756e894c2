"""Quality by a small convolutional network over bytes, written in numpy.

A text's bytes are cut into overlapping chunks that cover all of it. Filters over WIDTH neighbouring
bytes slide through a chunk two bytes at a time, the strongest response of each filter in the chunk is
kept (max pooling), and a hidden layer turns these into the chunk's logit. A document's probability is
a logistic function of the mean, largest and smallest logit of its chunks.

Filters, embeddings and the hidden layer are learned on all chunks of at most PER_CLASS labelled documents
of either class, where documents weigh alike however long they are; of more than MAX_CHUNKS chunks, so many
are drawn by hash. The logistic function is fitted on whole labelled
documents that the network has not seen. Scoring reads every chunk of every text.

Null and empty texts are one empty chunk. Null ids are never labelled; repeated ids are scored row by
row; of several labels of one id the largest holds. Without labels of both classes all scores are 1,
as nothing speaks against a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm import tables
from opinara.llm.labelled import CALIBRATION_FOLD, MAX_LABELLED, fit_logistic, training_labels

CHUNK, STRIDE = 256, 224
WIDTH, STEP = 7, 2
POSITIONS = (CHUNK - WIDTH) // STEP + 1
EMBEDDING, FILTERS, HIDDEN = 8, 16, 16
PER_CLASS = 2_000
MAX_CHUNKS = 200_000  # labelled chunks that take part in fitting
EPOCHS, BATCH, RATE = 12, 256, 0.01
STEP_CHUNKS = 512


def chunks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of every chunk of the texts that lie at starts to ends, and the text of each chunk."""
    per_text = 1 + np.maximum(0, -(-(ends - starts - CHUNK) // STRIDE))
    text = np.repeat(np.arange(len(starts)), per_text)
    step = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    return starts[text] + step * STRIDE, text


def cut(data: np.ndarray, places: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes of chunks, zero behind the end of their text."""
    at = places[:, None] + np.arange(CHUNK)
    return np.where(at < ends[:, None], data[np.minimum(at, max(len(data) - 1, 0))] if len(data) else 0, 0).astype(np.uint8)


class Network:
    def __init__(self, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.weights = {
            "embedding": draw(256, EMBEDDING, scale=0.5), "filters": draw(WIDTH, EMBEDDING, FILTERS, scale=0.4), "bias": np.zeros(FILTERS, np.float32),
            "hidden": draw(FILTERS, HIDDEN, scale=0.4), "hidden_bias": np.zeros(HIDDEN, np.float32), "out": draw(HIDDEN, scale=0.4), "out_bias": np.zeros(1, np.float32),
        }
        self._moments = {k: (np.zeros_like(w), np.zeros_like(w)) for k, w in self.weights.items()}
        self._steps = 0

    def responses(self, x: np.ndarray) -> np.ndarray:
        """Chunks by positions by filters; a filter is a table of byte values for each place in its window."""
        w = self.weights
        out = np.zeros((len(x), POSITIONS, FILTERS), np.float32)
        for k in range(WIDTH):
            out += (w["embedding"] @ w["filters"][k])[x[:, k : k + STEP * POSITIONS : STEP]]
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        w = self.weights
        out = np.zeros(len(x), np.float32)
        for k in range(0, len(x), STEP_CHUNKS):
            pooled = np.maximum(self.responses(x[k : k + STEP_CHUNKS]).max(axis=1) + w["bias"], 0)
            out[k : k + STEP_CHUNKS] = np.maximum(pooled @ w["hidden"] + w["hidden_bias"], 0) @ w["out"] + w["out_bias"]
        return out

    def learn(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """One step of Adam on a batch; only the position that a filter's maximum is at has a gradient."""
        w = self.weights
        found = self.responses(x)
        best = found.argmax(axis=1)
        raw = np.take_along_axis(found, best[:, None, :], axis=1)[:, 0] + w["bias"]
        pooled = np.maximum(raw, 0)
        before = pooled @ w["hidden"] + w["hidden_bias"]
        hidden = np.maximum(before, 0)
        logit = hidden @ w["out"] + w["out_bias"]
        slope = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) * weight / len(y)).astype(np.float32)
        back = np.outer(slope, w["out"]) * (before > 0)
        to_filter = (back @ w["hidden"].T) * (raw > 0)
        grads = {"out": hidden.T @ slope, "out_bias": slope.sum(keepdims=True), "hidden": pooled.T @ back, "hidden_bias": back.sum(axis=0), "bias": to_filter.sum(axis=0)}
        grads["embedding"], grads["filters"] = np.zeros_like(w["embedding"]), np.zeros_like(w["filters"])
        lane = np.broadcast_to(np.arange(FILTERS), best.shape)
        for k in range(WIDTH):
            table = np.zeros((256, FILTERS), np.float32)
            np.add.at(table, (np.take_along_axis(x, best * STEP + k, axis=1), lane), to_filter)
            grads["filters"][k] = w["embedding"].T @ table
            grads["embedding"] += table @ w["filters"][k].T
        self._steps += 1
        for name, grad in grads.items():
            mean, spread = self._moments[name]
            mean += 0.1 * (grad - mean)
            spread += 0.001 * (grad * grad - spread)
            w[name] -= RATE * (mean / (1 - 0.9**self._steps)) / (np.sqrt(spread / (1 - 0.999**self._steps)) + 1e-8)


def train(x: np.ndarray, y: np.ndarray, share: np.ndarray | None = None, seed: int = 11) -> Network:
    """A network fitted to chunks (rows of bytes) and the labels of their documents; classes weigh alike.

    ``share`` is what part of its document a chunk stands for.
    """
    network, rng = Network(seed), np.random.default_rng(seed)
    share = np.ones(len(y)) if share is None else share
    ones, all_of_it = share[y == 1].sum(), share.sum()
    weight = share * np.where(y == 1, 0.5 / max(ones, 1e-9), 0.5 / max(all_of_it - ones, 1e-9)) * len(y)
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for k in range(0, len(x), BATCH):
            part = order[k : k + BATCH]
            network.learn(x[part], y[part], weight[part])
    return network


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8), offsets


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = _bytes_of(batch.column("text"))
        places, text = chunks(data, offsets[:-1], offsets[1:])
        share = 1 / np.bincount(text, minlength=batch.num_rows)
        for k in range(0, len(places), STEP_CHUNKS):
            own = text[k : k + STEP_CHUNKS]
            rows = cut(data, places[k : k + STEP_CHUNKS], offsets[1:][own])
            of = [batch.column(name).take(pa.array(own)) for name in ("doc_id", "label")]
            yield pa.RecordBatch.from_arrays([*of, pa.array(share[own]), pa.array([r.tobytes() for r in rows], pa.binary())], ["doc_id", "label", "share", "chunk"])


def fit(docs: DataFrame, chosen: DataFrame, per_class: int = PER_CLASS) -> Network | None:
    """A network from at most per_class labelled documents of each class; None if a class has none."""
    learn = chosen.where(F.col("fold") != CALIBRATION_FOLD)
    both = [learn.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    known = F.broadcast(tables.stored(both[0].unionByName(both[1]).select("doc_id", "label"), "quality-labels"))
    rows = docs.join(known, "doc_id").select("doc_id", "label", "text").mapInArrow(_examples, "doc_id long, label int, share double, chunk binary")
    rows = rows.orderBy(F.xxhash64("doc_id", "chunk"), "doc_id", "chunk").limit(MAX_CHUNKS).toPandas()
    y = rows["label"].to_numpy()
    if not 0 < y.sum() < len(y):
        return None
    return train(np.frombuffer(b"".join(rows["chunk"]), np.uint8).reshape(-1, CHUNK), y, rows["share"].to_numpy())


def score(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, row (a number of the row), held_out, score and predicted of every document."""
    chosen = F.broadcast(tables.stored(training_labels(labels, "quality", limit), "quality-labels"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), tables.text_of().alias("text"))
    network = fit(texts, chosen, per_class)
    if network is None:
        return texts.select("doc_id", "row", (tables.fold_of() == 0).alias("held_out"), F.lit(1.0).alias("score"), F.lit(1).alias("predicted"))
    model = docs.sparkSession.sparkContext.broadcast(network)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _bytes_of(batch.column("text"))
            places, text = chunks(data, offsets[:-1], offsets[1:])
            found = np.zeros(len(places), np.float32)
            for k in range(0, len(places), STEP_CHUNKS):
                part = slice(k, k + STEP_CHUNKS)
                found[part] = model.value.logits(cut(data, places[part], offsets[1:][text[part]]))
            first = np.searchsorted(text, np.arange(batch.num_rows))
            mean = np.add.reduceat(found, first, dtype=np.float64) / np.bincount(text, minlength=batch.num_rows) if batch.num_rows else found
            edge = [np.maximum.reduceat(found, first), np.minimum.reduceat(found, first)] if batch.num_rows else [found, found]
            columns = [batch.column("doc_id"), batch.column("row"), *(pa.array(v, pa.float64()) for v in (mean, *edge))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "mean", "top", "low"])

    judged = tables.stored(texts.mapInArrow(tables.released(judge), "doc_id long, row long, mean double, top double, low double"), "quality-evidence")
    known = judged.join(chosen.where(F.col("fold") == CALIBRATION_FOLD), "doc_id").select("mean", "top", "low", "label").toPandas()
    y = known["label"].to_numpy()
    w = fit_logistic(known[["mean", "top", "low"]].to_numpy(), y).tolist() if 0 < y.sum() < len(y) else [1.0, 0.0, 0.0, 0.0]
    logit = w[0] * F.col("mean") + w[1] * F.col("top") + w[2] * F.col("low") + w[3]
    value = 1 / (1 + F.exp(-F.greatest(F.least(logit, F.lit(500.0)), F.lit(-500.0))))
    scored = judged.select("doc_id", "row", (tables.fold_of() == 0).alias("held_out"), value.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
