"""Hashed term counts of texts: what Spark's RegexTokenizer and HashingTF give, in a fraction of their time.

Texts whose characters mean the same to Python and to any JVM are cut into words and hashed by numpy, some
megabytes at once. Other texts take Spark's own stages.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.ml import Transformer
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param.shared import HasInputCol, HasNumFeatures, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BREAK = r"[^\p{L}\p{N}_]+"
SHORTEST = 2
DENSE = 1024  # widths up to which all counts of a text are kept; wider ones take Spark's stages
BLOCK = 1 << 18  # bytes of texts in work at once
LONG = 256  # bytes of a word beyond which it is hashed by itself
SEED = 42  # of HashingTF

# Characters outside these ranges, capital sigma and dotted capital i are left to the JVM: later versions of Unicode
# have added letters, and lower case depends on the neighbours.
UNSURE = re.compile(
    "[^\x00-\u012f\u0131-\u02ff\u0391-\u03a1\u03a4-\u03ff\u0400-\u052f\u2000-\u206f\u20a0-\u20bf"
    "\u3041-\u3096\u30a1-\u30fe\u4e00-\u9fef\uac00-\ud7a3]"
)
IN_WORD = np.array([c.isalnum() or c == "_" for c in map(chr, range(1 << 16))])  # of four bytes there are none in the ranges
ASCII_IN_WORD = np.append(IN_WORD[:128], np.zeros(128, bool))


def murmur3(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """MurmurHash3 of 32 bits of pieces of a byte array, behind which there are four more bytes."""
    h = np.full(len(starts), SEED, np.uint32)
    for k in range(0, int(sizes.max(initial=0)) & ~3, 4):
        on = np.flatnonzero(sizes >= k + 4)
        at = starts[on] + k
        h[on] = _turned(h[on] ^ _mixed(_number(words, at, 4)), 13) * np.uint32(5) + np.uint32(0xE6546B64)
    rest, at = sizes & 3, starts + (sizes & ~3)
    h ^= _mixed(_number(words, at, 3) & ((1 << 8 * rest) - 1).astype(np.uint32))
    h ^= sizes.astype(np.uint32)
    h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    return h ^ h >> np.uint32(16)


def _number(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    found = words[at].astype(np.uint32)
    for k in range(1, size):
        found |= words[at + k].astype(np.uint32) << np.uint32(8 * k)
    return found


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint32(by) | x >> np.uint32(32 - by)


def _mixed(k: np.ndarray) -> np.ndarray:
    return _turned(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)


def _long_murmur3(word: bytes) -> int:
    """The same of one word: its blocks follow one another, so plain numbers are quicker than arrays."""
    whole, h = len(word) & ~3, SEED
    for k in np.frombuffer(word[:whole], "<u4") * np.uint32(0xCC9E2D51):
        k = int(k)
        h ^= (k << 15 | k >> 17) * 0x1B873593 & 0xFFFFFFFF
        h = ((h << 13 | h >> 19) & 0xFFFFFFFF) * 5 + 0xE6546B64 & 0xFFFFFFFF
    rest = int.from_bytes(word[whole:], "little") * 0xCC9E2D51 & 0xFFFFFFFF
    h ^= (rest << 15 | rest >> 17) * 0x1B873593 & 0xFFFFFFFF
    h ^= len(word)
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    return h ^ h >> 16


def _word_edges(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words of two or more characters start and how many bytes they have; of UTF-8 without characters of four bytes."""
    inside = ASCII_IN_WORD[text]
    lead = np.flatnonzero(text >= 0xC0)
    if len(lead):
        three = text[lead] >= 0xE0
        first, second, third = text[lead].astype(int), text[lead + 1].astype(int) & 63, text[lead + 2].astype(int) & 63
        lead_in = IN_WORD[np.where(three, (first & 15) << 12 | second << 6 | third, (first & 31) << 6 | second)]
        inside[lead[lead_in]] = inside[lead[lead_in] + 1] = True
        inside[lead[lead_in & three] + 2] = True
    edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    first = text[starts]
    more = sizes > 1 + (first >= 0xC0) + (first >= 0xE0)
    return starts[more], sizes[more]


def counted(texts: list[bytes], width: int) -> np.ndarray:
    """Words per text and bucket."""
    text = np.frombuffer(b" ".join(texts) + b"    ", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    starts, sizes = _word_edges(text)
    hashes = np.empty(len(starts), np.uint32)
    short = sizes <= LONG
    hashes[short] = murmur3(text, starts[short], sizes[short])
    for k in np.flatnonzero(~short):
        hashes[k] = _long_murmur3(text[starts[k] : starts[k] + sizes[k]].tobytes())
    buckets = hashes.view(np.int32).astype(np.int64) % width
    place = np.searchsorted(ends, starts, "right") * width + buckets
    return np.bincount(place, minlength=len(texts) * width).reshape(len(texts), width)


def hashed_counts(width: int):
    """Column function text -> terms per bucket; null for texts that only the JVM can be sure of."""

    @F.arrow_udf("array<float>")
    def count(texts: pa.Array) -> pa.Array:
        full, missing = np.zeros((len(texts), width), np.float32), np.ones(len(texts), bool)
        rows: list[int] = []
        held: list[bytes] = []

        def flush() -> None:
            if rows:
                full[rows], missing[rows] = counted(held, width), False
                rows.clear()
                held.clear()

        size = 0
        for i, text in enumerate(texts.to_pylist()):
            if text is not None and (text.isascii() or not UNSURE.search(text)):
                rows.append(i)
                held.append(text.lower().encode())
                size += len(held[-1])
                if size >= BLOCK:
                    flush()
                    size = 0
        flush()
        offsets = pa.array(np.arange(0, (len(texts) + 1) * width, width, dtype=np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(full.ravel()), mask=pa.array(missing))

    return count


class HashedTerms(Transformer, HasInputCol, HasOutputCol, HasNumFeatures, DefaultParamsReadable, DefaultParamsWritable):
    """Words of two or more letters, digits and underscores in lower case, counted by the bucket of their hash.

    A table that has the counts already keeps them, so that texts need be counted once for the fit and for the vectors.
    """

    def setInputCol(self, name: str) -> HashedTerms:
        return self._set(inputCol=name)

    def setOutputCol(self, name: str) -> HashedTerms:
        return self._set(outputCol=name)

    def setNumFeatures(self, width: int) -> HashedTerms:
        return self._set(numFeatures=width)

    def _counts(self, text: Column) -> Column:
        width = self.getNumFeatures()
        return hashed_counts(width)(F.when(F.is_valid_utf8(text), text)) if width <= DENSE else F.lit(None).cast("array<float>")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if self.getOutputCol() in dataset.columns:
            return dataset
        text, counts = F.col(self.getInputCol()), F.col("_counts")
        rest = F.when(counts.isNull(), text).otherwise("")
        docs = dataset.withColumn("_counts", self._counts(text)).withColumn("_rest", rest)
        words = RegexTokenizer(inputCol="_rest", outputCol="_words", pattern=BREAK, minTokenLength=SHORTEST).transform(docs)
        hashed = HashingTF(inputCol="_words", outputCol="_hashed", numFeatures=self.getNumFeatures()).transform(words)
        vector = F.when(counts.isNotNull(), array_to_vector(counts)).otherwise(F.col("_hashed"))
        return hashed.withColumn(self.getOutputCol(), vector).drop("_counts", "_rest", "_words", "_hashed")
