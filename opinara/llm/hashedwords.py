"""Words of many texts at once, as 64-bit hashes.

A word is a run of ASCII letters and digits (A-Z read as a-z) and of bytes beyond ASCII. A word's
hash adds up random numbers, one for each byte and place, so equal words have equal hashes and others
differ but for chance of one in 2 ** 64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 4 << 20
_PLACES = 64
_rng = np.random.default_rng(20_011)
_of_byte = _rng.integers(0, (1 << 64) - 1, (_PLACES, 256), np.uint64)
_of_byte[:, 65:91] = _of_byte[:, 97:123]
_in_word = np.zeros(256, bool)
_in_word[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FACTORS = _rng.integers(0, (1 << 63) - 1, 8, np.uint64) * np.uint64(2) + np.uint64(1)


def blocks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of texts: number of the first, hashes of all words, and where each text's words end."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK, "right")) - 1)
        at = offsets[first : last + 1] - offsets[first]
        # A blank behind each text keeps words apart.
        part = np.insert(data[offsets[first] : offsets[last]], at[1:], 32)
        inside = _in_word[part]
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(starts):
            sizes = stops - starts
            letters = part[inside]
            begins = np.cumsum(sizes) - sizes
            place = np.arange(len(letters)) - np.repeat(begins, sizes)
            value = _of_byte.ravel()[(place % _PLACES) * 256 + letters]
            if sizes.max() > _PLACES:
                value = value * (2 * (place // _PLACES) + 1).astype(np.uint64)
            hashes = np.add.reduceat(value, begins)
        else:
            hashes = np.zeros(0, np.uint64)
        yield first, hashes, np.searchsorted(starts, at[1:] + np.arange(1, last - first + 1))
        first = last


def runs(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash for each run of ``length`` neighbouring words."""
    n = len(hashes) - length + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(length if n > 0 else 0):
        out += hashes[k : k + n] * _FACTORS[k]
    return out ^ (out >> np.uint64(29))
