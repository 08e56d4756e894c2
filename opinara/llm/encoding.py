"""Token ids of whole texts by the tokenizers library, each distinct word of a batch encoded once.

A text is cut only where both tokenizers always start a new pre-token, so the ids of the pieces, put
one after the other, are the ids of the text. Pieces are looked up among the ones already encoded by
this worker; new ones go to the library together, with a separator between them.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa

SPACES = b" \t\n\v\f\r"
CACHED_PIECES = 250_000  # pieces a worker remembers, some 50 MB; beyond it keeps the more frequent half
RESTING_PIECES = 150_000  # of these it keeps between tasks, again the most frequent
JOINED_PIECES = 64
BLOCK_BYTES = 8 << 20  # text handled at once; a longer text is a block of its own
#: A piece that may be joined with others: an optional space, then printable ASCII or Latin letters.
SIMPLE = re.compile(r" ?[!-~À-ɏ]+")

_space = np.zeros(256, bool)
_space[list(SPACES)] = True
_plain = np.zeros(256, bool)
_plain[0x21:0x7F] = True
_letter = np.zeros(256, bool)
_letter[[*range(65, 91), *range(97, 123)]] = True
_mark = _plain.copy()
_mark[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
_lowered = np.arange(256, dtype=np.uint8)
_lowered[65:91] += 32
_lowered[list(SPACES)] = 32


def cuts(data: np.ndarray) -> np.ndarray:
    """True before each byte that surely starts a pre-token; data are the bytes of joined texts.

    These are: white space behind a visible character, a visible character behind a lone tab or line
    end, and an ASCII mark behind an ASCII letter. A character of two bytes counts as visible unless
    its first byte is C2 (where the wide blanks are); longer ones never count, which is always safe.
    """
    out = np.zeros(len(data), bool)
    if len(data) < 2:
        return out
    space, ahead, behind = _space[data], data[1:], data[:-1]
    visible = _plain[behind]
    visible[1:] |= (behind[1:] >= 0x80) & (behind[:-1] >= 0xC3) & (behind[:-1] <= 0xDF)
    out[1:] = (space[1:] & visible) | (_letter[behind] & _mark[ahead])
    lone = np.flatnonzero(out[:-1] & space[:-1] & (data[:-1] != 32) & _plain[ahead])
    out[lone + 1] = True
    return out


class Encoder:
    """Ids of texts as one flat array and the number of ids of each text.

    A null text has no ids. The strings of special tokens in a text are ordinary text.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a worker per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # Where white space is dropped, line ends can't separate pieces and case is folded.
        self.folds = not self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.separator = self._separator()
        self._start()

    def _separator(self) -> tuple[str, int] | None:
        for mark in ("\n",) if not self.folds else ("£", "©", "®", "°", "€", "…"):
            ids = self.tokenizer.encode(mark, add_special_tokens=False).ids
            if len(ids) == 1:
                return (mark if mark == "\n" else f" {mark} ", ids[0])
        return None

    def _start(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 20, np.uint32)
        self.ends = np.zeros(1 << 18, np.int64)
        self.uses = np.zeros(1 << 18, np.int64)  # how often a piece was met; older uses weigh less
        self.known = 0

    def rest(self) -> None:
        """Between tasks, keep only the most frequent pieces."""
        if self.known > RESTING_PIECES:
            self._forget(RESTING_PIECES)

    def _forget(self, most: int) -> None:
        """Keep the pieces met most often, so many at most; what they were met counts half from now on."""
        uses = self.uses[: self.known]
        stay = np.sort(np.argpartition(-uses, most - 1)[:most]) if self.known > most else np.arange(self.known)
        names = list(self.slots)
        ends = self.ends[: self.known]
        begins = np.append(0, ends[:-1])
        sizes = (ends - begins)[stay]
        upto = np.cumsum(sizes)
        ids = self.ids[np.repeat(begins[stay] - upto + sizes, sizes) + np.arange(upto[-1] if len(upto) else 0)]
        uses = uses[stay] // 2
        self._start()
        self._grow(len(ids), len(stay))
        self.ids[: len(ids)], self.ends[: len(stay)], self.uses[: len(stay)] = ids, upto, uses
        self.slots = {names[k]: n for n, k in enumerate(stay.tolist())}
        self.known = len(stay)

    def _grow(self, ids: int, pieces: int) -> None:
        if ids > len(self.ids):
            self.ids = np.append(self.ids, np.zeros(max(len(self.ids), ids), np.uint32))
        if pieces > len(self.ends):
            more = max(len(self.ends), pieces)
            self.ends, self.uses = np.append(self.ends, np.zeros(more, np.int64)), np.append(self.uses, np.zeros(more, np.int64))

    def _learn(self, pieces: list[bytes]) -> None:
        texts = [p.decode() for p in pieces]
        is_simple = SIMPLE.fullmatch
        joined = [k for k, t in enumerate(texts) if is_simple(t)] if self.separator else []
        mark, mark_id = self.separator or ("", -1)
        groups = [joined[k : k + JOINED_PIECES] for k in range(0, len(joined), JOINED_PIECES)]
        codes = self._encode([mark.join([texts[k] for k in g]) + mark for g in groups])
        ids = np.fromiter(chain.from_iterable(codes), np.uint32, sum(map(len, codes)))
        marks = np.flatnonzero(ids == mark_id)
        if len(marks) != len(joined):  # some piece has the separator's id itself
            joined, ids, marks = [], ids[:0], marks[:0]
        taken = set(joined) if len(joined) < len(texts) else None
        alone = [k for k in range(len(texts)) if k not in taken] if taken is not None else []
        codes = self._encode([texts[k] for k in alone])
        rest = np.fromiter(chain.from_iterable(codes), np.uint32, sum(map(len, codes)))
        sizes = np.append(np.diff(marks, prepend=-1) - 1, np.fromiter(map(len, codes), np.int64, len(codes)))
        start = self.ends[self.known - 1] if self.known else 0
        ends = start + np.cumsum(sizes)
        self._grow(int(ends[-1]), self.known + len(ends))
        self.ids[start : ends[-1]] = np.append(ids[ids != mark_id] if len(marks) else ids, rest)
        self.ends[self.known : self.known + len(ends)] = ends
        self.slots.update(zip([pieces[k] for k in joined + alone], range(self.known, self.known + len(ends)), strict=True))
        self.known += len(ends)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)] if texts else []

    def block(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of one block: data are its bytes, starts the place of each text and the end of the last."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(starts) - 1, np.int64)
        if self.folds:
            data = _lowered[data]
        cut = cuts(data)
        cut[starts[:-1][starts[:-1] < len(data)]] = True
        places = np.append(np.flatnonzero(cut), len(data)).astype(np.int64)
        pieces = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(places) - 1, [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(data))]
        ).dictionary_encode()
        distinct, index = pieces.dictionary.to_pylist(), pieces.indices.to_numpy()
        if self.known + len(distinct) > CACHED_PIECES:
            self._forget(CACHED_PIECES // 2)
        if new := [p for p in distinct if p not in self.slots]:
            self._learn(new)
        slot = np.fromiter(map(self.slots.__getitem__, distinct), np.int64, len(distinct))
        self.uses[slot] += np.bincount(index, minlength=len(slot))
        ends = self.ends[slot]
        begins = np.where(slot > 0, self.ends[slot - 1], 0)
        sizes = (ends - begins)[index]
        upto = np.cumsum(sizes)
        shifts = (begins[index] - upto + sizes).astype(np.int32)
        ids = self.ids[np.repeat(shifts, sizes) + np.arange(upto[-1], dtype=np.int32)]
        before = np.append(0, upto)
        return ids, np.diff(before[np.searchsorted(places, starts)])

    def texts(self, texts: pa.Array):
        """Yields for each block of texts: number of the first, ids of all, count of each."""
        texts = texts.cast(pa.large_string()) if texts.type != pa.large_string() else texts
        texts = texts.fill_null("") if texts.null_count else texts
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK_BYTES, "right")) - 1)
            starts = offsets[first : last + 1]
            ids, counts = self.block(data[starts[0] : starts[-1]], starts - starts[0])
            yield first, ids, counts
            first = last


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and vocabulary; its memory of pieces lives on between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
