"""Periodic runs of words, found on a grammar of each text.

A run is a stretch of neighbouring words in which words a period apart are equal, which no neighbour
extends, and which is long enough. Re-Pair replaces pairs of neighbouring symbols that stand twice or
more in a text by a rule, the most frequent first, until no pair repeats; in a round all pairs are
replaced that are more frequent than the pairs overlapping them, so the most frequent pair of each text
always is. What remains of a text is joined by a balanced tree whose nodes occur once. Every run crosses
the boundary between the two parts of some node and lies within it: the lowest one that covers it. So
each rule and node is searched once, at one place where it stands, for runs across its boundary; runs of
a rule are carried to all places where the rule stands; and of runs with the same period only those that
lie in no other remain.

A run across a boundary has a period of words on one side of it, so for each possible period one
comparison there decides whether to look further. Runs are extended by comparing sums of powers modulo
two primes, and compared word by word at the end.

Texts are handled in blocks of ``BLOCK`` bytes, a longer one alone. A word takes some 150 bytes while
its block is in work, also in a text of any length.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.llm import tables

LEAST = 24  # words of a run
TIMES = 3  # periods of a run
BLOCK = 2 << 20
CANDIDATES = 1 << 20  # pairs of node and period in work at once
NEAR = 16  # words compared one by one before sums of powers are
PRIMES = (2_147_483_629, 2_147_483_587)
WORD = r"[^\x20\x09-\x0D]+"
RUN = "struct<start: bigint, length: bigint, period: bigint>"

_space = np.zeros(256, bool)
_space[[32, *range(9, 14)]] = True


class Words(NamedTuple):
    """The words of a block of texts."""

    data: np.ndarray  # bytes of all words, a blank behind each
    ends: np.ndarray  # where each word and its blank end
    names: np.ndarray  # a number for each word, equal for equal ones
    upto: np.ndarray  # the words of all texts up to each, starting with 0


class Nodes(NamedTuple):
    """Places of two neighbouring parts; those of one rule have the same number."""

    rule: np.ndarray
    start: np.ndarray
    middle: np.ndarray
    end: np.ndarray


class Runs(NamedTuple):
    node: np.ndarray
    start: np.ndarray
    end: np.ndarray
    period: np.ndarray

    def take(self, at: np.ndarray) -> Runs:
        return Runs(*(x[at] for x in self))


def blocks(texts: pa.Array) -> Iterator[tuple[int, Words]]:
    """Blocks of texts: number of the first text, and all words."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK, "right")) - 1)
        at = offsets[first : last + 1] - offsets[first]
        part = np.insert(data[offsets[first] : offsets[last]], at[1:], 32)
        blank = _space[part]
        behind = blank.copy()
        behind[0] = False
        behind[1:] &= ~blank[:-1]  # the first blank behind a word
        part[behind] = 32
        ends = np.cumsum(~blank | behind)[behind]
        upto = np.append(0, np.searchsorted(np.flatnonzero(behind), at[1:] + np.arange(1, last - first + 1)))
        packed = part[~blank | behind]
        places = np.append(0, ends)
        named = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(places), pa.py_buffer(packed)]).dictionary_encode()
        yield first, Words(packed, ends, named.indices.to_numpy(zero_copy_only=False), upto)
        first = last


def _streak_places(same: np.ndarray) -> np.ndarray:
    """For each element its place in its streak; ``same`` says that it goes on from the one before."""
    at = np.arange(len(same))
    return at - np.maximum.accumulate(np.where(same, 0, at))


def repair(symbols: np.ndarray, upto: np.ndarray, least: int = LEAST) -> tuple[Nodes, np.ndarray, np.ndarray]:
    """The places of all rules of ``least`` words and more; start and text of each symbol that remains.

    ``symbols`` are numbers from 0 that no two texts share, ``upto`` where the texts end, 0 first.
    """
    count = int(symbols.max()) + 1 if len(symbols) else 0
    symbols, start = symbols.astype(np.int64), np.arange(len(symbols))
    text = np.repeat(np.arange(len(upto) - 1), np.diff(upto))
    none = np.zeros(0, np.int64)
    made, left = [Nodes(none, none, none, none)], [(none, none)]
    while len(symbols):
        last = np.append(text[1:] != text[:-1], True)
        pairs = np.flatnonzero(~last)
        keys = symbols[pairs] * count + symbols[pairs + 1]
        again = np.zeros(len(pairs), bool)  # the pair overlaps an equal one before it
        again[1:] = (np.diff(pairs) == 1) & (np.diff(keys) == 0)
        own = _streak_places(again) % 2 == 0
        pairs, keys = pairs[own], keys[own]
        order = np.argsort(keys)
        ranked = keys[order]
        heads = np.flatnonzero(np.diff(ranked, prepend=-1))
        sizes = np.diff(np.append(heads, len(ranked)))
        group = np.empty(len(keys), np.int64)
        group[order] = np.repeat(np.arange(len(heads)), sizes)
        # More frequent pairs first; a scrambled number of the pair decides among equally frequent ones.
        scrambled = (ranked[heads].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(34)
        weight = np.zeros(len(symbols) + 2, np.int64)
        weight[pairs + 1] = np.where(sizes > 1, (sizes << 31) + scrambled.astype(np.int64), 0)[group]
        here = weight[pairs + 1]
        taken = np.flatnonzero((here > weight[pairs]) & (here >= weight[pairs + 2]))
        taken = taken[np.bincount(group[taken], minlength=len(heads))[group[taken]] > 1]
        at = pairs[taken]
        used = np.zeros(len(heads), bool)
        used[group[taken]] = True
        rule = count + (np.cumsum(used) - 1)[group[taken]]
        stop = np.append(start[1:], 0)
        stop[last] = upto[text[last] + 1]
        nodes = Nodes(rule, start[at], start[at + 1], stop[at + 1])
        made.append(Nodes(*(x[nodes.end - nodes.start >= least] for x in nodes)))
        symbols[at] = rule
        count += int(used.sum())
        stays = np.ones(len(symbols), bool)
        stays[at + 1] = False
        busy = np.zeros(len(upto) - 1, bool)
        busy[text[at]] = True
        done = ~busy[text]
        left.append((start[done], text[done]))
        stays &= ~done
        symbols, start, text = symbols[stays], start[stays], text[stays]
    starts, texts = (np.concatenate(x) for x in zip(*left, strict=True))
    order = np.argsort(starts)
    return Nodes(*(np.concatenate(x) for x in zip(*made, strict=True))), starts[order], texts[order]


def tree(starts: np.ndarray, texts: np.ndarray, upto: np.ndarray, least: int = LEAST) -> Nodes:
    """Nodes of balanced trees over what remains of each text; their rules have numbers below 0."""
    first = np.searchsorted(texts, texts)
    place = np.arange(len(starts)) - first
    after = np.searchsorted(texts, texts, "right")
    made, half = [], 1
    while half < (place.max() + 1 if len(place) else 0):
        middle = np.flatnonzero(place % (2 * half) == half)
        begin, end = starts[middle - half], middle + half
        inside = end < after[middle]
        end = np.where(inside, starts[np.minimum(end, len(starts) - 1)], upto[texts[middle] + 1])
        wide = end - begin >= least
        made.append((begin[wide], starts[middle][wide], end[wide]))
        half *= 2
    begin, middle, end = (np.concatenate(x) for x in zip(*made, strict=True)) if made else [np.zeros(0, np.int64)] * 3
    return Nodes(-1 - np.arange(len(begin)), begin, middle, end)


class Sums:
    """Sums of words times powers, modulo two primes, to compare stretches of any length."""

    def __init__(self, words: np.ndarray, attempt: int) -> None:
        rng = np.random.default_rng([11, attempt])
        self.powers, self.sums = [], []
        for prime in PRIMES:
            base, size = int(rng.integers(1 << 20, prime - 1)), 1
            power = np.ones(len(words) + 1, np.int64)
            while size < len(power):
                step = pow(base, size, prime)
                power[size : 2 * size] = power[: min(size, len(power) - size)] * step % prime
                size *= 2
            self.powers.append(power)
            self.sums.append(np.append(0, np.cumsum((words.astype(np.int64) + 1) * power[:-1] % prime) % prime))

    def equal(self, at: np.ndarray, shift: np.ndarray, length: np.ndarray) -> np.ndarray:
        out = np.ones(len(at), bool)
        for prime, power, sums in zip(PRIMES, self.powers, self.sums, strict=True):
            near, far = sums[at + length] - sums[at], sums[at + shift + length] - sums[at + shift]
            out &= near % prime * power[shift] % prime == far % prime
        return out

    def ahead(self, at: np.ndarray, shift: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words from ``at`` on are equal to those ``shift`` later, ``most`` at most."""
        low, high = np.zeros(len(at), np.int64), most.copy()
        while (low < high).any():
            half = (low + high + 1) // 2
            same = self.equal(at, shift, half)
            low, high = np.where(same, half, low), np.where(same, high, half - 1)
        return low

    def behind(self, at: np.ndarray, shift: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words before ``at`` are equal to those ``shift`` later, ``most`` at most."""
        low, high = np.zeros(len(at), np.int64), most.copy()
        while (low < high).any():
            half = (low + high + 1) // 2
            same = self.equal(at - half, shift, half)
            low, high = np.where(same, half, low), np.where(same, high, half - 1)
        return low


def crossing(words: np.ndarray, nodes: Nodes, sums: Sums | None = None, least: int = LEAST, times: int = TIMES) -> Runs:
    """The runs across the boundary of each node, as far as they lie within it, by their smallest period."""
    most = (nodes.end - nodes.start) // times
    sides = []
    for left in (True, False):
        # On the longer of its two sides a run has a period at least.
        tried = np.minimum(most, nodes.middle - nodes.start if left else nodes.end - nodes.middle)
        upto = np.append(0, np.cumsum(tried))
        first = 0
        while first < len(tried):
            last = max(first + 1, int(np.searchsorted(upto, upto[first] + CANDIDATES, "right")) - 1)
            node = np.repeat(np.arange(first, last), tried[first:last])
            period = np.arange(len(node)) - (upto[node] - upto[first]) + 1
            at = nodes.middle[node] - (period if left else 1)
            same = np.flatnonzero(words[at] == words[at + period])
            sides.append(_long_enough(words, nodes, node[same], period[same], at[same]))
            first = last
    node, period, at = (np.concatenate(x) for x in zip(*sides, strict=True)) if sides else [np.zeros(0, np.int64)] * 3
    if not len(node):
        return Runs(node, node, node, node)
    sums = sums or Sums(words, 0)
    end = at + sums.ahead(at, period, nodes.end[node] - period - at) + period
    start = at - sums.behind(at, period, at - nodes.start[node])
    fits = np.flatnonzero(end - start >= np.maximum(least, times * period))
    return _smallest(Runs(node, start, end, period).take(fits))


def _long_enough(words: np.ndarray, nodes: Nodes, node: np.ndarray, period: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words equal to those a period later, the ones among ``NEAR`` neighbouring ones that are."""
    top = nodes.end[node] - period
    low = nodes.start[node]
    length = np.ones(len(node), np.int64)
    for step in (1, -1):
        alive = np.arange(len(node))
        for k in range(1, NEAR):
            to = at[alive] + step * k
            inside = (to < top[alive]) & (to >= low[alive])
            alive, to = alive[inside], to[inside]
            alive = alive[words[to] == words[to + period[alive]]]
            length[alive] += 1
            if not len(alive):
                break
    stay = np.flatnonzero(length >= NEAR)
    return node[stay], period[stay], at[stay]


def _smallest(runs: Runs) -> Runs:
    """One run for each stretch of a node, that with the smallest period."""
    runs = runs.take(np.lexsort((runs.period, runs.end, runs.start, runs.node)))
    new = np.ones(len(runs.node), bool)
    new[1:] = (np.diff(runs.node) != 0) | (np.diff(runs.start) != 0) | (np.diff(runs.end) != 0)
    return runs.take(np.flatnonzero(new))


def carried(runs: Runs, one: Nodes, places: Nodes) -> Runs:
    """Runs of the nodes ``one``, each the only one of its rule, at all places of their rules."""
    order = np.argsort(places.rule, kind="stable")
    ranked = places.rule[order]
    low, high = (np.searchsorted(ranked, one.rule[runs.node], side) for side in ("left", "right"))
    each = high - low
    run = np.repeat(np.arange(len(each)), each)
    place = order[np.arange(len(run)) - np.repeat(np.cumsum(each) - each, each) + low[run]]
    shift = places.start[place] - one.start[runs.node[run]]
    return Runs(np.zeros(len(run), np.int64), runs.start[run] + shift, runs.end[run] + shift, runs.period[run])


def merged(runs: Runs) -> Runs:
    """The maximal ones among runs of the same period, by start and period."""
    runs = runs.take(np.lexsort((-runs.end, runs.start, runs.period)))
    if not len(runs.node):
        return runs
    # The furthest end of the runs before, of the same period.
    wide = int(runs.end.max()) + 1
    number = np.cumsum(np.diff(runs.period, prepend=runs.period[0]) != 0)
    far = np.maximum.accumulate(number * wide + runs.end)
    runs = runs.take(np.flatnonzero(number * wide + runs.end > np.append(-1, far[:-1])))
    return _smallest(runs)


def maximal_runs(words: np.ndarray, upto: np.ndarray, least: int = LEAST, times: int = TIMES) -> Runs:
    """All runs of texts given as one array of word numbers; ``upto`` says where the texts end, 0 first."""
    text = np.repeat(np.arange(len(upto) - 1), np.diff(upto))
    distinct = int(words.max()) + 1 if len(words) else 1
    pairs = text * distinct + words
    order = np.argsort(pairs)
    symbols = np.empty(len(words), np.int64)
    symbols[order] = np.cumsum(np.diff(pairs[order], prepend=pairs[order[:1]]) != 0)
    places, starts, texts = repair(symbols, upto, least)
    _, first = np.unique(places.rule, return_index=True)
    rest = tree(starts, texts, upto, least)
    one = Nodes(*(np.append(x[first], y) for x, y in zip(places, rest, strict=True)))
    places = Nodes(*(np.append(x, y) for x, y in zip(places, rest, strict=True)))
    for attempt in itertools.count():
        found = crossing(words, one, Sums(words, attempt) if attempt else None, least, times)
        found = merged(carried(found, one, places))
        if all(np.array_equal(words[s : e - q], words[s + q : e]) for _, s, e, q in zip(*(x.tolist() for x in found), strict=True)):
            return found


def _report(times: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, block in blocks(batch.column("text")):
                found = maximal_runs(block.names, block.upto, least, times)
                dropped = np.zeros(len(block.names) + 1, np.int64)
                np.add.at(dropped, found.start + found.period, 1)
                np.add.at(dropped, found.end, -1)
                keeps = np.cumsum(dropped)[:-1] == 0
                sizes = np.diff(block.ends, prepend=0)
                data = block.data[np.repeat(keeps, sizes)]
                ends = np.append(0, np.cumsum(np.where(keeps, sizes, 0)))[block.upto]
                # Without the blank behind the last word of each text.
                trims = np.flatnonzero(np.diff(ends))
                collapsed = np.delete(data, ends[1:][trims] - 1)
                gone = np.zeros(len(ends), np.int64)
                gone[1:][trims] = 1
                offsets = ends - np.cumsum(gone)
                text = np.searchsorted(block.upto, found.start, "right") - 1
                runs = pa.StructArray.from_arrays([pa.array(x) for x in (found.start - block.upto[text], found.end - found.start, found.period)], ["start", "length", "period"])
                each = np.append(0, np.cumsum(np.bincount(text, minlength=len(block.upto) - 1))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, len(block.upto) - 1),
                        pa.array(np.diff(block.upto)),
                        pa.ListArray.from_arrays(pa.array(each), runs),
                        pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(collapsed)).cast(pa.string()),
                    ],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    return run


def find(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed of every document.

    A run has ``least`` words and ``times`` periods at least. ``collapsed`` is the text, its words joined by
    one blank, without the words that some run repeats. A null, empty or blank text has no words, no
    runs and collapses to an empty text. Repeated rows and rows without an id are rows like others; other
    columns are not looked at. An empty table gives no rows.
    """
    if least < NEAR + least // times or times < 2:
        raise ValueError(f"a run must be longer than its period by {NEAR} words, and have two periods")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tables.text_of().alias("text"))
    return narrow.mapInArrow(tables.released(_report(times, least)), f"doc_id long, n_words long, runs array<{RUN}>, collapsed string")


def _longest(runs: Column) -> Column:
    """The run with most periods, of these the first, then that with the smallest period; null without runs."""
    more = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    return F.aggregate(runs, F.lit(None).cast(RUN), lambda best, run: F.when(best.isNull() | more(run, best), run).otherwise(best))


def with_loops(docs: DataFrame) -> DataFrame:
    """doc_id and text; in one of ten texts, by the checksum of the id, words from some place on go round.

    Where crc32 of the id as text (empty for a null id) ends on 0, with g that number without its last
    digit and n the words, the words from a = g mod n on repeat those of one period, 1 + (n - a) div (3 + g
    mod 8). Other texts, and those without words, stay as they are.
    """
    code = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.regexp_extract_all(tables.text_of(), F.lit(WORD), F.lit(0))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tables.text_of().alias("text"), F.when(code % 10 == 0, words).alias("w"), F.floor(code / 10).alias("g"))
    n = F.size("w").cast("long")
    narrow = narrow.withColumn("n", F.when(n > 0, n)).withColumn("a", F.col("g") % F.col("n"))
    narrow = narrow.withColumn("p", 1 + F.expr("(n - a) div (3 + g % 8)"))
    looped = F.expr("array_join(transform(sequence(0L, n - 1L), i -> element_at(w, cast(1 + if(i < a, i, a + (i - a) % p) as int))), ' ')")
    return narrow.select("doc_id", F.when(F.col("n").isNotNull(), looped).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """What ``find`` returns, as counts, the run with most periods and checksums."""
    best = found.select("doc_id", "runs", "collapsed", _longest(F.col("runs")).alias("best"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000L * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
