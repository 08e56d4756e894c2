import hashlib
import random
import re
import zlib

import numpy as np

from opinara.llm import periodic, queries


def runs_of(words, least=24, times=3):
    """All runs, by comparing each word with the ones each period later."""
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = max(j, i) + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def looped(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def random_words(rng):
    out = []
    for _ in range(rng.randint(0, 6)):
        kinds = rng.choice([1, 2, 3, 5, 30])
        unit = [rng.randint(0, kinds) for _ in range(rng.randint(1, 14))]
        out += (unit * rng.randint(1, 8))[: rng.randint(1, 80)]
    return out


def test_runs_of_random_words():
    rng = random.Random(5)
    for _ in range(400):
        texts = [random_words(rng) for _ in range(rng.randint(1, 6))]
        upto = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
        found = periodic.maximal_runs(np.array([w for t in texts for w in t], np.int64), upto)
        text = np.searchsorted(upto, found.start, "right") - 1
        for k, words in enumerate(texts):
            own = zip(found.start[text == k] - upto[k], (found.end - found.start)[text == k], found.period[text == k])
            assert [tuple(map(int, x)) for x in own] == runs_of(words)


def test_rules_stand_for_the_same_words():
    rng = random.Random(6)
    words = np.array([w for _ in range(30) for w in random_words(rng)], np.int64)
    nodes, starts, texts = periodic.repair(words, np.array([0, len(words)]), least=2)
    seen = {}
    for rule, a, m, b in zip(*(x.tolist() for x in nodes)):
        assert a < m < b
        assert seen.setdefault(rule, (m - a, words[a:b].tolist())) == (m - a, words[a:b].tolist())
    assert len(seen) < len(nodes.rule)  # every rule stands twice or more
    assert all((nodes.rule == r).sum() > 1 for r in seen)
    # No pair of what remains stands twice, but for overlaps of equal symbols.
    name = {int(a): (int(r), None) for r, a, b in sorted(zip(nodes.rule, nodes.start, nodes.end), key=lambda x: x[2] - x[1])}
    rest = [name.get(int(a)) if b - a > 1 else (None, int(words[a])) for a, b in zip(starts, [*starts[1:], len(words)])]
    pairs = [(x, y) for x, y in zip(rest, rest[1:]) if x != y]
    assert len(pairs) == len(set(pairs))


def test_long_texts_of_one_word():
    found = periodic.maximal_runs(np.zeros(300_000, np.int64), np.array([0, 300_000]))
    assert [x.tolist() for x in found] == [[0], [0], [300_000], [1]]


def test_false_sums_are_noticed(monkeypatch):
    calls = []

    class Wrong(periodic.Sums):
        def __init__(self, words, attempt):
            super().__init__(words, attempt)
            calls.append(attempt)
            self.attempt = attempt

        def equal(self, at, shift, length):
            return super().equal(at, shift, length) | (self.attempt == 0)

    monkeypatch.setattr(periodic, "Sums", Wrong)
    words = np.array([1, 2] * 20 + [3] * 5 + list(range(4, 60)), np.int64)
    assert [tuple(map(int, x)) for x in zip(*periodic.maximal_runs(words, np.array([0, len(words)]))[1:])] == [(0, 40, 2)]
    assert calls == [0, 1]


def test_op11_against_brute_force(spark, folder, small):
    got = {r.doc_id: r for r in queries.op11_periodic(spark, folder).collect()}
    docs = small["documents"].collect()
    assert len(got) == len(docs)
    some = 0
    for doc in docs:
        words = looped(doc.doc_id, doc.text)
        runs, row = runs_of(words), got[doc.doc_id]
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
        assert (row.n_runs, row.start, row.length, row.period) == (len(runs), *best)
        assert row.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
        some += len(runs)
    assert some > 5


def test_odd_rows(spark, odd, none):
    rows = sorted(periodic.find(odd).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.collapsed))
    assert len(rows) == odd.count() and periodic.find(none).count() == 0
    for row in rows:
        if row.n_words < 24:
            assert row.runs == []
    long = next(r for r in rows if r.doc_id == 4)
    assert [tuple(x) for x in long.runs] == [(0, 80_000, 4)] and long.collapsed == "alpha beta, gamma delta."
    assert next(r for r in rows if r.doc_id == 2).collapsed == ""
    assert periodic.digests(periodic.find(periodic.with_loops(odd))).count() == odd.count()
    assert periodic.digests(periodic.find(periodic.with_loops(none))).count() == 0
