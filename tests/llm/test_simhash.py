"""Fingerprints, grid join and components against all pairs."""

import re

import numpy as np
import pytest
import xxhash

from opinara.llm import simhash
from opinara.llm.components import components


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 4]).encode(), 42) for k in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(points):
    parent = list(range(len(points)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, j in zip(*np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= 4)):
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(points))]


def test_classes_of_documents(small):
    got = simhash.classes(small["documents"]).collect()
    rows = sorted(small["documents"].select("doc_id", "text").collect())
    prints = np.array([fingerprint(r.text) for r in rows], np.uint64)
    want = [(r.doc_id, int(f.view(np.int64)), rows[k].doc_id) for r, f, k in zip(rows, prints, roots(prints))]
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == want


@pytest.mark.parametrize("segments,block", [(6, 4096), (6, 16), (4, 64)])
def test_links_of_near_points(spark, monkeypatch, segments, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(3)
    points = [0, 15, (1 << 64) - 1]
    for base in rng.integers(0, 1 << 63, 12, np.uint64).tolist():
        for _ in range(25):
            base ^= sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False))
            points.append(base)
    points = np.unique(np.array(points, np.uint64).view(np.int64))
    frame = spark.createDataFrame([(int(p),) for p in points], "fingerprint long")
    found = {r.v: r.root for r in components(simhash.links(frame, segments=segments)).collect()}
    assert [found.get(p, p) for p in points.tolist()] == [points[k] for k in roots(points.view(np.uint64))]


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    found = {r.v: r.root for r in components(links).collect()}
    assert found == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}
    assert components(links.limit(0)).count() == 0


def test_odd_rows(odd, none):
    got = {(r.doc_id, r.fingerprint == 0): r.component_id for r in simhash.classes(odd).collect()}
    assert got[None, True] == 1 and got[1, True] == 1 and got[2, True] == 1 and got[None, False] is None and got[5, False] == 3
    kept = simhash.first_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or 0, len(r.text)) for r in kept.collect()) == [(0, 1), (1, 0), (3, 5), (3, 10), (4, 500_000), (6, 300)]
    assert simhash.classes(none).count() == 0 and simhash.first_of_each(none).count() == 0
