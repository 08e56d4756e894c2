import math
import re
from collections import Counter

import pytest

from opinara.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def brute_force(docs, items, places=10):
    """Each item's (rank, score, doc_id), by scoring every document."""
    counted = [(i, Counter(words(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    number, total = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, tf, n in counted:
            m = 10 + 90 * n * number // total
            score = 0
            for term in set(words(text)):
                weight = math.floor(1000 * math.log((2 * number + 2) / (2 * df[term] + 1)))
                score += weight * (10**9 * tf[term] // (1000 * tf[term] + 8 * m)) if tf[term] else 0
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scores)[:places])]
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def result(frame):
    return ordered(tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in frame.collect())


def test_bytes_are_read_as_characters(spark):
    texts = ["Straße ÄÖ-äö 12x_y\x7fz", "\x00a\tB", "日本 語", "", None]
    frame = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id long, text string")
    terms = {w.encode(): k for k, w in enumerate(sorted({w for t in texts for w in words(t)}))}
    names = {k: w.decode() for w, k in terms.items()}
    for row in lexical.count_terms(frame, terms).collect():
        assert Counter({names[t]: n for t, n in zip(row.terms, row.tfs)}) == Counter(words(texts[row.doc_id]))
        assert row.n == len(words(texts[row.doc_id]))


@pytest.mark.parametrize("places", [1, 10])
def test_against_brute_force(spark, small, monkeypatch, places):
    # Tiny parts, blocks and waves; workers keep the defaults, so blocks are cut small by the session only.
    monkeypatch.setattr(lexical, "PART_TERMS", 150)
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 2)
    docs = small["documents"].select("doc_id", "text").limit(120)
    items = small["benchmark"].select("item_id", "text").limit(8).unionByName(spark.createDataFrame([(1000, "The THE the"), (1001, ""), (1002, None), (None, "of and zzzz")], "item_id long, text string"))
    docs, items = spark.createDataFrame(docs.collect(), "doc_id long, text string"), spark.createDataFrame(items.collect(), "item_id long, text string")
    expected = brute_force([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()], places)
    assert result(lexical.search(docs, items, places)) == ordered(expected)


def test_odd_documents_and_items(spark, odd, none):
    items = [(1, "alpha beta"), (1, "alpha beta"), (2, "nothing here"), (3, "gamma other x éé"), (None, "é" * 300)]
    asked = spark.createDataFrame([(i, t, 1, 2.0, "b") for i, t in items], "item_id long, text string, rank int, score double, block string")
    expected = brute_force([(r.doc_id, r.text) for r in odd.collect()], items)
    assert result(lexical.search(odd, asked)) == ordered(expected)
    assert lexical.search(none, asked).count() == 0
    assert lexical.search(odd, asked.where("item_id = 99")).count() == 0
    assert lexical.search(none, asked).columns == ["item_id", "rank", "doc_id", "score"]
