import numpy as np
import pyarrow as pa

from opinara.llm import toxicity


def test_unseen_expressions_take_no_foreign_ratio():
    draw = np.random.default_rng(4)
    letters = draw.integers(14, 27, (1 << 20, toxicity.ORDER)).astype(np.int64)
    codes = np.unique((letters << 8 * np.arange(toxicity.ORDER)[::-1]).sum(axis=1))
    own = toxicity.Scorer(toxicity.slot_of(codes), np.full(len(codes), 8.0, np.float32))
    unseen = "".join(chr(97 + k) for k in draw.integers(0, 13, 20_000))
    seen = "".join(chr(96 + k) for k in letters[0])
    assert own.evidence(pa.array([unseen, seen], pa.large_string()))[:, 0].tolist() == [0, 0.5]


def test_parts_score_alike(spark, small, monkeypatch):
    docs, labels = small["documents"], small["labels"]
    want = sorted((r.doc_id, r.score) for r in toxicity.score(docs, labels).collect())
    monkeypatch.setattr(toxicity, "PART", 20_000)
    assert len(toxicity.fit(docs, labels).table) > 1
    assert sorted((r.doc_id, r.score) for r in toxicity.score(docs, labels).collect()) == want
