"""Archives, shards and the pipeline."""

import hashlib
import random
import zlib

import pytest

from opinara.llm import sharding, warc

RECORD = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
PAYLOADS = [
    RECORD, RECORD * 3, "WARC/1.1\r\n", "x WARC/1.1\r\nContent-Length: 50\r\n\r\n yy", "é" * 70, "", None, "z" * 99, "z" * 100, "WARC/1.1\r",
    "a\r\n\r\nWARC/1.1\r\nWARC/1.1\r\n" + "q" * 300,
]


def archived(rows):
    first = {}
    for i, _, html in rows:
        body = (html or "").encode()
        if len(body) >= 100 and i is not None:
            first[body] = min(first.get(body, i), i)
    for i, _, html in rows:
        body = (html or "").encode()
        to = first.get(body)
        to = None if to == i else to
        yield i, len(body), hashlib.sha256(body).hexdigest(), "response" if to is None else "revisit", to


@pytest.fixture
def short_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "5k", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_magic_in_payloads(spark, short_ranges):
    draw = random.Random(2)
    rows = [(k, f"http://x/{k}\r\nq", draw.choice([*PAYLOADS, f"w{draw.randrange(5)} " * draw.randrange(1, 300)])) for k in range(120)]
    rows += [(None, None, "z" * 100), (None, None, None), (7, "u", "dup" * 50), (7, "u", "dup" * 50), (9, "u", "dup" * 50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    got = [tuple(r) for r in warc.archive_digests(pages).collect()]
    assert sorted(got, key=repr) == sorted(archived(rows), key=repr)


def test_all_pages(small, spark):
    rows = [tuple(r) for r in small["pages"].select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, warc.archive_digests(small["pages"]).collect())) == sorted(archived(rows))
    empty = spark.createDataFrame([], "page_id long, url string, html string, digest string, first int")
    assert warc.archive_digests(empty).count() == 0


def least_capacity(sizes, shards):
    low, high = max(max(sizes), -(-sum(sizes) // shards)), sum(sizes)
    while low < high:
        middle, used, held = (low + high) // 2, 1, 0
        for size in sizes:
            used, held = (used + 1, size) if held + size > middle else (used, held + size)
        low, high = (low, middle) if used <= shards else (middle + 1, high)
    return low


@pytest.mark.parametrize("groups,shards,hot", [(2000, 24, False), (2000, 24, True), (10, 24, False), (5000, 7, False), (1, 3, False)])
def test_capacity_is_least(spark, groups, shards, hot):
    draw = random.Random(groups)
    keys = sorted(draw.getrandbits(64) - (1 << 63) for _ in range(groups))
    sizes = [draw.randint(8, 3000) for _ in keys]
    if hot:
        sizes[groups // 3] = sum(sizes) // 2
    frame = spark.createDataFrame(list(zip(keys, sizes)), "key long, bytes long")
    cuts = sharding.cut_keys(frame, shards)
    held = [0] * shards
    for key, size in zip(keys, sizes):
        held[sum(c is not None and c <= key for c in cuts)] += size
    assert max(held) == least_capacity(sizes, shards)


def test_shards_of_documents(small, odd, none):
    for docs in (small["documents"], odd):
        got = sharding.assign(docs).collect()
        want = sorted((len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.select("text").collect())
        assert sorted((r.size, r.text_crc32) for r in got) == want
        slots, shards = {}, {}
        for r in got:
            slots.setdefault(r.shard, []).append(r.slot)
            shards.setdefault(r.text_crc32, set()).add(r.shard)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(24))
        assert all(len(s) == 1 for s in shards.values())
    assert sharding.assign(none).count() == 0


def test_written_shards(small, spark, tmp_path):
    sharding.write_shards(small["documents"], f"{tmp_path}/out", 5)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(r.doc_id for r in back.select("document.doc_id").collect()) == sorted(r.doc_id for r in small["documents"].select("doc_id").collect())


def test_pipeline_stages(spark, folder, small, odd, none):
    import corpus_pipeline
    from opinara.llm import decontamination, rules, simhash, tables, toxicity

    docs = small["documents"]
    step = {name: None for name, _ in corpus_pipeline.STAGES}
    for name, stage in corpus_pipeline.STAGES:
        step[name] = docs = tables.stored(stage(spark, docs, folder), "test-stage")
    ids = [{r.doc_id for r in frame.select("doc_id").collect()} for frame in step.values()]
    before = [small["documents"], *step.values()]
    assert all(b <= a for a, b in zip(ids, ids[1:]))
    assert ids[0] == {r.doc_id for r in rules.report(before[0]).where("kept").collect()}
    assert ids[1] == {r.doc_id for r in toxicity.score(before[1], small["labels"]).where("predicted = 0").collect()}
    assert ids[2] == {r.component_id for r in simhash.classes(before[2]).collect()}
    assert ids[3] == ids[2] - {r.doc_id for r in decontamination.matches(before[3], small["benchmark"]).collect()}
    assert ids[4] == ids[3]
    assert all(frame.columns == small["documents"].columns for frame in list(step.values())[:-1])
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, odd, folder).count()
        assert stage(spark, none, folder).count() == 0
