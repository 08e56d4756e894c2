"""Encoding, packing and token files against the library itself and plain loops."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from opinara.llm import encoding, packing, token_files

ALPHABET = list(" \t\n  'sdlt,.!aA1éÉ\u0301\x1c£%🙂İ\u00a0")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_librarys(name):
    own = encoding.Encoder(encoding.tokenizer_file(name))
    draw = random.Random(5)
    texts = ["", "a  b\n\n\nc", "it's  don't's", "tab\t\tb\r\nq", "<|endoftext|> hi", "İx 12 a1.2", " lead", "trail  ", "£ £ a"]
    texts += ["".join(draw.choices(ALPHABET, k=draw.randrange(30))) for _ in range(3000)]
    got = []
    for _, ids, counts in own.texts(pa.array([*texts, None])):
        got += [x.tolist() for x in np.split(ids, np.cumsum(counts))[:-1]]
    want = [x.ids for x in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert got == [*want, []]


def test_forgetting_keeps_ids(monkeypatch):
    monkeypatch.setattr(encoding, "CACHED_PIECES", 50)
    monkeypatch.setattr(encoding, "BLOCK_BYTES", 200)
    own = encoding.Encoder(encoding.tokenizer_file("byte_bpe_50k.json"))
    texts = [f"word{n % 37} and other{n} the" for n in range(200)]
    got = []
    for _, ids, counts in own.texts(pa.array(texts)):
        got += [x.tolist() for x in np.split(ids, np.cumsum(counts))[:-1]]
    assert got == [x.ids for x in own.tokenizer.encode_batch(texts, add_special_tokens=False)]


def library_ids(name, text, end):
    own = encoding.encoder(encoding.tokenizer_file(name)).tokenizer
    return [*own.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_round_trip(small, odd, monkeypatch):
    path = encoding.tokenizer_file("word_bpe_49k.json")
    for docs in (small["documents"], odd):
        got = [tuple(r) for r in token_files.token_file_digests(docs, path).collect()]
        rows = docs.select("doc_id", "text").collect()
        assert sorted((r[0] is not None, r[0] or 0, r[2], r[3]) for r in got) == sorted(
            (r.doc_id is not None, r.doc_id or 0, len(i), crc(i)) for r in rows for i in [library_ids("word_bpe_49k.json", r.text, 2)]
        )
        start = 0
        for r in sorted(got, key=lambda r: r[1]):
            assert r[1] == start
            start += r[2]
        ids = [r[0] for r in sorted(got, key=lambda r: r[1])]
        assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))


def test_many_shards_and_segments(small, monkeypatch):
    want = sorted(map(tuple, token_files.token_file_digests(small["documents"], encoding.tokenizer_file("word_bpe_49k.json")).collect()))
    monkeypatch.setattr(token_files, "SHARD", 20_000)
    monkeypatch.setattr(token_files, "SEGMENT", 3_000)
    assert sorted(map(tuple, token_files.token_file_digests(small["documents"], encoding.tokenizer_file("word_bpe_49k.json")).collect())) == want


def test_no_documents(none):
    assert token_files.token_file_digests(none, encoding.tokenizer_file("word_bpe_49k.json")).count() == 0
    assert packing.pack_documents(none, encoding.tokenizer_file("byte_bpe_50k.json")).count() == 0


def test_code_is_limited_and_complete():
    counts = {k: 1 << min(k, 40) for k in range(50)}
    lengths = token_files.code_lengths(counts, 8)
    assert max(lengths.values()) <= 8 and sum(2.0 ** -b for b in lengths.values()) == 1
    free = token_files.code_lengths({k: n for k, n in enumerate([5, 9, 12, 13, 16, 45])}, 16)
    assert sum(n * free[k] for k, n in enumerate([5, 9, 12, 13, 16, 45])) == 224
    assert token_files.code_lengths({}) == {} and token_files.code_lengths({7: 3}) == {7: 1}


def test_pieces_and_places(small, odd):
    path = encoding.tokenizer_file("byte_bpe_50k.json")
    for docs in (small["documents"], odd):
        got = packing.pack_documents(docs, path).collect()
        want = []
        for r in docs.select("doc_id", "text").collect():
            ids = library_ids("byte_bpe_50k.json", r.text, 0)
            first = len(ids) if len(ids) <= 2048 else len(ids) % 2048 or 2048
            edges = [0, *range(first, len(ids) + 1, 2048)]
            want += [(r.doc_id or -1, n, a, b - a, crc(ids[a:b])) for n, (a, b) in enumerate(zip(edges, edges[1:]))]
        assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
        bins = {}
        for r in got:
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for places in bins.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 2048
        assert len(bins) <= -(-sum(r.length for r in got) // 2048) + 1


def test_sequences_hold_the_ids(spark, small):
    # Repeated ids and rows are documents of their own.
    docs = small["documents"].where("doc_id < 20").select("doc_id", "text")
    docs = docs.unionByName(docs.where("doc_id < 4")).unionByName(spark.createDataFrame([(1, "other words"), (None, None)], docs.schema))
    packed = packing.pack_documents(docs, encoding.tokenizer_file("byte_bpe_50k.json"), with_ids=True)
    rows = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packed).collect()}
    got = packed.collect()
    for r in got:
        assert rows[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)
    assert sum(map(len, rows.values())) == 4 * sum(r.length for r in got)
    encoder = encoding.encoder(encoding.tokenizer_file("byte_bpe_50k.json"))
    whole = sorted(sum((encoder.tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0] for r in docs.collect()), []))
    assert sorted(np.frombuffer(b"".join(rows.values()), "<u4").tolist()) == whole


def test_encoder_keeps_frequent_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(encoding, "RESTING_PIECES", 50)
    own = encoding.Encoder(encoding.tokenizer_file("byte_bpe_50k.json"))
    text = " ".join(["often"] * 9 + [f"word{k}" for k in range(300)])
    expected = own.tokenizer.encode(text, add_special_tokens=False).ids
    for _ in range(3):
        (_, ids, counts), = own.texts(pa.array([text]))
        assert ids.tolist() == expected and counts.tolist() == [len(expected)]
        own.rest()
        assert own.known == 50 == len(own.slots) and b" often" in own.slots
    uses = own.uses[own.slots[b" often"]]
    own.rest()
    assert own.known == 50 and own.uses[own.slots[b" often"]] == uses


@pytest.mark.parametrize("low,high", [(300, 1500), (900, 2047), (600, 800)])
def test_local_search(low, high):
    lengths = np.random.default_rng(low).integers(low, high, 600).tolist()
    first = packing.best_fit(lengths, 2048)
    better = packing.improve(first, lengths, 2048)
    assert sorted(k for b in better for k in b) == list(range(600))
    assert max(sum(lengths[k] for k in b) for b in better) <= 2048 and len(better) <= len(first)


def test_swaps_save_a_bin():
    # Best fit leaves three bins; one exchange of one for one makes two.
    lengths = [6, 4, 5, 5]
    assert len(packing.improve([[0], [1, 2], [3]], lengths, 10)) == 2
