import random

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronopix.llm import packing, planes, tokens

VOCAB = tokens.vocabulary()


@pytest.fixture(scope="module")
def reference():
    """Ids by the tokenizers library."""
    encode = tokens.encoder(VOCAB, "tokenizers")
    return lambda text: [*(encode(text) if text else []), 0]


def test_engines_agree(reference):
    fast = tokens.encoder(VOCAB)
    texts = ["", " ", "  \n\n x", "It's I'LL we've 'd", "<|endoftext|> a", "1234 5.6%", "é ñ 漢字 🙂🙂", " x y 　", "a" * 3000, " " * 500 + "z", "tab\t\ttab \r\n", brute.LONG[:5000]]
    assert [list(fast(t)) + [0] for t in texts] == [reference(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_engines_agree_on_any_text(text):
    assert list(tokens.encoder(VOCAB)(text)) == list(tokens.encoder(VOCAB, "tokenizers")(text))


def test_engines_agree_on_every_code_point():
    fast, slow = tokens.encoder(VOCAB), tokens.encoder(VOCAB, "tokenizers")
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rng = random.Random(1)
    for i in range(0, len(points), 512):
        text = " a".join(points[i : i + 512])
        assert list(fast(text)) == slow(text)
    for _ in range(3000):
        text = "".join(rng.choice([rng.choice(points), rng.choice(" \n\ta1'.")]) for _ in range(rng.randint(1, 40)))
        assert list(fast(text)) == slow(text)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), min_size=1))
def test_patterns_cover_the_histogram(histogram):
    made = {}
    for pattern, count in packing.shortest_pack_first(histogram, 64):
        assert sum(pattern) <= 64 and count > 0
        for n in pattern:
            made[n] = made.get(n, 0) + count
    assert made == histogram


def check_pieces(rows, docs, reference, limit):
    want = sorted((str(r.doc_id), tuple(reference(r.text))) for r in docs.collect())
    spans = {}
    for r in rows:
        assert 0 < r.length <= limit and r.offset + r.length <= limit
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in spans.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
    by_doc = {}
    for r in rows:
        by_doc.setdefault(str(r.doc_id), []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for doc, ids in want:
        for start in range(0, len(ids), limit):
            piece = ids[start : start + limit]
            by_doc[doc].remove((start, len(piece), brute.crc(piece), len(ids)))
    assert not any(by_doc.values())


def test_packing_hard_cases(spark, reference):
    docs = brute.hard_documents(spark)
    packed = packing.pack_documents(docs, limit=64)
    check_pieces(packed.collect(), docs, reference, 64)
    seqs = packing.sequences(packed, 64)
    assert sum(sum(r.lengths) for r in seqs.collect()) == packed.agg({"length": "sum"}).first()[0]
    assert all(len(r.ids) == 64 or len(r.ids) & (len(r.ids) - 1) == 0 for r in seqs.collect())
    assert packing.pack_documents(brute.empty_documents(spark)).collect() == []


def test_padding_is_little(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    packed = packing.pack_documents(docs, with_ids=False)
    used, full = packed.agg({"length": "sum"}).first()[0], packed.select("sequence_id").distinct().count()
    assert 1 - used / (full * 1024) < 0.05


def test_planes_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 8, 1000):
        ids = rng.integers(0, 2**32, n, dtype=np.uint32)
        for bits in (False, True):
            assert (planes.from_planes(planes.to_planes(ids, bits), n, bits) == ids).all()
            f = planes.PlaneFile(planes.encode_file([5, 6], [n, 0], ids, block=64, bits=bits))
            assert (f.ids() == ids).all() and f.doc_ids.tolist() == [5, 6] and f.lengths.tolist() == [n, 0]
            assert (f.range(n // 3, n // 2) == ids[n // 3 : n // 3 + n // 2]).all()


def test_damage_is_noticed():
    content = bytearray(planes.encode_file([1], [500], np.arange(500, dtype=np.uint32) % 7, block=128))
    with pytest.raises(ValueError):
        planes.PlaneFile(b"XXXX" + bytes(content[4:]))
    content[28] ^= 1  # the first block's crc
    with pytest.raises(ValueError):
        planes.PlaneFile(bytes(content)).ids()


def test_store_hard_cases(spark, reference):
    docs = brute.hard_documents(spark)
    store = planes.write_store(docs, bytes_per_bucket=50_000, file_ids=500, block=128)
    rows = planes.read_store(store).collect()
    key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")
    at = 0
    want = []
    for r in sorted(docs.collect(), key=key):
        ids = reference(r.text)
        want.append((r.doc_id, at, len(ids), brute.crc(ids)))
        at += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in sorted(rows, key=lambda r: r.start)] == want
    assert all(brute.crc(np.frombuffer(bytes(r.ids), dtype="<u4")) == r.ids_crc32 for r in rows)
    assert planes.read_store(planes.write_store(brute.empty_documents(spark))).collect() == []


def test_store_of_one_repeated_id(spark, reference):
    """Rows without an id, and of one id, span buckets."""
    docs = brute.documents(spark, [(None, f"some words {i % 3}") for i in range(200)] + [(7, "hot") for _ in range(300)] + [(8, "last")])
    store = planes.write_store(docs, bytes_per_bucket=100, file_ids=50, block=128)
    assert store.files.select("bucket").distinct().count() > 20
    rows = sorted(planes.read_store(store).collect(), key=lambda r: r.start)
    ends = [r.start + r.n_tokens for r in rows]
    assert [r.start for r in rows] == [0, *ends[:-1]] and [r.doc_id for r in rows] == [None] * 200 + [7] * 300 + [8]
    assert {r.ids_crc32 for r in rows[200:500]} == {brute.crc(reference("hot"))}
