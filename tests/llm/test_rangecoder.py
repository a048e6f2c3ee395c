import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siteloom.llm import common, encoding, rangecoder

from .test_dedup import DATA, table


@pytest.mark.parametrize("make", [
    lambda r: np.zeros(0, np.uint32),
    lambda r: np.zeros(5000, np.uint32),
    lambda r: r.integers(0, 50257, 5000),
    lambda r: r.integers(0, 1 << 17, 3000),
    lambda r: np.full(1024, (1 << 17) - 1),
    lambda r: np.tile(r.integers(0, 60000, 37), 200),
    lambda r: r.zipf(1.3, 9000) % 50257,
    lambda r: np.array([65534, 65535, 65536, 65537, 0, 1, 2, 3]),
])
def test_exact_round_trip(make):
    ids = make(np.random.default_rng(0)).astype(np.uint32)
    assert np.array_equal(rangecoder.decoded(rangecoder.encoded(ids)), ids)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, (1 << 17) - 1) | st.integers(0, 3), max_size=200), st.integers(1, 50))
def test_round_trip_of_any_ids(ids, block):
    ids = np.array(ids, np.uint32)
    assert np.array_equal(rangecoder.decoded(rangecoder.encoded(ids, block)), ids)


def test_blocks_stand_alone_and_notice_damage():
    ids = (np.random.default_rng(1).zipf(1.5, 10_000) % 50257).astype(np.uint32)
    blob = bytearray(rangecoder.encoded(ids, 1000))
    assert np.array_equal(rangecoder.decoded(bytes(blob), range(3, 5)), ids[3000:5000])
    blob[-1] ^= 1
    assert np.array_equal(rangecoder.decoded(bytes(blob), range(0, 9)), ids[:9000])
    with pytest.raises(rangecoder.Corrupt, match="block 9"):
        rangecoder.decoded(bytes(blob))
    blob[60] ^= 1
    with pytest.raises(rangecoder.Corrupt, match="head"):
        rangecoder.decoded(bytes(blob), range(0, 1))
    with pytest.raises(ValueError):
        rangecoder.encoded(np.array([1 << 17]))


def test_predictions_save_space():
    rng = np.random.default_rng(2)
    plain = rng.integers(0, 50257, 1 << 16).astype(np.uint32)
    repeated = np.tile(rng.integers(0, 50257, 64), 1 << 10).astype(np.uint32)
    after_one = np.zeros(1 << 16, np.uint32)
    follow = rng.permutation(128)
    for i in range(1, len(after_one)):
        after_one[i] = follow[after_one[i - 1]] if rng.random() < 0.9 else rng.integers(0, 128)
    size = [len(rangecoder.encoded(x)) / len(x) for x in (plain, repeated, after_one)]
    assert size[0] < 2.2 and size[1] < 0.4 and size[2] < 0.9


def test_fewer_bits_than_zlib_on_real_ids(spark):
    texts = [(r.text or "").encode() for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()]
    ids = encoding.encoder(encoding.vocabulary()).encode_all(texts, 0)[0][: 1 << 18]
    blob = rangecoder.encoded(ids)
    small = ids.astype("<u2").tobytes()
    by_block = sum(len(zlib.compress(small[a : a + 2 * rangecoder.BLOCK], 9)) for a in range(0, len(small), 2 * rangecoder.BLOCK))
    assert len(blob) < 0.85 * by_block and len(blob) < len(zlib.compress(small, 9))
    assert np.array_equal(rangecoder.decoded(blob), ids)


def test_order_0_follows_its_block():
    """Ids that keep company get likelier in blocks that hold them, without any repeated pair."""
    rng = np.random.default_rng(4)
    apart = np.concatenate([rng.integers(0, 2000, rangecoder.BLOCK) + 2000 * (i % 8) for i in range(512)]).astype(np.uint32)
    assert len(rangecoder.encoded(apart)) < 0.93 * len(rangecoder.encoded(rng.permutation(apart)))


def want(rows, encode):
    out, start = {}, 0
    for d, t in sorted(rows, key=lambda r: r[0]):
        raw = encode(t or "") + b"\0\0\0\0"
        out[d] = (start, len(raw) // 4, zlib.crc32(raw))
        start += len(raw) // 4
    return out


def test_query_reads_back_what_the_library_gives(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(encoding.vocabulary())
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    encode = lambda t: np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    got = rangecoder.query(spark, DATA).collect()
    assert len(got) == len(rows) and {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want(rows, encode)


def test_small_chunks_nulls_and_repeats(spark):
    texts = [None, "", "a b", "word " * 3000, "", "é"]
    df = table(spark, texts)
    path = encoding.vocabulary()
    got = rangecoder.read_documents(common.stored(rangecoder.shards(df, chunk=700, block=50), "t")).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want(list(enumerate(texts)), encoding.encoder(path).encode)
    both = df.union(df).union(df.limit(1).selectExpr("cast(null as long)", "text", "fp", "h", "lang"))
    rows = sorted(rangecoder.read_documents(common.stored(rangecoder.shards(both), "t")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, *sorted([*range(6), *range(6)])]
    assert all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:])) and rows[0].start == 0
    assert rangecoder.read_documents(common.stored(rangecoder.shards(table(spark, [])), "t")).count() == 0
