import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from siteloom.llm import encoding, packing

from .test_dedup import DATA, table


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(encoding.vocabulary())
    return t


ODD = [
    "",
    " ",
    "  ",
    " a",
    "a ",
    "a  b",
    "a   b \n\n c\t d\n",
    "it's we'll I'd 'tis ''s",
    "x y  z   w",
    "naïve Übung 漢字 かな 𝒳 👩‍👩‍👧 é",
    "\x1c\x1d a\x1fb \x85 c",
    "<|endoftext|> and<|endoftext|>",
    "a <|endoftext|> b",
    "a" * 5000 + " " + "é" * 3000,
    "line\nnext\n\nafter\n x \ny\n\tz",
    "é,è. ü! ×, ÷. É\nÈ x×, a\u00a0 b\u3000 c \u2028d\u0085 e",
    "Ž, ǆ. ɏ; ʰ, ̈a,",
    "0123 45６ ⅷ ² x²y",
    "tab\tand\r\nline \r\n  end  ",
]


def test_encoder_equals_the_library(spark, tokenizer):
    texts = ODD + [r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    encode = encoding.Encoder(encoding.vocabulary()).encode
    for t, want in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(encode(t), np.uint32).tolist() == want.ids, t[:80]


def check(rows, texts, tokenizer):
    """Every piece is right and every sequence is gapless and within its capacity."""
    want = {}
    for d, t in texts:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], np.uint32)
        for k, (s, n) in enumerate(packing.cuts(len(ids))):
            want[d, k] = (s, n, zlib.crc32(ids[s : s + n].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        end = 0
        for o, n in sorted(b):
            assert o == end
            end += n
        assert end <= 1024
    return len(bins), sum(n for _, n, _ in want.values())


def test_packing_is_whole_and_tight(spark, tokenizer):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    bins, tokens = check(packing.query(spark, "/root/testdata/sf0.01").collect(), texts, tokenizer)
    assert bins <= 1.003 * -(-tokens // 1024) + 2


def test_packing_edge_cases(spark, tokenizer):
    texts = [None, "", "word " * 5000, "x", *ODD]
    df = table(spark, texts)
    check(packing.stage(spark, df, "").collect(), list(enumerate(texts)), tokenizer)
    assert packing.stage(spark, df.union(df), "").count() == 2 * packing.stage(spark, df, "").count()
    assert packing.stage(spark, table(spark, []), "").count() == 0


def test_repair_saves_bins_and_keeps_items():
    rng = np.random.default_rng(6)
    saved = 0
    for _ in range(30):
        items = -np.sort(-rng.integers(1, 101, 300))
        bins, offsets, made = packing.sum_of_squares(items, 100)
        new, at, n = packing.repaired(items, bins, offsets, made, 100)
        saved += made - n
        assert n <= made and sorted(set(new.tolist())) == list(range(n))
        for b in range(n):
            mine = sorted(zip(at[new == b].tolist(), items[new == b].tolist()))
            assert all(o == sum(m for _, m in mine[:i]) for i, (o, _) in enumerate(mine)) and sum(m for _, m in mine) <= 100
    assert saved > 0


def test_repeated_rows_are_spread_over_groups(spark):
    df = spark.createDataFrame([(1, "same text")] * 400, "doc_id long, text string")
    parts = packing.common.stored(packing.pieces(df), "pieces")
    sizes = packing.packed(parts, per_group=50).selectExpr("sequence_id >> 32 as g").groupBy("g").count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 100


def test_cuts():
    assert packing.cuts(1) == [(0, 1)] and packing.cuts(1024) == [(0, 1024)]
    assert packing.cuts(1025) == [(0, 1), (1, 1024)] and packing.cuts(3000) == [(0, 952), (952, 1024), (1976, 1024)]


def test_sum_of_squares_takes_the_best_place():
    rng = np.random.default_rng(5)
    for _ in range(20):
        items = rng.integers(1, 21, 60)
        bins, offsets, made = packing.sum_of_squares(items, 20)
        gaps: list[int] = []
        for n, b, o in zip(items.tolist(), bins.tolist(), offsets.tolist()):
            def cost(i):
                g = sorted([*gaps[:i], gaps[i] - n, *gaps[i + 1 :]] if i < len(gaps) else [*gaps, 20 - n])
                return sum(c * c for c in np.bincount([x for x in g if x] or [0])[1:].tolist())

            fits = [i for i in range(len(gaps)) if gaps[i] >= n] + [len(gaps)]
            assert b in fits and cost(b) == min(map(cost, fits))
            if b == len(gaps):
                gaps.append(20)
            assert o == 20 - gaps[b]
            gaps[b] -= n
        assert made == len(gaps)


def test_encoder_keeps_the_parts_met_most_often():
    coder = encoding.Encoder(encoding.vocabulary(), remembered=100)
    plain = coder.tokenizer
    often = [f" often{'abcdefghij'[i]}" for i in range(10)]
    asked, new = [], coder._new
    coder._new = lambda parts: asked.extend(parts.to_pylist() if hasattr(parts, "to_pylist") else parts) or new(parts)
    for k in range(30):
        text = "".join(often * 3 + [f" once{chr(97 + k % 26) * (k // 26 + 1)}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40)]) + f"\n\u00c8t\u00e9 {k}"
        ids, n = coder.encode_all([text.encode()], 0)
        assert ids.tolist() == [*plain.encode(text, add_special_tokens=False).ids, 0] and n.tolist() == [len(ids)]
        assert len(coder.parts) <= 100 and len(coder.met) == len(coder.parts) == len(coder.ends) - 1
    assert all(asked.count(p.encode()) == 1 for p in often)
