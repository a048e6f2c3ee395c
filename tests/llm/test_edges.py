"""Every operator and stage on one table of odd rows: nulls, empty and long texts, repeated rows, shared ids, and columns named as inside."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from siteloom.llm import chat, common, licenses, mixing, packing, quality, rangecoder, simhash, substring, suffixtree, tiff

from .test_dedup import DATA

#: Names that operators use for columns of their own.
NAMES = "at _id _n own_runs own_id own_text own_missing nth alike h g t fp rep missing root bands key bucket rest size doc source_size target copies positions some x word chunk own parcel label c n m words kept piece start length page media error".split()
KINDS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *(T.StructField(n, T.StringType()) for n in NAMES)])


def words(k, n=120):
    return " ".join(f"{k}{(i * 7919 + len(k)) % 1009}x{i}" for i in range(n))


ROWS = [
    (None, words("a")), (None, words("b")), (None, words("b")), (1, words("a") + " " + words("tail")), (1, words("c")), (2, None), (3, ""), (3, " \n\t "),
    (4, words("long", 30_000)), (5, words("d")), (5, words("d")), (6, "é " * 200 + "漢字 𝒳 <|endoftext|> <|im_end|>"), (7, words("a")), (8, "one"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(d, t, None, None if i % 3 == 0 else f"s{i % 4}", None if t is None else len(t), *(["x", None][(i + k) % 2] for k in range(len(NAMES)))) for i, (d, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, KINDS)


OPERATORS = {
    "1": lambda df: rangecoder.read_documents(common.stored(rangecoder.shards(df), "t")),
    "2": licenses.scan,
    "4": lambda df: suffixtree.scored(df, 2, 5, 2),
    "5": lambda df: tiff.features(tiff.stored_texts(df)),
    "6": simhash.groups,
    "7": substring.digests,
    "8": lambda df: packing.packed(common.stored(packing.pieces(df), "t")).where("piece = 0"),
    "9": lambda df: quality.verdicts(df, None),
    "10": lambda df: mixing.mixed(mixing.sized(df).select(F.struct("doc_id").alias("doc"), "source", "bucket", "rest", (F.col("size") > 0).alias("some")), mixing.sized(df)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_give_a_row_for_each_odd_row(odd, name):
    got = OPERATORS[name](odd)
    assert got.count() == len(ROWS) == len(got.collect())
    assert OPERATORS[name](odd.limit(0)).count() == 0


def test_removed_words_and_ids_by_row(odd):
    """Rows of one id are judged each by its text, and rows without an id neither remove nor lose."""
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed) for r in substring.digests(odd).collect())
    want = sorted((d is None, d or 0, len((t or "").split()), {(7, words("a")): 120}.get((d, t), 0)) for d, t in ROWS)
    assert got == want


def test_chat_takes_odd_turns(spark):
    kinds = "conv_id long, turn long, role string, text string, t string, b string, loss string, formatted string, start long, before string"
    rows = [(None, None, None, None, "x", "x", "x", "x", 1, "x"), (1, 0, "assistant", "a" * 300_000, None, None, None, None, None, None), (1, 0, "assistant", "", "x", "x", "x", "x", 1, "x")]
    out = chat.parsed(chat.formatted(spark.createDataFrame(rows * 2, kinds))).collect()
    assert sorted((r.turns[0].role, len(r.turns), len("".join(r.loss))) for r in out) == [("", 2, 0), ("assistant", 4, 600_000)]


def test_stages_keep_columns_and_lose_no_row_but_by_their_rule(spark, odd):
    docs, sizes = odd, []
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, DATA), name)
        rows = docs.collect()
        sizes.append(len(rows))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.schema.names == odd.schema.names and [f.dataType for f in docs.schema] == [f.dataType for f in odd.schema]
        if name == "quality_rules":
            base = {t for _, t in ROWS if len((t or "").split()) >= 50 and "é é é" not in t}
            assert sorted(str((r.doc_id, r.text)) for r in rows) == sorted(str(x) for x in ROWS if x[1] in base)
        if name == "simhash_near_dedup":
            # of a's copies the one with an id stays; b has none, and one of its two rows stays; d's repeated rows leave one
            assert sorted(str((r.doc_id, (r.text or "")[:6])) for r in rows) == sorted(str((d, t[:6])) for d, t in [(None, words("b")), (1, words("a")), (1, words("c")), (4, words("long")), (5, words("d")), (7, words("a"))])
    assert sizes[-1] > 0
    docs = odd.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, DATA), name)
        assert docs.count() == 0
