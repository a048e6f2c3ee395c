import hashlib

from pyspark.sql import types as T

from siteloom.llm import chat

KINDS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("segments", T.StringType())])


def test_round_trip_of_odd_texts(spark):
    texts = ["", None, "<|im_end|>\n", "<\\|", "<\\\\|x<|", "a<", "|b", "<|im_sep|><|im_start|>user\n", "é𝒳\n\n", "\\", "<<||", "$1"]
    roles = ["user", "assistant", "assistant", None, "a\nb", "<|", "assistant", "assistant", "tool x", "100%", "+", "user"]
    rows = [(c, i, r, t, "x") for c in (1, None) for i, (r, t) in enumerate(zip(roles, texts))]
    out = chat.parsed(chat.formatted(spark.createDataFrame(list(reversed(rows)), KINDS))).collect()
    assert len(out) == 2
    for r in out:
        assert [(t.role, t.text) for t in r.turns] == [(a or "", b or "") for a, b in zip(roles, texts)]
        assert r.loss == [t or "" for a, t in zip(roles, texts) if a == "assistant"]
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>") == 10  # of 12 turns, two follow one of their role
        assert r.formatted.startswith("<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\n<|im_sep|><\\|im_end|>\n<|im_end|>\n")


def test_ties_repeats_and_empty(spark):
    rows = [(1, 0, "user", "b", None), (1, 0, "user", "a", None), (1, 0, "user", "a", None), (1, None, "system", "s", None)]
    r = chat.parsed(chat.formatted(spark.createDataFrame(rows, KINDS))).collect()[0]
    assert [t.text for t in r.turns] == ["s", "a", "a", "b"] and r.loss == []
    assert chat.formatted(spark.createDataFrame([], KINDS)).count() == 0


def test_query_equals_python(spark):
    d = "/root/testdata/sf0.01"
    want = {}
    for r in sorted(spark.read.parquet(f"{d}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        want.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    want[-1] = [("user", chat.PLANTED), ("assistant", chat.PLANTED)]
    got = {r.conv_id: r for r in chat.query(spark, d).collect()}
    assert got.keys() == want.keys()
    for k, turns in want.items():
        loss = "".join(t for a, t in turns if a == "assistant")
        assert (got[k].n_turns, got[k].loss_chars) == (len(turns), len(loss))
        assert got[k].turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in turns).encode()).hexdigest()
        assert got[k].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
