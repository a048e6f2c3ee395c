import math
import zlib
from collections import Counter

import numpy as np
import pytest

from siteloom.llm import common, suffixtree

from .test_dedup import DATA, table


def words(t):
    return (t or "").encode().lower().split()


def slow_model(texts, p_min, gain, prior):
    """The same tree from plain dictionaries: symbol tuples to counts of the next symbol."""
    seqs = [[10] * 4 + list(b" ".join(words(t))) + [10] for t in texts]
    counts = {d: {} for d in range(5)}
    for s in seqs:
        for i in range(4, len(s)):
            for d in range(5):
                counts[d].setdefault(tuple(s[i - d : i]), Counter())[s[i]] += 1
    total = sum(counts[0].get((), Counter()).values())
    least = max(2.0, p_min * total)
    threes = Counter(tuple(s[i - 2 : i + 1]) for s in seqs for i in range(4, len(s)))
    ok3 = {c for c, n in threes.items() if n >= least}
    fours = Counter(tuple(s[i - 4 : i]) for s in seqs for i in range(4, len(s)) if tuple(s[i - 3 : i]) in ok3)
    cands = [{()}, {(i,) for i in range(256)}, {c for c in counts[2] if sum(counts[2][c].values()) >= least}, ok3, {c for c, n in fours.items() if n >= least}]
    probs, kept = {}, set()
    base = counts[0].get((), Counter())
    probs[()] = [(base[x] + 0.5) / (total + 128) for x in range(256)]
    for d in range(1, 5):
        for c in cands[d]:
            if c[1:] not in probs:
                continue
            n, up = counts[d].get(c, Counter()), probs[c[1:]]
            m = sum(n.values())
            p = [(n[x] + prior * up[x]) / (m + prior) for x in range(256)]
            probs[c] = p
            if m * sum(a * math.log(a / b) for a, b in zip(p, up)) >= gain:
                kept |= {c[k:] for k in range(d)}

    def score(t):
        s, out = [10] * 4 + list(b" ".join(words(t))) + [10], 0.0
        for i in range(4, len(s)):
            d = next((d for d in range(4, 0, -1) if tuple(s[i - d : i]) in kept), 0)
            out += math.log10(probs[tuple(s[i - d : i])][s[i]])
        return out

    return score


def test_scores_equal_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    train = [(d, t) for d, t in rows if zlib.crc32(str(d).encode()) % 5 != 1]
    slow = slow_model([t for _, t in train], suffixtree.P_MIN, suffixtree.GAIN, suffixtree.PRIOR)
    c = Counter(w for _, t in train for w in [*words(t), b""])
    n, v = sum(c.values()), len(c)
    got = suffixtree.scored(df).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        ws = [*words(texts[r.doc_id]), b""]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1, len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel=1e-9)
        assert r.score == pytest.approx(slow(texts[r.doc_id]), rel=1e-5)


def test_model_beats_shorter_contexts_and_sums_to_one(spark):
    docs = common.id_text(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    model, flat = suffixtree.train(docs), suffixtree.train(docs, gain=1e18)
    assert np.allclose((10.0 ** model.logs.astype(np.float64)).sum(1), 1, atol=1e-4)
    assert len(flat.logs) == 1 < len(model.logs)
    held = [words(r.text) for r in docs.collect() if suffixtree.held_out(r.doc_id)]
    assert model.scores(held).sum() > 0.85 * flat.scores(held).sum()


def test_edge_cases(spark):
    texts = [None, "", "a", "A  a\n", "ü " * 30000, "a"]
    df = table(spark, texts)
    df = df.union(df).union(df.limit(1).selectExpr("cast(null as long)", "text", "fp", "h", "lang"))
    got = suffixtree.scored(df).collect()
    assert len(got) == 13 and sum(r.doc_id is None for r in got) == 1
    assert all(r.score <= 0 and r.n_tokens == len(words(texts[r.doc_id or 0])) + 1 for r in got)
    assert suffixtree.scored(table(spark, [])).count() == 0
    only = [i for i in range(50) if suffixtree.held_out(i)][:2]
    got = suffixtree.scored(spark.createDataFrame([(i, "x y") for i in only], "doc_id long, text string")).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and r.score == pytest.approx(4 * math.log10(1 / 256)) for r in got)


def slow_word_model(texts, depth, least, least_next, gain, byte_model):
    """The tree over words from plain dictionaries."""
    seqs = [[b"", *words(t), b""] for t in texts]
    counts = {}
    for s in seqs:
        for i in range(1, len(s)):
            for d in range(min(i, depth) + 1):
                counts.setdefault(tuple(s[i - d : i]), Counter())[s[i]] += 1
    root = counts.get((), Counter())
    n, v = sum(root.values()), len(root)

    def parts(c):
        own = {w: k for w, k in counts[c].items() if k >= least_next}
        m = sum(counts[c].values())
        return own, m, (len(own) + m - sum(own.values())) / (m + len(own))

    def p(c, w):
        if not c:
            if w in root:
                return root[w] / (n + v)
            return 10 ** byte_model.word_scores([w])[0] * (v / (n + v) if n else 1)
        own, m, rest = parts(c)
        return own.get(w, 0) / (m + len(own)) + rest * p(c[1:], w)

    kept = set()
    for c in counts:
        own, m, rest = parts(c)
        if c and m >= least:
            seen = [(p(c, w), p(c[1:], w)) for w in own]
            if m * (sum(x * math.log(x / y) for x, y in seen) + rest * (1 - sum(y for _, y in seen)) * math.log(rest)) >= gain:
                kept |= {c[k:] for k in range(len(c))}

    def score(t):
        s, out = [b"", *words(t), b""], 0.0
        for i in range(1, len(s)):
            d = next((d for d in range(min(i, depth), 0, -1) if tuple(s[i - d : i]) in kept), 0)
            out += math.log10(p(tuple(s[i - d : i]), s[i]))
        return out

    # with the root, a few contexts add up to one over all words and what is new
    for c in [(), *list(kept)[:20]]:
        assert sum(p(c, w) for w in root) + (v / (n + v)) * math.prod(parts(c[k:])[2] for k in range(len(c))) == pytest.approx(1)
    return score, kept


@pytest.mark.parametrize("often", [1, 50, 1 << 16])
def test_word_contexts_equal_brute_force(spark, often):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    rows += [(1000, None), (1001, ""), (1002, rows[3][1]), (None, "x y"), (1000, rows[5][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    train = [t for d, t in rows if not suffixtree.held_out(d)]
    vocab = spark.createDataFrame([(w,) for w in {w for t in train for w in words(t)}], "text binary")
    slow, kept = slow_word_model(train, 3, 10, 4, suffixtree.GAIN, suffixtree.train(vocab, lists=suffixtree._spelled))
    got = suffixtree.scored(df, 3, 10, 4, often, often).collect()
    assert len(got) == len(rows) and {len(c) for c in kept} == {1, 2, 3}
    want = Counter((d, round(slow(t), 4)) for d, t in rows)
    assert Counter((r.doc_id, round(r.score, 4)) for r in got) == want
    c = Counter(w for t in train for w in [*words(t), b""])
    n, v = sum(c.values()), len(c)
    base = lambda t: sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*words(t), b""])
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == Counter((d, len(words(t)) + 1, sum(c[w] > 0 for w in [*words(t), b""]), n, round(base(t), 6)) for d, t in rows)
    assert suffixtree.scored(table(spark, []), 3).count() == 0


def test_word_contexts_grow_with_the_corpus_and_beat_the_byte_tree(spark):
    kept = []
    for d in (DATA, "/root/testdata/sf0.01"):
        own = common.id_text(common.documents(spark, d))
        vocab = suffixtree.vocabulary(own)
        n, v = vocab.selectExpr("sum(c)", "count(*)").first()
        kept.append(suffixtree.word_tree(own, vocab, n, v).where("whole").count())
    assert kept[1] > 3 * kept[0] > 0
    held = lambda df: df.where("held_out").selectExpr("sum(score)").first()[0]
    assert held(suffixtree.query(spark, d)) > held(suffixtree.scored(common.documents(spark, d)))


def test_bounds_hold_at_most_so_many(spark):
    rows = [(int(n),) for n in np.random.default_rng(1).zipf(1.3, 500).clip(1, 10**6)]
    counts = spark.createDataFrame(rows, "n long")
    for most in (0, 1, 7, 100, 499, 500, 10_000):
        bound = suffixtree._bound(counts, most)
        assert sum(n >= bound for n, in rows) <= most
    assert suffixtree._bound(counts, 500) == min(n for n, in rows)


def test_counting_codes_holds_no_table_of_all_codes(spark):
    """A pass over a few words takes memory for the codes that it met; counts over several batches add up."""
    import tracemalloc

    import pyarrow as pa

    class Table:
        sparkSession = spark

        def mapInArrow(self, run, kinds):
            batch = pa.RecordBatch.from_arrays([pa.array([b"abc", b"abd"], pa.binary())], ["text"])
            tracemalloc.start()
            self.rows = list(run(iter([batch] * 3)))
            self.peak = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            raise InterruptedError

    table = Table()
    try:
        suffixtree.train(table, lists=suffixtree._spelled)
    except InterruptedError:
        pass
    got = {c: n for b in table.rows for c, n in zip(b.column("code").to_pylist(), b.column("n").to_pylist())}
    end = suffixtree.END
    assert got == {end << 16 | end << 8 | 97: 6, end << 16 | 97 << 8 | 98: 6, 97 << 16 | 98 << 8 | 99: 3, 97 << 16 | 98 << 8 | 100: 3, 98 << 16 | 99 << 8 | end: 3, 98 << 16 | 100 << 8 | end: 3}
    assert table.peak < 8 << 20, table.peak
