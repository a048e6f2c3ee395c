import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import types as T

from siteloom.llm import simhash, substring

DATA = "/root/testdata/sf0.001"
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("fp", T.StringType()), T.StructField("h", T.StringType()), T.StructField("lang", T.StringType())])


def table(spark, texts, first=0):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(first + i, t, "x", "y", None) for i, t in enumerate(texts)], SCHEMA)


def slow_fingerprint(text):
    ws = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not ws:
        return 0
    sh = [" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_groups(rows):
    fps = [(d, slow_fingerprint(t)) for d, t in rows]
    left, out = set(range(len(fps))), {}
    while left:
        todo, comp = [left.pop()], []
        while todo:
            i = todo.pop()
            comp.append(i)
            near = [j for j in left if (fps[i][1] ^ fps[j][1]).bit_count() <= 2]
            left.difference_update(near)
            todo += near
        low = min(fps[i][0] for i in comp)
        out |= {fps[i][0]: (f"{fps[i][1]:016x}", low) for i in comp}
    return out


def simhash_rows(df):
    return {r.doc_id: (f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in df.collect()}


def test_simhash_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.query(spark, DATA).collect()}
    assert got == slow_groups(rows)


def test_simhash_edge_cases(spark):
    texts = [None, "", " \n", "one", "ONE", "one two", "a b c", "a b c d", "Ä b c", "ä b c", "w " * 70000, "w " * 70001]
    got = simhash_rows(simhash.groups(table(spark, texts)))
    assert got == slow_groups(list(enumerate(texts)))
    assert got[0] == got[1] == ("0" * 16, 0) and got[4] == (got[3][0], 3) and got[8][0] != got[9][0]
    assert simhash.groups(table(spark, [])).count() == 0


def test_links_lose_no_pair(spark):
    rng = random.Random(3)
    seen = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        seen |= {x, x ^ 1 << rng.randrange(64), x ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64), x ^ 0b111 << rng.randrange(60)}
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in seen)
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    got = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def slow_near(rows, least=0.8):
    """Component of each row: five-word shingles alike to 0.8 or more, or fingerprints of them within two bits."""
    def shingles(t):
        ws = [w for w in re.split("[ \t-\r]+", "".join(c.lower() if c.isascii() else c for c in t or "")) if w]
        return [" ".join(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))] if ws else []

    def bits(sh):
        hs = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in sh]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    lists = [shingles(t) for _, t in rows]
    sets, fps = [set(x) for x in lists], [bits(x) for x in lists]
    holders = defaultdict(list)
    for i, x in enumerate(sets):
        for y in x:
            holders[y].append(i)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in {j for y in x for j in holders[y] if j < i} | {j for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2}:
            both = len(x & sets[j])
            if (fps[i] ^ fps[j]).bit_count() <= 2 or both >= least * (len(x) + len(sets[j]) - both):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def test_simhash_stage_keeps_one_of_each_group(spark):
    base = " ".join(f"w{i}" for i in range(300))
    texts = [base, base, "quite another text of words", base + " more", base.replace("w40 ", "x ").replace("w200 ", "y ")]
    df = table(spark, texts, first=7)
    kept = simhash.stage(spark, df.union(df), "")
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [7, 9]


def test_simhash_stage_finds_near_copies(spark):
    rng = random.Random(8)
    rows = []
    for k in range(60):
        ws = [f"{rng.choice('abcdefgh')}{rng.randrange(400)}" for _ in range(rng.choice((60, 200, 900)))]
        rows.append(ws)
        for _ in range(rng.randrange(4)):
            new = list(ws)
            for _ in range(len(ws) // rng.choice((60, 100))):
                new[rng.randrange(len(new))] = "changed"
            rows.append(new)
    rows = list(enumerate(" ".join(ws) for ws in rows))
    rng.shuffle(rows)
    roots = slow_near(rows)
    want = {min(d for (d, _), x in zip(rows, roots) if x == r) for r in set(roots)}
    assert len(want) < len(rows)
    got = [r.doc_id for r in simhash.stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()]
    assert sorted(got) == sorted(want)


def test_simhash_stage_loses_no_link(spark):
    """Short near copies, whose fingerprints are far apart, and chains in which each text is like the next ones only."""
    rng = random.Random(4)
    texts = []
    for k in range(150):
        ws = [f"k{k}w{i}" for i in range(rng.randrange(12, 30))]
        texts += [" ".join(ws), " ".join(ws + [f"k{k}x{i}" for i in range((len(ws) - 4) // 4)])]
    for k in range(3):
        ws = [f"chain{k}w{i}" for i in range(240)]
        texts += [" ".join(ws[i : i + 40]) for i in range(0, 200, 4)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    roots = slow_near(rows)
    want = [min(d for (d, _), x in zip(rows, roots) if x == r) for r in set(roots)]
    assert len(want) == 153
    got = [r.doc_id for r in simhash.stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()]
    assert sorted(got) == sorted(want)


def test_bounds_of_the_exact_join_hold():
    rng = np.random.default_rng(5)
    order = np.sort(rng.integers(0, 1 << 63, 40, np.uint64)), rng.integers(3, 9, 40)
    for n in (1, 2, 4, 5, 9, 10, 44, 45, 300):
        x = np.unique(np.concatenate([rng.integers(0, 1 << 63, n, np.uint64), order[0][: n // 3]]))
        for _ in range(20):
            y = np.unique(np.concatenate([rng.permutation(x)[: len(x) - rng.integers(0, len(x) // 5 + 1)], rng.integers(0, 1 << 63, rng.integers(0, n // 8 + 1), np.uint64)]))
            both, bits = len(np.intersect1d(x, y)), simhash.sketch(x) ^ simhash.sketch(y)
            assert sum((int(b) & (1 << 64) - 1).bit_count() for b in bits) <= len(x) + len(y) - 2 * both
            if both >= 0.8 * (len(x) + len(y) - both):
                assert np.intersect1d(simhash.prefix(x, 0.8, order), simhash.prefix(y, 0.8, order)).size


def test_simhash_stage_loses_no_row_without_an_id_or_with_anothers(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(80)) for x in "abc")
    rows = [(None, a), (None, b), (None, c), (5, a + " tail"), (5, " ".join(f"d{i}" for i in range(80))), (6, b), (None, "alone"), (None, "alone")]
    df = spark.createDataFrame([(d, t, i, i, i, i, "x") for i, (d, t) in enumerate(rows)], "doc_id long, text string, rep int, h int, own_id int, own_text int, nth string")
    kept = simhash.stage(spark, df, "")
    assert kept.schema == df.schema
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(None, c), (5, a + " tail"), rows[4], (6, b), (None, "alone")], key=str)
    empty = simhash.stage(spark, df.limit(0), "")
    assert empty.schema == df.schema and empty.count() == 0


def slow_substring(rows, width=13, by_row=False):
    first = {}
    for d, t in sorted((d, t) for d, t in rows if d is not None and t):
        ws = t.encode().split()
        for i in range(len(ws) - width + 1):
            first.setdefault(tuple(ws[i : i + width]), d)
    out = {}
    for d, t in rows:
        ws = (t or "").encode().split()
        gone = set()
        for i in range(len(ws) - width + 1):
            if d is not None and first[tuple(ws[i : i + width])] < d:
                gone.update(range(i, i + width))
        out[(d, t) if by_row else d] = (len(ws), len(gone), hashlib.sha256(b" ".join(w for i, w in enumerate(ws) if i not in gone)).hexdigest())
    return out


def rows_of(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


def test_substring_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = rows_of(substring.query(spark, DATA))
    assert got == slow_substring(rows) and any(n for _, n, _ in got.values())


@pytest.mark.parametrize("bits", [6, 27])
def test_substring_shared_at_every_offset(spark, bits):
    rng = random.Random(1)
    passage = [f"p{i}" for i in range(13)]
    texts = [" ".join([f"a{rng.random()}" for _ in range(i)] + passage + [f"x{i}"]) for i in range(9)]
    texts += [" ".join(passage[:12]), None, "", " ".join(passage * 3), "ü " * 40, "ü " * 13, "t\tu\nv\x0bw\x0cx\ry z " * 5]
    df = table(spark, texts)
    found = {r.doc_id: r.at for r in substring.spans(df, 13, bits).collect()}
    assert all(found[i] == [i, i + 13] for i in range(1, 9)) and 0 not in found and 9 not in found
    assert rows_of(substring.digests(df)) == slow_substring(list(enumerate(texts)))


def test_substring_repeated_rows_nulls_and_stage(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    df = table(spark, [passage, f"new  words {passage}\nend", passage, None, "short"])
    both = df.union(df).union(spark.createDataFrame([(None, passage, "", "", None)], SCHEMA))
    got = sorted((r.doc_id, r.n_removed) for r in substring.digests(both).collect() if r.doc_id is not None)
    assert got == [(0, 0), (0, 0), (1, 20), (1, 20), (2, 20), (2, 20), (3, 0), (3, 0), (4, 0), (4, 0)]
    kept = substring.stage(spark, both, "")
    assert kept.schema == both.schema
    assert sorted((r.doc_id, r.text) for r in kept.distinct().collect() if r.doc_id is not None) == [(0, passage), (1, "new  words end"), (3, None), (4, "short")]
    assert substring.digests(table(spark, [])).count() == 0


def test_substring_rows_that_share_an_id_keep_their_own_words(spark):
    a, tail = " ".join(f"a{i}" for i in range(20)), " ".join(f"t{i}" for i in range(30))
    rows = [(1, a), (5, f"{a} {tail}"), (5, f"b {' '.join(f'b{i}' for i in range(60))}"), (5, None), (None, a), (7, tail)]
    df = spark.createDataFrame([(d, t, i, "x", 1, 2, 3) for i, (d, t) in enumerate(rows)], "doc_id long, text string, at int, _id string, own_runs int, own_id int, t int")
    want = slow_substring(rows, by_row=True)
    got = sorted((r.n_words, r.n_removed, r.kept_sha256) for r in substring.digests(df).collect())
    assert got == sorted(want.values()) and want[rows[2]][1] == 0
    out = substring.stage(spark, df, "")
    assert out.schema == df.schema
    left = {(r.doc_id, r.text) for r in out.collect()}
    assert left == {(1, a), (5, tail), rows[2], (5, None), (None, a)}


def test_windows_whose_first_hash_collides_stay_apart(spark, monkeypatch):
    """With a first hash that is the same for all windows, the second one still tells them apart."""
    real = substring.common.Words.windows
    batch = spark.createDataFrame([(1, " ".join(f"a{i}" for i in range(40)), 1), (2, " ".join(f"b{i}" for i in range(40)) + " " + " ".join(f"a{i}" for i in range(20)), 2)], "doc_id long, text string, t long").toArrow().to_batches()

    class All:
        value = substring.np.full(1 << 14, substring.np.iinfo(substring.np.uint64).max, substring.np.uint64)

    monkeypatch.setattr(substring.common.Words, "windows", lambda self, at, width, seed=None: substring.np.zeros(len(at), substring.np.uint64) if width == 13 and seed is None else real(self, at, width, seed))
    rows = [r for b in substring._candidates(13, 20, All)(batch) for r in b.to_pylist()]
    assert {r["h"] for r in rows} == {0}
    by = defaultdict(set)
    for r in rows:
        by[r["g"]].add(r["doc_id"])
    assert sum(len(x) == 2 for x in by.values()) == 8


def test_filter_follows_the_count():
    assert [substring.filter_bits(n) for n in (0, 1 << 10, 1 << 20, 1 << 40)] == [20, 20, 25, 30]
