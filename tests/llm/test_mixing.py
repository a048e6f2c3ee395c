import numpy as np
import pytest
from pyspark.sql import types as T

from siteloom.llm import mixing

DATA = "/root/testdata/sf0.01"
SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("source", T.StringType()), ("_at", T.StringType()), ("size", T.StringType()))])


def slow_targets(sizes):
    """Raises a common level in small steps of exact events: sources fill up one after the other."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total = sum(sizes.values())
    lo, hi = 0.0, 3.0 * total + 1
    for _ in range(300):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(3 * sizes[s], w[s] * mid) for s in order) < total else (lo, mid)
    return {s: min(3 * sizes[s], w[s] * lo) for s in order}


def test_targets_equal_a_common_level(spark):
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 7, 300):
        sizes = {f"s{i}é": int(rng.integers(0, 1000)) ** 2 for i in range(n)} | {None: 50, "": 7}
        rows = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, n long").repartition(5)).collect()
        got, want = {r.source: r.target for r in rows}, slow_targets(sizes)
        assert [r.source for r in sorted(rows, key=lambda r: r.rank)] == sorted(sizes, key=lambda s: (s is None, s or ""))
        assert len(rows) == len(sizes) and all(got[s] == pytest.approx(want[s], rel=1e-6, abs=1e-6) for s in sizes)
        assert sum(got.values()) == pytest.approx(sum(sizes.values()))
    assert mixing.targets(spark.createDataFrame([], "source string, n long")).count() == 0


def test_query(spark):
    rows = mixing.query(spark, DATA).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    sizes = {}
    for d in docs.values():
        sizes[d.source] = sizes.get(d.source, 0) + len((d.text or "").encode().split())
    want = slow_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in rows:
        s = docs[r.doc_id].source
        assert r.size == len((docs[r.doc_id].text or "").encode().split()) and r.source_size == sizes[s]
        assert r.target == pytest.approx(want[s], rel=1e-6) and r.taken <= 3 * r.size and r.taken == r.copies * r.size
        assert (r.first_position is None) == (r.copies == 0) and (r.first_position is None or 0 <= r.first_position <= 1)
        taken[s] += r.taken
    for s, n in taken.items():
        longest = max(len((d.text or "").encode().split()) for d in docs.values() if d.source == s)
        assert abs(n - want[s]) <= 2 * longest
    assert sorted(map(str, rows)) == sorted(map(str, mixing.query(spark, DATA).collect()))
    # copies and positions, derived anew: an axis of hash buckets, then the inverse of the schedule
    import xxhash

    def place(d):
        h = xxhash.xxh64_intdigest(b"mix", xxhash.xxh64_intdigest(d.to_bytes(8, "little", signed=True), 42)) >> 24
        return h >> 28, (h & (1 << 28) - 1) / (1 << 28)

    order, in_bucket = sorted(sizes, key=lambda s: (s is None, s or "")), {}
    for d in docs.values():
        key = d.source, place(d.doc_id)[0]
        in_bucket[key] = in_bucket.get(key, 0) + len((d.text or "").encode().split())
    for r in rows:
        s = docs[r.doc_id].source
        b, rest = place(r.doc_id)
        at = sum(n for (x, k), n in in_bucket.items() if x == s and k < b) + rest * in_bucket[s, b]
        places = [at + e * sizes[s] for e in range(3) if at + e * sizes[s] < want[s]] if r.size else []
        assert r.copies == len(places) == len(r.positions)
        knots = mixing.SCHEDULES[order.index(s) % 3]
        for t, y in zip(r.positions, places):
            grid = [i / 2000 for i in range(2001)]
            w = np.interp(grid, [k[0] for k in knots], [k[1] for k in knots])
            demand = np.r_[0, np.cumsum((w[1:] + w[:-1]) / 2)]
            assert t == pytest.approx(float(np.interp(y / want[s], demand / demand[-1], grid)), abs=1e-3)
    first = [r.first_position for r in mixing.query(spark, DATA).collect() if r.first_position is not None]
    assert first == sorted(first)


def test_positions_invert_the_schedule(spark):
    for knots in mixing.SCHEDULES:
        pieces = mixing.integrated(knots)
        frame = spark.createDataFrame([(y / 50, [tuple(p) for p in pieces]) for y in range(51)], "y double, pieces array<struct<t0:double,width:double,w0:double,slope:double,before:double>>")
        for r in frame.select("y", mixing.position(frame["y"], frame["pieces"]).alias("t")).collect():
            t0, _, w0, slope, before = max(p for p in pieces if p[0] <= r.t)
            d = r.t - t0
            assert before + w0 * d + slope * d * d / 2 == pytest.approx(r.y, abs=1e-9)


def test_stage_and_edge_cases(spark):
    rows = [(i, "w " * (i % 7 + 1), "a" if i % 3 else None, "x", "y") for i in range(200)] + [(900, None, "b", None, None), (901, "", "b", None, None), (None, "one two", "c", None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = mixing.stage(spark, df.union(df.where("doc_id = 5")), "")
    assert kept.schema == df.schema
    got = kept.collect()
    sizes = {}
    for _, t, s, *_ in [*rows, rows[5]]:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = slow_targets(sizes)
    for s in ("a", None, "c"):
        n = sum(len(r.text.split()) for r in got if r.source == s)
        assert abs(n - want[s]) <= 14
    assert not any(r.source == "b" for r in got)
    assert mixing.stage(spark, spark.createDataFrame([], SCHEMA), "").count() == 0
