"""SimHash near-duplicates found by pigeonring filtering.

A 64-bit fingerprint is cut into a ring of three segments. If two fingerprints differ in at most two bits, the ring
principle gives a segment from which every chain of l consecutive segments differs in at most l * 2/3 bits: none in the
first, one at most in the first two, two in all three. One side therefore announces, for each start, the first segment with
the second one changed in no or one bit; the other looks these 43-bit keys up, and only those meet the full Hamming check.
Keys are that long because short ones (one segment) fill up as the corpus grows.

The pipeline's stage takes texts for near copies whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.
Their fingerprints differ in up to some 20 bits, for which no ring of 64 bits gives keys long enough; so beside the links above,
the stage takes candidates from min-wise bands: each text meets the smallest fingerprint of each of its bands, pairs whose
chains on a ring of eight segments break their budgets (or whose whole distance does) go, and those left are compared exactly.
These links gather most of each group, but bands, hubs and the ring may miss some. An exact join then finds all links between
texts that are not yet in one group: with shingles in one order for all texts (those common in a sample last, then by hash), two
similar texts share one of their first n - ceil(0.8 n) + 1 of n. Sizes, the places of the shared shingle and the parities of
512 classes of shingles bound the overlap from above, so they prune without loss; what is left is compared exactly.

Nulls: a null text counts as empty (fingerprint zero); a null doc_id takes part but never names a component unless the
component has no other. Repeated rows and rows of one doc_id with other texts: each gets its row by its own text. Ties in doc_id:
the smaller hash of the text. Very long texts are read whole. Extra columns, whatever their names, pass through the stage. An empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SEED = 42
SHINGLE = 3
#: First bit and width of the three segments of the ring.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
MAX_BITS = 2
#: The stage: words of a shingle, least similarity, bands of so many min-wise values, and the ring on which candidates are pruned.
NEAR_SHINGLE, NEAR = 5, 0.8
BANDS, ROWS = 12, 4
NEAR_SEGMENTS, NEAR_BITS = 8, 24
#: The exact join: bits of a text's parities; one text in SAMPLE tells which shingles are common: so many times, so many of them. They change no result.
SKETCH, SAMPLE, COMMON, COMMONEST = 512, 16, 3, 1 << 20


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of the shingles in order, repeats included; a text of fewer words is one shingle, an empty one has none."""
    words = text.lower().split()  # bytes.lower() changes A-Z alone
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    n = len(words) - shingle + 1
    if n <= 1:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: n - 1].tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())], np.uint64)


def majority(h: np.ndarray) -> int:
    """A fingerprint: bit by bit, whether over half of the hashes have it set; zero for none."""
    if len(h) <= 1:
        return int(h[0]) if len(h) else 0
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 65535):  # so many at once that 16-bit sums hold
        bits = np.unpackbits(h[a : a + 65535].view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, 64).sum(0, dtype=np.uint16)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    return majority(shingles(text, shingle))


#: What rounding may change in a bound.
SLACK = 1e-6

_TIMES = common.multipliers(BANDS * ROWS, seed=6)


def bands(h: np.ndarray) -> list[int]:
    """Keys that two texts share the likelier the more shingles they share: each of ROWS min-wise values."""
    if not len(h):
        return []
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(h), 4096):
        part = h[a : a + 4096, None] * _TIMES
        np.minimum(low, (part ^ (part >> np.uint64(32))).min(0), out=low)
    rows = low.reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        out = common.mix64(out * _TIMES[0] + rows[:, k])
    return out.view(np.int64).tolist()


def prefix(x: np.ndarray, least: float, order: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The first of a text's distinct hashes, so many that two texts similar enough share one; order: common ones and their counts."""
    n = len(x) - int(np.ceil(least * len(x) - SLACK)) + 1 if len(x) else 0
    if order is None or not len(order[0]):
        return x[:n]
    at = np.minimum(np.searchsorted(order[0], x), len(order[0]) - 1)
    count = np.where(order[0][at] == x, order[1][at], 0)
    return x[np.argsort(count, kind="stable")[:n]]


def sketch(x: np.ndarray) -> np.ndarray:
    """Parities of the numbers of distinct hashes by class: two texts' differ in no more bits than their sets in elements."""
    odd = np.bincount((x >> np.uint64(40)).astype(np.int64) % SKETCH, minlength=SKETCH).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


_LONGS = pa.list_(pa.int64())


def _fingerprints(shingle: int, banded: bool, least: float, order):
    def run(batches):
        for batch in common.slices(batches):
            hashes = [shingles(t, shingle) for t in common.texts(batch)]
            fp = np.array([majority(h) for h in hashes], np.uint64).view(np.int64)
            columns = {"doc_id": common.ids(batch), "h": batch.column("h"), "fp": pa.array(fp)}
            if banded:
                sets = [np.unique(h) for h in hashes]
                columns["bands"] = pa.array([bands(h) for h in hashes], _LONGS)
                columns["n"] = pa.array([len(x) for x in sets], pa.int64())
                columns["prefix"] = pa.array([prefix(x, least, order and order.value).view(np.int64) for x in sets], _LONGS)
                columns["sketch"] = pa.array([sketch(x) for x in sets], _LONGS)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def _distinct_shingles(shingle: int):
    def run(batches):
        for batch in common.slices(batches):
            sets = [np.unique(shingles(t, shingle)).view(np.int64) for t in common.texts(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets))], ["key"])

    return run


def common_shingles(docs: DataFrame, shingle: int = NEAR_SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles that many texts of a sample hold, ascending, and in how many."""
    own = common.id_text(docs).withColumn("h", F.xxhash64("text")).where(F.pmod("h", F.lit(SAMPLE)) == 0)
    keys = own.select("h", "text").dropDuplicates(["h"]).select("text").mapInArrow(common.tidied(_distinct_shingles(shingle)), "key long")
    most = keys.groupBy("key").count().where(F.col("count") >= COMMON).orderBy(F.desc("count"), "key").limit(COMMONEST).toArrow()
    hashes, counts = most.column("key").to_numpy().view(np.uint64), most.column("count").to_numpy()
    by = np.argsort(hashes)
    return hashes[by], counts[by]


def text_hash(text):
    """What tells rows of one doc_id apart: a hash of the text, null counting as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, banded: bool = False, least: float = NEAR) -> DataFrame:
    """(doc_id, h, fp long) for every row, h being the text's hash; banded: also bands, n distinct shingles, prefix and sketch."""
    own = common.id_text(docs).withColumn("h", F.xxhash64("text"))
    order = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, shingle)) if banded else None
    more = ", bands array<long>, n long, prefix array<long>, sketch array<long>" if banded else ""
    return own.mapInArrow(common.tidied(_fingerprints(shingle, banded, least, order)), "doc_id long, h long, fp long" + more)


def _segment(fp, k: int):
    at, width = SEGMENTS[k % 3]
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1))


def _chain(a, b, k: int):
    """Whether the chain that starts at segment k keeps its budgets (the last one is the full check)."""
    first = _segment(a, k) == _segment(b, k)
    return first & (F.bit_count(_segment(a, k + 1).bitwiseXOR(_segment(b, k + 1))) <= 1)


def links(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b) of different fingerprints, a < b, within two bits; each pair once."""

    def key(fp, k: int, flip):
        width = SEGMENTS[(k + 1) % 3][1]
        second = _segment(fp, k + 1).bitwiseXOR(flip)
        return F.shiftleft(_segment(fp, k), width).bitwiseOR(second).bitwiseOR(F.lit(k << 60))

    def flips(k: int) -> list[int]:
        return [0, *(1 << j for j in range(SEGMENTS[(k + 1) % 3][1]))]

    fp = F.col("fp")
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = distinct.select("fp").repartition(n)  # each row becomes many
    probes = distinct.select(fp.alias("a"), F.explode(F.array(*(key(fp, k, F.lit(x)) for k in range(3) for x in flips(k)))).alias("key"))
    homes = distinct.select(fp.alias("b"), F.explode(F.array(*(key(fp, k, F.lit(0)) for k in range(3)))).alias("key"))
    a, b = F.col("a"), F.col("b")
    start = F.shiftrightunsigned(F.col("key"), 60)
    first = F.when(_chain(a, b, 0), 0).when(_chain(a, b, 1), 1).otherwise(2)
    near = (a < b) & (F.bit_count(a.bitwiseXOR(b)) <= MAX_BITS) & (start == first)
    return probes.join(homes, "key").where(near).select("a", "b")


def _component(fps: DataFrame, near=None) -> tuple[DataFrame, DataFrame]:
    """(fp, root) of every fingerprint, and fingerprints with their first row: (fp, missing, rep, h)."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("rep"), F.col("h")))
    reps = common.stored(fps.groupBy("fp").agg(first.alias("first")).select("fp", "first.*"), "fp-reps")
    found = links(reps)
    if near is not None:
        found = found.union(near(reps))
    roots = common.components(found, "fp-links").withColumnsRenamed({"node": "fp"})
    return reps.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "missing", "rep", "h"), reps


def groups(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id that links of two bits or fewer reach."""
    fps = common.stored(fingerprints(docs, shingle), "fp")
    rooted, _ = _component(fps)
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    return fps.join(rooted.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def _ring(a, b, segments: int = NEAR_SEGMENTS, budget: int = NEAR_BITS):
    """Whether two fingerprints are within the budget, and from some segment on every chain is within its share of it."""
    width = 64 // segments
    apart = a.bitwiseXOR(b)
    diff = [F.bit_count(F.shiftrightunsigned(apart, k * width).bitwiseAND(F.lit((1 << width) - 1))) for k in range(segments)]
    starts = []
    for k in range(segments):
        chain, ok = F.lit(0), F.lit(True)
        for n in range(1, segments + 1):
            chain = chain + diff[(k + n - 1) % segments]
            ok = ok & (chain * segments <= n * budget)
        starts.append(ok)
    some = starts[0]
    for x in starts[1:]:
        some = some | x
    return (F.bit_count(apart) <= budget) & some


def _similar(least: float, shingle: int):
    """Pairs of texts whose sets of shingles are similar enough."""

    def run(batches):
        for batch in batches:
            for part in common.slices([batch], text="ta"):
                keep = []
                for x, y in zip(common.texts(part, "ta"), common.texts(part, "tb")):
                    x, y = (np.unique(shingles(t, shingle)) for t in (x, y))
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(both >= least * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(keep))

    return run


def _texts(docs: DataFrame, fps: DataFrame, pairs: DataFrame) -> DataFrame:
    """(h, text) of the text hashes in pairs (a, b), each read from its first row, so that copies do not meet in one task."""
    ends = pairs.select(F.col("a").alias("h")).union(pairs.select(F.col("b").alias("h"))).distinct()
    first = fps.groupBy("h").agg(F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id"))["doc_id"].alias("doc_id"))
    named = first.join(ends, "h").select("doc_id", "h")
    own = common.id_text(docs).withColumn("h", F.xxhash64("text"))
    rows = own.join(named.hint("merge"), own["doc_id"].eqNullSafe(named["doc_id"]) & (own["h"] == named["h"])).select(own["h"], "text")
    return common.stored(rows.groupBy("h").agg(F.min("text").alias("text")), "near-texts")


def _compared(texts: DataFrame, pairs: DataFrame, least: float, shingle: int) -> DataFrame:
    """Those pairs (a, b) of text hashes whose texts are similar enough."""
    side = lambda h, text: texts.select(F.col("h").alias(h), F.col("text").alias(text))
    both = pairs.select("a", "b").join(side("a", "ta"), "a").join(side("b", "tb"), "b").select("a", "b", "ta", "tb")
    return common.stored(both.mapInArrow(common.tidied(_similar(least, shingle)), "a long, b long"), "near-links")


def hub_links(docs: DataFrame, fps: DataFrame, reps: DataFrame, least: float = NEAR, shingle: int = NEAR_SHINGLE) -> DataFrame:
    """Pairs (a, b) of fingerprints whose first texts are similar: each text is compared with the first one of each of its bands."""
    keys = common.stored(fps.select("fp", F.explode("bands").alias("key")).distinct(), "bands")
    first = common.stored(keys.groupBy("key").agg(F.min("fp").alias("a"), F.max("fp").alias("most")).where("a < most").select("key", "a"), "first-of-bands")
    pairs = keys.join(first, "key").where("fp > a").select("a", F.col("fp").alias("b")).distinct()
    pairs = common.stored(pairs.where(_ring(F.col("a"), F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > MAX_BITS)), "near-pairs")
    of = lambda fp, h: reps.select(F.col("fp").alias(fp), F.col("h").alias(h))
    named = common.stored(pairs.join(of("a", "ha"), "a").join(of("b", "hb"), "b"), "near-pairs")
    hashes = named.select(F.col("ha").alias("a"), F.col("hb").alias("b"))
    texts = _texts(docs, fps, hashes)
    alike = _compared(texts, hashes, least, shingle)
    out = named.join(alike.withColumnsRenamed({"a": "ha", "b": "hb"}).distinct(), ["ha", "hb"]).select("a", "b")
    out = common.stored(out, "near-links")
    common.drop(keys, first, pairs, named, texts, alike)
    return out


def _candidates(fps: DataFrame, rooted: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of text hashes with their roots (ra, rb), which differ, and the bits apart: all that can be similar enough.

    Of the texts that share a key, those in the key's largest group are not paired with each other.
    """
    keys = fps.select("h", "fp", "n", F.posexplode("prefix").alias("at", "key"))
    shared = common.stored(keys.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo < hi").select("key"), "near-keys")
    held = keys.join(shared, "key").distinct().join(rooted.select("fp", "root"), "fp").drop("fp")
    held = common.stored(held, "near-held")
    sizes = held.groupBy("key", "root").count()
    tops = sizes.groupBy("key").agg(F.max(F.struct("count", "root"))["root"].alias("top"), F.count("*").alias("roots")).where("roots > 1").select("key", "top")
    sketches = fps.groupBy("h").agg(F.any_value("sketch").alias("sketch"))
    rows = common.stored(held.join(tops, "key").join(sketches, "h"), "near-rows")
    x, y = (rows.select("key", *(F.col(c).alias(c + side) for c in ("h", "n", "at", "root", "top", "sketch"))) for side in "xy")
    nx, ny = F.col("nx"), F.col("ny")
    both = F.least(nx - F.col("atx"), ny - F.col("aty"))  # at most, if the key is the first they share
    apart = F.lit(0)
    for k in range(SKETCH // 64):
        apart = apart + F.bit_count(F.col("sketchx")[k].bitwiseXOR(F.col("sketchy")[k]))
    near = (F.least(nx, ny) >= F.greatest(nx, ny) * least - SLACK) & (both * (1 + least) >= (nx + ny) * least - SLACK)
    near = near & (apart * (1 + least) <= (nx + ny) * (1 - least) + SLACK)
    once = (F.col("rootx") != F.col("topx")) & ((F.col("rooty") == F.col("topy")) | (F.col("hx") < F.col("hy")))
    pairs = x.join(y, "key").where((F.col("rootx") != F.col("rooty")) & once & near)
    turned = F.col("rootx") > F.col("rooty")  # the smaller root first
    ends = [F.when(turned, F.col(c + "y")).otherwise(F.col(c + "x")).alias(to) for c, to in (("h", "a"), ("root", "ra"))]
    ends += [F.when(turned, F.col(c + "x")).otherwise(F.col(c + "y")).alias(to) for c, to in (("h", "b"), ("root", "rb"))]
    out = common.stored(pairs.select(*ends, (apart / (nx + ny)).alias("apart")).distinct(), "near-candidates")
    common.drop(shared, held, rows)
    return out


def near_links(docs: DataFrame, fps: DataFrame, rooted: DataFrame, least: float = NEAR, shingle: int = NEAR_SHINGLE) -> DataFrame:
    """Links (a, b) between roots: all that similar texts of different groups give, but for those that others imply.

    The likeliest pair of each two groups is compared first, then every pair whose groups are still apart.
    """
    pairs = _candidates(fps, rooted, least)
    texts = _texts(docs, fps, pairs)
    best = common.stored(pairs.groupBy("ra", "rb").agg(F.min(F.struct("apart", "a", "b")).alias("x")).select("ra", "rb", "x.a", "x.b"), "near-best")
    alike = _compared(texts, best, least, shingle)
    first = common.stored(best.join(alike, ["a", "b"]).select(F.col("ra").alias("a"), F.col("rb").alias("b")), "near-first")
    now = common.components(first, "near-first")
    of = lambda node, root: now.withColumnsRenamed({"node": node, "root": root})
    rest = pairs.join(best, ["a", "b"], "left_anti").join(of("ra", "na"), "ra", "left").join(of("rb", "nb"), "rb", "left")
    rest = common.stored(rest.where(F.coalesce("na", "ra") != F.coalesce("nb", "rb")).select("a", "b", "ra", "rb"), "near-rest")
    more = _compared(texts, rest, least, shingle)
    second = rest.join(more, ["a", "b"]).select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    out = common.stored(first.union(second).distinct(), "near-links")
    common.drop(pairs, texts, best, alike, first, now, rest, more)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    g = groups(common.documents(spark, sf_dir))
    return g.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: the one of the smallest doc_id, then of the smallest hash of its text.

    Rows without a doc_id come last; of rows alike in doc_id and text, one stays. All others go whatever ids they share.
    """
    fps = common.stored(fingerprints(docs, NEAR_SHINGLE, True), "fp")
    rooted, _ = _component(fps, lambda reps: hub_links(docs, fps, reps))
    rooted = common.stored(rooted, "fp-roots")
    joined = common.components(near_links(docs, fps, rooted), "group-links").select(F.col("node").alias("root"), F.col("root").alias("whole"))
    rooted = rooted.join(joined, "root", "left").withColumn("root", F.coalesce("whole", "root"))
    first = rooted.groupBy("root").agg(F.min(F.struct("missing", "rep", "h")).alias("first")).select("first.rep", "first.h")
    keys = [common.fresh(docs, k) for k in ("own_id", "own_missing", "own_text")]
    row = lambda doc_id, h: [c.alias(k) for c, k in zip((F.coalesce(doc_id.cast("long"), F.lit(0)), doc_id.isNull(), h), keys)]
    keep = common.stored(first.select(*row(F.col("rep"), F.col("h"))), "fp-keep")
    kept = docs.select("*", *row(docs["doc_id"], text_hash(docs["text"]))).join(keep.hint("merge"), keys)
    nth = common.fresh(kept, "nth")
    kept = kept.withColumn(nth, F.row_number().over(Window.partitionBy(*keys).orderBy(keys[0]))).where(F.col(nth) == 1)
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
