"""Mixing sources to target weights with a time-varying curriculum.

Targets: sources in code-point order, null last, weigh 5, 2, 1, repeating, and share the sum of all sizes; a target stops at
3 times its source's size and the excess is shared again. Sources stay in a table, however many there are: they are ranked by a range sort,
and the common level that open ones share follows from two sums a round. A source's documents lie in hash order on an axis as long as the
source; the mix runs along that axis as often as its target needs, so a document is taken 0 to 3 times. The axis comes from
sums of 4096 hash buckets per source, and places within a bucket are interpolated, so no source is ever sorted or gathered,
however large it is. A copy at place y of its source's demand gets the training position t at which the integral of the
source's weight schedule reaches y, and documents are range-sorted by position.

Nulls: a null text has size 0; null sources form the last source; a null doc_id is hashed like a value of its own. Repeated rows and rows of
one doc_id share their place (ties in position are settled by doc_id). Very long texts are counted whole. Extra columns, whatever their names,
pass through the stage. An empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5, 2, 1)
MOST = 3
BUCKETS = 4096
#: Rows of the bucket table up to which it is broadcast (about 10 MB); beyond, it is joined.
BROADCAST_ROWS = 200_000


def ranked(sums: DataFrame) -> DataFrame:
    """Adds rank to (source, n): the place in code-point order, null last."""
    ordered = sums.repartitionByRange(F.col("source").isNull(), "source").sortWithinPartitions(F.col("source").isNull(), "source")
    ordered = common.stored(ordered.withColumn("row", F.monotonically_increasing_id()), "mix-sources")  # 2^33 numbers a partition
    part = F.shiftright("row", 33)
    counts = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row per partition
    offsets = counts.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return ordered.join(F.broadcast(offsets), part == F.col("part")).select("source", "n", (F.col("before") + F.col("row").bitwiseAND(F.lit((1 << 33) - 1))).alias("rank"))


def targets(sums: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, n, rank, target) of (source, n): what a full source can't take goes to the others by weight."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    table = common.stored(ranked(sums).withColumn("weight", weight), "mix-targets")
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    level, full = F.lit(0.0), -1
    while True:  # each round fills a source at least, in practice most of those that will be full
        is_full = F.col("weight") * level > most * F.col("n") if full >= 0 else F.lit(False)
        n, taken, open_ = table.agg(F.count_if(is_full), F.coalesce(F.sum(F.when(is_full, F.col("n"))), F.lit(0)), F.coalesce(F.sum(F.when(~is_full, F.col("weight"))), F.lit(0))).first()
        if n == full or not open_:
            break
        full, level = n, F.lit(float((total - most * taken) / open_))
    return table.select("source", "n", "rank", F.least(F.col("weight") * level, most * F.col("n").cast("double")).alias("target"))


#: Knots (time, weight) of a source's weight over the training run, by rank in turn: it fades, stays or rises.
SCHEDULES = tuple([(0.0, 1 - slope), (0.5, 1.0), (1.0, 1 + slope)] for slope in (-0.5, 0.0, 0.5))


def integrated(knots: list[tuple[float, float]]) -> list[tuple[float, float, float, float, float]]:
    """Pieces (t0, width, w0, slope, demand before), demand running to 1."""
    total = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
    out, before = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        out.append((t0, t1 - t0, w0 / total, (w1 - w0) / (t1 - t0) / total, before))
        before += (t1 - t0) * (w0 + w1) / 2 / total
    return out


def position(y, pieces):
    """The time at which the demand, an array of pieces, reaches y (columns)."""
    piece = F.try_element_at(F.filter(pieces, lambda p: p["before"] <= y), F.lit(-1))
    need = F.greatest(y - piece["before"], F.lit(0.0))
    root = F.sqrt(F.greatest(piece["w0"] * piece["w0"] + 2 * piece["slope"] * need, F.lit(0.0)))
    return piece["t0"] + F.least(piece["width"], F.when(need == 0, 0.0).otherwise(2 * need / (piece["w0"] + root)))


def size(text):
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD_PATTERN)), F.lit(0)).cast("long")


def _place(doc_id):
    """A document's place in [0, 1) by hash of its id: (bucket, rest within the bucket)."""
    h = F.shiftrightunsigned(F.xxhash64(doc_id, F.lit("mix")), 24)  # 40 bits
    return F.shiftright(h, 28).cast("int"), h.bitwiseAND(F.lit((1 << 28) - 1)) / float(1 << 28)


_PIECES = "array<struct<t0:double,width:double,w0:double,slope:double,before:double>>"


def axis(sized: DataFrame, weights=WEIGHTS, most: int = MOST, schedules: Sequence = SCHEDULES) -> DataFrame:
    """A row for each source and bucket of sized(source, bucket, size): where it lies, and its source's size, target and schedule."""
    buckets = common.stored(sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")), "mix-buckets")
    goal = targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("n")), weights, most)
    every = F.from_json(F.lit(json.dumps([[dict(zip(("t0", "width", "w0", "slope", "before"), p)) for p in integrated(k)] for k in schedules])), f"array<{_PIECES}>")
    goal = goal.select(F.col("source").alias("_g"), F.col("n").alias("_source_size"), F.col("target").alias("_target"), F.element_at(every, (F.col("rank") % len(schedules) + 1).cast("int")).alias("_pieces"))
    goal = common.stored(goal, "mix-goals")
    before = F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    table = buckets.select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), "bucket_size", F.coalesce(before, F.lit(0)).alias("_before"))
    table = table.join(goal, F.col("_s").eqNullSafe(F.col("_g"))).drop("_g")
    # the rows that it can have at most: broadcast or not, the result is the same
    return F.broadcast(table) if goal.count() * BUCKETS <= BROADCAST_ROWS else table


def mixed(rows: DataFrame, sized: DataFrame, weights=WEIGHTS, most: int = MOST, schedules: Sequence = SCHEDULES) -> DataFrame:
    """(doc, source_size, target, copies, positions) of rows(doc, source, bucket, rest, some): some tells whether there is a word."""
    table = axis(sized, weights, most, schedules)
    own = rows.join(table, rows["source"].eqNullSafe(table["_s"]) & (rows["bucket"] == table["_b"]))
    at = F.col("_before") + F.col("rest") * F.col("bucket_size")
    full, length = F.floor(F.try_divide("_target", "_source_size")), F.col("_source_size")
    copies = F.when(F.col("some"), F.least(F.lit(most), full + F.when(at + full * length < F.col("_target"), 1).otherwise(0))).otherwise(0).cast("int")
    out = own.withColumn("_at", at).withColumn("copies", copies)
    places = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda e: position(F.try_divide(F.col("_at") + e * F.col("_source_size"), F.col("_target")), F.col("_pieces")))
    return out.select("doc", length.alias("source_size"), F.col("_target").alias("target"), "copies", F.slice(places, 1, F.col("copies")).alias("positions"))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, bucket, rest, size): words counted once."""
    bucket, rest = _place(F.col("doc_id"))
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), bucket.alias("bucket"), rest.alias("rest"), size(F.col("text")).alias("size"))


def _range_sorted(df: DataFrame, *keys: str) -> DataFrame:
    return df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)


def query(spark, sf_dir: str) -> DataFrame:
    own = common.stored(sized(common.documents(spark, sf_dir)), "mix-sizes")
    rows = own.select(F.struct("doc_id", "size").alias("doc"), "source", "bucket", "rest", (F.col("size") > 0).alias("some"))
    out = mixed(rows, own)
    out = out.select("doc.doc_id", "doc.size", "source_size", "target", (F.col("doc.size") * F.col("copies")).alias("taken"), "copies", "positions", F.get("positions", F.lit(0)).alias("first_position"))
    return _range_sorted(out, "first_position", "doc_id")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, in the order of the training positions; those not taken go."""
    bucket, rest = _place(F.col("doc_id"))
    rows = docs.select(F.struct("*").alias("doc"), F.col("source").cast("string").alias("source"), bucket.alias("bucket"), rest.alias("rest"), F.coalesce(F.col("text").rlike(common.WORD_PATTERN), F.lit(False)).alias("some"))
    spread = mixed(rows, sized(docs)).select("doc", F.explode("positions").alias("position"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return spread.repartitionByRange(n, "position").sortWithinPartitions("position", "doc.doc_id").select("doc.*")
