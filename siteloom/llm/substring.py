"""Removal of repeated passages, found by difference-cover anchors.

Positions of a document are taken modulo 7, and anchors of 7 words are hashed at residues 0, 1 and 3 only. These
residues have every difference modulo 7, so wherever two documents share 13 words, some offset below 7 is an anchor
position in both, and the anchor lies within the 13 words. Three passes:

1. Anchors are counted (pre-aggregated in each slice); those seen twice set bits of a Bloom filter that has 16 bits for each
   of them, up to 2^30 bits.
2. A window of 13 words that holds such an anchor is a candidate. Its hash of 96 bits is extended to all 13 words, and the smallest
   doc_id of each window hash is found. The filter only prunes: a false hit costs a row and changes no result, so a filter that
   is full makes more candidates (every window at most) and loses none.
3. Windows seen in a smaller doc_id come back to their row as runs of covered words, which it drops.

Hot passages: every aggregation is combined before its shuffle, and the window join is an equi-join that adaptive
execution can split. With 96 bits, 10^13 windows have a false match with a chance of one in a thousand.

Nulls: a null text has no words; rows with a null doc_id neither lose words nor make others lose any. Repeated rows have
one doc_id, so they do not remove each other. Rows of one doc_id with other texts are told apart by 34 bits of their text's hash, and each loses its
own words; ties in doc_id remove nothing. Very long texts are read whole. Extra columns, whatever their names, pass through the
stage. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 13
#: Difference covers: period -> residues with all differences modulo the period.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3)}
#: Bits of a Bloom filter: as many as its entries times PER_ENTRY, at least and at most so many (as powers of two).
LEAST_BITS, BITMAP_BITS, PER_ENTRY = 20, 30, 16
HASHES = 2


def plan(window: int) -> tuple[int, tuple[int, ...], int]:
    """Period, cover and anchor width for a window: the longest period that leaves anchors of 7 words, or 1."""
    period = max((p for p in COVERS if window - p + 1 >= 7), default=1)
    return period, COVERS[period], window - period + 1


def _anchors(words: common.Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors and their hashes."""
    period, cover, width = plan(window)
    at = np.flatnonzero(np.isin(words.pos % period, cover) & (words.left >= width))
    return at, words.windows(at, width)


def _split(batch) -> common.Words:
    known = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
    return common.Words([t.split() if k else [] for t, k in zip(common.texts(batch), known)])


def _count_anchors(window: int):
    def run(batches):
        for batch in common.slices(batches):
            h, n = np.unique(_anchors(_split(batch), window)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int64))], ["h", "n"])

    return run


def _slots(h, bits: int, k: int):
    """The k-th place of a hash in the bitmap: its top bits, then its lower ones (a Column or numpy values)."""
    if isinstance(h, np.ndarray):
        return ((h << np.uint64(k * 32)) >> np.uint64(64 - bits)).astype(np.int64)
    return F.shiftrightunsigned(F.shiftleft(h, k * 32), 64 - bits)


def filter_bits(entries: int, most: int = BITMAP_BITS) -> int:
    return min(most, max(LEAST_BITS, (entries * PER_ENTRY).bit_length()))


def bloom(hashes: DataFrame, bits: int):
    """A Bloom filter of 2^bits bits with the longs of column h; the driver gets its 64-bit words."""
    slot = hashes.select(F.explode(F.array(*(_slots(F.col("h"), bits, k) for k in range(HASHES)))).alias("slot"))
    word = slot.select(F.shiftright("slot", 6).cast("int").alias("i"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("w"))
    rows = word.groupBy("i").agg(F.bit_or("w").alias("w"))
    out = np.zeros(max(1, 1 << (bits - 6)), np.int64)
    with common.freed_shuffles(hashes.sparkSession):
        for batch in rows.mapInArrow(_gathered, "i binary, w binary").toArrow().to_batches():
            for i, w in zip(batch.column("i").to_pylist(), batch.column("w").to_pylist()):
                out[np.frombuffer(i, np.int32)] = np.frombuffer(w, np.int64)
    common.tidy()
    return hashes.sparkSession.sparkContext.broadcast(out.view(np.uint64))


def _gathered(batches):
    """Words and their places, a batch in one row."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.column(c).to_numpy().tobytes()], pa.binary()) for c in ("i", "w")], ["i", "w"])


def hits(marked: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    """1 where a hash may be in the filter, else 0."""
    out = np.ones(len(h), np.uint64)
    for k in range(HASHES):
        slot = _slots(h, bits, k)
        out &= marked[slot >> 6] >> (slot & 63).astype(np.uint64)
    return out


def _bitmap(docs: DataFrame, window: int, most: int):
    """A Bloom filter with the anchors that occur twice, and its size."""
    counted = docs.mapInArrow(common.tidied(_count_anchors(window)), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    twice = common.stored(counted.where("n > 1").select("h"), "anchors")
    bits = filter_bits(twice.count(), most)
    out = bloom(twice, bits)
    common.drop(twice)
    return out, bits


def _candidates(window: int, bits: int, bitmap):
    def run(batches):
        marked = bitmap.value
        _, _, width = plan(window)
        for batch in common.slices(batches):
            words = _split(batch)
            at, h = _anchors(words, window)
            hit = hits(marked, h, bits)
            n = len(words.pos)
            seen = np.zeros(n + window + 1, np.int32)
            seen[at + 1] = hit.astype(np.int32)
            seen = np.cumsum(seen, dtype=np.int32)
            near = seen[window - width + 1 : window - width + 1 + n] > seen[:n]  # an anchor starts in the window and ends in it
            p = np.flatnonzero(near & (words.left >= window))
            own = [np.asarray(batch.column(c).fill_null(0))[words.doc[p]] for c in ("doc_id", "t")]
            both = words.windows(p, window).view(np.int64), (words.windows(p, window, window + 1) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays([*map(pa.array, both), *map(pa.array, own), pa.array(words.pos[p].astype(np.int32))], ["h", "g", "doc_id", "t", "pos"])

    return run


def _runs(window: int):
    """Starts of windows to the runs of words that they cover."""

    def run(batches):
        for batch in batches:
            lists = []
            for at in _lists(batch.column("at")):
                p = np.unique(at).astype(np.int64)
                first = np.r_[True, p[1:] > p[:-1] + window] if len(p) else np.zeros(0, bool)
                last = np.r_[first[1:], True] if len(p) else first
                lists.append(np.stack([p[first], p[last] + window], 1).ravel().tolist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), pa.array(lists, pa.list_(pa.int32()))], ["doc_id", "t", "at"])

    return run


def _covered(n: int, runs) -> np.ndarray:
    """Which of n words lie in one of the runs, a flat row of starts and ends."""
    out = np.zeros(n, bool)
    for a, b in zip(runs[::2].tolist(), runs[1::2].tolist()):
        out[a:b] = True
    return out


def spans(docs: DataFrame, window: int = WINDOW, bits: int = BITMAP_BITS) -> DataFrame:
    """(doc_id, t, at array<int>): runs of words to remove, as a row of starts and ends, where there are any; t is the text's hash.

    They are covered by windows whose words also start in a document with a smaller doc_id. The filter has 2^bits bits at most.
    """
    it = _own(docs)
    bitmap, size = _bitmap(it, window, bits)
    found = common.stored(it.mapInArrow(common.tidied(_candidates(window, size, bitmap)), "h long, g int, doc_id long, t long, pos int"), "windows")
    bitmap.destroy()  # also its copies on the executors' disks
    first = found.groupBy("h", "g").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h", "g", "lo")
    first = common.stored(first, "first-windows")  # from a table, both sides of the join are shuffled for it, and a hot window can be split
    # a text has fewer than 2^30 words, so place and text fit into one number, which makes less to shuffle
    rows = found.select("h", "g", "doc_id", F.shiftleft("t", 30).bitwiseOR(F.col("pos").cast("long")).alias("at"))
    own, pos = F.shiftrightunsigned("at", 30).alias("t"), F.col("at").bitwiseAND(F.lit((1 << 30) - 1)).cast("int")
    starts = rows.join(first, ["h", "g"]).where("lo < doc_id").groupBy("doc_id", own).agg(F.collect_list(pos).alias("at"))
    out = common.stored(starts.mapInArrow(common.tidied(_runs(window)), "doc_id long, t long, at array<int>"), "spans")
    common.drop(found, first)
    return out


def _text_hash(text):
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 30)


def _own(docs: DataFrame) -> DataFrame:
    return common.id_text(docs).withColumn("t", _text_hash(F.col("text")))


def _digests(batches):
    for batch in common.slices(batches):
        n, gone, sha = [], [], []
        for t, at in zip(common.texts(batch), _lists(batch.column("at"))):
            ws = t.split()
            if at is not None:
                out = _covered(len(ws), at)
                n.append(len(ws))
                gone.append(int(out.sum()))
                ws = [w for w, o in zip(ws, out.tolist()) if not o]
            else:
                n.append(len(ws))
                gone.append(0)
            sha.append(hashlib.sha256(b" ".join(ws)).hexdigest())
        yield pa.RecordBatch.from_arrays([common.ids(batch), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _lists(col) -> list:
    """A list column as numpy slices, None for null."""
    edges, values = col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False)
    return [values[a:b] if ok else None for a, b, ok in zip(edges, edges[1:], col.is_valid().to_pylist())]


def cut(text: bytes, runs) -> bytes:
    """A text without the words of some runs; a kept word keeps the white space that follows it."""
    out = _covered(len(text.split()), runs)
    if not out.any():
        return text
    raw = np.frombuffer(text, np.uint8)
    solid = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    begins = np.flatnonzero(solid & ~np.r_[False, solid[:-1]])
    ends = np.r_[begins[1:], len(raw)]
    return b"".join(text[a:b] for a, b, o in zip(begins.tolist(), ends.tolist(), out.tolist()) if not o).rstrip(b" \t\n\r\x0b\x0c")


def _cut_texts(runs: str):
    """Texts without the words of the runs in a column, which goes."""

    def run(batches):
        for batch in common.slices(batches):
            at = _lists(batch.column(runs))
            new = [t if p is None else cut(t, p) for t, p in zip(common.texts(batch), at)]
            new = pa.array([None if p is None and not ok else t for t, p, ok in zip(new, at, batch.column("text").is_valid().to_pylist())], pa.binary()).cast(pa.string())
            put = {"text": new}
            if "n_chars" in batch.schema.names:
                own = batch.column("n_chars")
                put["n_chars"] = pc.if_else(batch.column(runs).is_valid(), pc.utf8_length(new).cast(own.type), own)
            names = [f.name for f in batch.schema if f.name != runs]
            out = pa.RecordBatch.from_arrays([put.get(c, batch.column(c)) for c in names], names)
            yield out.filter(pa.array([p is None or t != b"" for p, t in zip(at, new.cast(pa.binary()).to_pylist())]))

    return run


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document."""
    joined = _own(docs).join(spans(docs, window).hint("merge"), ["doc_id", "t"], "left")
    return joined.mapInArrow(common.tidied(_digests), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    return digests(common.documents(spark, sf_dir))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated passages; one that has no word left after that goes, n_chars follows the text."""
    common.small_batches(spark)
    runs, own_id, own_text = (common.fresh(docs, c) for c in ("own_runs", "own_id", "own_text"))
    found = spans(docs).withColumnsRenamed({"doc_id": own_id, "t": own_text, "at": runs})
    own = docs.join(found.hint("merge"), (docs["doc_id"] == found[own_id]) & (_text_hash(docs["text"]) == found[own_text]), "left")
    return own.drop(own_id, own_text).mapInArrow(common.tidied(_cut_texts(runs)), docs.schema)
