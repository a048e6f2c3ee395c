"""Best-fit packing of documents into sequences by the sum-of-squares rule.

A document of more than `capacity` tokens is cut into full pieces, the first taking the remainder. Items are dealt by hash
into groups of about PER_GROUP, and each group is packed on its own: an item goes where the squared counts of open bins per
residual gap become smallest, a new bin included. Afterwards the worst filled bins are taken apart and packed again, by best fit,
where that saves bins. Groups are dealt by hash, so every one sees the lengths of the whole and wastes a sequence or so; nothing
grows in one task, and hot sources do not matter.

Nulls: a null text is empty and has the end token alone; a null doc_id is packed like any other. Repeated rows and rows of one
doc_id are packed as often as they occur, each by itself, and dealt by their place in the table too. Very long texts are encoded whole,
a slice of the batch each. Equal lengths are ties, settled by doc_id, piece and checksum. Extra columns, whatever their names, are not
looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, encoding

CAPACITY = 1024
END = 2
PER_GROUP = 60_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens."""
    head = n % capacity or capacity
    return [(0, min(head, n)), *((s, capacity) for s in range(head, n, capacity))]


def _pieces(path: str, end: int, capacity: int):
    def run(batches):
        encoder = encoding.encoder(path)
        for batch in common.slices(batches, encoding.SLICE):
            ids, lens = encoder.encode_all(common.texts(batch), end)
            raw, docs, rows, at = memoryview(ids.view(np.uint8)), batch.column("doc_id").to_pylist(), [], 0
            for doc, n in zip(docs, lens.tolist()):
                rows += [(doc, k, s, m, zlib.crc32(raw[4 * (at + s) : 4 * (at + s + m)])) for k, (s, m) in enumerate(cuts(n, capacity))]
                at += n
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, path: str | None = None, end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document with the checksum of their ids."""
    return common.id_text(docs).mapInArrow(common.tidied(_pieces(path or encoding.vocabulary(), end, capacity)), PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of every item, in the given order, and the number of bins."""
    count = np.zeros(capacity + 1, np.int64)  # open bins per gap; a gap of 0 is closed and never counted
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i, n in enumerate(lengths.tolist()):
        # change of the sum of squares when a bin of gap n, n + 1, ... takes the item
        change = 2 * (1 + count[: capacity - n + 1] - count[n:])
        change[0] = 1 - 2 * count[n]  # the bin closes
        change[count[n:] == 0] = 1 << 40
        best = int(change.argmin())  # ties: the smallest gap that is left
        if count[n + best] and change[best] <= (2 * count[capacity - n] + 1 if n < capacity else 0):
            gap = n + best
            b = stacks[gap].pop()
            count[gap] -= 1
        else:
            gap, b, made = capacity, made, made + 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > n:
            stacks[gap - n].append(b)
            count[gap - n] += 1
    return bins, offsets, made


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """As sum_of_squares(), but every item goes where the least is left."""
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = np.zeros(capacity + 1, bool)
    bins, offsets, made = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i, n in enumerate(lengths.tolist()):
        gap = n + int(open_[n:].argmax())
        if open_[gap]:
            b = stacks[gap].pop()
            open_[gap] = bool(stacks[gap])
        else:
            gap, b, made = capacity, made, made + 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > n:
            stacks[gap - n].append(b)
            open_[gap - n] = True
    return bins, offsets, made


def repaired(lengths: np.ndarray, bins: np.ndarray, offsets: np.ndarray, made: int, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """Takes the worst filled bins apart and packs their items again, longest first, wherever that saves bins.

    Twice as many are taken each time, the emptiest first and half of all bins at most; the best of these packings stays.
    """
    gaps = capacity - np.bincount(bins, lengths, made).astype(np.int64)
    order = np.argsort(-gaps, kind="stable")
    order = order[: max((gaps > 0).sum(), made // 2)] if gaps.any() else order[:0]
    best, out, k = 0, (bins, offsets, made), 32
    while len(order):
        chosen = np.zeros(made, bool)
        chosen[order[:k]] = True
        items = np.flatnonzero(chosen[bins])
        items = items[np.argsort(-lengths[items], kind="stable")]
        again, place, n = best_fit(lengths[items], capacity)
        if chosen.sum() - n > best:
            best = int(chosen.sum() - n)
            names = np.cumsum(~chosen) - 1
            new, at = names[bins], offsets.copy()
            new[items], at[items] = made - chosen.sum() + again, place
            out = new, at, made - best
        if k >= len(order):
            break
        k *= 2
    return out


def _pack(capacity: int):
    def run(key, table):
        g = key[0].as_py()
        # longest first; ids, pieces and checksums settle ties
        order = np.lexsort([table.column(c).to_numpy() for c in ("ids_crc32", "piece")] + [np.asarray(table.column("doc_id").fill_null(-1)), -table.column("length").to_numpy()])
        table = table.take(pa.array(order))
        lengths = table.column("length").to_numpy()
        bins, offsets, _ = repaired(lengths, *sum_of_squares(lengths, capacity), capacity)
        return table.drop(["g"]).append_column("sequence_id", pa.array((g << 32) + bins)).append_column("offset", pa.array(offsets))

    return run


def packed(parts: DataFrame, capacity: int = CAPACITY, per_group: int = PER_GROUP) -> DataFrame:
    """Stored pieces with sequence_id and offset."""
    groups = max(1, -(-parts.count() // per_group))
    dealt = parts.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)).cast("long"))
    return dealt.groupBy("g").applyInArrow(_pack(capacity), PIECES + ", sequence_id long, offset long")


def query(spark, sf_dir: str) -> DataFrame:
    return packed(common.stored(pieces(common.documents(spark, sf_dir)), "pieces"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: where each piece of each document goes."""
    return packed(common.stored(pieces(docs), "pieces"))
