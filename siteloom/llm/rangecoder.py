"""Token-id output through an adaptive context-mixing range coder.

Blocks of BLOCK ids are coded independently, each from the state that the chunk's head gives, and carry their own CRC-32; so
a damaged block is noticed and costs nothing else. numpy codes all blocks of a chunk side by side, one id of each at a time.

Three predictions are mixed. Order 2 and order 1 name the id last seen after the same two ids and after the same id, each
with a confidence and an adaptive hit rate. Order 0 is a distribution of all ids: they lie in up to BINS bins of ids that keep
company (an axis on which ids of the same blocks come near each other is cut into parts of equal weight), a bin's ids share it by
their frequency in the chunk, and the bins' own shares start from that frequency and then follow what the block has had. Weights
of the orders follow how well each did. The mixture drives the coder with one interval an id: the prediction of order 2, that
of order 1, or the id's part of order 0's remainder.

A shard table has one row per chunk: part and chunk number (both ascending with doc_id), doc_ids, the ids that each
document takes, the ids in all, and the coded blocks. A part is a range of documents that one task has written.

Nulls: a null text is empty (the end id alone); rows with a null doc_id come first. Ties in doc_id are settled by the text's hash and
the text, so rows of one id are spread over tasks like other rows, and repeated rows stand side by side. Very long texts are encoded whole and
make a long chunk. Extra columns, whatever their names, are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, encoding

BLOCK = 448
#: Ids of a chunk: whole documents until there are as many.
CHUNK = 4 << 20
END = 0
MAGIC = b"CMRC2\0\0\0"
_HEAD = struct.Struct("<8sQIII")
MOST_IDS = 1 << 17
#: Order 0: bins, places in a bin, places that all bins share, and how many each has at least.
BINS = 16
_IN_BIN, _SHARES, _LEAST = 14, 15, 8
#: How much an id adds to its bin, against a start of _START for all bins, and after how many ids the shares are set anew.
_GAIN, _START, _EVERY = 4.0, 256.0, 64
#: Blocks that place the ids on their axis, and rounds of that.
_SAMPLE, _ROUNDS = 256, 6
U = np.uint64
#: What a miss (first eight) or a hit adds to each confidence.
_STEPS = np.array([0, 0, 0, 0, -3, -3, -3, -3, 1, 1, 1, 1, 1, 1, 1, 0], np.int32)
#: What order 0 gives to an id that the others did not name, and to one that they did, about a thousandth.
_SHORT = np.array([1, 0.001], np.float32)
_LOW, _BITS, _DIGIT = U((1 << 40) - 1), U(40), U(16)


class Corrupt(ValueError):
    """A chunk or block that does not agree with its checksum."""


class _Ids:
    """Order 0 of a chunk: ids by bin, their places within, and the bins' first shares."""

    def __init__(self, ids: np.ndarray, bins: np.ndarray, steps: np.ndarray, shares: np.ndarray):
        """Ids (ascending in each bin), their bins (ascending), frequencies as quarters of octaves, and the bins' shares."""
        self.stored = ids, bins, steps, shares
        self.n = int(bins[-1]) + 1 if len(bins) else 0
        weight = np.exp2(steps / 4.0)
        first = np.searchsorted(bins, np.arange(self.n + 1))
        size = np.diff(first)
        free = (1 << _IN_BIN) - size
        freq = 1 + np.floor(weight / np.bincount(bins, weight, self.n)[bins] * free[bins] * 0.999).astype(np.int64)
        freq[first[:-1]] += (1 << _IN_BIN) - np.bincount(bins, freq, self.n).astype(np.int64)
        top = int(ids.max()) + 1 if len(ids) else 1
        self.where = np.zeros(top, np.int64)  # id -> bin, start within, frequency
        begin = (np.cumsum(freq) - freq) & ((1 << _IN_BIN) - 1)
        self.where[ids] = bins << 32 | begin << 16 | freq
        self.at = np.repeat(ids.astype(np.int32), freq)  # (bin, place) -> id
        self.shares = shares.astype(np.float32)

    @classmethod
    def of(cls, ids: np.ndarray, block: int) -> _Ids:
        counts = np.bincount(ids)
        own = np.flatnonzero(counts)
        n = counts[own]
        order = np.argsort(_axis(ids, block, len(counts))[own], kind="stable")
        weight = (n / n.sum() + 1 / len(n))[order]
        bins = np.minimum((np.cumsum(weight) - weight / 2) * (BINS / 2), BINS - 1).astype(np.int64)
        bins = np.unique(bins, return_inverse=True)[1]
        again = np.lexsort((own[order], bins))
        own, n, bins = own[order][again], n[order][again], bins[again]
        shares = np.maximum(np.bincount(bins, n) * 60000 // n.sum(), 1)
        return cls(own, bins, np.rint(4 * np.log2(n)).astype(np.int64), shares)

    def packed(self) -> bytes:
        """A byte an id: how far it is from the one before and its frequency, 15 of either standing for more, which follows."""
        ids, bins, steps, shares = self.stored
        far = np.where(np.diff(bins, prepend=-1) > 0, ids, np.diff(ids, prepend=0) - 1)
        more = far[far >= 15].astype("<u4"), steps[steps >= 15].astype(np.uint8)
        short = (np.minimum(far, 15) << 4 | np.minimum(steps, 15)).astype(np.uint8)
        lens = np.bincount(bins, minlength=self.n).astype("<u4")
        return zlib.compress(struct.pack("<4I", len(ids), self.n, *map(len, more)) + shares.astype("<u2").tobytes() + lens.tobytes() + short.tobytes() + more[0].view(np.uint8).reshape(-1, 4).T.tobytes() + more[1].tobytes())

    @classmethod
    def unpacked(cls, blob: bytes) -> _Ids:
        raw = zlib.decompress(blob)
        m, n, m_far, m_steps = struct.unpack_from("<4I", raw)
        shares, at = np.frombuffer(raw, "<u2", n, 16).astype(np.int64), 16 + 2 * n
        bins, at = np.repeat(np.arange(n), np.frombuffer(raw, "<u4", n, at)), at + 4 * n
        short, at = np.frombuffer(raw, np.uint8, m, at), at + m
        far, steps = (short >> 4).astype(np.int64), (short & 15).astype(np.int64)
        far[far == 15] = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * m_far, at).reshape(4, -1).T).view("<u4").ravel()
        steps[steps == 15] = np.frombuffer(raw, np.uint8, m_steps, at + 4 * m_far)
        new = np.diff(bins, prepend=-1) > 0
        sums = np.cumsum(np.where(new, 0, far + 1))
        return cls(sums + (far - sums)[new][bins], bins, steps, shares)


def _axis(ids: np.ndarray, block: int, top: int) -> np.ndarray:
    """A place for each id, by the blocks it stands in: the main axis of ids against blocks, from a sample of blocks."""
    blocks = -(-len(ids) // block)
    chosen = np.unique(np.linspace(0, blocks - 1, min(blocks, _SAMPLE)).astype(np.int64)) if blocks else np.zeros(0, np.int64)
    if len(chosen) < 8:
        return np.zeros(top)
    own = np.concatenate([ids[b * block : (b + 1) * block] for b in chosen.tolist()])
    row = np.repeat(np.arange(len(chosen)), [len(ids[b * block : (b + 1) * block]) for b in chosen.tolist()])
    per_id, per_row = np.bincount(own, minlength=top), np.bincount(row)
    place = np.random.default_rng(0).normal(size=top)
    for _ in range(_ROUNDS):
        mean = np.bincount(row, place[own]) / per_row
        mean -= (mean * per_row).sum() / per_row.sum()
        mean /= np.abs(mean).max() + 1e-9
        place = np.bincount(own, mean[row], top) / np.maximum(per_id, 1)
    return np.where(per_id >= 8, np.round(place, 3), 0.0)


class _Mixer:
    """The adaptive state of many blocks, before one id of each. All of it is 32-bit arithmetic that every machine does alike."""

    ROWS = 7  # bits of the number of rows; a row has a place for order 1 and three for order 2 beside it

    def __init__(self, n: int, order0: _Ids):
        lane = np.arange(n, dtype=np.int64)
        self.lane, self.n, self.order0 = lane, n, order0
        self.base, self.base8 = lane << self.ROWS, lane << 3
        self.seen = np.zeros(n << (self.ROWS + 2), np.int32)
        rate = (0.1 + 0.11 * np.arange(8)).astype(np.float32)
        self.hits1, self.hits2 = np.tile(rate, n), np.tile(rate, n)
        self.w1, self.w2 = np.full(n, 0.3, np.float32), np.full(n, 0.3, np.float32)
        self.last, self.before = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
        start = order0.shares / np.float32(max(1.0, float(order0.shares.sum()))) * np.float32(_START)
        self.counts = np.repeat(start[:, None].astype(np.float32), n, 1)
        self.had = np.zeros((_EVERY, n), np.int64)
        self.steps = 0
        self._settle()

    def _settle(self):
        """The bins' cumulated shares of 2^15, a row a bin."""
        k = self.order0.n
        total = self.counts.sum(0)
        sums = np.cumsum(self.counts, 0) * (np.float32((1 << _SHARES) - _LEAST * k) / total) * np.float32(0.9999)
        cum = np.zeros((k + 1, self.n), np.int32)
        cum[1:] = sums.astype(np.int32) + _LEAST * np.arange(1, k + 1, dtype=np.int32)[:, None]
        cum[k] = 1 << _SHARES
        self.cum = cum

    def predict(self):
        """Predicted ids of order 2 and 1 and their shares of 2^32."""
        row = (self.last * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.ROWS)
        beside = (((self.before * np.uint32(0x85EBCA6B)) >> np.uint32(16)) * np.uint32(3) >> np.uint32(16)) + np.uint32(1)
        self.i1 = (row + self.base) << 2
        self.i2 = self.i1 + beside
        self.t1, self.t2 = self.seen.take(self.i1, mode="wrap"), self.seen.take(self.i2, mode="wrap")
        self.a, self.b = self.t2 >> 3, self.t1 >> 3
        self.j1, self.j2 = (self.t1 & 7) + self.base8, (self.t2 & 7) + self.base8
        self.p1, self.p2 = self.hits1.take(self.j1, mode="wrap"), self.hits2.take(self.j2, mode="wrap")
        one, two = self.w1 * self.p1, self.w2 * self.p2
        joint = (self.a == self.b) * one
        scale = np.float32(0.98 * (1 << 24))
        fa, fb = ((two + joint) * scale).astype(np.int64) + 1, ((one - joint) * scale).astype(np.int64) + 1
        return self.a, self.b, fa << 8, fb << 8

    def update(self, x: np.ndarray, bins: np.ndarray, ok1: np.ndarray, ok2: np.ndarray):
        p1, p2 = self.p1, self.p2
        fresh = x << 3
        total = np.float32(1) - self.w1
        total -= self.w2
        total *= _SHORT.take((ok1 | ok2).view(np.int8), mode="wrap")
        each = []
        for p, w, hits, j, i, t, ok in ((p1, self.w1, self.hits1, self.j1, self.i1, self.t1, ok1), (p2, self.w2, self.hits2, self.j2, self.i2, self.t2, ok2)):
            hit = ok.astype(np.int32)
            got = hit.astype(np.float32)
            # what the order gave to what came: its rate or the rest
            e = p + got
            e -= np.float32(1)
            np.abs(e, out=e)
            e *= w
            total += e
            each.append(e)
            got *= np.float32(0.98)
            got += np.float32(0.01)
            got -= p
            got *= np.float32(0.04)
            got += p
            hits[j] = got
            # a hit makes surer, a miss halves what was sure and replaces what was not
            sure = t & 7
            hit <<= 3
            hit += sure
            new = _STEPS.take(hit, mode="wrap")
            new += t
            np.copyto(new, fresh, where=hit < 4)
            self.seen[i] = new
        scale = np.float32(0.94) / total
        for e in each:
            e *= scale
            e += np.float32(0.02)
        self.w1, self.w2 = each
        self.had[self.steps % _EVERY] = bins
        self.steps += 1
        if self.steps % _EVERY == 0:
            added = np.bincount((self.had * self.n + self.lane).ravel(), minlength=self.counts.size)
            self.counts += added.reshape(self.counts.shape).astype(np.float32) * np.float32(_GAIN)
            self._settle()
        self.before, self.last = self.last, x.view(np.uint32)


class _Writer:
    """Range coders of many blocks: 56-bit ranges, 16-bit digits, carries settled at the end."""

    def __init__(self, n: int, digits: int):
        self.low, self.range = np.zeros(n, U), np.full(n, 1 << 56, U)
        self.out, self.n = np.zeros((n, digits), np.uint32), np.zeros(n, np.int64)

    def put(self, start, freq):
        """An interval of 2^32."""
        r = self.range >> U(32)
        self.low += r * start
        self.range = r * freq
        small = np.flatnonzero(self.range < U(1 << 40))
        while len(small):
            self._shift(small)
            small = small[self.range[small] < U(1 << 40)]

    def _shift(self, at):
        low, n = self.low[at], self.n[at]
        if n.max() >= self.out.shape[1]:
            self.out = np.pad(self.out, ((0, 0), (0, 64)))
        self.out[at, n] = low >> _BITS
        self.n[at] = n + 1
        self.low[at] = (low & _LOW) << _DIGIT
        self.range[at] <<= _DIGIT

    def finish(self) -> list[bytes]:
        every = np.arange(len(self.low))
        self.low += _LOW  # a range is 2^40 at least, so it holds a number whose lower 40 bits are zero; those are not written
        self._shift(every)
        carry = np.zeros(len(every), np.uint32)
        for k in range(int(self.n.max()) - 1, -1, -1):
            d = self.out[:, k] + carry
            carry = d >> np.uint32(16)
            self.out[:, k] = d & np.uint32(0xFFFF)
        digits = self.out.astype("<u2")
        return [digits[i, :n].tobytes() for i, n in enumerate(self.n.tolist())]


class _Reader:
    def __init__(self, payloads: list[bytes]):
        longest = max(map(len, payloads)) // 2 + 6
        self.digits = np.zeros((len(payloads), longest), U)
        for i, p in enumerate(payloads):
            self.digits[i, : len(p) // 2] = np.frombuffer(p, "<u2")
        # the first digit stands for bits 40 to 55
        d = self.digits
        self.code = d[:, 0] << _BITS | d[:, 1] << U(24) | d[:, 2] << U(8) | d[:, 3] >> U(8)
        self.half = d[:, 3] & U(255)  # bits of the next digit's upper byte, not in the code yet
        self.range, self.n = np.full(len(payloads), 1 << 56, U), np.full(len(payloads), 4)

    def peek(self) -> np.ndarray:
        self.r = self.range >> U(32)
        return np.minimum(self.code // self.r, U((1 << 32) - 1)).astype(np.int64)

    def take(self, start, freq):
        self.code -= self.r * start
        self.range = self.r * freq
        small = np.flatnonzero(self.range < U(1 << 40))
        while len(small):
            n = self.n[small]
            d = self.digits[small, np.minimum(n, self.digits.shape[1] - 1)]
            self.code[small] = self.code[small] << _DIGIT | self.half[small] << U(8) | d >> U(8)
            self.half[small] = d & U(255)
            self.range[small] <<= _DIGIT
            self.n[small] = n + 1
            small = small[self.range[small] < U(1 << 40)]


def _parts(where):
    """Bin, start and frequency of ids."""
    return where >> 32, where >> 16 & 0xFFFF, where & 0xFFFF


def _bin(mix: _Mixer, width, bins):
    """Where a bin begins in order 0's remainder of some width, and how wide it is."""
    at = bins * mix.n + mix.lane
    cum = mix.cum.reshape(-1)
    low = (width * cum.take(at, mode="wrap")) >> _SHARES
    return low, ((width * cum.take(at + mix.n, mode="wrap")) >> _SHARES) - low


def encoded(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A chunk of ids (below 2^17) as coded blocks."""
    n = len(ids)
    lanes = -(-n // block)
    if n and int(ids.max()) >= MOST_IDS:
        raise ValueError("ids must be below 2^17")
    order0 = _Ids.of(ids, block) if n else _Ids(*[np.zeros(0, np.int64)] * 4)
    prior = order0.packed()
    payloads = []
    if lanes:
        grid = np.full((lanes, block), ids[0], np.int32)
        grid.reshape(-1)[:n] = ids
        steps = min(block, n)
        grid = np.ascontiguousarray(grid[:, :steps].T)
        mix, out = _Mixer(lanes, order0), _Writer(lanes, block * 2 // 3 + 64)
        for x in grid:
            bins, begin, size = _parts(order0.where.take(x))
            a, b, fa, fb = mix.predict()
            ok2, ok1 = a == x, b == x
            both = fa + fb
            low, wide = _bin(mix, (1 << 32) - both, bins)
            inner = (wide * begin) >> _IN_BIN
            freq = ((wide * (begin + size)) >> _IN_BIN) - inner
            start = both + low
            start += inner
            np.copyto(start, fa, where=ok1)
            np.copyto(freq, fb, where=ok1)
            np.copyto(start, 0, where=ok2)
            np.copyto(freq, fa, where=ok2)
            out.put(start.view(U), freq.view(U))
            mix.update(x, bins, ok1, ok2)
        payloads = out.finish()
    index = np.array([(len(p) // 2, zlib.crc32(p)) for p in payloads], "<u4").tobytes()
    return _HEAD.pack(MAGIC, n, block, lanes, len(prior)) + struct.pack("<I", zlib.crc32(prior + index)) + prior + index + b"".join(payloads)


def decoded(blob: bytes, blocks: range | None = None) -> np.ndarray:
    """The ids of a chunk, or of some consecutive blocks of it."""
    magic, n, block, lanes, size = _HEAD.unpack_from(blob)
    at = _HEAD.size + 4
    prior, raw = bytes(blob[at : at + size]), blob[at + size : at + size + 8 * lanes]
    if magic != MAGIC or len(raw) != 8 * lanes or zlib.crc32(prior + raw) != struct.unpack_from("<I", blob, _HEAD.size)[0]:
        raise Corrupt("head of the chunk")
    index = np.frombuffer(raw, "<u4").reshape(lanes, 2).astype(np.int64)
    ends = at + size + 8 * lanes + np.cumsum(2 * index[:, 0])
    chosen = range(lanes) if blocks is None else blocks
    payloads = [bytes(blob[ends[i] - 2 * index[i, 0] : ends[i]]) for i in chosen]
    for i, p in zip(chosen, payloads):
        if zlib.crc32(p) != index[i, 1]:
            raise Corrupt(f"block {i}")
    if not payloads:
        return np.zeros(0, np.uint32)
    m, steps, order0 = len(payloads), min(block, n), _Ids.unpacked(prior)
    mix, src, out = _Mixer(m, order0), _Reader(payloads), np.zeros((steps, m), np.int32)
    for k in range(steps):
        a, b, fa, fb = mix.predict()
        both = fa + fb
        v = src.peek()
        is2, is1 = v < fa, v < both
        width = (1 << 32) - both
        # the last bin, then the last place, that begins at v or before; these quotients are exact in 64-bit floats
        u = np.maximum(v - both, 0)
        share = ((((u + 1) << _SHARES) - 1) / width).astype(np.int32)
        bins = (mix.cum[1 : order0.n] <= share).sum(0, dtype=np.uint8).astype(np.int64)
        low, wide = _bin(mix, width, bins)
        place = ((((u - low + 1) << _IN_BIN) - 1) / wide).astype(np.int64)
        np.minimum(place, (1 << _IN_BIN) - 1, out=place)
        x = order0.at.take(bins << _IN_BIN | place)
        np.copyto(x, b, where=is1)
        np.copyto(x, a, where=is2)
        bins, begin, size = _parts(order0.where.take(x, mode="clip"))
        start = (wide * begin) >> _IN_BIN
        freq = ((wide * (begin + size)) >> _IN_BIN) - start
        start += both
        start += low
        np.copyto(start, fa, where=is1)
        np.copyto(freq, fb, where=is1)
        np.copyto(start, 0, where=is2)
        np.copyto(freq, fa, where=is2)
        src.take(start.view(U), freq.view(U))
        out[k] = x
        mix.update(x, bins, b == x, a == x)
    flat = np.zeros((m, block), np.int32)
    flat[:, :steps] = out.T
    return flat.reshape(-1)[: max(0, min(n, chosen[-1] * block + block) - chosen[0] * block)].astype(np.uint32)


# ---------------------------------------------------------------- shards


def _shards(path: str, end: int, block: int, chunk: int):
    def run(batches):
        encoder = encoding.encoder(path)
        part, number, docs, lens, ids, size = TaskContext.get().partitionId(), 0, [], [], [], 0

        def row(docs, lens, ids):
            one = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([lens], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([*one, pa.array([encoded(ids, block)], pa.binary())], ["part", "chunk", "n_tokens", "doc_ids", "lengths", "payload"])

        for batch in common.slices(batches, encoding.SLICE):
            got, n = encoder.encode_all(common.texts(batch), end)
            docs += batch.column("doc_id").to_pylist()
            lens += n.tolist()
            ids.append(got)
            size += len(got)
            if size >= chunk:
                ids = [np.concatenate(ids)]
                ends = np.cumsum(lens)
                while len(ends) and ends[-1] >= chunk:
                    k = int(np.searchsorted(ends, chunk)) + 1  # whole documents until there are as many
                    yield row(docs[:k], lens[:k], ids[0][: ends[k - 1]])
                    number, docs, lens, ids = number + 1, docs[k:], lens[k:], [ids[0][ends[k - 1] :]]
                    ends = np.cumsum(lens)
                size = len(ids[0])
        if docs:
            yield row(docs, lens, np.concatenate(ids))

    return run


SHARDS = "part int, chunk int, n_tokens long, doc_ids array<long>, lengths array<long>, payload binary"


def shards(docs: DataFrame, path: str | None = None, end: int = END, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """Shard rows of all documents in ascending doc_id order: range-partitioned, so no task sees more than its range."""
    tie = F.xxhash64("text")  # splits rows of one id
    ordered = common.id_text(docs).repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie, "text")
    return ordered.mapInArrow(common.tidied(_shards(path or encoding.vocabulary(), end, block, chunk)), SHARDS)


def _documents(batches):
    for batch in batches:
        for r in range(batch.num_rows):
            ids = decoded(batch.column("payload")[r].as_py())
            lens = np.array(batch.column("lengths")[r].as_py(), np.int64)
            ends = np.cumsum(lens)
            if len(ids) != ends[-1]:
                raise Corrupt("the index and the ids differ in number")
            raw = ids.astype("<u4").tobytes()
            crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lens.tolist())]
            same = lambda c, n=len(lens): pa.array([batch.column(c)[r].as_py()] * n, pa.int32())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([same("part"), same("chunk"), batch.column("doc_ids")[r].values, pa.array(ends - lens), pa.array(lens), pa.array(crc, pa.int64())], ["part", "chunk", "doc_id", "offset", "n_tokens", "ids_crc32"])


def read_documents(table: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from shard rows: every block is checked and decoded."""
    sizes = table.select("part", "chunk", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    to_here = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    parts = parts.select("part", F.coalesce(F.sum("n").over(to_here), F.lit(0)).alias("before_part"))
    in_part = Window.partitionBy("part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = sizes.select("part", "chunk", F.coalesce(F.sum("n_tokens").over(in_part), F.lit(0)).alias("before_chunk")).join(parts, "part")
    rows = table.mapInArrow(common.tidied(_documents), "part int, chunk int, doc_id long, offset long, n_tokens long, ids_crc32 long")
    return rows.join(chunks, ["part", "chunk"]).select("doc_id", (F.col("before_part") + F.col("before_chunk") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def query(spark, sf_dir: str) -> DataFrame:
    return read_documents(common.stored(shards(common.documents(spark, sf_dir)), "token-shards"))
