"""LM scoring with a probabilistic suffix tree.

The tree's symbols are words and the end of a text, so it grows with the corpus. Its contexts of up to WORD_DEPTH words are candidates when they
occur LEAST times, an absolute count. A context has the next words that follow it LEAST_NEXT times; its
distribution gives them their counts, and the rest (as many parts as it has such words, and all others that followed it) to its suffix's
distribution. A context is retained where the gain of its own distribution over its suffix's, count times Kullback-Leibler divergence,
is GAIN or more; suffixes of retained contexts stay too. At the root, words seen in training share N / (N + V) by their counts, and others
share the rest by the probability of their spelling. A text's score adds the log10 probability of each symbol after the longest retained
suffix of what precedes it.

Spelling is a second tree, over bytes, learnt from the words of the training vocabulary: contexts of up to DEPTH bytes are candidates
while they make up P_MIN of all symbols, which bounds their number by 1/P_MIN a level; they are retained by the same test and smoothed with
weight PRIOR, down to half a count for each symbol. With depth 0, this tree is learnt from whole texts and scores them by itself.

Counts and probabilities stay in distributed tables that are joined. Only Bloom filters, which just prune, and the commonest entries
are broadcast: at most COMMON_WORDS words and COMMON_KEYS contexts and pairs, whatever the corpus. The log probability after
the longest retained context is the root's plus one difference a level; so each chunk of texts asks for the values of the rarer words,
contexts and pairs that it holds. Questions are dealt to buckets by hash, in one parcel a chunk and bucket; a bucket meets its part of the
tables and sends each chunk a parcel of sums for its documents. Pairs are counted the same way. Buckets follow from the number of tokens, so
one takes what fits in memory at any size, and as common keys are not asked for, no key fills one. The unigram base score needs the counts of
words only and takes the same way.

Nulls: a null text is empty (the end alone); a null doc_id counts as the text "". Repeated rows count and score as often as they
occur, and rows of one doc_id with other texts each by their own. Ties between counts do not matter. A very long text is a chunk of its own. Extra
columns, whatever their names, are not looked at. With no training rows, the model is uniform. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, substring

DEPTH = 4
P_MIN = 1e-4
GAIN = 20.0
PRIOR = 8.0
END = 10  # no word holds this byte
#: The tree over words: longest contexts, how often a context must occur, and a word that follows one after it.
WORD_DEPTH, LEAST, LEAST_NEXT = 2, 50, 10
#: How many of the commonest words, and of the commonest contexts and pairs, are broadcast.
COMMON_WORDS, COMMON_KEYS = 1 << 18, 1 << 21
#: Training tokens for each bucket in which pairs are counted, and tokens for each in which questions are answered.
PAIRS, QUESTIONS = 1 << 20, 1 << 22
#: Codes that a task counts before it adds them up.
HELD = 1 << 19
#: Bytes of text in a chunk.
CHUNK = 4 << 20
_PAD = bytes([END]) * DEPTH
FOLDS, HELD_OUT = 5, 1


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % FOLDS == HELD_OUT


class Symbols:
    """Padded symbols of some texts in a row, and the places to predict."""

    def __init__(self, split: list[list[bytes]]):
        texts = [b" ".join(ws) for ws in split]
        self.sym = np.frombuffer(b"".join(_PAD + t + b"\n" for t in texts), np.uint8).astype(np.int32)
        self.lens = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        real = np.ones(len(self.sym), bool)
        starts = np.cumsum(self.lens + DEPTH) - self.lens - DEPTH
        for k in range(DEPTH):
            real[starts + k] = False
        self.at = np.flatnonzero(real)
        self.next = self.sym[self.at]

    def back(self, k: int) -> np.ndarray:
        """The k-th symbol before each place."""
        return self.sym[self.at - k]


@dataclass
class Candidates:
    """Contexts in the running: codes of three symbols, then (place among those, symbol before) for four."""

    three: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    four: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Dense tables from codes to places, -1 where there is none."""
        if not hasattr(self, "_tables"):
            small = np.int16 if len(self.three) < 1 << 15 else np.int32
            a, b = np.full(1 << 24, -1, small), np.full(len(self.three) << 8 or 1, -1, np.int32)
            a[self.three], b[self.four] = np.arange(len(self.three)), np.arange(len(self.four))
            self._tables = a, b
        return self._tables

    def __getstate__(self):
        return {"three": self.three, "four": self.four}

    def places(self, s: Symbols) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.tables()
        k3 = a[s.back(3) << 16 | s.back(2) << 8 | s.back(1)]
        k4 = np.where(k3 >= 0, b[np.maximum(k3, 0).astype(np.int32) << 8 | s.back(4)], -1) if len(self.four) else np.full(len(k3), -1, np.int32)
        return k3, k4


# ---------------------------------------------------------------- counting


def _training(batch) -> list[list[bytes]]:
    return [t.lower().split() for t, d in zip(common.texts(batch), batch.column("doc_id").to_pylist()) if not held_out(d)]


def _spelled(batch) -> list[list[bytes]]:
    """Words of a vocabulary, each for itself."""
    return [[w] for w in batch.column("text").to_pylist()]


def _summed_codes(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of (codes, counts), ascending, and their counts."""
    code, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return code, np.bincount(at, np.concatenate([n for _, n in parts]), len(code)).astype(np.int64)


def _counted(docs: DataFrame, lists, codes) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the codes that codes(symbols) gives, summed over what lists(batch) takes from a table's batches."""

    def run(batches):
        parts, held = [], 0

        def rows():
            code, n = parts[0]
            for a in range(0, len(code), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(code[a : a + 100_000].astype(np.int64)), pa.array(n[a : a + 100_000])], ["code", "n"])

        for batch in common.slices(batches, 2 << 20):
            split = lists(batch)
            if split:
                parts.append(np.unique(codes(Symbols(split)).astype(np.int32), return_counts=True))
                held += len(parts[-1][0])
                if held > HELD:
                    parts[:] = [_summed_codes(parts)]
                    held = len(parts[0][0])
                    if held > HELD // 2:
                        yield from rows()
                        parts, held = [], 0
        if parts:
            parts[:] = [_summed_codes(parts)]
            yield from rows()

    with common.freed_shuffles(docs.sparkSession):
        got = docs.mapInArrow(common.tidied(run), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    return got.column("code").to_numpy(), got.column("n").to_numpy()


@dataclass
class Model:
    """Retained contexts and their log10 distributions, one row each; row 0 is the empty context."""

    candidates: Candidates
    one: np.ndarray  # symbol -> row
    two: np.ndarray  # code of two symbols -> row or -1
    three: np.ndarray  # place among the candidates -> row or -1
    four: np.ndarray
    logs: np.ndarray

    def _each(self, s: Symbols) -> np.ndarray:
        row = self.one[s.back(1)]
        deeper = self.two[s.back(2) << 8 | s.back(1)]
        row = np.where(deeper >= 0, deeper, row)
        for k, rows in zip(self.candidates.places(s), (self.three, self.four)):
            if len(rows):
                deeper = np.where(k >= 0, rows[np.maximum(k, 0)], -1)
                row = np.where(deeper >= 0, deeper, row)
        return self.logs.reshape(-1)[row.astype(np.int64) << 8 | s.next]

    def scores(self, split: list[list[bytes]]) -> np.ndarray:
        s = Symbols(split)
        edges = np.r_[0, np.cumsum(s.lens)]
        return np.diff(np.r_[0.0, np.cumsum(self._each(s), dtype=np.float64)][edges])

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        """The spelling of each word and its end."""
        return self.scores([[w] for w in words])


def train(docs: DataFrame, p_min: float = P_MIN, gain: float = GAIN, prior: float = PRIOR, lists=_training) -> Model:
    """Learns from the rows that are not held out (or what lists takes from a batch), in one pass a level."""
    code, n = _counted(docs, lists, lambda s: s.back(2) << 16 | s.back(1) << 8 | s.next)
    total = int(n.sum())
    least = max(2.0, p_min * total)
    cand = Candidates(np.sort(code[n >= least]))
    size = len(cand.three) << 8

    def third(s: Symbols):
        k3, _ = cand.places(s)
        ok = k3 >= 0
        base = k3[ok].astype(np.int64) << 8
        return np.r_[base | s.next[ok], size + (base | s.back(4)[ok])]

    code3, n3 = _counted(docs, lists, third) if size else (code[:0], n[:0])
    before = code3 >= size
    cand = Candidates(cand.three, np.sort(code3[before][n3[before] >= least] - size))

    def fourth(s: Symbols):
        _, k4 = cand.places(s)
        ok = k4 >= 0
        return k4[ok] << 8 | s.next[ok]

    code4, n4 = _counted(docs, lists, fourth) if len(cand.four) else (code[:0], n[:0])
    dense = lambda c, m, rows: np.bincount(c, m, rows << 8).reshape(rows, 256)
    by_two_codes = np.unique(code >> 8)
    two_totals = np.bincount(np.searchsorted(by_two_codes, code >> 8), n, len(by_two_codes))
    twos = by_two_codes[two_totals >= least]
    place = np.full(1 << 16, -1, np.int64)
    place[twos] = np.arange(len(twos))
    in_two = place[code >> 8] >= 0
    counts = [
        dense(code & 255, n, 1),
        dense(code & 0xFFFF, n, 256),
        dense(place[code[in_two] >> 8] << 8 | code[in_two] & 255, n[in_two], len(twos)),
        dense(code3[~before], n3[~before], len(cand.three)),
        dense(code4, n4, len(cand.four)),
    ]
    # the suffix of each context: its place on the level above
    suffix = [None, np.zeros(256, np.int64), twos & 255, place[cand.three & 0xFFFF], cand.four >> 8]
    probs = [(counts[0] + 0.5) / (counts[0].sum() + 128)]
    keep = [np.ones(1, bool)]
    for level in range(1, 5):
        up = probs[-1][suffix[level]]
        sums = counts[level].sum(1, keepdims=True)
        p = (counts[level] + prior * up) / (sums + prior)
        probs.append(p)
        keep.append((sums[:, 0] * (p * np.log(p / up)).sum(1) >= gain) & (suffix[level] >= 0))
    for level in range(4, 1, -1):  # suffixes of what is retained stay
        keep[level - 1][suffix[level][keep[level]]] = True
    rows, logs, at = [], [np.log10(probs[0])], 1
    for level in range(1, 5):
        r = np.full(len(keep[level]), 0 if level == 1 else -1, np.int32)
        r[keep[level]] = np.arange(at, at + keep[level].sum())
        at += int(keep[level].sum())
        rows.append(r)
        logs.append(np.log10(probs[level][keep[level]]))
    two = np.full(1 << 16, -1, np.int32)
    two[twos] = rows[1]
    return Model(cand, rows[0], two, rows[2], rows[3], np.concatenate(logs).astype(np.float32))


# ---------------------------------------------------------------- words


def _hash(words: list[bytes]) -> np.ndarray:
    """As Spark's xxhash64() of a binary column."""
    return np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words))


_END_HASH = _hash([b""])[0]
_STEP = np.uint64(common.multipliers(1, seed=4)[0])


def _chained(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a context made one word longer at its near end; with word 0, the key of the context itself."""
    return common.mix64(context * _STEP + word)


class Tokens:
    """The words of some texts as codes of their distinct ones, each text after and before an end (the last code)."""

    def __init__(self, texts: list[bytes]):
        blob = b"\n".join(texts).lower() + b"\n" if texts else b""  # bytes.lower() changes A-Z alone
        raw = np.frombuffer(blob, np.uint8)
        solid = (raw != 32) & ((raw < 9) | (raw > 13))
        edge = np.flatnonzero(np.diff(solid.astype(np.int8), prepend=0))  # starts and ends in turn
        size = edge[1::2] - edge[::2]
        offsets = pa.py_buffer(np.r_[0, np.cumsum(size)].astype(np.int32))
        coded = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, offsets, pa.py_buffer(raw[solid])]).dictionary_encode()
        self.distinct = pa.concat_arrays([coded.dictionary, pa.array([b""], pa.binary())])
        self.words = self.distinct.to_pylist()
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        in_text = np.diff(np.searchsorted(edge[::2], np.r_[0, ends]))
        self.lens = in_text + 1  # with the end
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), in_text + 2)
        start = np.cumsum(in_text + 2) - in_text - 2
        self.pos = np.arange(len(self.doc), dtype=np.int32) - start.astype(np.int32)[self.doc]
        self.code = np.full(len(self.doc), len(self.words) - 1, np.int32)
        inner = np.ones(len(self.doc), bool)
        inner[start] = inner[start + in_text + 1] = False
        self.code[inner] = coded.indices.to_numpy()
        self.hash_of = _hash(self.words)

    def contexts(self, depth: int) -> list[np.ndarray]:
        """Hashes of the 0, 1, ... depth words before each place, across texts where there are fewer."""
        self.hash = self.hash_of[self.code]
        out = [np.zeros(len(self.hash), np.uint64)]
        for _ in range(depth):
            c = np.zeros(len(self.hash), np.uint64)
            c[1:] = _chained(out[-1][:-1], self.hash[:-1])
            out.append(c)
        return out


def _raw_training(batch) -> list[bytes]:
    return [t for t, d in zip(common.texts(batch), batch.column("doc_id").to_pylist()) if not held_out(d)]


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, c) over the training rows; the end is the empty word."""

    def run(batches):
        for batch in common.slices(batches, CHUNK):
            t = Tokens(_raw_training(batch))
            counts = np.bincount(t.code, minlength=len(t.words))
            counts[-1] -= len(t.lens)  # ends before texts
            yield pa.RecordBatch.from_arrays([pa.array(t.words, pa.binary()), pa.array(counts)], ["word", "c"])

    return docs.mapInArrow(common.tidied(run), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")).where("c > 0")


# ---------------------------------------------------------------- contexts of words


@dataclass
class Filter:
    """A broadcast Bloom filter and its size."""

    marks: object
    bits: int

    @classmethod
    def of(cls, hashes: DataFrame) -> Filter:
        bits = substring.filter_bits(hashes.count())
        return cls(substring.bloom(hashes, bits), bits)

    def has(self, h: np.ndarray) -> np.ndarray:
        return substring.hits(self.marks.value, h, self.bits) == 1


def _packed(*arrays: np.ndarray) -> bytes:
    """A parcel: the arrays' sizes in bytes, then the arrays."""
    return b"".join([np.array([a.nbytes for a in arrays], np.int64).tobytes(), *(a.tobytes() for a in arrays)])


def _unpacked(blob: bytes, *kinds) -> list[np.ndarray]:
    sizes, out, at = np.frombuffer(blob, np.int64, len(kinds)).tolist(), [], 8 * len(kinds)
    for kind, n in zip(kinds, sizes):
        out.append(np.frombuffer(blob, kind, n // np.dtype(kind).itemsize, at))
        at += n
    return out


def _bits(tokens: int, each: int) -> int:
    """Buckets, as a power of two and 32 at least, so that each has about so many of the tokens."""
    return max(5, min(30, (max(1, tokens // each) - 1).bit_length()))


def _stretches(hashes: np.ndarray, bits: int) -> dict[int, tuple[int, int]]:
    """Where each bucket, the top bits of a hash, begins and ends among sorted hashes, of those that have any."""
    bucket, first = np.unique((hashes >> np.uint64(64 - bits)).astype(np.int64), return_index=True)
    return dict(zip(bucket.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(hashes)])))


def _parcels(rows: list[tuple], names: list[str], kinds: list):
    cols = list(zip(*rows)) or [()] * len(names)
    for a in range(0, len(rows), 500):
        yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 500], k) for c, k in zip(cols, kinds)], names)


def _count_pairs(k: int, contexts: Filter, words: Filter, bits: int):
    def run(batches):
        for batch in common.slices(batches, CHUNK):
            t = Tokens(_raw_training(batch))
            context = t.contexts(k)[k]
            likely = words.has(t.hash_of)
            at = np.flatnonzero((t.pos >= k) & likely[t.code])
            at = at[contexts.has(context[at])]
            key = _chained(context[at], t.hash[at])
            order = np.argsort(key)
            key = key[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            at, times = at[order[first]], np.diff(np.r_[first, len(key)]).astype(np.uint32)
            context, word = context[at], t.hash[at]
            rows = [(b, _packed(context[i:j], word[i:j], times[i:j])) for b, (i, j) in _stretches(key[first], bits).items()]
            yield from _parcels(rows, ["bucket", "parcel"], [pa.int32(), pa.binary()])

    return run


def _summed(least: int):
    """Counts of a bucket's pairs, of those that occur so often."""

    def run(key, table):
        parts = [_unpacked(p, np.uint64, np.uint64, np.uint32) for p in table.column("parcel").to_pylist()]
        context, word, n = (np.concatenate(x) for x in zip(*parts))
        key = _chained(context, word)
        order = np.argsort(key)
        first = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
        total = np.add.reduceat(n[order].astype(np.int64), first)
        at, total = order[first[total >= least]], total[total >= least]
        return pa.table([pa.array(context[at].view(np.int64)), pa.array(word[at].view(np.int64)), pa.array(total)], names=["context", "word", "n"])

    return run


def _longer(k: int):
    """Pairs (context of k - 1 words, its suffix, word) as contexts of k words and their suffixes."""

    def run(batches):
        for batch in batches:
            context, suffix, word = (batch.column(c).to_numpy().view(np.uint64) for c in ("context", "suffix", "word"))
            below = np.zeros(len(word), np.uint64) if k == 1 else _chained(suffix, word)
            yield pa.RecordBatch.from_arrays([pa.array(_chained(context, word).view(np.int64)), pa.array(below.view(np.int64)), batch.column("n")], ["context", "suffix", "m"])

    return run


def word_tree(docs: DataFrame, vocab: DataFrame, n_train: int, n_words: int, depth: int = WORD_DEPTH, least: int = LEAST, gain: float = GAIN, least_next: int = LEAST_NEXT) -> DataFrame:
    """(key, v, n, level): what pairs and contexts (those with whole set) add to a log10 probability, and how often they occur."""
    total = float(n_train + n_words or 1)
    zero = F.lit(0).cast("long")
    known = vocab.where(F.col("c") >= min(least, least_next)).select(zero.alias("context"), zero.alias("suffix"), F.xxhash64("word").alias("word"), F.col("c").alias("n"), (F.col("c") / total).alias("p"))
    levels, tests = [common.stored(known, "roots")], [None]
    words = Filter.of(levels[0].where(F.col("n") >= least_next).select(F.col("word").alias("h")))
    for k in range(1, depth + 1):
        grown = levels[-1].where(F.col("n") >= least)
        if k > 1:
            grown = grown.where(F.col("word") != F.lit(int(_END_HASH.view(np.int64))))  # nothing follows the end
        contexts = common.stored(grown.select("context", "suffix", "word", "n").mapInArrow(_longer(k), "context long, suffix long, m long"), "contexts")
        marks = Filter.of(contexts.select(F.col("context").alias("h")))
        parcels = docs.mapInArrow(common.tidied(_count_pairs(k, marks, words, _bits(n_train, PAIRS))), "bucket int, parcel binary")
        pairs = parcels.groupBy("bucket").applyInArrow(_summed(least_next), "context long, word long, n long")
        pairs = common.stored(pairs.join(contexts.hint("shuffle_hash"), "context"), "pairs")
        up = levels[-1].select(F.col("context").alias("suffix"), "word", F.col("p").alias("up"))
        both = common.stored(pairs.join(up, ["suffix", "word"]), "pairs-up")
        sums = both.groupBy("context").agg(F.sum("n").alias("own"), F.count("*").alias("t"))
        # what goes to the suffix: a part for each next word, and all that followed once or are rare
        rest = (F.col("t") + F.col("m") - F.col("own")) / (F.col("m") + F.col("t"))
        p = F.col("n") / (F.col("m") + F.col("t")) + F.col("rest") * F.col("up")
        rows = both.join(sums, "context").withColumn("rest", rest).select("context", "suffix", "word", "n", "m", "rest", "up", p.alias("p"))
        levels.append(common.stored(rows, "word-level"))
        common.drop(pairs, contexts, both)
        marks.marks.destroy()  # also its copies on the executors' disks
        rest = F.first("rest")
        divergence = F.sum(F.col("p") * F.log(F.col("p") / F.col("up"))) + rest * (1 - F.sum("up")) * F.log(rest)
        tests.append(common.stored(levels[-1].groupBy("context", "suffix").agg((F.round(F.first("m") * divergence, 6) >= gain).alias("own")), "tests"))
    words.marks.destroy()
    kept, values = None, []
    for k in range(depth, 0, -1):  # suffixes of what is retained stay
        own = tests[k].where("own").select("context", "suffix")
        if kept is not None:
            own = own.union(tests[k].join(kept.select(F.col("suffix").alias("context")).distinct(), "context", "left_semi").select("context", "suffix")).distinct()
        kept = common.stored(own, "retained")
        rows = levels[k].join(kept.select("context"), "context", "left_semi")
        values.append(rows.select("context", "word", (F.log10("p") - F.log10("up") - F.log10("rest")).alias("v"), "n", F.lit(k).alias("level"), F.lit(False).alias("whole")))
        values.append(rows.groupBy("context").agg(F.first(F.log10("rest")).alias("v"), F.first("m").alias("n")).select("context", zero.alias("word"), "v", "n", F.lit(k).alias("level"), F.lit(True).alias("whole")))
    every = values[0]
    for v in values[1:]:
        every = every.union(v)
    every = common.stored(every.mapInArrow(_keyed, "key long, v double, n long, level int, whole boolean"), "word-values")
    common.drop(*levels, *tests[1:])
    return every


def _keyed(batches):
    for batch in batches:
        context, word = (batch.column(c).to_numpy().view(np.uint64) for c in ("context", "word"))
        yield pa.RecordBatch.from_arrays([pa.array(_chained(context, word).view(np.int64)), *(batch.column(c) for c in ("v", "n", "level", "whole"))], ["key", "v", "n", "level", "whole"])


# ---------------------------------------------------------------- scores


@dataclass
class Common:
    """What is so frequent that it is broadcast: words with counts, and keys (in order) with values."""

    words: pa.Array
    counts: np.ndarray
    keys: np.ndarray
    values: np.ndarray

    def counts_of(self, words: pa.Array) -> np.ndarray:
        """Counts of words, 0 for those that are not common."""
        at = pc.index_in(words, value_set=self.words)
        return np.append(self.counts, 0)[at.fill_null(len(self.counts)).to_numpy()]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places among the common keys, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)


def _posts(key: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, ...]:
    """Distinct keys (small numbers) in order, how many documents each is in, and those documents and how often each has it."""
    pairs, times = np.unique(key.astype(np.int64) * n_docs + doc, return_counts=True)
    first = np.flatnonzero(np.diff(pairs // n_docs, prepend=-1))
    return pairs[first] // n_docs, np.diff(np.r_[first, len(pairs)]), (pairs % n_docs).astype(np.uint32), times.astype(np.uint32)


#: A chunk's questions to a bucket: words (lengths, bytes), documents of each, documents and times; then the same of keys.
_QUESTION = (np.uint32, np.uint8, np.uint32, np.uint32, np.uint32, np.uint64, np.uint32, np.uint32, np.uint32)
#: A bucket's answer to a chunk: documents, and what to add to their base scores, scores and known words.
_ANSWER = (np.uint32, np.float64, np.float64, np.uint32)
#: A chunk's own: whether there are doc_ids, doc_ids, numbers of tokens, whether held out, and its sums so far.
_OWN = (bool, np.int64, np.int64, bool, np.float64, np.float64, np.int64)
_ASKED = "bucket int, chunk long, own boolean, parcel binary"


def _asked(model, often, contexts, depth: int, root, base, bits: int):
    """For each chunk: its documents with what they have so far, and its questions to each bucket."""

    def run(batches):
        for k, batch in enumerate(common.slices(batches, CHUNK)):
            chunk = TaskContext.get().partitionId() << 24 | k
            raw, doc_ids, few = common.texts(batch), batch.column("doc_id"), often.value
            t = Tokens(raw)
            n = len(raw)
            real = t.pos > 0
            code, doc = t.code[real], t.doc[real]
            c = few.counts_of(t.distinct)
            frequent = c[code] > 0
            bases = np.bincount(doc[frequent], base(c)[code[frequent]], n)
            known = np.bincount(doc[frequent], minlength=n)
            if depth:
                scores = np.bincount(doc[frequent], root(c)[code[frequent]], n)
            else:
                split = [x.lower().split() for x in raw]
                scores = np.concatenate([model.value.scores(split[a : a + 100]) for a in range(0, n, 100)])
            by_hash = np.argsort(t.hash_of)
            rank = np.empty(len(by_hash), np.int64)
            rank[by_hash] = np.arange(len(by_hash))
            names, *word_posts = _posts(rank[code[~frequent]], doc[~frequent], n)
            words = t.distinct.take(pa.array(by_hash[names]))
            word_at = _stretches(t.hash_of[by_hash[names]], bits)
            key, where = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            if depth:
                keys, docs = [], []
                for j, context in enumerate(t.contexts(depth)):
                    if j:
                        at = np.flatnonzero(t.pos >= j)
                        own = _chained(context[at], np.zeros(len(at), np.uint64))
                        ok = contexts.has(own)
                        at = at[ok]
                        pair = _chained(context[at], t.hash[at])
                        has = contexts.has(pair)
                        keys += [own[ok], pair[has]]
                        docs += [t.doc[at], t.doc[at[has]]]
                key, where = np.concatenate(keys), np.concatenate(docs)
                del keys, docs
                order = np.argsort(key)
                key, where = key[order], where[order]
                place = few.find(key)  # faster for sorted keys
                hit = place >= 0
                scores += np.bincount(where[hit], few.values[place[hit]] if len(few.values) else None, n)
                key, where = key[~hit], where[~hit]
            new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
            _, *key_posts = _posts(np.cumsum(new) - 1, where, n)
            key = key[new]
            key_at = _stretches(key, bits)
            own = _packed(doc_ids.is_valid().to_numpy(zero_copy_only=False), doc_ids.fill_null(0).to_numpy(), t.lens.astype(np.int64), np.array([held_out(d) for d in doc_ids.to_pylist()], bool), bases, scores, known.astype(np.int64))
            rows = [(chunk % (1 << bits), chunk, True, own)]
            offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4) if len(words) else np.zeros(1, np.int32)
            data = np.frombuffer(words.buffers()[2], np.uint8) if len(words) and words.buffers()[2] else np.zeros(0, np.uint8)
            ends = [np.r_[0, np.cumsum(p[0])] for p in (word_posts, key_posts)]
            size = np.diff(offsets).astype(np.uint32)
            part = lambda posts, e, a, z: (posts[0][a:z].astype(np.uint32), posts[1][e[a] : e[z]], posts[2][e[a] : e[z]])
            for b in sorted(word_at.keys() | key_at.keys()):
                (i, j), (x, y) = word_at.get(b, (0, 0)), key_at.get(b, (0, 0))
                rows.append((b, chunk, False, _packed(size[i:j], data[offsets[i] : offsets[j]], *part(word_posts, ends[0], i, j), key[x:y], *part(key_posts, ends[1], x, y))))
            yield from _parcels(rows, ["bucket", "chunk", "own", "parcel"], [pa.int32(), pa.int64(), pa.bool_(), pa.binary()])

    return run


def _answered(model, depth: int, root, base):
    """A bucket's answers to all chunks; what is a chunk's own passes through."""

    def run(key, asked, known):
        order = np.lexsort((asked.column("chunk").to_numpy(), ~asked.column("own").to_numpy()))
        asked = asked.take(pa.array(order))
        own, chunks, parcels = asked.column("own").to_pylist(), asked.column("chunk").to_pylist(), asked.column("parcel").to_pylist()
        rows = [(c, True, p) for c, o, p in zip(chunks, own, parcels) if o]
        parts = [_unpacked(p, *_QUESTION) for p, o in zip(parcels, own) if not o]
        chunks = [c for c, o in zip(chunks, own) if not o]
        if parts:
            size, data, w_docs, w_doc, w_times, keys, k_docs, k_doc, k_times = (np.concatenate(x) for x in zip(*parts))
            of_part = lambda i: np.repeat(np.arange(len(parts)), [len(x[i]) for x in parts])
            words = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.py_buffer(data)])
            is_word = pc.is_valid(known.column("word"))
            table = known.filter(is_word)
            at = pc.index_in(words, value_set=table.column("word").combine_chunks() if table.num_rows else pa.array([], pa.binary())).fill_null(-1).to_numpy()
            c = np.append(table.column("x").to_numpy(), 0.0)[at].astype(np.int64)
            logs = np.zeros(len(c))
            if depth:
                logs = root(np.maximum(c, 1))
                new = np.flatnonzero(c == 0)
                names = words.take(pa.array(new)).dictionary_encode()
                spelled = names.dictionary.to_pylist()
                spelled = np.concatenate([np.zeros(0), *(model.value.word_scores(spelled[a : a + 10_000]) for a in range(0, len(spelled), 10_000))])
                logs[new] = spelled[names.indices.to_numpy()] + root(None) if len(new) else 0
            table = known.filter(pc.invert(is_word))
            have, v = table.column("key").to_numpy().view(np.uint64), table.column("x").to_numpy()
            order = np.argsort(have)
            have, v = have[order], np.append(v[order], 0.0)
            place = np.searchsorted(have, keys)
            place[place == len(have)] = 0
            v = np.where(have[place] == keys, v[place], 0.0) if len(have) else np.zeros(len(keys))  # what a Bloom filter let through adds nothing
            # documents of all chunks in a row
            doc = np.concatenate([w_doc, k_doc]).astype(np.int64)
            part = np.concatenate([of_part(3), of_part(7)])
            wide = int(doc.max()) + 1
            place, doc = np.unique(part * wide + doc, return_inverse=True)
            each = np.repeat(np.arange(len(c)), w_docs)
            w, k = doc[: len(w_doc)], doc[len(w_doc) :]
            sums = lambda at, x: np.bincount(at, x, len(place))
            bases, seen = sums(w, w_times * base(c)[each]), sums(w, w_times * (c > 0)[each])
            scores = sums(w, w_times * logs[each]) + sums(k, k_times * v[np.repeat(np.arange(len(keys)), k_docs)])
            edges = np.searchsorted(place, np.arange(len(parts) + 1) * wide).tolist()
            for i, (a, b) in enumerate(zip(edges, edges[1:])):
                rows.append((chunks[i], False, _packed((place[a:b] - i * wide).astype(np.uint32), bases[a:b], scores[a:b], np.rint(seen[a:b]).astype(np.uint32))))
        cols = list(zip(*rows)) or [(), (), ()]
        return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.bool_()), pa.array(cols[2], pa.binary())], names=["chunk", "own", "parcel"])

    return run


def _scored(n_train: int):
    def run(key, table):
        own, parcels = table.column("own").to_pylist(), table.column("parcel").to_pylist()
        known, doc_ids, n_tokens, held, bases, scores, seen = (x.copy() for x in _unpacked(parcels[own.index(True)], *_OWN))
        n = len(doc_ids)
        for p in sorted(p for p, o in zip(parcels, own) if not o):  # in an order that reruns keep
            doc, b, s, k = _unpacked(p, *_ANSWER)
            bases[doc] += b
            scores[doc] += s
            seen[doc] += k
        cols = [pa.array(doc_ids, mask=~known), pa.array(held), pa.array(n_tokens), pa.array(seen), pa.array(np.full(n, n_train)), pa.array(bases), pa.array(scores)]
        return pa.table(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def _logs(n_train: int, n_words: int):
    """Base score of words by count, and the root's log10 probability of words by count (None: of all that are new)."""
    base = lambda c: np.log10((c + 0.5) / (n_train + 0.5 * (n_words + 1)))

    def root(c):
        if c is None:
            return np.log10(n_words / (n_train + n_words)) if n_train else 0.0
        return np.log10(np.maximum(c, 1) / max(1, n_train + n_words))

    return base, root


def _bound(counts: DataFrame, most: int) -> float:
    """A least count that at most so many rows of counts(n) have; from a histogram of some 16 parts an octave."""
    part = F.floor(F.log2("n") * 16)
    left, out = most, float("inf")
    for r in counts.groupBy(part.alias("part")).agg(F.count("*").alias("rows"), F.min("n").alias("n")).orderBy(F.desc("part")).collect():
        left -= r.rows
        if left < 0:
            break
        out = float(r.n)
    return out


def scored(docs: DataFrame, depth: int = 0, least: int = LEAST, least_next: int = LEAST_NEXT, common_words: int = COMMON_WORDS, common_keys: int = COMMON_KEYS) -> DataFrame:
    """Base and model scores of every document; the model is the tree over bytes, or with a depth the one over words above it."""
    own = common.id_text(docs)
    sc = docs.sparkSession.sparkContext
    vocab = common.stored(vocabulary(own), "vocabulary")
    n_train, n_words = (int(x) for x in vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first())
    spelled = vocab.where(F.octet_length("word") > 0).select(F.col("word").alias("text"))
    model = sc.broadcast(train(spelled, lists=_spelled) if depth else train(own))
    base, root = _logs(n_train, n_words)
    bound = _bound(vocab.select(F.col("c").alias("n")), common_words)
    got = vocab.where(F.col("c") >= bound).toArrow()
    words = got.column("word").combine_chunks() if got.num_rows else pa.array([], pa.binary()), got.column("c").to_numpy().astype(np.int64)
    bits = _bits(n_train, QUESTIONS)
    bucket = lambda h: F.shiftrightunsigned(h, 64 - bits).cast("int").alias("bucket")
    none = F.lit(None)
    table = vocab.where(F.col("c") < bound).select(bucket(F.xxhash64("word")), "word", none.cast("long").alias("key"), F.col("c").cast("double").alias("x"))
    few, contexts = Common(*words, np.zeros(0, np.uint64), np.zeros(0)), None
    if depth:
        values = word_tree(own, vocab, n_train, n_words, depth, least, least_next=least_next)
        contexts = Filter.of(values.select(F.col("key").alias("h")))
        bound = _bound(values, common_keys)
        got = values.where(F.col("n") >= bound).select("key", "v").toArrow()
        keys, v = got.column("key").to_numpy().view(np.uint64), got.column("v").to_numpy()
        order = np.argsort(keys)
        few = Common(*words, keys[order], v[order])
        table = table.union(values.where(F.col("n") < bound).select(bucket(F.col("key")), none.cast("binary"), "key", "v"))
    asked = own.mapInArrow(common.tidied(_asked(model, sc.broadcast(few), contexts, depth, root, base, bits)), _ASKED)
    answered = asked.groupBy("bucket").cogroup(table.groupBy("bucket")).applyInArrow(_answered(model, depth, root, base), "chunk long, own boolean, parcel binary")
    kinds = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return answered.groupBy("chunk").applyInArrow(_scored(n_train), kinds)


def query(spark, sf_dir: str) -> DataFrame:
    return scored(common.documents(spark, sf_dir), WORD_DEPTH)
