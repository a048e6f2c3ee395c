"""Quality rules: fixed base rules, then a calibrated logistic regression on hashed word and character n-grams.

Features: words, word pairs and 4-grams of characters (bytes of the lower-cased UTF-8 text), hashed to 2^18 weights each;
a text's score is the mean weight of each kind, added up. Training takes labelled documents in the order of a hash, at most TRAIN_ROWS
of them and as many as fit into TRAIN_BYTES of text together (both bounds are parameters); a fifth of them is held out and calibrates the
probability. One task gets the distinct features of these documents with their shares and fits the weights; the driver gets those alone.
Scoring runs in Arrow batches over whole texts against a fixed threshold.

Nulls: a null text has no words and fails the base rules. Labels with a null in them are left out; with no labels, or labels
of one kind, the base rules decide alone. Repeated rows get the same verdict; rows of one doc_id with other texts are judged each by its
text, and share their label in training. Ties in the order of training are settled by doc_id and the text's hash. Very long texts are
judged whole. Extra columns, whatever their names, pass through the stage. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed values of the base rules.
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words
SYMBOLS = b"#*$%&|<>"

BITS = 18
TRAIN_ROWS = 4000
TRAIN_BYTES = 24 << 20
EPOCHS = 8
THRESHOLD = 0.3
#: Bytes of text judged at a time; the n-grams of a slice take some fifty times as much memory.
SLICE = 2 << 20
_SPACES = bytes([32, *range(9, 14)])
_NOT_FIRST = bytes(range(0x80, 0xC0))  # UTF-8 bytes that continue a character


@dataclass
class Model:
    weights: np.ndarray  # 3 kinds x 2^BITS
    bias: float
    slope: float
    shift: float

    def probability(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (score + self.bias) + self.shift, -40, 40)))


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int32)


def _features(split: list[list[bytes]], raw: list[bytes]):
    """For each kind: slots of all its n-grams in a row, and how many each text has."""
    words = common.Words(split)
    yield _slots(common.mix64(words.hash)), words.lens
    at = np.flatnonzero(words.left >= 2)
    yield _slots(words.windows(at, 2)), np.maximum(words.lens - 1, 0)
    lens = np.fromiter(map(len, raw), np.int64, len(raw))
    b = np.frombuffer(b"".join(raw) + b"\0\0\0", np.uint8).astype(np.uint32)
    n = len(b) - 3
    grams = b[:n] | b[1 : n + 1] << np.uint32(8) | b[2 : n + 2] << np.uint32(16) | b[3 : n + 3] << np.uint32(24)
    ends = np.cumsum(lens)
    whole = np.ones(n, bool)
    for k in (1, 2, 3):  # none runs over the end of its text
        whole[np.maximum(ends - k, ends - lens)[lens > 0]] = False
        whole[(ends - k)[lens >= k]] = False
    slots = ((grams[whole] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int32)
    yield slots, np.maximum(lens - 3, 0)


def _means(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    edges = np.r_[0, np.cumsum(counts)]
    total = np.r_[0.0, np.cumsum(values, dtype=np.float64)]
    return (total[edges[1:]] - total[edges[:-1]]) / np.maximum(counts, 1)


def scores(model: Model, split: list[list[bytes]], raw: list[bytes]) -> np.ndarray:
    return sum(_means(w[slots], n) for w, (slots, n) in zip(model.weights, _features(split, raw)))


# ---------------------------------------------------------------- training


def _training_rows(batches):
    """Distinct features of each text (kind and slot in one number) and their shares of the kind."""
    for batch in common.slices(batches, 1 << 20):
        raw = [t.lower() for t in common.texts(batch)]
        slots, shares = [[] for _ in raw], [[] for _ in raw]
        for k, (flat, counts) in enumerate(_features([t.split() for t in raw], raw)):
            for i, (end, n) in enumerate(zip(np.cumsum(counts).tolist(), counts.tolist())):
                own, times = np.unique(flat[end - n : end], return_counts=True)
                slots[i].append((own + (k << BITS)).astype(np.int32))
                shares[i].append((times / max(n, 1)).astype(np.float32))
        joined = lambda x: pa.array([np.concatenate(y).tobytes() for y in x], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), batch.column("label"), joined(slots), joined(shares)], ["doc_id", "t", "label", "slots", "shares"])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> Model | None:
    """Fits on at most `rows` labelled documents of `most_bytes` together; None where there is nothing to learn from."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("long").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit("quality")), "doc_id").limit(rows)  # so few rows that they may be broadcast
    texts = common.id_text(docs).join(F.broadcast(chosen), "doc_id").withColumn("t", F.xxhash64("text"))
    order = (F.xxhash64("doc_id", F.lit("quality")), "doc_id", "t")
    sizes = texts.select("doc_id", "t", F.octet_length("text").alias("n")).orderBy(*order).limit(rows).collect()  # whatever repeats an id has
    taken, left = set(), most_bytes
    for r in sizes:
        if r.n <= left and (r.doc_id, r.t) not in taken:
            taken.add((r.doc_id, r.t))
            left -= r.n
    few = docs.sparkSession.createDataFrame(sorted(taken), "doc_id long, t long")
    texts = texts.join(F.broadcast(few), ["doc_id", "t"])
    texts = texts.groupBy("doc_id", "t").agg(F.first("label").alias("label"), F.first("text").alias("text"))  # a text counts once
    kinds = "doc_id long, t long, label long, slots binary, shares binary"
    got = texts.mapInArrow(common.tidied(_training_rows), kinds).repartition(1)
    got = got.mapInArrow(common.tidied(_fitted), "weights binary, bias double, slope double, shift double").toArrow().to_pylist()
    if not got:
        return None
    return Model(np.frombuffer(got[0]["weights"], np.float32).reshape(3, -1), got[0]["bias"], got[0]["slope"], got[0]["shift"])


def _blobs(column, kind) -> list[np.ndarray]:
    """The values of a binary column as arrays, not copied."""
    return [np.frombuffer(x.as_buffer(), kind) for part in column.chunks for x in part]


def _fitted(batches):
    """The model that all rows of training together give, as one row; none where there is nothing to learn from."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    got = pa.Table.from_batches(batches)
    order = pc.sort_indices(got, sort_keys=[("doc_id", "ascending"), ("t", "ascending")]).to_numpy()
    y = (got.column("label").to_numpy()[order] > 0).astype(np.float64)
    if y.min() == y.max():
        return
    rest = got.column("doc_id").to_numpy()[order] % 5 == 0
    slots, shares = _blobs(got.column("slots"), np.int32), _blobs(got.column("shares"), np.float32)
    rows_ = [(slots[i], shares[i]) for i in order.tolist()]
    w, g, bias, gb = np.zeros(3 << BITS), np.full(3 << BITS, 1e-8), 0.0, 1e-8
    fit, rng = np.flatnonzero(~rest) if rest.sum() >= 20 and 0 < y[rest].mean() < 1 else np.arange(len(y)), np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in rng.permutation(fit).tolist():
            s, x = rows_[i]
            e = 1 / (1 + np.exp(-np.clip(w[s] @ x + bias, -40, 40))) - y[i]
            d = e * x
            g[s] += d * d
            w[s] -= 0.3 * d / np.sqrt(g[s])
            gb += e * e
            bias -= 0.3 * e / np.sqrt(gb)
    weights = w.astype(np.float32)
    held = np.flatnonzero(rest) if len(fit) < len(y) else np.arange(len(y))
    z = np.array([weights[rows_[i][0]] @ rows_[i][1] + bias for i in held])
    slope, shift = calibrated(z, y[held])
    yield pa.RecordBatch.from_pylist([{"weights": weights.tobytes(), "bias": float(bias), "slope": slope, "shift": shift}])


def calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's slope and shift by Newton steps, with his targets that keep off 0 and 1."""
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x, b = np.stack([z, np.ones_like(z)], 1), np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -40, 40)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
        b = b - np.clip(np.linalg.solve(h, x.T @ (p - t)), -2, 2)
    return float(max(b[0], 1e-3)), float(b[1])


# ---------------------------------------------------------------- scoring


def _repeated(words: common.Words) -> np.ndarray:
    """Words of each text in 3-word windows that it holds twice or more."""
    at = np.flatnonzero(words.left >= 3)
    key = words.windows(at, 3) ^ common.mix64(words.doc[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order] = np.r_[same, False] | np.r_[False, same] if len(at) else False
    hit = np.zeros(len(words.pos) + 3, bool)
    for k in range(3):
        hit[at[twice] + k] = True
    return np.bincount(words.doc[hit[: len(words.pos)]], minlength=len(words.lens))


def judged(model: Model | None, raw: list[bytes], threshold: float = THRESHOLD) -> dict[str, np.ndarray]:
    """All columns of the verdict for some texts."""
    split = [t.split() for t in raw]
    words = common.Words(split)
    n, again = words.lens, _repeated(words)
    failed = (n < LEAST_WORDS) | (100 * again > MOST_REPEATED * n)
    dup = []
    for t in raw:
        lines = [x for x in t.split(b"\n") if x.strip(_SPACES)] if b"\n" in t else ()
        dup.append(len(lines) - len(set(lines)))
    p = np.ones(len(raw))
    if model:
        low = [t.lower() for t in raw]
        p = model.probability(scores(model, [t.split() for t in low], low))
    return {
        "n_words": n,
        "word_chars": np.array([len(t.translate(None, _SPACES + _NOT_FIRST)) for t in raw], np.int64),
        "n_symbols": np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in raw], np.int64),
        "n_dup_lines": np.array(dup, np.int64),
        "n_repeat_words": again.astype(np.int64),
        "base_failed": failed,
        "kept": ~failed & (p >= threshold),
        "probability": p,
    }


def verdicts(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in common.slices(batches, SLICE):
            cols = judged(shared.value, common.texts(batch), threshold)
            yield pa.RecordBatch.from_arrays([common.ids(batch), *map(pa.array, cols.values())], ["doc_id", *cols])

    kinds = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"
    return common.id_text(docs).mapInArrow(common.tidied(run), f"doc_id long, {kinds}")


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return verdicts(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules and the classifier keep, unchanged."""
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))

    def run(batches):
        for batch in common.slices(batches, SLICE):
            yield batch.filter(pa.array(judged(shared.value, common.texts(batch))["kept"]))

    return docs.mapInArrow(common.tidied(run), docs.schema)
