"""What the training-data operators share: scratch tables, word hashing in numpy, connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of most operators: runs of anything but ASCII white space. bytes.split() splits exactly there.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


# ---------------------------------------------------------------- scratch tables


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where that is unset, a local session (as in tests) gets a temporary folder; on a cluster, executors would not share it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="siteloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_made: set[str] = set()


def scratch(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/siteloom/{name}-{uuid.uuid4().hex}"
    _made.add(path)
    return path


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession):
    """Spark deletes the shuffle files of what runs inside as soon as it has ended, instead of at some later garbage collection."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table into the shared folder and reads it again, which cuts the lineage and frees its shuffle files."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with freed_shuffles(spark):
        df.write.parquet(path)
    tidy_driver(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path  # for drop()
    return out


#: Share of the driver's heap that its JVM may have taken before stored() collects its garbage.
HEAP_SHARE = 0.5

_settled = 0  # bytes that the heap still had after the last collection


def tidy_driver(spark: SparkSession) -> None:
    """Gives memory of the driver's JVM back: steps by the hundred leave plans and events of tasks, and the heap grows rather than collects them.

    Only if the heap has grown since the last time, so that one full of live objects isn't collected again and again.
    """
    global _settled
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() <= max(HEAP_SHARE * runtime.maxMemory(), _settled):
        return
    gc.collect()  # Python's references hold objects of the JVM
    runtime.gc()
    _trim(spark)
    _settled = runtime.totalMemory()


def _trim(spark: SparkSession) -> None:
    """What malloc keeps for the JVM goes back too, where the JVM can do that (17.0.9 or later, with glibc)."""
    gateway, java = spark.sparkContext._gateway, spark._jvm.java.lang
    array = lambda kind, *x: _filled(gateway.new_array(kind, len(x)), x)
    with contextlib.suppress(Exception):
        of = java.Class.forName
        kinds = [of(k) for k in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
        invoke = of("javax.management.MBeanServer").getMethod("invoke", array(java.Class, *kinds))
        name = spark._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        invoke.invoke(java.management.ManagementFactory.getPlatformMBeanServer(), array(java.Object, name, "systemTrimNativeHeap", None, None))


def _filled(array, values):
    for k, x in enumerate(values):
        array[k] = x
    return array


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _made.discard(path)


def drop(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_scratch_path", None)
        if path:
            _delete(t.sparkSession, path)


def tables() -> frozenset[str]:
    """Paths of what this process has stored and not dropped."""
    return frozenset(_made)


def sweep(spark: SparkSession, *keep: DataFrame, since: frozenset[str] = frozenset()) -> None:
    """Deletes the tables that this process has stored since then, but for some. For callers that have used an operator's result up."""
    stay = since | {getattr(t, "_scratch_path", None) for t in keep}
    for path in [p for p in _made if p not in stay]:
        _delete(spark, path)


@atexit.register
def _sweep_at_exit() -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        spark = SparkSession.getActiveSession() if _made else None
        if spark is not None:
            sweep(spark)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that a table does not have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Rows of an Arrow batch: whole texts are long, and Spark's default of 10,000 of them would fill a worker.
BATCH_ROWS = 2000


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that the operators read; null texts count as empty. Other columns, whatever their names, stay out."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS, where they are larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


# ---------------------------------------------------------------- texts in Arrow batches

pa.set_memory_pool(pa.system_memory_pool())  # the other pools keep what they free


def tidy() -> None:
    """Gives freed memory back: workers stay for later tasks."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidied(run):
    """A function on batches that tidies up once its own memory is free."""

    def outer(batches):
        yield from run(batches)
        tidy()

    return outer


def slices(batches, max_bytes: int = 4 << 20, text: str = "text"):
    """Arrow batches cut into slices whose texts come to about max_bytes, so that memory does not follow the batch size."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        cut = np.cumsum(size, dtype=np.int64) // max_bytes
        edges = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist(), n]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def texts(batch, name: str = "text") -> list[bytes]:
    """A text column as UTF-8 bytes."""
    col = batch.column(name)
    return [x if x is not None else b"" for x in col.cast(pa.binary()).to_pylist()]


def ids(batch, name: str = "doc_id"):
    return batch.column(name)


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def multipliers(n: int, seed: int = 1) -> np.ndarray:
    """n odd 64-bit multipliers from a fixed rule."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


class Words:
    """All words of a batch of texts in one row: hashes, position in the text, length of the text."""

    def __init__(self, split: list[list[bytes]]):
        self.split = split
        self.lens = np.fromiter(map(len, split), np.int64, len(split))
        flat = [w for ws in split for w in ws]
        self.hash = word_hashes(flat)
        self.start = np.cumsum(self.lens) - self.lens
        self.doc = np.repeat(np.arange(len(split)), self.lens)
        self.pos = np.arange(len(flat)) - self.start[self.doc]
        self.left = self.lens[self.doc] - self.pos  # words from here to the end of the text

    def windows(self, at: np.ndarray, width: int, seed: int | None = None) -> np.ndarray:
        """Hash of the width words from each place in at (which must have so many words left)."""
        out = np.zeros(len(at), np.uint64)
        for j, m in enumerate(multipliers(width, seed=width if seed is None else seed)):
            out += self.hash[at + j] * m
        return mix64(out)


# ---------------------------------------------------------------- connected components


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """Components of links (a long, b long): (node, root), root being the smallest node of its component.

    Alternating large-star and small-star rounds; each ends in a table in the shared folder, and nothing but a count and
    a checksum of it reaches the driver. Hot nodes: minima are pre-aggregated, and the joins are plain equi-joins that
    adaptive execution can split.
    """

    def stars(e: DataFrame) -> DataFrame:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b")))
        return small.distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    now = state(edges)
    while now[0]:
        after = stored(stars(edges), name)
        drop(edges)
        edges, before, now = after, now, state(after)
        if now == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
