"""The manifest: one row per canonical URL, with freshness, reuse decisions and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.content import hash_bytes, now_seconds

ENTRY = "canonical_url string, path string, size bigint, hash string, mtime string, etag string, rtype string, original_url string, outlinks array<string>"
VERSION = 2


def new_manifest(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ENTRY)


def new_meta(spark: SparkSession, start_url: str) -> DataFrame:
    """One row of version, start URL and times."""
    return spark.range(1).select(F.lit(VERSION).alias("version"), F.lit(start_url).alias("start_url"), now_seconds().alias("created_at"), now_seconds().alias("updated_at"))


def entries(processed: DataFrame) -> DataFrame:
    """Manifest rows of processed documents (canonical_url, path, bytes, mtime, etag, rtype, original_url, outlinks)."""
    return processed.select(
        "canonical_url",
        "path",
        F.octet_length("bytes").cast("long").alias("size"),
        hash_bytes(F.col("bytes")).alias("hash"),
        "mtime",
        "etag",
        "rtype",
        F.nullif(F.nullif("original_url", F.col("canonical_url")), F.lit("")).alias("original_url"),
        "outlinks",
    )


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new replace those of old whole; rows not in new stay. new must hold a URL once (see last_written)."""
    return old.join(new, "canonical_url", "left_anti").unionByName(new)


def last_written(rows: DataFrame, order: Column) -> DataFrame:
    """The last row of each URL in the given order."""
    every = F.struct(*rows.columns)
    return rows.groupBy("canonical_url").agg(F.max_by(every, order).alias("r")).select("r.*")


def visited(old: DataFrame, new: DataFrame, *others: DataFrame) -> DataFrame:
    """Every URL that a run has settled: recorded before, processed now, and others, such as those that failed or that robots forbid."""
    out = old.select("canonical_url").union(new.select("canonical_url"))
    for df in others:
        out = out.union(df.select("canonical_url"))
    return out.distinct()


def entry_of(manifest: DataFrame, canonical_url: str) -> DataFrame:
    """The entry of one URL, with its rtype and outlinks; no row where it is unknown."""
    return manifest.where(F.col("canonical_url") == canonical_url)


def with_freshness(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Adds file_exists and local_fresh from files(path, bytes): fresh is a stored file whose hash is the recorded one."""
    return with_hashes(manifest, files.select("path", hash_bytes(F.col("bytes")).alias("hash")))


def with_hashes(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """The same from files(path, hash), which do not move whole files."""
    now = files.select("path", F.col("hash").alias("_hash"))
    joined = manifest.join(now, "path", "left")
    return joined.select(*[manifest[c] for c in manifest.columns], F.col("_hash").isNotNull().alias("file_exists"), F.coalesce(F.col("_hash") == manifest["hash"], F.lit(False)).alias("local_fresh"))


def reuse_action(known: Column, fresh: Column, exists: Column, etag: Column, mtime: Column) -> Column:
    """reuse_local, conditional_get or get."""
    bare = etag.isNull() & mtime.isNull()
    return F.when(known & fresh & exists & bare, "reuse_local").when(known & exists & ~bare, "conditional_get").otherwise("get")


def request_headers(action: Column, etag: Column, mtime: Column) -> Column:
    """Headers of the request that the action makes."""
    pairs = F.array(F.struct(F.lit("If-None-Match").alias("k"), etag.alias("v")), F.struct(F.lit("If-Modified-Since").alias("k"), mtime.alias("v")))
    return F.when(action == "conditional_get", F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull())))


def planned(urls: DataFrame, manifest_with_freshness: DataFrame, fresh: bool = False) -> DataFrame:
    """What to do with each URL, by its manifest row where there is one; outlinks that are empty count as unknown.

    A fresh run knows nothing of the last one.
    """
    m = manifest_with_freshness.where(F.lit(not fresh)).select("*", F.lit(True).alias("known"))
    joined = urls.join(m, "canonical_url", "left")
    no = F.lit(False)
    known, fresh, exists = (F.coalesce(F.col(c), no) for c in ("known", "local_fresh", "file_exists"))
    action = reuse_action(known, fresh, exists, F.col("etag"), F.col("mtime"))
    prior = F.when(F.size("outlinks") > 0, F.col("outlinks"))
    return joined.select(*urls.columns, action.alias("action"), request_headers(action, F.col("etag"), F.col("mtime")).alias("request_headers"), prior.alias("prior_outlinks"), F.col("rtype").alias("prior_rtype"), F.col("path").alias("prior_path"))


def after_response(action: Column, status: Column, known: Column) -> Column:
    """reused, replaced or error."""
    return F.when(action == "reuse_local", "reused").when((status == 304) & known, "reused").when(status == 200, "replaced").otherwise("error")
