"""The offline closure: whether every local reference of the stored files leads to a stored file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html, paths


def duplicate_paths(manifest: DataFrame) -> DataFrame:
    """Paths that several URLs share, with those URLs in order."""
    return manifest.groupBy("path").agg(F.sort_array(F.collect_list("canonical_url")).alias("urls")).where("size(urls) > 1")


def scanned(files: DataFrame) -> DataFrame:
    """Files that hold references: html, htm and css, as written."""
    return files.where(F.element_at(F.split("path", r"\."), -1).isin("html", "htm", "css") & F.col("path").contains("."))


def references(files: DataFrame) -> DataFrame:
    """(path, ref, resolved, escaped) of every distinct local reference; resolved is relative to the output folder."""
    refs = scanned(files).select("path", F.explode(html.local_refs(F.col("text"))).alias("ref"))
    folder = F.regexp_extract("path", r"(?s)^(.*)/[^/]*$", 1)
    # a rooted reference leaves the output folder; so does one that climbs above it
    depth = F.aggregate(
        F.filter(F.split(F.concat_ws("/", F.nullif(folder, F.lit("")), "ref"), "/"), lambda x: ~x.isin("", ".")),
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")),
        lambda acc, x: F.struct((acc["at"] + F.when(x == "..", -1).otherwise(1)).alias("at"), F.least(acc["low"], acc["at"] + F.when(x == "..", -1).otherwise(1)).alias("low")),
    )
    escaped = F.col("ref").startswith("/") | (depth["low"] < 0)
    return refs.select("path", "ref", paths.resolve_ref(F.nullif(folder, F.lit("")), F.col("ref")).alias("resolved"), escaped.alias("escaped"))


def checked(files: DataFrame) -> DataFrame:
    """references() with status ok, escaped or missing; a folder that holds files counts as there."""
    refs = references(files)
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    there = files.select(F.explode(folders).alias("resolved")).distinct().withColumn("there", F.lit(True))
    status = F.when(F.col("escaped"), "escaped").when(F.col("there") | (F.col("resolved") == ""), "ok").otherwise("missing")
    return refs.join(there, "resolved", "left").select("path", "ref", "resolved", status.alias("status"))


def report(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row: checked, missing, escaped, duplicate_paths, ok."""
    counted = checked(files).select("status").union(duplicate_paths(manifest).select(F.lit("duplicate")))
    n = lambda s: F.count_if(F.col("status") == s)
    out = counted.agg(F.count_if(F.col("status") != "duplicate").alias("checked"), n("missing").alias("missing"), n("escaped").alias("escaped"), n("duplicate").alias("duplicate_paths"))
    return out.withColumn("ok", F.col("missing") + F.col("escaped") + F.col("duplicate_paths") == 0)
