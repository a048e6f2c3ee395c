"""Answers of web servers as tables. Fetching and rendering are left to whatever fills them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import content, urls

RESPONSES = "url string, final_url string, status int, headers map<string,string>, body binary"


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESPONSES).parquet(path)


def processed(responses: DataFrame) -> DataFrame:
    """Typed answers: rtype by request URL and header, text for pages and styles, etag and mtime with empty ones as null.

    Only answers of status 200 and 304 count; a redirect's request is url, where it led final_url.
    """
    rows = urls.with_url(responses.where(F.col("status").isin(200, 304)), "url", "u").withColumn("content_type", content.header(F.col("headers"), "content-type"))
    rtype = urls.classify(F.col("content_type"), F.col("u"))
    text = F.when(rtype.isin("page", "css"), content.decode_body(F.col("body"), F.col("content_type")))
    return rows.select("url", F.coalesce("final_url", "url").alias("final_url"), "status", rtype.alias("rtype"), F.col("body").alias("bytes"), text.alias("text"), content.header(F.col("headers"), "etag").alias("etag"), content.header(F.col("headers"), "last-modified").alias("mtime"))


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes) of a file tree, paths relative to the folder."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = folder.rstrip("/").removeprefix("file://")
    return rows.select(F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), "^" + _quoted(root) + "/", "").alias("path"), F.col("content").alias("bytes"))


def _quoted(s: str) -> str:
    return "\\Q" + s + "\\E"


def export_files(files: DataFrame, folder: str) -> None:
    """Writes files(path, bytes) as a tree below a folder that every executor can write; a path that leaves the folder is an error."""

    def write(rows):
        import os
        from pathlib import Path

        for r in rows:
            out = Path(folder) / r.path
            if not Path(os.path.normpath(out)).is_relative_to(os.path.normpath(folder)) or Path(r.path).is_absolute():
                raise ValueError(f"{r.path!r} leaves the output folder")
            out.parent.mkdir(parents=True, exist_ok=True)
            out.write_bytes(bytes(r.bytes))

    files.select("path", "bytes").foreachPartition(write)
