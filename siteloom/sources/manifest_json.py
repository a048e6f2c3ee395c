"""Manifests as JSON documents: {version, start_url, created_at, updated_at, entries: {url: entry}, visited: [url]}."""

from __future__ import annotations

import io
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.manifest import VERSION, new_manifest

_ENTRY = "struct<path:string,size:bigint,hash:string,mtime:string,etag:string,rtype:string,original_url:string,outlinks:array<string>>"
SCHEMA = f"version int, start_url string, created_at string, updated_at string, entries map<string,{_ENTRY}>, visited array<string>, _corrupt string"


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, visited, meta); a document that is no JSON gives empty tables."""
    docs = spark.read.schema(SCHEMA).option("multiLine", "true").option("columnNameOfCorruptRecord", "_corrupt").json(path).where("_corrupt is null")
    rows = docs.select(F.explode("entries").alias("canonical_url", "e")).select("canonical_url", "e.*")
    rows = rows.withColumn("outlinks", F.coalesce("outlinks", F.array().cast("array<string>"))).select(*new_manifest(spark).columns)
    return rows, docs.select(F.explode("visited").alias("canonical_url")).distinct(), docs.select("version", "start_url", "created_at", "updated_at")


def write(out, entries: DataFrame, visited: DataFrame, start_url: str, created_at: str, updated_at: str) -> None:
    """Writes the document into an open text file. It is one JSON value, so the driver writes it, one partition's rows at a time."""
    text = lambda x: json.dumps(x, ensure_ascii=False)
    out.write(f'{{\n  "version": {VERSION},\n  "start_url": {text(start_url)},\n  "created_at": {text(created_at)},\n  "updated_at": {text(updated_at)},\n  "entries": {{')
    mark = "\n    "
    for r in entries.orderBy("canonical_url").toLocalIterator():
        e = r.asDict()
        out.write(f"{mark}{text(e.pop('canonical_url'))}: {text(e)}")
        mark = ",\n    "
    out.write('\n  },\n  "visited": [')
    mark = "\n    "
    for r in visited.orderBy("canonical_url").toLocalIterator():
        out.write(mark + text(r.canonical_url))
        mark = ",\n    "
    out.write("\n  ]\n}\n")


def dump(entries: DataFrame, visited: DataFrame, start_url: str, created_at: str, updated_at: str) -> str:
    """The document as text."""
    out = io.StringIO()
    write(out, entries, visited, start_url, created_at, updated_at)
    return out.getvalue()
