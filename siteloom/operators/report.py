"""Counts, outcome and listings of a run."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.content import format_bytes
from ..functions.fixed import MANIFEST_NAME


def outcome(pages: Column, errors: Column, manifest_saved: Column | None = None) -> Column:
    saved = F.lit(True) if manifest_saved is None else manifest_saved
    return F.when((pages == 0) & (errors > 0), "failed").when((errors > 0) | ~saved, "partial").otherwise("complete")


def exit_code(outcome_: Column) -> Column:
    return F.when(outcome_ == "complete", 0).when(outcome_ == "partial", 2).otherwise(1)


def limit_reached(pages: Column, total_bytes: Column, max_pages: int = 10_000, max_bytes: int = 0) -> Column:
    return (pages >= max_pages) | (F.lit(max_bytes > 0) & (total_bytes >= max_bytes))


def summary(results: DataFrame, *by: str) -> DataFrame:
    """Counts by type, bytes and errors of results(rtype, size, not_modified, failed); reused rows count but add no bytes."""
    n = lambda t: F.count_if(~F.col("failed") & (F.col("rtype") == t))
    out = results.groupBy(*by).agg(
        n("page").alias("pages"), n("image").alias("images"), n("css").alias("css"), n("js").alias("js"),
        F.coalesce(F.sum(F.when(~F.col("failed") & ~F.col("not_modified"), F.col("size"))), F.lit(0)).alias("total_bytes"),
        F.count_if(F.col("failed")).alias("errors"),
    )
    return out.withColumn("size_text", format_bytes(F.col("total_bytes"))).withColumn("outcome", outcome(F.col("pages"), F.col("errors")))


def console_lines(summary_: DataFrame) -> DataFrame:
    """The summary as text."""
    line = lambda name, c: F.concat(F.rpad(F.lit(name), 8, " "), F.col(c).cast("string"))
    return summary_.select(F.array_join(F.array(line("pages", "pages"), line("images", "images"), line("css", "css"), line("js", "js"), line("size", "size_text"), line("errors", "errors"), line("status", "outcome")), "\n").alias("text"))


def file_count(files: DataFrame) -> DataFrame:
    """One row: files and bytes of files(path, bytes)."""
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0)).alias("total_bytes"))


def archive_listing(files: DataFrame) -> DataFrame:
    """What goes into the archive: every file but those named like the manifest."""
    return files.where(F.element_at(F.split("path", "/"), -1) != MANIFEST_NAME)


def create_zip(files: DataFrame, prefix: str = "", to=None) -> bytes | None:
    """A deflated archive of files(path, bytes) in path order, written to a path or an open file, else returned as bytes.

    It is one file, so the driver writes it; rows come and go one partition at a time.
    """
    out = to if to is not None else io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for r in archive_listing(files).orderBy("path").toLocalIterator():
            info = zipfile.ZipInfo(prefix + r.path)
            info.external_attr, info.compress_type = 0o644 << 16, zipfile.ZIP_DEFLATED
            z.writestr(info, bytes(r.bytes))
    return out.getvalue() if to is None else None
