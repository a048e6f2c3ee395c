"""Captured browser requests: filter and first-wins dedup, on tables and on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html, urls


def kept(captures: DataFrame, site: str = "site_host", port: str = "site_port") -> DataFrame:
    """Requests of captures(page_url, seq, url, resource_type, site_host, site_port) that are files, fragments cut off."""
    rows = urls.with_url(captures.withColumn("url", F.substring_index("url", "#", 1)), "url", "u")
    return rows.where(html.should_capture(F.col("u"), F.col("resource_type"), F.col(site), F.col(port))).drop("u")


def first_captures(captures: DataFrame) -> DataFrame:
    """The first request of each URL on a page."""
    rows = kept(captures)
    return rows.groupBy("page_url", "url").agg(F.min_by(F.struct("seq", "resource_type"), "seq").alias("r")).select("page_url", "url", "r.*")


def stream_captures(captures: DataFrame, time: str = "ts", within: str = "1 minute") -> DataFrame:
    """The same on a stream: each URL of a page once while the page settles."""
    return kept(captures.withWatermark(time, within)).dropDuplicatesWithinWatermark(["page_url", "url"])
