"""Assets of pages and style sheets: extraction, resolution, and the fan-out from sheet to sheet."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html, paths, urls
from .scratch import delete, shared_dir


def _kept(rows: DataFrame, base: str) -> DataFrame:
    """Adds url and canonical_url of each ref that means a file to mirror; others go."""
    rows = urls.once(rows, "a", urls.parse_web_url(urls.resolve_url(F.col(base), F.col("ref")))).where("a is not null")
    rows = rows.where(urls.is_mirrorable_static(F.col("a"), F.col("site_host"), F.col("site_port")) & ~urls.is_dynamic_request(F.col("a")))
    return rows.withColumn("url", urls.href(F.col("a"))).withColumn("canonical_url", urls.normalize_discovered(F.col("a")))


def page_assets(pages: DataFrame) -> DataFrame:
    """(source, seq, ref, url, canonical_url) of pages(source, u, html, site_host, site_port), u being the page's parsed URL.

    References are read by a full tokenizer, resolved against the page's base element, and kept where they are files to mirror.
    """
    rows = pages.withColumn("t", html.tokenized(F.col("html"))).select("source", "u", "site_host", "site_port", "t.elements")
    rows = urls.once(rows, "base", F.coalesce(urls.parse_web_url(urls.joined(F.col("u"), html.first_base(F.col("elements")))), F.col("u")))
    rows = html.asset_refs(rows).select("source", "seq", "ref", "base", "site_host", "site_port")
    return _kept(rows, "base").select("source", "seq", "ref", "url", "canonical_url")


def sheet_assets(sheets: DataFrame) -> DataFrame:
    """The same of sheets(source, u, css, site_host, site_port)."""
    rows = sheets.select("source", "u", "site_host", "site_port", F.posexplode(html.css_refs(F.col("css"))).alias("seq", "ref"))
    return _kept(rows, "u").select("source", "seq", "ref", "url", "canonical_url")


def without_own_documents(found: DataFrame, page: str = "page_u", final: str = "final_u") -> DataFrame:
    """Captured assets (parsed URL in a) but those that are the page's own document."""
    return found.where(~paths.is_spa_document_url(F.col("a"), F.col(page), F.col(final)))


def first_of_each(found: DataFrame) -> DataFrame:
    """One row a canonical_url: the first by (source, seq)."""
    return found.groupBy("canonical_url").agg(F.min(F.struct("source", "seq", "url")).alias("f")).select("canonical_url", "f.*")


def not_done(found: DataFrame, done: DataFrame) -> DataFrame:
    """Assets that are neither stored nor asked for yet: done(canonical_url)."""
    return first_of_each(found).join(done, "canonical_url", "left_anti")


def fan_out(first: DataFrame, answers: DataFrame, done: DataFrame, site_host: Column, site_port: Column) -> DataFrame:
    """(canonical_url, url, source, seq, round) of every asset that pages lead to, style sheets' own references followed.

    first: assets of pages; answers(canonical_url, rtype, text): what a request for each gives, text for sheets; done(canonical_url):
    what is stored already. A round takes what the sheets of the round before refer to and ends in a table in the shared folder; it goes on
    until a round finds nothing new.
    """
    spark = first.sparkSession
    folder = f"{shared_dir(spark)}/assets-{uuid.uuid4().hex}"
    columns = ("canonical_url", "url", "source", "seq", "round")
    schema, names, k = None, [], 0
    found = not_done(first, done)
    while True:
        found.withColumn("round", F.lit(k)).select(*columns).write.parquet(f"{folder}/{k}")
        schema = schema or spark.read.parquet(f"{folder}/{k}").schema
        new = spark.read.schema(schema).parquet(f"{folder}/{k}")
        if not new.limit(1).count():
            delete(spark, f"{folder}/{k}")
            break
        names.append(f"{folder}/{k}")
        every = spark.read.schema(schema).parquet(*names).select("canonical_url")
        sheets = new.join(answers.where("rtype = 'css'").select("canonical_url", "text"), "canonical_url")
        sheets = urls.with_url(sheets, "url", "u").select(F.col("url").alias("source"), "u", F.col("text").alias("css"), site_host.alias("site_host"), site_port.alias("site_port"))
        found, k = not_done(sheet_assets(sheets), done.select("canonical_url").union(every)), k + 1
    return spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)


def reused(planned: DataFrame, files: DataFrame) -> DataFrame:
    """What a run takes over from the last one without a request: rows of planned() whose action is reuse_local.

    Adds rtype (the recorded one, else by extension), bytes of the stored file, new_urls (a page's recorded links; a sheet's are found by
    sheet_assets()) and not_modified. planned has url too; files(path, bytes).
    """
    rows = urls.with_url(planned.where("action = 'reuse_local'"), "url", "u")
    rows = rows.withColumn("rtype", F.coalesce("prior_rtype", urls.resource_type(F.col("u"))))
    rows = rows.join(files.select(F.col("path").alias("prior_path"), "bytes"), "prior_path")
    links = F.when(F.col("rtype") == "page", F.coalesce("prior_outlinks", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    return rows.select("canonical_url", "url", "rtype", F.col("prior_path").alias("path"), "bytes", links.alias("new_urls"), links.alias("outlinks"), F.lit(True).alias("not_modified"))
