"""Pages as a browser has rendered them: resources of the document, links, and the crawl over them.

Rendering itself is a source that others fill: rendered(page_url, u, html, site_host, site_port), u being the parsed final URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html, urls
from ..functions.fixed import DOM_RESOURCES
from .crawl import crawl

OTHER = "Other"


def _parsed(rendered: DataFrame, refs: Column, base: Column) -> DataFrame:
    """(page_url, site_host, site_port, seq, a) of every reference that is a web URL."""
    rows = urls.once(rendered.withColumn("t", html.tokenized(F.col("html"))).withColumn("elements", F.col("t.elements")), "base", base)
    rows = rows.select("page_url", "site_host", "site_port", "base", F.posexplode(refs).alias("seq", "ref"))
    return urls.once(rows, "a", urls.parse_web_url(urls.resolve_url(F.col("base"), F.col("ref")))).where("a is not null")


def dom_resources(rendered: DataFrame) -> DataFrame:
    """(page_url, seq, url, resource_type): files that the document's elements name, each once, whatever was requested."""
    elements = F.col("elements")
    of = lambda tag, attr: F.transform(F.filter(elements, lambda x: (x["tag"] == tag) & x["attrs"][attr].isNotNull()), lambda x: x["attrs"][attr])
    base = F.coalesce(urls.parse_web_url(urls.joined(F.col("u"), html.first_base(elements))), F.col("u"))
    rows = _parsed(rendered, F.concat(*(of(*x) for x in DOM_RESOURCES)), base)
    rows = rows.where(urls.is_mirrorable_static(F.col("a"), F.col("site_host"), F.col("site_port")) & ~urls.is_dynamic_request(F.col("a")))
    rows = rows.withColumn("url", F.substring_index(urls.href(F.col("a")), "#", 1))
    return rows.groupBy("page_url", "url").agg(F.min("seq").alias("seq")).select("page_url", "seq", "url", F.lit(OTHER).alias("resource_type"))


def with_dom_resources(captures: DataFrame, found: DataFrame) -> DataFrame:
    """Captured requests(page_url, seq, url, resource_type) and, after them, what only the document names."""
    new = found.join(captures.select("page_url", "url"), ["page_url", "url"], "left_anti")
    return captures.select("page_url", "seq", "url", "resource_type").union(new.select("page_url", "seq", "url", "resource_type"))


def links(rendered: DataFrame) -> DataFrame:
    """(page_url, seq, url): links of a and area elements to the same domain but for live requests, whatever their extension.

    They are resolved against the page's own URL; a base element does not count here.
    """
    rows = _parsed(rendered, html.link_refs(F.col("elements")), F.col("u"))
    rows = rows.where(urls.is_same_domain(F.col("a"), F.col("site_host")) & ~urls.is_dynamic_request(F.col("a")))
    return rows.select("page_url", "seq", urls.href(F.col("a")).alias("url"))


def render_crawl(rendered: DataFrame, seeds: DataFrame, robots_rules: DataFrame | None = None, reused: DataFrame | None = None, **limits) -> DataFrame:
    """crawl() over rendered pages, whose seeds obey robots; reused(canonical_url, outlinks): fresh local pages that are not rendered again."""
    pages = urls.once(rendered, "own", urls.normalize_url(urls.parse_web_url(F.col("page_url")), F.lit("page"))).select("page_url", "own")
    found = links(rendered).groupBy("page_url").agg(F.sort_array(F.collect_list(F.struct("seq", "url"))).alias("x"))
    every = pages.join(found, "page_url", "left").select(F.col("own").alias("canonical_url"), F.coalesce(F.transform("x", lambda r: r["url"]), F.array().cast("array<string>")).alias("links"))
    if reused is not None:
        every = every.join(reused, "canonical_url", "left_anti").union(reused.select("canonical_url", F.col("outlinks").alias("links")))
    return crawl(every, seeds, robots_rules, seed_obeys_robots=True, **limits)
