"""Queries over the pages table; each page is its own site."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import content, html, paths, rewrite, robots, sql, urls
from ..operators import assets, closure, manifest, rendered, report
from ..streaming import captures

PAGE_KIND = "page"
#: Rules of the robots query, the same for every site.
ROBOTS = "User-agent: other\nDisallow: /\nUser-agent: *\nDisallow: /t\nAllow: /th\nDisallow: /de\nDisallow:\n# end\nDisallow: /en/\nAllow: /en/\n"


def pages(spark, sf_dir: str) -> DataFrame:
    return urls.with_url(spark.read.parquet(f"{sf_dir}/pages.parquet"), "url", "u")


def canonical(spark, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir)
    u = F.col("u")
    return p.select("page_id", "url", "u", "html", urls.normalize_url(u, F.lit(PAGE_KIND)).alias("canonical_url"), paths.url_to_offline_path_with(u, u["host"], u["port"], urls.infer_url_kind(u)).alias("path"))


def links(spark, sf_dir: str) -> DataFrame:
    """(page_id, u, pos, href, resolved, l): every link of every page; html ends here."""
    p = pages(spark, sf_dir)
    base = F.coalesce(urls.parse_web_url(urls.joined(F.col("u"), html.base_href(F.col("html")))), F.col("u"))
    p = urls.once(p, "base", base).select("page_id", "u", "base", html.anchor_hrefs(F.col("html")).alias("hrefs"))
    p = p.select("page_id", "u", "base", F.posexplode("hrefs").alias("pos", "href"))
    p = urls.once(p, "l", urls.parse_web_url(urls.resolve_url(F.col("base"), F.col("href")))).where("l is not null")
    return p.withColumn("resolved", urls.href(F.col("l")))


def stored_files(spark, sf_dir: str) -> DataFrame:
    """(page_id, canonical_url, path, text): pages rewritten for offline reading."""
    c = canonical(spark, sf_dir)
    return rewrite.rewrite_html(c, "text", F.col("html"), F.col("u"), F.col("u.host"), F.col("u.port")).select("page_id", "canonical_url", "url", "path", "text")


def url_components(spark, sf_dir):
    u = F.col("u")
    return pages(spark, sf_dir).select("page_id", "u.scheme", "u.host", "u.port", "u.path", "u.query", "u.fragment", paths.host_label(u).alias("label"))


def canonical_url(spark, sf_dir):
    return canonical(spark, sf_dir).select("page_id", "url", "canonical_url", "path")


def canonical_groups(spark, sf_dir):
    return canonical(spark, sf_dir).groupBy("canonical_url").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


def tracking_params(spark, sf_dir):
    pairs = pages(spark, sf_dir).select(F.explode(urls.query_pairs(F.col("u.query"))).alias("p"))
    return pairs.groupBy(F.col("p.k").alias("param"), urls.is_tracking_param(F.col("p.k")).alias("tracking")).agg(F.count("*").alias("n"))


def offline_path(spark, sf_dir):
    u = F.col("u")
    other = F.lit("static.example.com")
    return pages(spark, sf_dir).select("page_id", paths.url_to_offline_path(u).alias("own_path"), paths.url_to_offline_path_with(u, other, F.lit(None).cast("int"), F.lit(PAGE_KIND)).alias("external_path"), paths.url_to_path_with(F.lit("/out/site"), u, u["host"], u["port"], F.lit(PAGE_KIND)).alias("file"))


def path_collisions(spark, sf_dir):
    """URLs that share a file of their site's folder."""
    c = canonical(spark, sf_dir).select(F.col("u.host").alias("site"), "path", F.col("url").alias("canonical_url"))
    return c.groupBy("site", "path").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("canonical_url")), ",").alias("urls"))


def page_links(spark, sf_dir):
    return links(spark, sf_dir).select("page_id", F.col("pos").cast("long").alias("pos"), "href", "resolved")


def link_kinds(spark, sf_dir):
    l, u = F.col("l"), F.col("u")
    one = links(spark, sf_dir).groupBy("resolved").agg(F.min(F.struct("page_id", "pos", "u", "l")).alias("x")).select("resolved", "x.u", "x.l")
    return one.select("resolved", urls.infer_url_kind(l).alias("kind"), urls.resource_type(l).alias("rtype"), urls.is_dynamic_request(l).alias("dynamic"), urls.is_same_domain(l, u["host"]).alias("same_domain"), urls.is_mirrorable_static(l, u["host"], u["port"]).alias("mirrorable"), urls.is_enqueueable_page(l, u["host"]).alias("enqueueable"))


def kind_counts(spark, sf_dir):
    x = links(spark, sf_dir).select(urls.bare_host(F.col("u.host")).alias("site"), urls.resource_type(F.col("l")).alias("rtype"))
    return x.groupBy("site", "rtype").agg(F.count("*").alias("n"))


def outlinks(spark, sf_dir):
    x = links(spark, sf_dir).where(urls.is_enqueueable_page(F.col("l"), F.col("u.host")))
    x = x.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("pos", "resolved"))).alias("x"))
    return x.select("page_id", F.size("x").cast("long").alias("n"), F.array_join(F.transform("x", lambda r: r["resolved"]), " ").alias("outlinks"))


def _edges(spark, sf_dir) -> DataFrame:
    return links(spark, sf_dir).where(urls.is_enqueueable_page(F.col("l"), F.col("u.host"))).select(urls.normalize_url(F.col("u"), F.lit(PAGE_KIND)).alias("src"), urls.normalize_url(F.col("l"), F.lit(PAGE_KIND)).alias("dst"))


def link_degrees(spark, sf_dir):
    ends = _edges(spark, sf_dir).select(F.explode(F.array(F.struct(F.col("src").alias("url"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("url"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.url").agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))


def _frontier(spark, sf_dir) -> DataFrame:
    visited = canonical(spark, sf_dir).select("canonical_url").distinct()
    x = links(spark, sf_dir).where(urls.is_enqueueable_page(F.col("l"), F.col("u.host")))
    x = x.select(urls.normalize_url(F.col("l"), F.lit(PAGE_KIND)).alias("canonical_url"), "page_id", "pos")
    return x.groupBy("canonical_url").agg(F.min(F.struct("page_id", "pos")).alias("f")).join(visited, "canonical_url", "left_anti").select("canonical_url", F.col("f.page_id").alias("page_id"), F.col("f.pos").cast("long").alias("pos"))


def frontier_new(spark, sf_dir):
    return _frontier(spark, sf_dir)


def frontier_limited(spark, sf_dir):
    """A crawl's round with a page limit: the first 100 in the order of discovery (the limit is the feature)."""
    return _frontier(spark, sf_dir).orderBy("page_id", "pos").limit(100)


def relative_links(spark, sf_dir):
    l, u = F.col("l"), F.col("u")
    target = paths.url_to_offline_path_with(l, u["host"], u["port"], urls.infer_url_kind(l))
    x = links(spark, sf_dir).select("page_id", F.col("pos").cast("long").alias("pos"), paths.url_to_offline_path(u).alias("from_path"), target.alias("target"))
    return x.withColumn("relative", paths.relative_path(F.col("from_path"), F.col("target")))


def rewritten_attrs(spark, sf_dir):
    u = F.col("u")
    new = rewrite.rewrite_attributes(pages(spark, sf_dir), "new", F.col("html"), u, paths.url_to_offline_path(u), u["host"], u["port"])
    return new.select("page_id", F.sha2("new", 256).alias("sha256"), F.length("new").cast("long").alias("n_chars"))


def stripped_html(spark, sf_dir):
    marked = F.concat(F.lit('<link rel="manifest" href="/m"><meta http-equiv="refresh" content="0;url=/x"><script>navigator.serviceWorker.x()</script><img src="a" crossorigin="anonymous">'), F.col("html"))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", rewrite.strip_offline_breakers(marked).alias("stripped"))


def scripts_stripped(spark, sf_dir):
    marked = F.concat(F.lit('<script type="application/ld+json">{"a":1}</script>'), F.col("html"))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", rewrite.strip_scripts(marked).alias("stripped"))


def spa_signals(spark, sf_dir):
    s = html.spa_signals(F.col("html"))
    x = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", s.alias("s"))
    return x.select("page_id", F.array_join("s.markers", ",").alias("markers"), "s.modules", "s.scripts", "s.root", "s.text_bytes", html.is_spa(F.col("s")).alias("spa"))


def visible_text_len(spark, sf_dir):
    h = F.col("html")
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.octet_length(html.body_text(h)).cast("long").alias("body_bytes"), F.length(html.strip_tags(h)).cast("long").alias("stripped_chars"))


def css_refs(spark, sf_dir):
    """References of each page's styles, a fixed sheet put before them."""
    css = F.concat(F.lit("@import 'base.css';p{background:url( \"/i/a.png\" )}i{src:url(data:x)}"), html.style_text(F.col("html")))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.posexplode(html.css_refs(css)).alias("p", "ref")).select("page_id", F.col("p").cast("long").alias("pos"), "ref")


def local_refs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.explode(html.local_refs(F.col("html"))).alias("ref"))


def _closure(spark, sf_dir) -> DataFrame:
    files = stored_files(spark, sf_dir).select(F.concat(F.col("page_id").cast("string"), F.lit("/"), F.col("path")).alias("path"), "text")
    return closure.checked(files)


def closure_missing(spark, sf_dir):
    return _closure(spark, sf_dir).where("status = 'missing'").select("path", "ref")


def closure_escaped(spark, sf_dir):
    """Unrewritten pages: rooted references leave the folder."""
    files = canonical(spark, sf_dir).select(F.concat(F.col("page_id").cast("string"), F.lit("/"), F.col("path")).alias("path"), F.col("html").alias("text"))
    return closure.checked(files).where("status = 'escaped'").select("path", "ref")


def manifest_rows(spark, sf_dir):
    f = stored_files(spark, sf_dir)
    null = F.lit(None).cast("string")
    rows = manifest.entries(f.select("page_id", "canonical_url", "path", F.col("text").cast("binary").alias("bytes"), null.alias("mtime"), null.alias("etag"), F.lit(PAGE_KIND).alias("rtype"), F.col("url").alias("original_url"), F.array().cast("array<string>").alias("outlinks")).withColumn("page_id", F.col("page_id")))
    return rows.select("canonical_url", "path", "size", "hash", "rtype", "original_url")


def _known(spark, sf_dir) -> DataFrame:
    """A manifest of the pages with even ids, every third hash stale, every fifth with an etag."""
    c, k = canonical(spark, sf_dir), F.col("page_id")
    h = F.concat(content.hash_bytes(F.col("html").cast("binary")), F.when(k % 3 == 0, "x").otherwise(""))
    rows = c.where(k % 2 == 0).select("page_id", "canonical_url", "path", F.octet_length("html").cast("long").alias("size"), h.alias("hash"), F.lit(None).cast("string").alias("mtime"), F.when(k % 5 == 0, F.concat(F.lit("v"), k.cast("string"))).alias("etag"), F.lit(PAGE_KIND).alias("rtype"), F.lit(None).cast("string").alias("original_url"), F.array().cast("array<string>").alias("outlinks"))
    return manifest.last_written(rows, k).drop("page_id")


def incremental_actions(spark, sf_dir):
    c = canonical(spark, sf_dir).where("page_id % 7 <> 0")
    # files by path: of pages with one path, the last
    files = c.select("path", "page_id", content.hash_bytes(F.col("html").cast("binary")).alias("hash")).groupBy("path").agg(F.max_by("hash", "page_id").alias("hash"))
    every = canonical(spark, sf_dir).select("canonical_url").distinct()
    x = manifest.planned(every, manifest.with_hashes(_known(spark, sf_dir), files))
    return x.select("canonical_url", "action", F.get(F.map_values("request_headers"), F.lit(0)).alias("etag"), "prior_rtype")


def manifest_upsert(spark, sf_dir):
    c = canonical(spark, sf_dir)
    new = c.where("page_id % 4 <> 0").select("page_id", "canonical_url", "path", F.octet_length("html").cast("long").alias("size"), content.hash_bytes(F.col("html").cast("binary")).alias("hash"), F.lit("new").alias("mtime"), F.lit(None).cast("string").alias("etag"), F.lit(PAGE_KIND).alias("rtype"), F.lit(None).cast("string").alias("original_url"), F.array().cast("array<string>").alias("outlinks"))
    out = manifest.upsert(_known(spark, sf_dir), manifest.last_written(new, F.col("page_id")).drop("page_id"))
    return out.select("canonical_url", "path", "size", "hash", "mtime")


def robots_allowed(spark, sf_dir):
    x = links(spark, sf_dir).select(F.col("l.path").alias("path"), F.lit("s").alias("site")).distinct()
    rules = spark.createDataFrame([("s", ROBOTS)], "site string, body string")
    return robots.with_allowed(x, rules).select("path", "allowed")


def crawl_summary(spark, sf_dir):
    l = F.col("l")
    x = links(spark, sf_dir).select(urls.bare_host(F.col("u.host")).alias("site"), urls.resource_type(l).alias("rtype"), (F.length("resolved") * 97).cast("long").alias("size"), (F.col("pos") % 5 == 4).alias("not_modified"), (F.length("href") == 3).alias("failed"))
    return report.summary(x, "site")


def archive_listing(spark, sf_dir):
    name = F.when(F.col("page_id") % 10 == 0, "a/.site-manifest.json").otherwise(F.col("path"))
    files = canonical(spark, sf_dir).select("page_id", name.alias("path"), F.octet_length("html").cast("long").alias("size"))
    return report.archive_listing(files)


def charset_sniff(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    body = F.when(F.col("page_id") % 3 == 0, F.replace("html", F.lit('<meta charset="utf-8">'), F.lit("<META http-equiv=x content='text/html; charset=GB2312'>"))).otherwise(F.col("html")).cast("binary")
    return p.select("page_id", content.sniff_meta_charset(body).alias("charset"))


def formatted_sizes(spark, sf_dir):
    n = F.octet_length("html").cast("long") * F.col("page_id") * F.col("page_id")
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", content.format_bytes(n).alias("size_text"))


def _site(spark, sf_dir, second: int) -> DataFrame:
    """A crawl of one site made of the pages: page i links to the pages 2i + 1 and second * i + 2, beyond the last one from the start again."""
    from ..operators.crawl import crawl

    ids = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id")
    name = lambda k: F.concat(F.lit("https://site.example/p"), k.cast("string"))
    n = ids.count()
    i = F.col("page_id")
    rows = ids.select(name(i).alias("canonical_url"), F.array(name((2 * i + 1) % n), name((second * i + 2) % n)).alias("links"))
    seeds = ids.where("page_id = 0").select(name(i).alias("canonical_url"), name(i).alias("url"), F.lit("site.example").alias("site"))
    return crawl(rows, seeds).select("canonical_url", F.col("depth").cast("long").alias("depth"))


def bfs_depths(spark, sf_dir):
    """Breadth-first crawl of a wide site."""
    return _site(spark, sf_dir, 2)


def bfs_deep(spark, sf_dir):
    """Breadth-first crawl of a site with long chains of pages."""
    return _site(spark, sf_dir, 3)


#: Put before pages that have no assets of their own; the third word is where a reference leads.
ASSET_HEAD = (
    '<base href="/zz/"><img src="i.png" srcset="a.png 1x, /zz/c.webp 2x"><img data-lazy-src="../l.gif"><input type="image" src="go.svg">'
    '<video poster="https://cdn.example.net:8443/p.jpg"></video><link rel="stylesheet" href="https://fonts.example.net/css2?family=A"><script src="/api/x.js"></script>'
)
REWRITE_HEAD = (
    "<base href='/zz/'><img src='i.png' srcset=\"a.png 1x, /zz/c.webp 2x\"><p style=\"background:url('/zz/bg.png') no-repeat\">"
    '<video poster="//cdn.example.net:8443/p.jpg"></video><script src="/sw.js"></script><script type="module" src="/zz/m.js" crossorigin></script>'
)
SHEET = "@import \"/zz/x.css\"; b{background:url('/zz/bg.png')} i{src:url(data:y)} u{src:url(https://elsewhere.example/p)}"


def _assets(spark, sf_dir) -> DataFrame:
    p = pages(spark, sf_dir).select(F.col("page_id").cast("string").alias("source"), "u", F.concat(F.lit(ASSET_HEAD), F.col("html")).alias("html"), F.col("u.host").alias("site_host"), F.col("u.port").alias("site_port"))
    return assets.page_assets(p)


def page_assets(spark, sf_dir):
    return _assets(spark, sf_dir).select(F.col("source").cast("long").alias("page_id"), F.col("seq").cast("long").alias("seq"), "ref", "url")


def asset_fan_out(spark, sf_dir):
    """Assets of the pages of all sites, and what two linked style sheets lead to; those of one host are stored already."""
    first = _assets(spark, sf_dir).withColumn("source", F.lpad("source", 20, "0"))
    sheets = spark.createDataFrame([("https://fonts.example.net/css2?family=A", "css", "@import 'b.css';@font-face{src:url(f.woff2)}"), ("https://fonts.example.net/b.css", "css", "p{background:url(/css2?family=A)}i{background:url(g.png)}")], "canonical_url string, rtype string, text string")
    done = first.where(F.col("canonical_url").startswith("https://cdn.example.net")).select("canonical_url").distinct()
    out = assets.fan_out(first, sheets, done, F.lit("site.example"), F.lit(None).cast("int"))
    return out.select("canonical_url", "url", F.col("round").cast("long").alias("round"))


def rewritten_assets(spark, sf_dir):
    """A fixed head and a fixed sheet, rewritten for each page's place."""
    p, u = pages(spark, sf_dir).withColumns({"head": F.lit(REWRITE_HEAD), "sheet": F.lit(SHEET)}), F.col("u")
    p = rewrite.rewrite_html(p, "new_html", F.col("head"), u, u["host"], u["port"])
    return rewrite.rewrite_css(p, "new_css", F.col("sheet"), u, u["host"], u["port"]).select("page_id", "new_html", "new_css")


def captures_kept(spark, sf_dir):
    """Requests of a browser on each page: which are files of the site, each once."""
    asked = (("/a.js#x", "Script"), ("/a.js", "Image"), ("/api/x", "Script"), ("/x.json", "Fetch"), ("/p/q", "Document"), ("//cdn.example.net/f.woff2", "Font"), ("//elsewhere.example/q", "Document"), ("/t?_rsc=1", "Script"), (":81/a.css", "Stylesheet"), (":81/page", "Image"))
    rows = F.array(*(F.struct(F.lit(i).alias("seq"), F.lit(url).alias("url"), F.lit(t).alias("resource_type")) for i, (url, t) in enumerate(asked)))
    u = F.col("u")
    own = F.concat(u["scheme"], F.lit("://"), u["host"])
    x = pages(spark, sf_dir).select(F.col("page_id").cast("string").alias("page_url"), u["host"].alias("site_host"), u["port"].alias("site_port"), u["scheme"].alias("scheme"), own.alias("own"), F.explode(rows).alias("r"))
    url = F.when(F.col("r.url").startswith("//"), F.concat(F.col("scheme"), F.lit(":"), F.col("r.url"))).otherwise(F.concat("own", "r.url"))
    x = captures.first_captures(x.select("page_url", "site_host", "site_port", "r.seq", url.alias("url"), "r.resource_type"))
    return x.select(F.col("page_url").cast("long").alias("page_id"), "url", F.col("seq").cast("long").alias("seq"), "resource_type")


RENDERED_HEAD = (
    '<base href="https://cdn.example.net/zz/"><a href="/own#f">o</a><a href="https://elsewhere.example/x">x</a><area href="/api/x"><a href="/f.pdf">f</a>'
    '<img src="i.png#p"><script src="i.png"></script><link href="https://elsewhere.example/page"><audio src="/a.js"></audio>'
)


def _rendered(spark, sf_dir) -> DataFrame:
    u = F.col("u")
    return pages(spark, sf_dir).select(F.col("page_id").cast("string").alias("page_url"), u, F.concat(F.lit(RENDERED_HEAD), F.col("html")).alias("html"), u["host"].alias("site_host"), u["port"].alias("site_port"))


def rendered_links(spark, sf_dir):
    x = rendered.links(_rendered(spark, sf_dir))
    return x.select(F.col("page_url").cast("long").alias("page_id"), F.col("seq").cast("long").alias("seq"), "url")


def rendered_resources(spark, sf_dir):
    """Captured scripts of each page and what only its document names."""
    p = _rendered(spark, sf_dir)
    asked = p.select("page_url", F.lit(0).alias("seq"), F.lit("https://cdn.example.net/a.js").alias("url"), F.lit("Script").alias("resource_type"))
    x = rendered.with_dom_resources(asked, rendered.dom_resources(p))
    return x.select(F.col("page_url").cast("long").alias("page_id"), "url", "resource_type")


def sql_functions(spark, sf_dir):
    """The functions under their SQL names."""
    sql.register(spark)
    x = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return x.selectExpr("page_id", "site_canonical_url(url, 'page') as canonical_url", "site_offline_path(url) as path", "site_start_problem(url) as problem", "site_content_hash(cast(html as binary)) as hash", "site_format_bytes(octet_length(html)) as size_text")


def start_problems(spark, sf_dir):
    """Each page's URL, whole and spoiled in several ways, as the start of a crawl."""
    u, k = F.col("url"), F.col("page_id") % 4
    text = F.when(k == 0, u).when(k == 1, F.regexp_replace(u, "^https?", "ftp")).when(k == 2, F.regexp_replace(u, "^https?://", "")).otherwise("http://")
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", urls.start_problem(text).alias("problem"))


def decoded_bodies(spark, sf_dir):
    """Bodies in several charsets, by header, by mark in the text, and by neither."""
    cases = (("", "text/html; charset=gbk", "d6d0cec4"), ('<meta charset="gbk">', "text/html", "d6d0cec4"), ("", "text/html; charset=iso-8859-1", "e9"), ("", None, "e4b8ad"), ("", "text/css", "ff41"))
    k = F.col("page_id") % len(cases)
    pick = lambda i: F.element_at(F.array(*(F.lit(c[i]) for c in cases)), (k + 1).cast("int"))
    body = F.concat(pick(0).cast("binary"), F.unhex(pick(2)))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", content.decode_body(body, pick(1)).alias("text"))


QUERIES = {
    f.__name__: f
    for f in (
        url_components, canonical_url, canonical_groups, tracking_params, offline_path, path_collisions, page_links, link_kinds, kind_counts, outlinks, link_degrees, frontier_new, frontier_limited, relative_links,
        rewritten_attrs, stripped_html, scripts_stripped, spa_signals, visible_text_len, css_refs, local_refs, closure_missing, closure_escaped, manifest_rows, incremental_actions, manifest_upsert, robots_allowed,
        crawl_summary, archive_listing, charset_sniff, formatted_sizes, bfs_depths, bfs_deep, page_assets, asset_fan_out, rewritten_assets, captures_kept, decoded_bodies, rendered_links, rendered_resources, start_problems, sql_functions,
    )
}
