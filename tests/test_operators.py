import json
import zipfile
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from siteloom.functions import paths, urls
from siteloom.operators import assets, closure, manifest, rendered, report
from siteloom.operators.crawl import crawl
from siteloom.plans import pages
from siteloom.sources import corpus, manifest_json
from siteloom.streaming import captures


def test_closure(spark):
    files = [("index.html", '<link href="look/main.css"><img src="mark.png"><a href="de/">'), ("look/main.css", ""), ("mark.png", "x"), ("de/index.html", '<a href="../index.html"><img src="../mark.png"><a href="../../away.html"><a href="gone.png"><a href="/root"><a href="..">')]
    df = spark.createDataFrame(files, "path string, text string")
    got = {(r.path, r.ref): r.status for r in closure.checked(df).collect()}
    assert got == {("index.html", "look/main.css"): "ok", ("index.html", "mark.png"): "ok", ("index.html", "de/"): "ok", ("de/index.html", "../index.html"): "ok", ("de/index.html", "../mark.png"): "ok", ("de/index.html", "../../away.html"): "escaped", ("de/index.html", "gone.png"): "missing", ("de/index.html", "/root"): "escaped", ("de/index.html", ".."): "ok"}
    rows = spark.createDataFrame([("u1", "p"), ("u2", "p"), ("u3", "q")], "canonical_url string, path string")
    assert closure.duplicate_paths(rows).collect()[0].asDict() == {"path": "p", "urls": ["u1", "u2"]}
    r = closure.report(df, rows).first()
    assert (r.checked, r.missing, r.escaped, r.duplicate_paths, r.ok) == (9, 1, 2, 1, False)
    assert closure.report(df.limit(0), rows.limit(0)).first().ok


def entry(url, path, text, etag=None, mtime=None):
    return (url, path, bytearray(text.encode()), mtime, etag, "page", url, ["a", "a"])


BYTES = "canonical_url string, path string, bytes binary, mtime string, etag string, rtype string, original_url string, outlinks array<string>"


def test_manifest(spark, tmp_path):
    m = manifest.entries(spark.createDataFrame([entry("u1", "a", "one"), entry("u2", "b", "two", "v1"), entry("u3", "c", "three"), entry("u4", "d", "four", None, "Mon")], BYTES))
    files = spark.createDataFrame([("a", bytearray(b"one")), ("b", bytearray(b"two")), ("c", bytearray(b"changed"))], "path string, bytes binary")
    fresh = manifest.with_freshness(m, files)
    wanted = spark.createDataFrame([(f"u{i}",) for i in range(1, 6)], "canonical_url string")
    plan = {r.canonical_url: r for r in manifest.planned(wanted, fresh).collect()}
    assert {k: r.action for k, r in plan.items()} == {"u1": "reuse_local", "u2": "conditional_get", "u3": "get", "u4": "get", "u5": "get"}
    assert plan["u2"].request_headers == {"If-None-Match": "v1"} and plan["u1"].prior_outlinks == ["a", "a"] and plan["u1"].prior_path == "a"
    new = manifest.entries(spark.createDataFrame([entry("u2", "b2", "2")], BYTES))
    both = manifest.upsert(m, new)
    assert {r.canonical_url: r.path for r in both.collect()} == {"u1": "a", "u2": "b2", "u3": "c", "u4": "d"} and both.where("original_url is not null").count() == 0
    text = manifest_json.dump(both, wanted, "https://s/", "1", "2")
    (tmp_path / "m.json").write_text(text)
    rows, seen, meta = manifest_json.load(spark, str(tmp_path / "m.json"))
    assert sorted(map(str, rows.collect())) == sorted(map(str, both.collect())) and seen.count() == 5 and meta.first().version == json.loads(text)["version"] == 2
    (tmp_path / "bad.json").write_text("{")
    assert manifest_json.load(spark, str(tmp_path / "bad.json"))[0].count() == 0
    got = spark.range(1).select(manifest.after_response(F.lit("conditional_get"), F.lit(304), F.lit(True)), manifest.after_response(F.lit("get"), F.lit(304), F.lit(False)), manifest.after_response(F.lit("get"), F.lit(200), F.lit(False))).first()
    assert tuple(got) == ("reused", "error", "replaced")


def test_reports(spark):
    rows = [("s", "page", 100, False, False), ("s", "image", 2000, False, False), ("s", "page", 50, True, False), ("t", "other", 1, False, True)]
    got = {r.site: r for r in report.summary(spark.createDataFrame(rows, "site string, rtype string, size long, not_modified boolean, failed boolean"), "site").collect()}
    assert (got["s"].pages, got["s"].images, got["s"].total_bytes, got["s"].size_text, got["s"].outcome) == (2, 1, 2100, "2.1 KB", "complete") and (got["t"].errors, got["t"].outcome) == (1, "failed")
    codes = spark.range(1).select(*(report.exit_code(F.lit(o)) for o in ("complete", "partial", "failed")), report.limit_reached(F.lit(5), F.lit(9), 5), report.limit_reached(F.lit(1), F.lit(9), 5, 9), report.limit_reached(F.lit(1), F.lit(9), 5)).first()
    assert tuple(codes) == (0, 2, 1, True, True, False)
    files = spark.createDataFrame([("b/x.html", bytearray(b"x")), ("a.png", bytearray(b"yy")), ("b/.site-manifest.json", bytearray(b"{}"))], "path string, bytes binary")
    z = zipfile.ZipFile(BytesIO(report.create_zip(files)))
    assert z.namelist() == ["a.png", "b/x.html"] and z.read("b/x.html") == b"x" and z.getinfo("a.png").external_attr >> 16 == 0o644


def site(spark):
    h = "https://h"
    rows = [(f"{h}/", [f"{h}/a", f"{h}/b?utm_source=x", f"{h}/a", "https://o/x", f"{h}/v1.2"]), (f"{h}/a", [f"{h}/", f"{h}/c", f"{h}/private/p"]), (f"{h}/b", [f"{h}/c?ref=1", f"{h}/d"]), (f"{h}/c", [f"{h}/e"])]
    seeds = [(f"{h}/", f"{h}/?ref=z", "h")]
    return spark.createDataFrame(rows, "canonical_url string, links array<string>"), spark.createDataFrame(seeds, "canonical_url string, url string, site string")


def test_crawl(spark):
    pages, seeds = site(spark)
    depth = lambda df: {r.canonical_url.removeprefix("https://h"): r.depth for r in df.collect()}
    full = crawl(pages, seeds)
    assert depth(full) == {"/": 0, "/a": 1, "/b": 1, "/c": 2, "/private/p": 2, "/d": 2, "/e": 3}
    assert {r.canonical_url: r.url for r in full.collect()}["https://h/b"] == "https://h/b?utm_source=x"
    rules = spark.createDataFrame([("h", "User-agent: *\nDisallow: /private\nDisallow: /b")], "site string, body string")
    assert depth(crawl(pages, seeds, rules)) == {"/": 0, "/a": 1, "/c": 2, "/e": 3}
    assert depth(crawl(pages, seeds, max_pages=4)) == {"/": 0, "/a": 1, "/b": 1, "/c": 2}
    assert depth(crawl(pages, seeds, max_pages=0)) == {"/": 0} and depth(crawl(pages, seeds, max_pages=0, seed_obeys_robots=True)) == {}


def test_sources_and_captures(spark, tmp_path):
    answers = [("https://h/", None, 200, {"Content-Type": "text/html", "ETag": "", "Last-Modified": "Mon"}, bytearray("é".encode("cp1252"))), ("https://h/a.png", "https://h/b.png", 200, {"content-type": "image/png"}, bytearray(b"\xff"))]
    got = {r.url: r for r in corpus.processed(spark.createDataFrame(answers, corpus.RESPONSES)).collect()}
    assert (got["https://h/"].rtype, got["https://h/"].etag, got["https://h/"].mtime, got["https://h/"].text) == ("page", None, "Mon", "�") and got["https://h/a.png"].text is None and got["https://h/a.png"].final_url == "https://h/b.png"
    files = spark.createDataFrame([("a/b.html", bytearray(b"x")), ("c", bytearray(b"y"))], "path string, bytes binary")
    corpus.export_files(files, str(tmp_path / "out"))
    assert {r.path: bytes(r.bytes) for r in corpus.read_files(spark, str(tmp_path / "out")).collect()} == {"a/b.html": b"x", "c": b"y"}
    kinds = "page_url string, seq int, url string, resource_type string, site_host string, site_port int, ts timestamp"
    rows = [("p", 2, "https://h/a.js#x", "Script"), ("p", 1, "https://h/a.js", "Image"), ("p", 3, "https://h/api/x", "Script"), ("p", 4, "https://h/x", "Fetch"), ("p", 5, "https://o/", "Document"), ("q", 1, "https://h/a.js", "Script")]
    df = spark.createDataFrame([(*r, "h", None, None) for r in rows], kinds).withColumn("ts", F.timestamp_seconds(F.col("seq")))
    assert sorted((r.page_url, r.url, r.seq) for r in captures.first_captures(df).collect()) == [("p", "https://h/a.js", 1), ("q", "https://h/a.js", 1)]
    df.write.parquet(str(tmp_path / "in"))
    stream = captures.stream_captures(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("kept_captures").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("kept_captures").count() == 2


def test_bfs_depths_covers_more_pages_than_crawls_do_by_default(spark, tmp_path):
    n = 10_500
    spark.range(n).withColumnRenamed("id", "page_id").write.parquet(str(tmp_path / "pages.parquet"))
    got = {int(r.canonical_url.rsplit("/p", 1)[1]): r.depth for r in pages.bfs_depths(spark, str(tmp_path)).collect()}
    assert got == {i: (i + 1).bit_length() - 1 for i in range(n)}


def test_crawl_limits_and_ties(spark):
    pages, seeds = site(spark)
    sized = pages.withColumn("size", F.lit(10))
    depth = lambda df: {r.canonical_url.removeprefix("https://h"): r.depth for r in df.collect()}
    assert depth(crawl(sized, seeds, max_bytes=20)) == {"/": 0, "/a": 1, "/b": 1}
    assert depth(crawl(sized, seeds, max_bytes=10)) == {"/": 0}
    twice = seeds.union(spark.createDataFrame([(seeds.first().canonical_url, "https://h/?utm_source=a", "h")], seeds.schema))
    got = {r.canonical_url: r.url for r in crawl(pages, twice).collect()}
    assert got[seeds.first().canonical_url] == min(r.url for r in twice.collect())


def test_crawl_compacts_what_it_has_seen(spark, monkeypatch):
    from siteloom.operators import crawl as module

    monkeypatch.setattr(module, "COMPACT", 3)
    n = 12
    rows = spark.createDataFrame([(f"https://h/p{i}", [f"https://h/p{i + 1}", f"https://h/p{i // 2}"]) for i in range(n)], "canonical_url string, links array<string>")
    seeds = spark.createDataFrame([("https://h/p0", "https://h/p0", "h")], "canonical_url string, url string, site string")
    assert {r.canonical_url: r.depth for r in crawl(rows, seeds).collect()} == {f"https://h/p{i}": i for i in range(n + 1)}


def test_crawl_of_a_deep_site_takes_no_job_a_round(spark, tmp_path):
    n = 250
    spark.range(n).withColumnRenamed("id", "page_id").write.parquet(str(tmp_path / "pages.parquet"))
    group = "deep-site"
    spark.sparkContext.setJobGroup(group, group)
    got = {int(r.canonical_url.rsplit("/p", 1)[1]): r.depth for r in pages.bfs_deep(spark, str(tmp_path)).collect()}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    want, level, depth = {0: 0}, [0], 0
    while level:
        depth, level = depth + 1, sorted({x for i in level for x in ((2 * i + 1) % n, (3 * i + 2) % n)} - set(want))
        want |= dict.fromkeys(level, depth)
    assert got == want and max(want.values()) == 99
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) < 60


def test_crawl_walks_as_it_goes_by_rounds(spark, monkeypatch):
    import random

    from siteloom.operators import crawl as module

    rng, n = random.Random(5), 60
    name = lambda i: f"https://{('h', 'www.h', 'o')[i % 3]}/{('d', 'p')[i % 7 > 0]}{i}"
    rows = spark.createDataFrame([(name(i), [name(rng.randrange(n)) + rng.choice(("", "?ref=1")) for _ in range(rng.randrange(3, 8))]) for i in range(n) if i % 11], "canonical_url string, links array<string>")
    seeds = spark.createDataFrame([(name(i), name(i), s) for i, s in ((1, "www.h"), (3, "h"), (5, "o"), (12, "www.h"))], "canonical_url string, url string, site string")
    rules = spark.createDataFrame([("h", "User-agent: *\nDisallow: /d")], "site string, body string")
    every = lambda **x: [sorted(map(tuple, crawl(rows, seeds, *r, **x).collect())) for r in ((), (rules,))] + [crawl(rows, seeds, **x).schema]
    for limits in ({}, {"max_pages": 20}, {"max_pages": 2}):
        monkeypatch.setattr(module, "WALKED", 1 << 25)
        walked = every(**limits)
        monkeypatch.setattr(module, "WALKED", 0)
        assert walked == every(**limits) and len(walked[0]) > (2 if limits.get("max_pages") == 2 else 10)


def with_u(df):
    return urls.with_url(df, "url", "u")


def test_assets_are_resolved_and_filtered(spark):
    page = '<base href="/sub/"><img src="a.png"><script src="/api/y.js"></script><a href="/page"></a><link href="https://elsewhere.org/page" rel="x"><link rel="stylesheet" href="https://cdn.net/s.css?v=1#x"><source srcset="b.webp 2x,../c.gif"><img src="data:image/png;base64,x">'
    df = with_u(spark.createDataFrame([("p", "https://h:8443/dir/", page, "h", 8443)], "source string, url string, html string, site_host string, site_port int"))
    got = [(r.ref, r.url) for r in assets.page_assets(df).orderBy("seq").collect()]
    assert got == [("https://cdn.net/s.css?v=1#x", "https://cdn.net/s.css?v=1#x"), ("a.png", "https://h:8443/sub/a.png"), ("b.webp", "https://h:8443/sub/b.webp"), ("../c.gif", "https://h:8443/c.gif")]
    sheet = with_u(spark.createDataFrame([("s", "https://cdn.net/look/s.css", "@import 'n.css'; a{src:url(../f.woff2)} b{src:url(data:x)}", "h", 8443)], "source string, url string, css string, site_host string, site_port int"))
    assert sorted(r.canonical_url for r in assets.sheet_assets(sheet).collect()) == ["https://cdn.net/f.woff2", "https://cdn.net/look/n.css"]


def test_own_documents_are_no_assets(spark):
    rows = [("https://h/shop", "https://h/shop", "https://h/shop/"), ("https://h/shop/", "https://h/shop", "https://h/shop/"), ("https://h/shop.js", "https://h/shop", "https://h/shop/")]
    df = spark.createDataFrame(rows, "x string, y string, z string")
    for a, b in (("x", "a"), ("y", "page_u"), ("z", "final_u")):
        df = urls.with_url(df, a, b)
    assert [r.x for r in assets.without_own_documents(df).collect()] == ["https://h/shop.js"]


def test_fan_out_follows_sheets_and_leaves_what_is_done(spark):
    first = spark.createDataFrame([("p", 0, "https://h/a.css", "https://h/a.css"), ("p", 1, "https://h/i.png", "https://h/i.png"), ("q", 0, "https://h/a.css", "https://h/a.css")], "source string, seq int, url string, canonical_url string")
    answers = spark.createDataFrame([("https://h/a.css", "css", "@import 'b.css'; x{src:url(f.woff2)}"), ("https://h/b.css", "css", "@import 'a.css'; y{src:url(g.png)}"), ("https://h/i.png", "image", None)], "canonical_url string, rtype string, text string")
    done = spark.createDataFrame([("https://h/f.woff2",)], "canonical_url string")
    got = {r.canonical_url: (r["round"], r.source) for r in assets.fan_out(first, answers, done, F.lit("h"), F.lit(None).cast("int")).collect()}
    assert got == {"https://h/a.css": (0, "p"), "https://h/i.png": (0, "p"), "https://h/b.css": (1, "https://h/a.css"), "https://h/g.png": (2, "https://h/b.css")}
    assert assets.fan_out(first.limit(0), answers, done, F.lit("h"), F.lit(None).cast("int")).count() == 0


def test_reuse_visited_and_fresh_runs(spark):
    known = manifest.entries(spark.createDataFrame([entry("https://h/", "index.html", "x"), entry("https://h/e", "e.html", "y", etag="1")], BYTES))
    files = spark.createDataFrame([("index.html", bytearray(b"x")), ("e.html", bytearray(b"y"))], "path string, bytes binary")
    asked = spark.createDataFrame([("https://h/", "https://h/"), ("https://h/e", "https://h/e"), ("https://h/n", "https://h/n")], "canonical_url string, url string")
    plan = manifest.planned(asked, manifest.with_freshness(known, files))
    assert {r.canonical_url: r.action for r in plan.collect()} == {"https://h/": "reuse_local", "https://h/e": "conditional_get", "https://h/n": "get"}
    r = assets.reused(plan, files).collect()
    assert [(x.canonical_url, x.rtype, bytes(x.bytes), x.new_urls, x.not_modified) for x in r] == [("https://h/", "page", b"x", ["a", "a"], True)]
    assert {x.action for x in manifest.planned(asked, manifest.with_freshness(known, files), fresh=True).collect()} == {"get"}
    one = lambda u: spark.createDataFrame([(u,)], "canonical_url string")
    assert sorted(x.canonical_url for x in manifest.visited(one("a"), one("b"), one("c"), one("a")).collect()) == ["a", "b", "c"]


def test_sinks_refuse_and_stream(spark, tmp_path):
    bad = spark.createDataFrame([("../out.html", bytearray(b"x"))], "path string, bytes binary")
    with pytest.raises(Exception, match="leaves the output folder"):
        corpus.export_files(bad, str(tmp_path / "tree"))
    assert not (tmp_path / "out.html").exists()
    files = spark.createDataFrame([("a.html", bytearray(b"x")), ("b.css", bytearray(b"yy"))], "path string, bytes binary")
    assert tuple(report.file_count(files).first()) == (2, 3)
    report.create_zip(files, to=str(tmp_path / "all.zip"))
    import zipfile

    assert zipfile.ZipFile(tmp_path / "all.zip").namelist() == ["a.html", "b.css"]
    gone = spark.createDataFrame([("https://h/", None, 404, {}, bytearray(b""))], corpus.RESPONSES)
    assert corpus.processed(gone).count() == 0


def test_a_cluster_needs_a_shared_folder(spark):
    from siteloom.operators.scratch import shared_dir

    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: None)

        class sparkContext:
            master = "yarn"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session)


def test_render_crawl_obeys_robots_and_reuses(spark):
    page = lambda *refs: "".join(f'<a href="{r}">x</a>' for r in refs)
    rows = [("https://h/", page("/a", "/b.pdf", "/private/x")), ("https://h/a", page("c")), ("https://h/c", ""), ("https://h/old", page("/never"))]
    df = urls.with_url(spark.createDataFrame([(u, h, "h", None) for u, h in rows], "page_url string, html string, site_host string, site_port int"), "page_url", "u")
    seeds = spark.createDataFrame([("https://h/", "https://h/", "h")], "canonical_url string, url string, site string")
    got = {r.canonical_url: r.depth for r in rendered.render_crawl(df, seeds).collect()}
    assert got == {"https://h/": 0, "https://h/a": 1, "https://h/private/x": 1, "https://h/c": 2}
    rules = spark.createDataFrame([("h", "User-agent: *\nDisallow: /private")], "site string, body string")
    kept = spark.createDataFrame([("https://h/a", ["https://h/old"])], "canonical_url string, outlinks array<string>")
    got = {r.canonical_url: r.depth for r in rendered.render_crawl(df, seeds, rules, kept).collect()}
    assert got == {"https://h/": 0, "https://h/a": 1, "https://h/old": 2, "https://h/never": 3}
    none = spark.createDataFrame([("h", "User-agent: *\nDisallow: /")], "site string, body string")
    assert rendered.render_crawl(df, seeds, none).count() == 0


def test_types_and_starts(spark):
    rows = [("https://h/a.css?v=1", "css"), ("https://h/p?b=1&a=2", "page")]
    df = urls.with_url(spark.createDataFrame(rows, "url string, rtype string"), "url", "u")
    got = df.select(paths.url_to_path_of_type(F.lit("/out"), F.col("u"), F.lit("h"), F.lit(None).cast("int"), F.col("rtype")).alias("p"), paths.expected_offline_path(F.col("u"), F.lit("h"), F.lit(None).cast("int")).alias("e")).collect()
    assert [(r.p, r.e) for r in got] == [("/out/a@v=1.css", "a@v=1.css"), ("/out/p@b=1&a=2/index.html", "p@b=1&a=2/index.html")]
    texts = ["https://h/x", " HTTP://h", "mailto:a@b", "h/x", "https://", None, "https://h:x/"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(urls.start_problem(F.col("t"))).collect()
    assert [r[0] for r in got] == [None, None, "neither http nor https", "no URL", "no host", "no URL", "no host"]
    one = manifest.entries(spark.createDataFrame([entry("u1", "a", "x"), entry("u2", "b", "y")], BYTES))
    assert manifest.entry_of(one, "u2").first().outlinks == ["a", "a"] and manifest.entry_of(one, "u3").count() == 0
