import hashlib
import random
from urllib.parse import urljoin

from pyspark.sql import functions as F

from siteloom.functions import content, html, paths, rewrite, robots, urls


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def parsed(name="url"):
    return urls.parse_web_url(F.col(name))


def test_parse(spark):
    cases = {
        "HTTP://User:pw@Example.COM:80/a/../b?x#f": "http://example.com/b?x#f",
        " https://h:8443\\p q\t/é ": "https://h:8443/p%20q/%C3%A9",
        "https://h": "https://h/",
        "https://h/a/./b/%2e%2E/c/..": "https://h/a/",
        "https://h/?a b='\"<>": "https://h/?a%20b=%27%22%3C%3E",
        "https:///h/x": "https://h/x",
        "http://[::1]:81/": "http://[::1]:81/",
        "https://h:443/%zz{}`": "https://h/%zz%7B%7D%60",
        "ftp://h/": None, "mailto:a@b": None, "http://": None, "nothing": None, "http://h:x/": None, "": None, None: None,
    }
    got = values(spark, [(k,) for k in cases], "url string", urls.href(parsed()))
    assert [g[0] for g in got] == list(cases.values())


def test_joining_equals_the_standard_library(spark):
    rng, base = random.Random(1), "https://h.example/a/b/c?q=1"
    refs = ["", "?x=1", "/", "//o.example/p", "http://o.example", ".", "..", "../..", "../../../x", "./y/", "z?u#v", "/a//b"]
    refs += ["/".join(rng.choice(["a", "..", ".", "b.c"]) for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    refs = [r for r in refs if not r.startswith("//") or r == "//o.example/p"]
    got = values(spark, [(base, r) for r in refs], "base string, r string", urls.href(urls.parse_web_url(urls.joined(urls.parse_web_url(F.col("base")), F.col("r")))))
    for r, (g,) in zip(refs, got):
        want = urljoin(base, r).split("#")[0]
        assert g.split("#")[0].rstrip("/") == (want + "/" if want.count("/") == 2 else want).rstrip("/"), r


def test_resolve_skips(spark):
    refs = ["#a", "", "  ", "javascript:x", "mailto:a", "tel:1", "data:x", "blob:x", " /a ", "ftp://x/y", "JavaScript:x"]
    got = values(spark, [(r,) for r in refs], "r string", urls.href(urls.parse_web_url(urls.resolve_url(urls.parse_web_url(F.lit("https://h/")), F.col("r")))))
    assert [g[0] for g in got] == [None] * 8 + ["https://h/a", None, None]


CANONICAL = [
    ("https://example.com/?ref=weekly&utm_medium=mail", "page", "https://example.com/"),
    ("https://example.com/notes?_rsc=abc", "page", "https://example.com/notes"),
    ("https://example.com/notes?tag=z&tag=k", "page", "https://example.com/notes?tag=k&tag=z"),
    ("https://example.com/a?b=1%26c&a+b=%zz&d=#x", "page", "https://example.com/a?a%20b=%zz&b=1&c&d"),
    ("https://example.com/a=b?a=1&a%3D=0", "page", "https://example.com/a=b?a=1&a==0"),
    ("https://example.com/a.css?utm_x=1&v=2#x", "asset", "https://example.com/a.css?utm_x=1&v=2"),
]


def test_canonical(spark):
    got = values(spark, [c[:2] for c in CANONICAL], "url string, kind string", urls.normalize_url(parsed(), F.col("kind")))
    assert [g[0] for g in got] == [c[2] for c in CANONICAL]


def test_predicates(spark):
    site, port = F.lit("example.com"), F.lit(None).cast("int")
    rows = [
        # url, mirrorable, dynamic, enqueueable, kind, type
        ("https://fonts.gstatic.com/l/inter.woff2", True, False, False, "asset", "other"),
        ("https://elsewhere.org/about", False, False, False, "page", "page"),
        ("https://example.com/notes?_rsc=1", False, True, False, "page", "page"),
        ("https://www.example.com/v1.2", True, False, False, "asset", "other"),
        ("https://example.com:8080/a", False, False, True, "page", "page"),
        ("https://example.com/x.php", True, False, False, "page", "page"),
        ("https://example.com/X.HTML", True, False, True, "page", "page"),
        ("https://fonts.googleapis.com/css2?family=R", True, False, False, "asset", "page"),
        ("https://example.com/API/x", False, True, False, "page", "page"),
        ("https://example.com/_next/static/chunks/%5Bid%5D.js", False, True, False, "asset", "js"),
    ]
    u = parsed()
    got = values(spark, [(r[0],) for r in rows], "url string", "url", urls.is_mirrorable_static(u, site, port), urls.is_dynamic_request(u), urls.is_enqueueable_page(u, site), urls.infer_url_kind(u), urls.resource_type(u))
    assert got == rows


def test_classify(spark):
    rows = [("text/html; charset=x", "/a.png", "page"), ("image/svg+xml", "/", "image"), ("font/woff2", "/", "other"), ("application/x-font-woff", "/", "other"), ("application/json", "/api", "page"), (None, "/a.mjs", "js"), ("text/javascript", "/", "js"), ("Text/HTML", "/a.css", "css")]
    got = values(spark, [(t, f"https://h{p}") for t, p, _ in rows], "t string, url string", urls.classify(F.col("t"), parsed()))
    assert [g[0] for g in got] == [r[2] for r in rows]


LONG = "q" * 49


OFFLINE = [
    ("https://example.com/", "page", "index.html"),
    ("https://example.com/team", "page", "team/index.html"),
    ("https://example.com/pics/b.png", "asset", "pics/b.png"),
    ("https://example.com/post?no=7", "page", "post@no=7/index.html"),
    ("https://example.com/pics/cover.png?rev=9", "asset", "pics/cover@rev=9.png"),
    ("https://example.com/../../var/log", "page", "var/log/index.html"),
    ("https://example.com/?a=b/c", "page", "@a=b_c/index.html"),
    ("https://fonts.gstatic.com/l/inter.woff2", "asset", "_external/fonts.gstatic.com/l/inter.woff2"),
    ("https://fonts.googleapis.com/css2?family=Inter", "asset", "_external/fonts.googleapis.com/css2@family=Inter/index.html"),
    ("http://www.o.com:81/a:b.c", "asset", "_external/o.com_81/a_b.c"),
    (f"https://example.com/a.js?{LONG[1:]}", "asset", f"a@{LONG[1:]}.js"),
    (f"https://example.com/a.js?{LONG}", "asset", f"a@{hashlib.sha256(LONG.encode()).hexdigest()[:16]}.js"),
    (f"https://example.com/a.html?{LONG}", "page", f"a@{LONG}.html"),
]


def test_offline_path(spark):
    path = paths.url_to_offline_path_with(parsed(), F.lit("example.com"), F.lit(None).cast("int"), F.col("kind"))
    got = values(spark, [c[:2] for c in OFFLINE], "url string, kind string", path)
    assert [g[0] for g in got] == [c[2] for c in OFFLINE]


def test_small_path_functions(spark):
    one = spark.range(1)
    get = lambda *cs: one.select(*cs).first()
    L = F.lit
    assert tuple(get(*(paths.relative_path(L(a), L(b)) for a, b in (("index.html", "pics/mark.png"), ("team/index.html", "index.html"), ("a/b/index.html", "a/c/x"), ("a/b/x", "a/b")))))  == ("pics/mark.png", "../index.html", "../c/x", ".")
    assert tuple(get(*(paths.is_under_output(L(p), L("/out")) for p in ("/out/a", "/out/../x", "/outside", "/out", "/out/a/../b")))) == (True, False, False, True, True)
    assert get(paths.resolve_ref(L("/srv/copy/de"), L("../index.html")))[0] == "/srv/copy/index.html"
    assert tuple(get(paths.split_fragment(L("a#b#c")).alias("x")).x) == ("a", "#b#c") and get(paths.split_fragment(L("a")).alias("x")).x.fragment is None
    assert tuple(get(*(paths.safe_segment(L(x)) for x in ("", ".", "..", 'a*b|"')))) == ("_", "_", "_", "a_b__")
    own = lambda a, p, f: paths.is_spa_document_url(*(urls.parse_web_url(L(f"https://h{x}")) for x in (a, p, f)))
    assert tuple(get(own("/shop", "/shop", "/shop/"), own("/shop/", "/shop", "/shop/"), own("/shop.js", "/shop", "/shop/"))) == (True, True, False)


def test_content(spark):
    bodies = [("d6d0cec4", "text/html; charset=gbk", "中文"), ("3c6d65746120636861727365743d2267626b223ed6d0cec4", "text/html", '<meta charset="gbk">中文'), ("68656c6c6f20e4b8ade69687", "text/html; charset=gbk", "hello 中文"), ("ff41", None, "�A"), ("e9", "text/html; charset=iso-8859-1", "é"), ("e9", 'text/html; Charset="x"', "�")]
    got = values(spark, [(bytearray.fromhex(b), t) for b, t, _ in bodies], "b binary, t string", content.decode_body(F.col("b"), F.col("t")))
    assert [g[0] for g in got] == [w for *_, w in bodies]
    sizes = [(0, "0 B"), (1023, "1023 B"), (1024, "1.0 KB"), (2304, "2.2 KB"), (1024**2, "1.0 MB"), (5 * 1024**4, "5120.0 GB")]
    assert [g[0] for g in values(spark, [(n,) for n, _ in sizes], "n long", content.format_bytes(F.col("n")))] == [t for _, t in sizes]
    assert values(spark, [(bytearray(b"good morning"),)], "b binary", content.hash_bytes(F.col("b")))[0][0].startswith("sha256:cdf71dea")
    tries = [(200, 1, "use", None), (304, 1, "not_modified", None), (500, 1, "retry", 500), (429, 2, "retry", 1000), (None, 3, "fail", None), (404, 1, "fail", None)]
    assert values(spark, [t[:2] for t in tries], "s int, a int", content.retry_decision(F.col("s"), F.col("a")).alias("d"))[0][0] == ("use", None)
    assert [tuple(g[0]) for g in values(spark, [t[:2] for t in tries], "s int, a int", content.retry_decision(F.col("s"), F.col("a")))] == [t[2:] for t in tries]


def test_robots(spark):
    body = "User-agent: a\nUser-agent: *\nDisallow: /staff\n# c\nAllow: /staff/open\nDisallow:\nDisallow: /path\nAllow: /path\nuser-agent: x\nUser-agent: b\nDisallow: /\n"
    cases = [("/staff/room", False), ("/public", True), ("/staff/open/page", True), ("/path/page", True), ("/whatever", True)]
    links = spark.createDataFrame([("s", p) for p, _ in cases] + [("other", "/staff")], "site string, path string")
    got = robots.with_allowed(links, spark.createDataFrame([("s", body)], "site string, body string")).collect()
    assert {r.path: r.allowed for r in got if r.site == "s"} == dict(cases) and all(r.allowed for r in got if r.site == "other")


PAGE = '<base href="/b/"><a HREF=x>1</a><!-- <a href="no"> --><script>"<a href=no>"</script><area href=\'y&amp;z\'><img src="i.png" src="2.png" srcset="a.png 1x, b.png 2x" data-srcset="c 1x"><img data-srcset="d"><input type=IMAGE src=go.png><input src=n><video poster=p.jpg></video><iframe src="/frame/9"></iframe>'


def test_extraction(spark):
    df = spark.createDataFrame([(PAGE,)], "h string").select("h", html.tokenized(F.col("h")).alias("t")).select("h", "t.elements", "t.text")
    r = df.select(html.link_refs(F.col("elements")).alias("a"), html.first_base(F.col("elements")).alias("b"), html.anchor_hrefs(F.col("h")).alias("n"), html.base_href(F.col("h")).alias("nb")).first()
    assert r.a == ["x", "y&z"] == r.n and r.b == "/b/" == r.nb
    got = [x.ref for x in html.asset_refs(df).orderBy("seq").collect()]
    assert got == ["i.png", "p.jpg", "/frame/9", "go.png", "a.png", "b.png", "a.png", "b.png"]
    one = spark.range(1).select(F.lit("@import 'x.css'; a{background:url( \"/i.png\" )} b{src:url(data:1)}").alias("c"), F.lit('<a data-src="q" href="../a\\b#c"> <p x-src="z" href="#n"><i style="background:url(u.png)"> <a href="//o"> <a href="/r"> <a href="q">').alias("h"))
    r = one.select(html.css_refs(F.col("c")).alias("c"), html.local_refs(F.col("h")).alias("l"), html.strip_tags(F.lit("a<b>c>d<e")).alias("s")).first()
    assert r.c == ["/i.png", "x.css"] and r.l == ["q", "../a/b", "z", "/r", "u.png"] and r.s == "acd"


def test_spa(spark):
    shell = '<body><div id="app"></div><script type="module" src=x></script></body>'
    rows = [(shell, True), (shell.replace("</div>", "x" * 600 + "</div>"), False), ("<html data-reactroot>", True), ("<body>" + "<script></script>" * 3 + "<script type='module'></script>", True), ("<body><p>plain</p></body>", False)]
    assert [g[0] for g in values(spark, [(h,) for h, _ in rows], "h string", html.is_spa(html.spa_signals(F.col("h"))))] == [w for _, w in rows]
    assert values(spark, [('<div id="app"></div><script></script>',)], "h string", html.looks_like_spa(F.col("h")))[0][0]


def rewritten(spark, rows, css=False):
    f = rewrite.rewrite_css if css else rewrite.rewrite_html
    df = urls.with_url(spark.createDataFrame(rows, "p string, t string"), "p", "u")
    return [r.out for r in f(df, "out", F.col("t"), F.col("u"), F.lit("example.com"), F.lit(None).cast("int")).collect()]


HOME = "https://example.com/"


REWRITTEN = [
    ("https://example.com/team/", '<a href="https://example.com/">', '<a href="../index.html">'),
    (HOME, '<link href="https://fonts.googleapis.com/css2?family=Inter" rel="stylesheet">', '<link href="_external/fonts.googleapis.com/css2@family=Inter/index.html" rel="stylesheet">'),
    (HOME, '<a href="https://elsewhere.org/page">', '<a href="https://elsewhere.org/page">'),
    (HOME, '<a href="/team">', '<a href="team/index.html">'),
    (HOME, "<img src='/pics/mark.png'>", '<img src="pics/mark.png">'),
    (HOME, '<a href="#part">', '<a href="#part">'),
    (HOME, '<a href="/a#b">', '<a href="a/index.html#b">'),
    (HOME, '<a href="https://example.com:8080/a">', '<a href="https://example.com:8080/a">'),
    (HOME, '<img srcset="/a.png 1x,  /b.png  2x ,data:x">', '<img srcset="a.png 1x, b.png 2x, data:x">'),
    (HOME, '<p style="background:url(\'/a.png\') x">', '<p style="background:url(a.png) x">'),
    (HOME, '<base href="/d/"><a href="x">', '<a href="d/x/index.html">'),
    (HOME, '<a href = "/x" title="a href=\'/y\'">', '<a href="x/index.html" title="a href=\'/y\'">'),
    (HOME, '<link as="script" href="y" rel="preload"><link rel="preload" as="font" href="/f.woff2">', '<link rel="preload" as="font" href="f.woff2">'),
    (HOME, '<script>1</script><script src="x', '<script>1</script><script src="x'),
    (HOME, "<p>text crossorigin here</p>", "<p>text here</p>"),
    (HOME, '<link rel="manifest" href="/m"><link rel=\'modulepreload\' href="x"><link rel="preload" href="y" as="script"><meta http-equiv="refresh" content="0"><script src="/sw.js"> </script><script>navigator.serviceWorker</script><script>ok</script>', "<script>ok</script>"),
]


def test_rewriting(spark):
    assert rewritten(spark, [c[:2] for c in REWRITTEN]) == [c[2] for c in REWRITTEN]


def test_css_rewriting_and_scripts(spark):
    sheet = "https://example.com/look/main.css"
    css = ["a{b:url('/pics/paper.png')} @import \"/x.css\"; @import \"y.css\"; url(data:1) url(https://o.com/page)", "url('https://fonts.gstatic.com/l/inter.woff2')"]
    got = rewritten(spark, [(sheet, c) for c in css], True)
    assert got == ['a{b:url("../pics/paper.png")} url("../x.css"); @import "y.css"; url(data:1) url(https://o.com/page)', 'url("../_external/fonts.gstatic.com/l/inter.woff2")']
    h = '<script>a</script><script type="application/ld+json">{}</script>b<SCRIPT x>c</SCRIPT>'
    assert values(spark, [(h,)], "h string", rewrite.strip_scripts(F.col("h")))[0][0] == '<script type="application/ld+json">{}</script>b'


def test_sql_names_give_what_the_columns_give(spark):
    from siteloom.functions import sql

    assert len(sql.register(spark)) == len(sql.FUNCTIONS)
    samples = {"url": ["HTTP://A.b:81/c/../d.CSS?y=2&x=1&utm_q=1#f", "https://h/api/x?q='a'", "nothing"], "page": ["https://h/a/b"], "ref": ["../c?d", "#x"], "kind": ["page", "asset"], "param": ["utm_x", "q"], "page_path": ["a/b.html"], "target": ["c/d.png"], "css": ["a{b:url( 'x.png' )} @import \"y.css\";"], "html": ["<a href='q'>a</a>"], "path": ["/x/y", "/z"], "body": ["User-agent: *\nDisallow: /x"], "n": [5, 5000]}
    for name, (arguments, _, function) in sql.FUNCTIONS.items():
        columns = [a.split() for a in arguments.split(", ")]
        rows = [()]
        for c, _ in columns:
            rows = [(*r, v) for r in rows for v in samples[c]]
        df = spark.createDataFrame([tuple(bytearray(v.encode()) if k == "BINARY" else v for v, (_, k) in zip(r, columns)) for r in rows], ", ".join(f"{c} {k}" for c, k in columns))
        got = df.select(F.expr(f"site_{name}({', '.join(c for c, _ in columns)})").alias("a"), function(*(F.col(c) for c, _ in columns)).alias("b")).collect()
        assert [r.a for r in got] == [r.b for r in got] and any(r.a is not None for r in got), name


def in_pieces(udf, *columns):
    """What a worker sends back for one Arrow batch, piece by piece."""
    import pyarrow as pa

    arrays = tuple(map(pa.array, columns))
    return [x.to_pylist() for x in udf.func(iter([arrays if len(arrays) > 1 else arrays[0]]))]


def test_tokenized_pages_leave_a_worker_a_few_at_a_time(spark):
    from siteloom.functions import batches

    given = [f"<a href='/{i}'>" + "x" * (batches.SLICE // 4) for i in range(40)] + [None, "", "<i a=1>" * (batches.SLICE // 4), "<b c='d'>"]
    pieces = in_pieces(html._tokenized, given)
    assert [[e["tag"] for e in p["elements"]] for p in sum(pieces, [])] == [["a"]] * 40 + [[], [], ["i"] * (batches.SLICE // 4), ["b"]]
    assert max(map(len, pieces)) == 3 and [len(p) for p in pieces if any(len(r["elements"]) > 1 for r in p)] == [1]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(given[:43:7])], "i int, h string").repartition(1).select("i", html.tokenized(F.col("h"))["elements"][0]["attrs"]["href"].alias("a"))
    assert {r.i: r.a for r in df.collect()} == {i: f"/{7 * i}" if i < 6 else None for i in range(7)}


def test_stripped_pages_leave_a_worker_a_few_at_a_time():
    from siteloom.functions import batches, markup

    given = ["<script>1</script>" + "x" * (batches.SLICE // 4)] * 20 + [None, "", "<p crossorigin>"]
    for udf, f in ((markup.strip_scripts, markup.without_scripts), (markup.strip_breakers, markup.stripped)):
        pieces = in_pieces(udf, given)
        assert sum(pieces, []) == [None if h is None else f(h) for h in given] and max(map(len, pieces)) < 7


def test_linked_pages_leave_a_worker_a_few_at_a_time():
    from siteloom.functions import batches, markup

    page = "<a href='a'>" + "x" * (batches.SLICE // 4)
    given, refs, links = [page] * 20 + [None, page, "<a href='b'>"], [["a"]] * 21 + [None, ["a", "b"]], [["../a"]] * 21 + [None, [None, "../b"]]
    want = ['<a href="../a">' + page[12:]] * 20 + [None, page, '<a href="../b">']
    for udf in (markup.linked, markup.finished):
        pieces = in_pieces(udf, given, refs, links)
        assert sum(pieces, []) == want and max(map(len, pieces)) < 7
    assert sum(in_pieces(markup.sheet_linked, ["i{b:url(a)}", None], [["a"], None], [["../a"], None]), []) == ['i{b:url("../a")}', None]
