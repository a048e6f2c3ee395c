"""URLs as struct columns: parsing, resolution, canonical form and predicates.

parse_web_url() gives struct(scheme, host, port, path, query, fragment), null for anything but http and https with a host. The
other functions take such structs. Ports equal to the scheme's default are null; paths and queries are percent-encoded as
the WHATWG standard asks. Hosts beyond ASCII are lower-cased, not converted to punycode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fixed import ASSET_EXTENSIONS, DYNAMIC_HINTS, IMAGE_EXTENSIONS, OTHER_SCHEMES, SCRIPT_TYPES, TRACKING

_URL = r"(?s)^([A-Za-z]+):[/\\]*([^/\\?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
_DOTS = r"(?i)^(\.|%2e)$"
_DOTS2 = r"(?i)^(\.|%2e)(\.|%2e)$"


def let(value: Column, body) -> Column:
    """body(value), computing the value once: a Column used several times in a lambda would be repeated."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _escaped(s: Column, keep: str) -> Column:
    """Percent-encodes the characters outside keep, a character class of Java's; untouched texts cost one match."""
    one = lambda c: F.when(c.rlike(f"^{keep}$"), c).when(c == " ", "%20").otherwise(F.url_encode(c))
    return let(s, lambda x: F.when(x.rlike(f"^{keep}*$"), x).otherwise(F.array_join(F.transform(F.split(x, ""), one), "")))


def escaped_path(s: Column) -> Column:
    return _escaped(s, r"[!$-;=@-_a-z|~]")


def escaped_query(s: Column) -> Column:
    return _escaped(s, r"[!$-&(-;=?-~]")


def without_dots(path: Column) -> Column:
    """Resolves '.' and '..' segments of a path that begins with a slash."""

    def clean(parts: Column) -> Column:
        last = F.element_at(parts, -1)
        done = F.aggregate(
            F.slice(parts, 2, F.size(parts)),
            F.array().cast("array<string>"),
            lambda acc, x: F.when(x.rlike(_DOTS2), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x.rlike(_DOTS), acc).otherwise(F.array_append(acc, x)),
        )
        tail = F.when(last.rlike(_DOTS) | last.rlike(_DOTS2), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.lit("/"), F.array_join(F.concat(done, tail), "/"))

    return let(path, lambda p: F.when(p.rlike(r"(?i)/(\.|%2e){1,2}(/|$)"), let(F.split(p, "/"), clean)).otherwise(p))


def parse_web_url(url: Column) -> Column:
    def raw(s: Column) -> Column:
        part = lambda i: F.regexp_extract(s, _URL, i)
        return F.struct(F.lower(part(1)).alias("scheme"), F.regexp_replace(part(2), r"^.*@", "").alias("place"), F.translate(part(3), "\\", "/").alias("path"), part(4).alias("query"), part(5).alias("fragment"))

    def built(r: Column) -> Column:
        host = F.lower(F.regexp_extract(r["place"], r"^(\[[^\]]*\]|[^:]*)", 1))
        port = F.regexp_extract(r["place"], r":(\d{1,5})$", 1).try_cast("int")
        usual = F.when(r["scheme"] == "https", 443).otherwise(80)
        bad = ~r["scheme"].isin("http", "https") | (host == "") | F.regexp_replace(r["place"], r"^\[[^\]]*\]", "").rlike(":.*[^0-9]") | F.coalesce(port > 65535, F.lit(False)) | host.rlike(r"[\x00-\x20\"<>^`{|}%]")
        return F.when(
            ~bad,
            F.struct(
                r["scheme"].alias("scheme"),
                host.alias("host"),
                F.nullif(port, usual).alias("port"),
                without_dots(escaped_path(F.when(r["path"] == "", "/").otherwise(r["path"]))).alias("path"),
                F.when(r["query"] != "", escaped_query(F.substr(r["query"], F.lit(2)))).alias("query"),
                F.when(r["fragment"] != "", F.substr(r["fragment"], F.lit(2))).alias("fragment"),
            ),
        )

    s = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")
    return let(let(s, raw), built)


def href(u: Column) -> Column:
    """The URL as text."""
    mark = lambda sign, x: F.when(x.isNotNull(), F.concat(F.lit(sign), x)).otherwise("")
    return F.concat(u["scheme"], F.lit("://"), u["host"], mark(":", u["port"].cast("string")), u["path"], mark("?", u["query"]), mark("#", u["fragment"]))


def joined(base: Column, ref: Column) -> Column:
    """Text of the absolute URL that ref means on the page base; parse it again with parse_web_url."""
    origin = F.concat(base["scheme"], F.lit("://"), base["host"], F.when(base["port"].isNotNull(), F.concat(F.lit(":"), base["port"].cast("string"))).otherwise(""))
    query = F.when(base["query"].isNotNull(), F.concat(F.lit("?"), base["query"])).otherwise("")

    def absolute(r: Column) -> Column:
        before = (
            F.when(r.rlike(r"^[/\\]"), "")
            .when(r.startswith("?"), base["path"])
            .when((r == "") | r.startswith("#"), F.concat(base["path"], query))
            .otherwise(F.regexp_extract(base["path"], r"^(.*/)", 1))
        )
        return F.when(r.rlike(_SCHEME), r).when(r.rlike(r"^[/\\]{2}"), F.concat(base["scheme"], F.lit(":"), r)).otherwise(F.concat(origin, before, r))

    return let(F.regexp_replace(ref, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), absolute)


def is_skipped_ref(ref: Column) -> Column:
    """References that never lead to another document or asset."""
    out = (ref == "") | ref.startswith("#")
    for p in OTHER_SCHEMES:
        out = out | ref.startswith(p)
    return out


def resolve_url(base: Column, ref: Column) -> Column:
    """Text of the URL that a reference means, null where it is no web reference."""
    r = F.trim(ref)
    return F.when(~is_skipped_ref(r), joined(base, r))


def is_tracking_param(key: Column) -> Column:
    return key.isin(*TRACKING) | key.startswith("utm_")


def query_pairs(query: Column) -> Column:
    """Form-decoded (k, v) structs; malformed escapes stay as they are."""
    plain = lambda x: F.coalesce(F.try_url_decode(x), F.translate(x, "+", " "))
    return F.transform(
        F.filter(F.split(F.coalesce(query, F.lit("")), "&"), lambda p: p != ""),
        lambda p: F.struct(plain(F.substring_index(p, "=", 1)).alias("k"), F.when(F.instr(p, "=") > 0, plain(F.substr(p, F.instr(p, "=") + 1))).otherwise("").alias("v")),
    )


def normalize_url(u: Column, kind: Column) -> Column:
    """Canonical text: no fragment; on pages, query pairs without tracking, decoded and sorted."""
    text = lambda p: F.when(p["v"] == "", p["k"]).otherwise(F.concat(p["k"], F.lit("="), p["v"]))
    kept = F.array_sort(F.filter(query_pairs(u["query"]), lambda p: ~is_tracking_param(p["k"])))
    page_query = let(kept, lambda pairs: F.when(F.size(pairs) > 0, escaped_query(F.array_join(F.transform(pairs, text), "&"))))
    port = F.when(u["port"].isNotNull(), F.concat(F.lit(":"), u["port"].cast("string"))).otherwise("")
    query = let(F.when(kind == "page", page_query).otherwise(u["query"]), lambda q: F.when(q.isNotNull(), F.concat(F.lit("?"), q)).otherwise(""))
    return F.concat(u["scheme"], F.lit("://"), u["host"], port, u["path"], query)


def infer_url_kind(u: Column) -> Column:
    """page or asset, by the path's extension (the storage rule)."""
    path = F.lower(u["path"])
    last = F.element_at(F.split(path, "/"), -1)
    asset = path.rlike(r"\.(" + "|".join(ASSET_EXTENSIONS) + ")$") | path.isin("/css", "/css2")
    page = path.rlike(r"(\.(html|htm|php)|/)$") | (path == "") | ~last.contains(".")
    return F.when(asset, "asset").when(page, "page").otherwise("asset")


def resource_type(u: Column) -> Column:
    """page, css, js, image or other, by the path's extension (the crawler's rule)."""
    path = F.lower(u["path"])
    last = F.element_at(F.split(path, "/"), -1)
    return (
        F.when(path.rlike(r"(\.(html|htm|php)|/)$") | (path == "") | ~last.contains("."), "page")
        .when(path.endswith(".css"), "css")
        .when(path.rlike(r"\.m?js$"), "js")
        .when(path.rlike(r"\.(" + "|".join(IMAGE_EXTENSIONS) + ")$"), "image")
        .otherwise("other")
    )


def classify(content_type: Column, u: Column) -> Column:
    """Type of a response by its header, else by its URL."""
    kind = F.trim(F.substring_index(content_type, ";", 1))
    return (
        F.when(kind == "text/html", "page")
        .when(kind == "text/css", "css")
        .when(kind.isin(*SCRIPT_TYPES), "js")
        .when(kind.startswith("image/"), "image")
        .when(kind.contains("font"), "other")
        .otherwise(resource_type(u))
    )


def kind_of_type(rtype: Column) -> Column:
    """page for pages, asset for all other resource types."""
    return F.when(rtype == "page", "page").otherwise("asset")


def start_problem(url: Column) -> Column:
    """Why a text can't be the start of a crawl, null where it can."""
    scheme = F.lower(F.regexp_extract(F.trim(url), r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    return F.when(url.isNull() | (scheme == ""), "no URL").when(~scheme.isin("http", "https"), "neither http nor https").when(parse_web_url(url).isNull(), "no host")


def normalize_discovered(u: Column) -> Column:
    """Canonical text of a link found on a page; its type by extension decides how."""
    return normalize_url(u, kind_of_type(resource_type(u)))


def is_rsc_request(u: Column) -> Column:
    return F.exists(query_pairs(u["query"]), lambda p: p["k"] == "_rsc") | (u["path"].contains("_next/static/chunks/") & u["path"].contains("%"))


def is_dynamic_request(u: Column) -> Column:
    path = F.lower(u["path"])
    out = is_rsc_request(u)
    for how, hint in DYNAMIC_HINTS:
        out = out | getattr(path, how)(hint)
    return out


def bare_host(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def is_same_domain(u: Column, site_host: Column) -> Column:
    """Same host but for one leading www.; port and scheme do not count."""
    return bare_host(u["host"]) == bare_host(site_host)


def is_same_site(u: Column, site_host: Column, site_port: Column) -> Column:
    """Same domain and same explicit port."""
    return is_same_domain(u, site_host) & u["port"].eqNullSafe(site_port)


def is_mirrorable_static(u: Column, site_host: Column, site_port: Column) -> Column:
    return ~is_dynamic_request(u) & (is_same_site(u, site_host, site_port) | (infer_url_kind(u) == "asset"))


def is_enqueueable_page(u: Column, site_host: Column) -> Column:
    last = F.element_at(F.split(u["path"], "/"), -1)
    return ~is_dynamic_request(u) & is_same_domain(u, site_host) & (~last.contains(".") | F.lower(u["path"]).rlike(r"\.html?$"))


def with_url(df: DataFrame, url: str, name: str) -> DataFrame:
    """Adds a parsed URL."""
    return once(df, name, parse_web_url(F.col(url)))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column behind a generator of one row. Filters on it are not pushed below, where the optimizer would repeat the
    whole expression for each use of one of its fields."""
    return df.select("*", F.explode(F.array(value)).alias(name))
