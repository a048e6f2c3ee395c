"""Offline paths of URLs, and relative paths between them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls
from .fixed import UNSAFE


def host_label(u: Column) -> Column:
    """host, with its port where that is explicit and neither 80 nor 443."""
    return F.when(u["port"].isNotNull() & ~u["port"].isin(80, 443), F.concat(u["host"], F.lit(":"), u["port"].cast("string"))).otherwise(u["host"])


def sanitize_component(s: Column) -> Column:
    return F.translate(s, UNSAFE, "_" * len(UNSAFE))


def safe_segment(s: Column) -> Column:
    return F.when(s.isin("", ".", ".."), "_").otherwise(sanitize_component(s))


def host_prefix(u: Column, site_host: Column, site_port: Column) -> Column:
    """Folder of another site's files; null on the site itself."""
    return F.when(~urls.is_same_site(u, site_host, site_port), F.concat(F.lit("_external/"), safe_segment(urls.bare_host(host_label(u)))))


def query_suffix(query: Column, kind: Column) -> Column:
    """What a query adds to a file name; long ones of assets (over 48 bytes) are hashed."""
    long = (kind == "asset") & (F.octet_length(query) > 48)
    mark = F.when(long, F.substring(F.sha2(query, 256), 1, 16)).otherwise(sanitize_component(query))
    return F.when(F.coalesce(query, F.lit("")) == "", "").otherwise(F.concat(F.lit("@"), mark))


def url_to_offline_path_with(u: Column, site_host: Column, site_port: Column, kind: Column) -> Column:
    """Where a URL is stored below the output folder."""
    parts = F.filter(F.split(u["path"], "/"), lambda x: x != "")

    def named(x: Column) -> Column:
        parts, suffix, safe = x["parts"], x["suffix"], x["safe"]
        folders = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), safe_segment)
        stem = F.regexp_extract(safe, r"(?s)^(.*)\.[^.]*$", 1)
        file = F.when(suffix == "", safe).when(safe.contains("."), F.concat(stem, suffix, F.substr(safe, F.length(stem) + 1))).otherwise(F.concat(safe, suffix))
        as_page = u["path"].endswith("/") | ~F.element_at(parts, -1).contains(".")
        names = F.when(as_page, F.array(F.concat(safe, suffix), F.lit("index.html"))).otherwise(F.array(file))
        return F.when(F.size(parts) == 0, F.when(suffix == "", "index.html").otherwise(F.concat(suffix, F.lit("/index.html")))).otherwise(F.array_join(F.concat(folders, names), "/"))

    inside = urls.let(F.struct(parts.alias("parts"), query_suffix(u["query"], kind).alias("suffix"), safe_segment(F.try_element_at(parts, F.lit(-1))).alias("safe")), named)
    return F.concat_ws("/", host_prefix(u, site_host, site_port), inside)


def url_to_offline_path(u: Column) -> Column:
    """The path on the URL's own site, its kind inferred."""
    return url_to_offline_path_with(u, u["host"], u["port"], urls.infer_url_kind(u))


def clean_path(path: Column) -> Column:
    """Without empty and '.' parts; '..' takes the part before it away. A leading slash stays."""
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    done = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, x: F.when((x == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == "..", acc).otherwise(F.array_append(acc, x)),
    )
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(done, "/"))


def is_under_output(path: Column, root: Column) -> Column:
    """Whether a path, '..' resolved, lies in the root folder."""
    p, r = clean_path(path), clean_path(root)
    return (p == r) | p.startswith(F.concat(F.when(r == "/", "").otherwise(r), F.lit("/"))) | ((r == "") & ~p.startswith("/"))


def url_to_path_with(root: Column, u: Column, site_host: Column, site_port: Column, kind: Column) -> Column:
    """The file below root; '.' and '..' never leave it."""
    parts = F.filter(F.split(url_to_offline_path_with(u, site_host, site_port, kind), "/"), lambda x: ~x.isin("", ".", ".."))
    return F.concat_ws("/", F.rtrim(root, F.lit("/")), F.array_join(parts, "/"))


def url_to_path_of_type(root: Column, u: Column, site_host: Column, site_port: Column, rtype: Column) -> Column:
    """The file below root of a resource whose type is known."""
    return url_to_path_with(root, u, site_host, site_port, urls.kind_of_type(rtype))


def expected_offline_path(u: Column, site_host: Column, site_port: Column) -> Column:
    """Where a link's target should be stored, its kind inferred."""
    return url_to_offline_path_with(u, site_host, site_port, urls.infer_url_kind(u))


def split_fragment(ref: Column) -> Column:
    """struct(path, fragment), the fragment with its sign, null where there is none."""
    at = F.instr(ref, "#")
    return F.struct(F.when(at > 0, F.substr(ref, F.lit(1), at - 1)).otherwise(ref).alias("path"), F.when(at > 0, F.substr(ref, at)).alias("fragment"))


def relative_path(page_path: Column, target: Column) -> Column:
    """The link from a page's folder to a target path."""
    folder = F.filter(F.split(F.regexp_extract(page_path, r"(?s)^(.*)/[^/]*$", 1), "/"), lambda x: x != "")
    parts = F.filter(F.split(target, "/"), lambda x: x != "")

    def linked(x: Column) -> Column:
        same = F.aggregate(
            F.zip_with(x["folder"], x["parts"], lambda a, b: F.coalesce(a == b, F.lit(False))),
            F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
            lambda acc, y: F.struct((acc["n"] + F.when(acc["on"] & y, 1).otherwise(0)).alias("n"), (acc["on"] & y).alias("on")),
        )["n"]
        rest = lambda n: F.concat(F.repeat(F.lit("../"), F.size(x["folder"]) - n), F.array_join(F.slice(x["parts"], n + 1, F.greatest(F.size(x["parts"]) - n, F.lit(0))), "/"))
        return urls.let(same, rest)

    return urls.let(urls.let(F.struct(folder.alias("folder"), parts.alias("parts")), linked), lambda link: F.when(link == "", ".").otherwise(link))


def is_spa_document_url(asset: Column, page: Column, final: Column) -> Column:
    """Whether a captured request is the page's own document."""
    canonical = lambda u: urls.normalize_url(u, F.lit("page"))
    return (canonical(asset) == canonical(page)) | F.coalesce(canonical(asset) == canonical(final), F.lit(False))


def resolve_ref(folder: Column, ref: Column) -> Column:
    """A reference seen from a folder, '.' and '..' resolved; a rooted one stays rooted."""
    return clean_path(F.when(ref.startswith("/"), ref).otherwise(F.concat_ws("/", folder, ref)))
