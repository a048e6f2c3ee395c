"""The Column functions as temporary SQL functions of a session, their bodies written from the same expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import content, html, paths, robots, urls

#: SQL text: strings, names in backquotes, or an operator (or a word for one) written like a function.
_TOKEN = re.compile(r"'(?:\\.|[^'\\])*'|`[^`]*`|(?<![\w.])(?:and|or|not|[<>=!+\-*/%&|~^]+)(?=\()", re.I)
_URL = "STRUCT<scheme: STRING, host: STRING, port: INT, path: STRING, query: STRING, fragment: STRING>"


def text_of(expression: Column) -> str:
    """An expression as SQL."""
    return _TOKEN.sub(lambda m: m[0] if m[0][0] in "'`" else f"`{m[0].lower()}`", expression._jc.node().sql())


def _of_url(f):
    return lambda url, *rest: urls.let(urls.parse_web_url(url), lambda u: f(u, *rest))


#: SQL name -> arguments, result, function of Columns. URLs are texts here.
FUNCTIONS = {
    "parse_web_url": ("url STRING", _URL, urls.parse_web_url),
    "resolve_web_url": ("page STRING, ref STRING", "STRING", lambda page, ref: urls.href(urls.parse_web_url(urls.resolve_url(urls.parse_web_url(page), ref)))),
    "canonical_url": ("url STRING, kind STRING", "STRING", lambda url, kind: urls.normalize_url(urls.parse_web_url(url), kind)),
    "url_kind": ("url STRING", "STRING", _of_url(urls.infer_url_kind)),
    "resource_type": ("url STRING", "STRING", _of_url(urls.resource_type)),
    "is_dynamic_request": ("url STRING", "BOOLEAN", _of_url(urls.is_dynamic_request)),
    "is_tracking_param": ("param STRING", "BOOLEAN", urls.is_tracking_param),
    "start_problem": ("url STRING", "STRING", urls.start_problem),
    "offline_path": ("url STRING", "STRING", lambda url: paths.url_to_offline_path(urls.parse_web_url(url))),
    "relative_path": ("page_path STRING, target STRING", "STRING", paths.relative_path),
    "css_refs": ("css STRING", "ARRAY<STRING>", html.css_refs),
    "local_refs": ("html STRING", "ARRAY<STRING>", html.local_refs),
    "strip_tags": ("html STRING", "STRING", html.strip_tags),
    "is_robots_allowed": ("path STRING, body STRING", "BOOLEAN", lambda path, body: robots.is_allowed(path, robots.parse_robots(body))),
    "content_hash": ("body BINARY", "STRING", content.hash_bytes),
    "format_bytes": ("n BIGINT", "STRING", content.format_bytes),
}


def register(spark: SparkSession, prefix: str = "site_") -> list[str]:
    """Registers all of them under a prefix; their names are returned."""
    names = []
    for name, (arguments, result, function) in FUNCTIONS.items():
        columns = [F.col(a.split()[0]) for a in arguments.split(", ")]
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({arguments}) RETURNS {result} RETURN {text_of(function(*columns))}")
        names.append(prefix + name)
    return names
