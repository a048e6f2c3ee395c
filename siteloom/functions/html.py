"""Links, assets and text of HTML and CSS.

The native functions use patterns, with scripts, styles and comments taken out first; elements() is a full tokenizer in
Arrow batches for what patterns can't say (entities in attributes, odd quoting, first of repeated attributes).
"""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import urls
from .batches import by_texts
from .fixed import ASSET_ATTRIBUTES, DYNAMIC_TYPES, LINK_ATTRIBUTES, SPA_MARKERS, SPA_ROOTS, SRCSET_ATTRIBUTES, STATIC_TYPES

_QUOTED = r"\"[^\"]*\"|'[^']*'"
#: Where references stand in texts; the first group holds one, with its quotes if it has any.
_STYLE_URL = rf"url\(\s*({_QUOTED}|[^\s\"')]+)\s*\)"
_STYLE_IMPORT = rf"@import\s+({_QUOTED})"
_LOCAL = rf"(?i)(?:{'|'.join(LINK_ATTRIBUTES)})\s*=\s*({_QUOTED})"


def matches(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _unquoted(found: Column) -> Column:
    """References without their quotes and the white space around them; empty ones go."""
    return F.filter(F.transform(found, lambda r: F.trim(F.regexp_replace(r, r"^[\"']|[\"']$", ""))), lambda r: r != "")


# ---------------------------------------------------------------- native


def unescaped(s: Column) -> Column:
    """The entities that URLs in attributes use."""
    for entity, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(entity), F.lit(c))
    return s


def anchor_hrefs(html: Column) -> Column:
    """href of a elements, then of area elements, in order, repeats kept."""
    clean = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", "")
    of = lambda tag: F.transform(matches(clean, rf"(?is)<{tag}\s(?:[^>]*?\s)?href\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"), lambda v: unescaped(F.regexp_replace(v, r"(?s)^([\"'])(.*)\1$", "$2")))
    return F.concat(of("a"), of("area"))


def _inner(quoted: Column) -> Column:
    return F.when(quoted.rlike("^[\"']"), F.substr(quoted, F.lit(2), F.length(quoted) - 2)).otherwise(quoted)


def attribute_references(html: Column) -> Column:
    """Quoted values of link attributes, then the candidates of srcsets, as they stand."""
    of = lambda names: F.transform(matches(html, rf"(?i)\s(?:{'|'.join(names)})\s*=\s*({_QUOTED})"), _inner)
    return F.concat(of(LINK_ATTRIBUTES), F.flatten(F.transform(of(SRCSET_ATTRIBUTES), srcset_urls)))


def style_references(text: Column, imports: bool) -> Column:
    """References of url() but data:, and of @import where asked for, as they stand."""
    of = lambda pattern: F.filter(F.transform(matches(text, pattern), _inner), lambda x: ~x.startswith("data:"))
    return F.concat(of(_STYLE_URL), of(_STYLE_IMPORT)) if imports else of(_STYLE_URL)


def base_href(html: Column) -> Column:
    """The quoted href of the first base element that has one; null where there is none."""
    tags = F.transform(matches(html, r"(?i)<base(\s[^>]*)>"), lambda t: F.regexp_extract(t, rf"(?i)\shref\s*=\s*({_QUOTED})", 1))
    return F.get(_unquoted(tags), F.lit(0))


def srcset_urls(srcset: Column) -> Column:
    """First word of each candidate."""
    return F.filter(F.transform(F.split(srcset, ","), lambda c: F.get(F.split(F.trim(c), r"\s+"), F.lit(0))), lambda x: x != "")


def css_refs(css: Column) -> Column:
    """References of a style sheet: url() but data:, then @import strings."""
    return F.concat(F.filter(_unquoted(matches(css, _STYLE_URL)), lambda x: ~x.startswith("data:")), _unquoted(matches(css, _STYLE_IMPORT)))


def style_text(html: Column) -> Column:
    return F.array_join(matches(html, r"(?is)<style\b[^>]*>(.*?)</style>"), "\n")


def local_refs(html: Column) -> Column:
    """Distinct local references of a stored file, as the closure check reads them."""
    found = F.concat(_unquoted(matches(html, _LOCAL)), _unquoted(matches(html, _STYLE_URL)))
    skipped = r"^(#|data:|javascript:|mailto:|tel:|http://|https://|//)"
    kept = F.filter(found, lambda r: ~r.rlike(skipped))
    cut = F.transform(kept, lambda r: F.translate(F.substring_index(r, "#", 1), "\\", "/"))
    return F.array_distinct(F.filter(cut, lambda r: r != ""))


def strip_tags(html: Column) -> Column:
    return F.replace(F.regexp_replace(html, r"<[^>]*>?", ""), F.lit(">"), F.lit(""))


def body_text(html: Column) -> Column:
    """Text of the body element, scripts' and styles' included; native, entities stay."""
    body = F.regexp_extract(html, r"(?is)<body\b[^>]*>(.*?)(?:</body>|$)", 1)
    return F.regexp_replace(F.regexp_replace(body, r"(?s)<!--.*?-->|<[^>]*>", ""), r"^\s+|\s+$", "")


def spa_signals(html: Column) -> Column:
    """struct(markers, modules, scripts, root, text_bytes) of the page-built-by-script test."""
    low = F.lower(html)
    markers = F.filter(F.array(*map(F.lit, SPA_MARKERS)), lambda m: low.contains(m))
    root = F.lit(False)
    for r in SPA_ROOTS:
        root = root | low.contains(f'id="{r}"') | low.contains(f"id='{r}'")
    return F.struct(
        markers.alias("markers"),
        F.regexp_count(low, F.lit(r"type=(\"module\"|'module')")).cast("long").alias("modules"),
        F.regexp_count(low, F.lit("<script")).cast("long").alias("scripts"),
        root.alias("root"),
        F.octet_length(body_text(html)).cast("long").alias("text_bytes"),
    )


def is_spa(s: Column) -> Column:
    """Decision from spa_signals()."""
    return (F.size(s["markers"]) > 0) | (s["root"] & (s["modules"] >= 1) & (s["text_bytes"] < 500)) | ((s["scripts"] >= 3) & (s["text_bytes"] < 200) & (s["modules"] >= 1))


def looks_like_spa(html: Column) -> Column:
    """The renderer's older test: a mount point, a script and under 200 characters of text."""
    low = F.lower(html)
    mount = low.rlike("id=(\"(app|root|__nuxt)\"|'(app|root)')|data-v-app")
    return mount & low.contains("<script") & (F.length(F.regexp_replace(strip_tags(html), r"\s", "")) < 200)


def is_static_type(t: Column) -> Column:
    return t.isin(*STATIC_TYPES)


def is_dynamic_type(t: Column) -> Column:
    return t.isin(*DYNAMIC_TYPES)


def should_capture(u: Column, rtype: Column, site_host: Column, site_port: Column) -> Column:
    """Whether a request that the browser made is a file of the site."""
    own = F.when(rtype == "Document", urls.is_same_domain(u, site_host)).otherwise(urls.is_mirrorable_static(u, site_host, site_port))
    return ~is_dynamic_type(rtype) & is_static_type(rtype) & ~urls.is_dynamic_request(u) & own


# ---------------------------------------------------------------- tokenizer


class _Elements(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.text, self.in_body = [], [], False

    def handle_starttag(self, tag, attrs):
        self.in_body = self.in_body or tag == "body"
        first: dict[str, str] = {}
        for k, v in attrs:
            first.setdefault(k, v or "")
        if first:
            self.found.append({"tag": tag, "attrs": first, "pos": len(self.found)})

    handle_startendtag = handle_starttag

    def handle_data(self, data):
        if self.in_body:
            self.text.append(data)


_TOKENS = T.StructType().add("elements", T.ArrayType(T.StructType().add("tag", "string").add("attrs", T.MapType(T.StringType(), T.StringType())).add("pos", T.IntegerType()))).add("text", "string")


@by_texts(_TOKENS)
def _tokenized(html):
    p = _Elements()
    p.feed(html or "")
    p.close()
    return {"elements": [x | {"attrs": list(x["attrs"].items())} for x in p.found], "text": "".join(p.text).strip()}


def tokenized(html: Column) -> Column:
    """struct(elements array<struct<tag, attrs, pos>>, text); for inputs that patterns misread."""
    return _tokenized(html)


def asset_refs(pages: DataFrame, elements: str = "elements") -> DataFrame:
    """Adds seq, ref: references to assets, by kind of element first and in document order within, repeats kept."""
    e = F.col(elements)

    def plain(k: int, tag: str, attr: str) -> Column:
        image = lambda x: F.lower(x["attrs"]["type"]) == "image" if tag == "input" else F.lit(True)
        mine = F.filter(e, lambda x: (x["tag"] == tag) & x["attrs"][attr].isNotNull() & image(x))
        return F.transform(mine, lambda x: F.struct(F.lit(k).alias("kind"), x["attrs"][attr].alias("ref")))

    def sets(k: int, tag: str, need: str) -> Column:
        # elements that have the attribute asked for, of which srcset is read in any case
        mine = F.filter(e, lambda x: (x["tag"] == tag) & x["attrs"][need].isNotNull())
        refs = F.flatten(F.transform(mine, lambda x: srcset_urls(F.coalesce(x["attrs"]["srcset"], F.lit("")))))
        return F.transform(refs, lambda r: F.struct(F.lit(k).alias("kind"), r.alias("ref")))

    kinds = [plain(k, tag, attr) for k, (tag, attr) in enumerate(ASSET_ATTRIBUTES)]
    kinds += [sets(len(kinds) + k, tag, need) for k, (tag, need) in enumerate((("img", "srcset"), ("source", "srcset"), ("img", "data-srcset"), ("source", "data-srcset")))]
    return pages.select("*", F.posexplode(F.concat(*kinds)).alias("seq", "_a")).select("*", F.col("_a.ref").alias("ref")).drop("_a")


def link_refs(elements: Column) -> Column:
    """href of a elements, then of area elements."""
    of = lambda tag: F.transform(F.filter(elements, lambda x: (x["tag"] == tag) & x["attrs"]["href"].isNotNull()), lambda x: x["attrs"]["href"])
    return F.concat(of("a"), of("area"))


def first_base(elements: Column) -> Column:
    """href of the first base element that has one."""
    return F.get(F.filter(elements, lambda x: (x["tag"] == "base") & x["attrs"]["href"].isNotNull()), F.lit(0))["attrs"]["href"]
