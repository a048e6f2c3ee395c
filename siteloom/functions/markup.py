"""Tags, attributes and style references of stored pages, found and put back in Arrow batches.

One tokenizer serves rewriting and stripping alike: it walks over tags and quoted attributes whatever their names, and tables of names
(fixed.py) say what happens to each. Links themselves are Column expressions; they come as two arrays, references and what each becomes.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import types as T

from .batches import by_texts
from .fixed import DATA_SCRIPTS, DROPPED_LINKS, LINK_ATTRIBUTES, SRCSET_ATTRIBUTES, WORKER_CALLS, WORKER_FILES

_QUOTED = r"\"[^\"]*\"|'[^']*'"
#: A quoted attribute after white space: what stands before its value, its name, the value in quotes.
_ATTRIBUTE = re.compile(rf"(\s+([^\s\"'<>/=]+))\s*=\s*({_QUOTED})")
_TAG = re.compile(rf"<([A-Za-z][^\s/>]*)((?:{_QUOTED}|[^>\"'])*)>")
#: A style sheet's reference: url() with or without quotes, or the string of an @import.
_STYLE = re.compile(rf"url\(\s*({_QUOTED}|[^\s\"')]+)\s*\)|@import\s+({_QUOTED})")


def _bare(value: str) -> str:
    return value[1:-1] if value[:1] in "\"'" and value[-1:] == value[:1] else value


def attributes(tag: str) -> dict[str, str]:
    """Quoted attributes of a tag by lower-cased name, the first of each."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(tag):
        out.setdefault(m[2].lower(), _bare(m[3]))
    return out


# ---------------------------------------------------------------- putting links in


def candidates(srcset: str) -> list[list[str]]:
    """Words of each candidate of a srcset."""
    return [c.split() for c in srcset.split(",") if c.strip()]

def with_style_links(css: str, links: dict[str, str], quote: str, imports: bool) -> str:
    def one(m: re.Match) -> str:
        link = links.get(_bare(m[1] or m[2])) if imports or m[1] else None
        return m[0] if link is None else f"url({quote}{link}{quote})"

    return _STYLE.sub(one, css)


def with_links(html: str, links: dict[str, str]) -> str:
    """Attributes whose reference has a link come out in double quotes, others as they were."""

    def one(m: re.Match) -> str:
        name, value = m[2].lower(), _bare(m[3])
        if name in LINK_ATTRIBUTES:
            new = links.get(value, value)
        elif name in SRCSET_ATTRIBUTES:
            words = candidates(value)
            new = ", ".join(" ".join([links.get(c[0], c[0]), *c[1:]]) for c in words) if any(c[0] in links for c in words) else value
        elif name == "style":
            new = with_style_links(value, links, "", False)
        else:
            return m[0]
        return m[0] if new == value else f'{m[1]}="{new}"'

    return _ATTRIBUTE.sub(one, html)


# ---------------------------------------------------------------- stripping


def _scripts(html: str, keep: Callable[[dict[str, str], str], bool]) -> str:
    """Without the script elements that keep(attributes, body) is false for."""
    out, at, low = [], 0, html.lower()
    while True:
        begin = low.find("<script", at)
        m = _TAG.match(html, begin) if begin >= 0 else None
        if begin < 0:
            break
        end = low.find("</script>", m.end()) if m and m[1].lower() == "script" else -1
        if end < 0:
            out.append(html[at : begin + 1])
            at = begin + 1
            continue
        whole = end + len("</script>")
        out.append(html[at:whole] if keep(attributes(m[2]), html[m.end() : end]) else html[at:begin])
        at = whole
    return "".join([*out, html[at:]])


def _serves_offline(given: dict[str, str], body: str) -> bool:
    """Whether a script neither is nor starts a service worker."""
    source = given.get("src", "").lower()
    return not (any(w in source for w in WORKER_FILES) and not body.strip()) and not any(w in body for w in WORKER_CALLS)


def _breaks_offline(m: re.Match) -> bool:
    name, given = m[1].lower(), attributes(m[2])
    if name == "link":
        rel = given.get("rel", "").lower()
        return rel in DROPPED_LINKS and (rel != "preload" or given.get("as", "").lower() == "script")
    return name == "meta" and given.get("http-equiv", "").lower() == "refresh" and "content" in given


def stripped(html: str) -> str:
    """Without service workers, manifests, script preloads, refreshes and crossorigin marks (these wherever they stand)."""
    html = _TAG.sub(lambda m: "" if _breaks_offline(m) else m[0], _scripts(html, _serves_offline))
    out, low, at = [], html.lower(), 0
    while (found := low.find("crossorigin", at)) >= 0:
        before = len(html[at:found].rstrip()) + at
        m = re.compile(rf"\s*=\s*(?:{_QUOTED})").match(html, found + 11)
        end = m.end() if m else found + 11
        out.append(html[at:end] if before == found else html[at:before])  # it must follow white space
        at = end
    return "".join([*out, html[at:]])


def without_scripts(html: str) -> str:
    """Without scripts but those that hold data."""
    return _scripts(html, lambda given, body: given.get("type", "").lower() in DATA_SCRIPTS)


def without_base(html: str) -> str:
    return _TAG.sub(lambda m: "" if m[1].lower() == "base" else m[0], html)


# ---------------------------------------------------------------- columns


def _links(refs, links) -> dict[str, str]:
    return {r: x for r, x in zip(refs, links) if x is not None} if refs is not None else {}


@by_texts(T.StringType())
def linked(html, refs, links):
    """A page with links put in."""
    return None if html is None else with_links(html, _links(refs, links))


@by_texts(T.StringType())
def finished(html, refs, links):
    """A page for offline reading: links put in, the base element gone (where anything may be linked), and stripped."""
    if html is None:
        return None
    marks = ("href=", "src=", "srcset=", "data-src", "style=")
    return stripped(without_base(with_links(html, _links(refs, links))) if any(m in html for m in marks) else html)


@by_texts(T.StringType())
def sheet_linked(css, refs, links):
    return None if css is None else with_style_links(css, _links(refs, links), '"', True)


@by_texts(T.StringType())
def strip_breakers(html):
    return None if html is None else stripped(html)


@by_texts(T.StringType())
def strip_scripts(html):
    return None if html is None else without_scripts(html)
