"""DuckDB SQL for the queries over pages, written from the definitions and not from the Spark code."""

from __future__ import annotations

from .pages import ROBOTS

_TRACK = "'_rsc','ref','utm_source','utm_medium','utm_campaign','utm_term','utm_content','gclid','fbclid','msclkid','mc_cid','mc_eid'"


def _tracking(k: str) -> str:
    return f"({k} IN ({_TRACK}) OR starts_with({k}, 'utm_'))"


def _safe(s: str) -> str:
    return f"""CASE WHEN {s} IN ('', '.', '..') THEN '_' ELSE translate({s}, '/\\:*?"<>|', '_________') END"""


def _suffix(query: str, kind: str) -> str:
    return f"""CASE WHEN coalesce({query}, '') = '' THEN '' WHEN {kind} = 'asset' AND strlen({query}) > 48 THEN '@' || substr(sha256({query}), 1, 16) ELSE '@' || translate({query}, '/\\:*?"<>|', '_________') END"""


def _kind(path: str) -> str:
    p = f"lower({path})"
    return f"""CASE WHEN regexp_matches({p}, '[.](css|js|mjs|woff|woff2|ttf|otf|png|jpg|jpeg|gif|svg|webp|ico|avif|mp4|webm)$') OR {p} IN ('/css', '/css2') THEN 'asset'
      WHEN regexp_matches({p}, '[.](html|htm|php)$') OR {p} LIKE '%/' OR NOT contains(string_split({p}, '/')[-1], '.') THEN 'page' ELSE 'asset' END"""


def _rtype(path: str) -> str:
    p = f"lower({path})"
    return f"""CASE WHEN regexp_matches({p}, '[.](html|htm|php)$') OR {p} LIKE '%/' OR NOT contains(string_split({p}, '/')[-1], '.') THEN 'page' WHEN {p} LIKE '%.css' THEN 'css'
      WHEN regexp_matches({p}, '[.]m?js$') THEN 'js' WHEN regexp_matches({p}, '[.](png|jpg|jpeg|gif|svg|webp|ico|avif)$') THEN 'image' ELSE 'other' END"""


def _offline(path: str, query: str, kind: str) -> str:
    """Path within the site's folder."""
    segs, sfx = f"list_filter(string_split({path}, '/'), lambda x: x <> '')", _suffix(query, kind)
    last = _safe(f"{segs}[-1]")
    heads = f"list_transform({segs}[:-2], lambda x: {_safe('x')})"
    tail = f"""CASE WHEN {path} LIKE '%/' OR NOT contains({segs}[-1], '.') THEN ({last}) || ({sfx}) || '/index.html'
      ELSE regexp_replace(({last}), '[.][^.]*$', '') || ({sfx}) || regexp_extract(({last}), '[.][^.]*$') END"""
    return f"""CASE WHEN len({segs}) = 0 THEN CASE WHEN ({sfx}) = '' THEN 'index.html' ELSE ({sfx}) || '/index.html' END
      ELSE array_to_string({heads}, '/') || CASE WHEN len({segs}) > 1 THEN '/' ELSE '' END || ({tail}) END"""


def _canonical(scheme: str, host: str, path: str, query: str) -> str:
    plain = lambda x: f"url_decode(replace({x}, '+', ' '))"
    k, v = plain("split_part(p, '=', 1)"), plain("CASE WHEN contains(p, '=') THEN substr(p, instr(p, '=') + 1) ELSE '' END")
    pairs = f"list_sort(list_filter(list_transform(list_filter(string_split(coalesce({query}, ''), '&'), lambda p: p <> ''), lambda p: {{'k': {k}, 'v': {v}}}), lambda q: NOT {_tracking('q.k')}))"
    text = f"array_to_string(list_transform({pairs}, lambda q: CASE WHEN q.v = '' THEN q.k ELSE q.k || '=' || q.v END), '&')"
    return f"({scheme} || '://' || {host} || {path} || CASE WHEN len({pairs}) > 0 THEN '?' || ({text}) ELSE '' END)"


def _bare(h: str) -> str:
    return f"regexp_replace({h}, '^www[.]', '')"


PAGES = f"""
pg AS (SELECT page_id, url, html, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS host,
  regexp_extract(url, '^[A-Za-z]+://[^/?#]*(/[^?#]*)', 1) AS path, nullif(regexp_extract(url, '[?]([^#]*)', 1), '') AS query, nullif(regexp_extract(url, '#(.*)$', 1), '') AS fragment FROM pages),
canon AS (SELECT *, {_canonical('scheme', 'host', 'path', 'query')} AS canonical_url, {_offline('path', 'query', _kind('path'))} AS opath FROM pg)
"""
LINKS = (
    PAGES
    + r""",
href0 AS (SELECT page_id, url, scheme, host, path, query, canonical_url, opath, regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>', '', 'g'), '<a href="([^"]*)"', 1) AS hs FROM canon),
href1 AS (SELECT *, unnest(range(len(hs))) AS pos FROM href0),
lk AS (SELECT page_id, scheme, host, path AS ppath, canonical_url, opath, pos, hs[pos + 1] AS href,
  array_to_string(list_transform(string_split(hs[pos + 1], ''), lambda c: CASE WHEN regexp_matches(c, '[!$-;=@-_a-z|~]') THEN c ELSE url_encode(c) END), '') AS lpath FROM href1 WHERE starts_with(hs[pos + 1], '/'))
"""
)
_RESOLVED = "scheme || '://' || host || lpath"
_ENQ = "(NOT contains(string_split(lpath, '/')[-1], '.') OR regexp_matches(lower(lpath), '[.]html?$')) AND NOT ({dyn})"
_DYN = "starts_with(lower(lpath), '/api/') OR starts_with(lower(lpath), '/cdn-cgi/') OR contains(lower(lpath), '/__cf_') OR lower(lpath) LIKE '%/rum' OR contains(lower(lpath), 'cloudflareinsights') OR (contains(lpath, '_next/static/chunks/') AND contains(lpath, '%'))"
_ENQ = _ENQ.format(dyn=_DYN)
_KIND = _kind("lpath")
_TARGET = _offline("lpath", "NULL::VARCHAR", _KIND)
# folders of the page, parts of the target, and how many they share
_REL = f"""
rel AS (SELECT *, ({_TARGET}) AS target FROM lk),
rel1 AS (SELECT *, string_split(opath, '/')[:-2] AS d, string_split(target, '/') AS t FROM rel),
rel2 AS (SELECT *, len(list_filter(range(1, least(len(d), len(t)) + 1), lambda i: d[:i] = t[:i])) AS c FROM rel1),
rel3 AS (SELECT *, CASE WHEN repeat('../', len(d) - c) || array_to_string(t[c + 1:], '/') = '' THEN '.' ELSE repeat('../', len(d) - c) || array_to_string(t[c + 1:], '/') END AS relative FROM rel2)
"""
#: Pages rewritten for offline reading: every <a href> put back with its new link; nothing else in them changes.
_REWRITTEN = f"""{LINKS}, {_REL},
newlink AS (SELECT page_id, pos, href, CASE WHEN ({_DYN}) OR relative = href OR relative = '.' OR relative = opath THEN href ELSE relative END AS nl FROM rel3),
newlinks AS (SELECT page_id, list(nl ORDER BY pos) AS nls FROM newlink GROUP BY page_id),
rew AS (SELECT c.page_id, c.canonical_url, c.url, c.opath, html AS old, string_split_regex(html, '<a href="[^"]*"') AS ps, nls FROM canon c LEFT JOIN newlinks USING (page_id)),
newpage AS (SELECT page_id, canonical_url, url, opath, array_to_string(list_transform(range(1, len(ps) + 1), lambda i: CASE WHEN i = 1 THEN '' ELSE '<a href="' || nls[i - 1] || '"' END || ps[i]), '') AS text FROM rew)
"""
_LOCAL = r"""list_distinct(list_filter(list_transform(list_filter(list_transform(
  list_concat(regexp_extract_all({t}, '(?i)(?:href|src|action|poster|data-src|data-lazy-src)\s*=\s*["'']([^"'']+)["'']', 1), regexp_extract_all({t}, 'url\(\s*[''"]?([^''")]+)[''"]?\s*\)', 1)),
  lambda r: trim(r)), lambda r: r <> '' AND NOT regexp_matches(r, '^(#|data:|javascript:|mailto:|tel:|http://|https://|//)')), lambda r: replace(split_part(r, '#', 1), '\', '/')), lambda r: r <> ''))"""
_KNOWN = """
known0 AS (SELECT page_id, canonical_url, opath AS path, strlen(html) AS size, 'sha256:' || sha256(html) || CASE WHEN page_id % 3 = 0 THEN 'x' ELSE '' END AS hash, CASE WHEN page_id % 5 = 0 THEN 'v' || page_id END AS etag,
  row_number() OVER (PARTITION BY canonical_url ORDER BY page_id DESC) AS rn FROM canon WHERE page_id % 2 = 0),
known AS (SELECT * FROM known0 WHERE rn = 1)
"""


def _rules() -> str:
    """The literal rules that hold for all agents, longest first; allow wins ties."""
    rules, on = [], False
    for line in ROBOTS.splitlines():
        key, _, value = line.partition(":")
        if key == "User-agent":
            on = value.strip() == "*"
        elif on and value.strip() and key in ("Allow", "Disallow"):
            rules.append((value.strip(), key == "Allow"))
    return ", ".join(f"('{r}', {str(a).lower()})" for r, a in rules)


def _bfs(second: int) -> str:
    return f"""WITH RECURSIVE e AS (SELECT page_id AS a, unnest([(2 * page_id + 1) % c, ({second} * page_id + 2) % c]) AS b, c FROM pages, (SELECT count(*) AS c FROM pages)),
r(id, depth) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION SELECT e.b, r.depth + 1 FROM r JOIN e ON e.a = r.id WHERE r.depth < c)
SELECT 'https://site.example/p' || id AS canonical_url, min(depth) AS depth FROM r GROUP BY id"""


_SIZES = "count(*) FILTER (NOT failed AND rtype = '{}')"
SQL = {
    "url_components": f"WITH {PAGES} SELECT page_id, scheme, host, CAST(NULL AS INTEGER) AS port, path, query, fragment, host AS label FROM pg",
    "canonical_url": f"WITH {PAGES} SELECT page_id, url, canonical_url, opath AS path FROM canon",
    "canonical_groups": f"WITH {PAGES} SELECT canonical_url, count(*) AS n, min(page_id) AS first_page FROM canon GROUP BY 1",
    "tracking_params": f"WITH {PAGES}, k AS (SELECT split_part(unnest(string_split(query, '&')), '=', 1) AS param FROM pg WHERE query IS NOT NULL) SELECT param, {_tracking('param')} AS tracking, count(*) AS n FROM k GROUP BY ALL",
    "offline_path": f"WITH {PAGES}, x AS (SELECT page_id, host, opath, ({_offline('path', 'query', chr(39) + 'page' + chr(39))}) AS pp FROM canon) SELECT page_id, opath AS own_path, '_external/' || {_bare('host')} || '/' || pp AS external_path, '/out/site/' || pp AS file FROM x",
    "path_collisions": f"WITH {PAGES} SELECT host AS site, opath AS path, count(*) AS n, string_agg(url, ',' ORDER BY url) AS urls FROM canon GROUP BY 1, 2",
    "page_links": f"WITH {LINKS} SELECT page_id, pos, href, {_RESOLVED} AS resolved FROM lk",
    "link_kinds": f"WITH {LINKS} SELECT DISTINCT {_RESOLVED} AS resolved, {_KIND} AS kind, {_rtype('lpath')} AS rtype, ({_DYN}) AS dynamic, true AS same_domain, NOT ({_DYN}) AS mirrorable, ({_ENQ}) AS enqueueable FROM lk",
    "kind_counts": f"WITH {LINKS} SELECT {_bare('host')} AS site, {_rtype('lpath')} AS rtype, count(*) AS n FROM lk GROUP BY ALL",
    "outlinks": f"WITH {LINKS} SELECT page_id, count(*) AS n, string_agg({_RESOLVED}, ' ' ORDER BY pos) AS outlinks FROM lk WHERE {_ENQ} GROUP BY 1",
    "link_degrees": f"WITH {LINKS}, e AS (SELECT canonical_url AS src, {_RESOLVED} AS dst FROM lk WHERE {_ENQ}), b AS (SELECT src AS url, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) SELECT url, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM b GROUP BY 1",
    "frontier_new": f"WITH {LINKS}, f AS (SELECT {_RESOLVED} AS canonical_url, page_id, pos, row_number() OVER (PARTITION BY {_RESOLVED} ORDER BY page_id, pos) AS rn FROM lk WHERE {_ENQ}) SELECT canonical_url, page_id, pos FROM f WHERE rn = 1 AND canonical_url NOT IN (SELECT canonical_url FROM canon)",
    "frontier_limited": f"WITH {LINKS}, f AS (SELECT {_RESOLVED} AS canonical_url, page_id, pos, row_number() OVER (PARTITION BY {_RESOLVED} ORDER BY page_id, pos) AS rn FROM lk WHERE {_ENQ}) SELECT canonical_url, page_id, pos FROM f WHERE rn = 1 AND canonical_url NOT IN (SELECT canonical_url FROM canon) ORDER BY page_id, pos LIMIT 100",
    "relative_links": f"WITH {LINKS}, {_REL} SELECT page_id, pos, opath AS from_path, target, relative FROM rel3",
    "rewritten_attrs": f"WITH {_REWRITTEN} SELECT page_id, sha256(text) AS sha256, length(text) AS n_chars FROM newpage",
    "stripped_html": r"""SELECT page_id, '<img src="a">' || regexp_replace(html, '\s+crossorigin(\s*=\s*["''][^"'']*["''])?', '', 'gi') AS stripped FROM pages""",
    "scripts_stripped": r"""SELECT page_id, '<script type="application/ld+json">{"a":1}</script>' || regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>', '', 'g') AS stripped FROM pages""",
    "spa_signals": r"""WITH m AS (SELECT page_id, lower(html) AS l, regexp_replace(regexp_replace(regexp_extract(html, '(?is)<body\b[^>]*>(.*?)(</body>|$)', 1), '(?s)<!--.*?-->|<[^>]*>', '', 'g'), '^\s+|\s+$', '', 'g') AS b FROM pages),
s AS (SELECT page_id, list_filter(['__next_data__','__next_f','__nuxt__','ng-version','data-reactroot','data-react-root','data-server-rendered','vite-plugin-pwa','registersw','data-v-app'], lambda x: contains(l, x)) AS ms,
  CAST(len(regexp_extract_all(l, 'type=("module"|''module'')')) AS BIGINT) AS modules, CAST(len(regexp_extract_all(l, '<script')) AS BIGINT) AS scripts, regexp_matches(l, 'id=("(root|app|__next|__nuxt|q-app|__vue)"|''(root|app|__next|__nuxt|q-app|__vue)'')') AS root, strlen(b) AS text_bytes FROM m)
SELECT page_id, array_to_string(ms, ',') AS markers, modules, scripts, root, text_bytes, len(ms) > 0 OR (root AND modules >= 1 AND text_bytes < 500) OR (scripts >= 3 AND text_bytes < 200 AND modules >= 1) AS spa FROM s""",
    "visible_text_len": r"""SELECT page_id, strlen(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<body\b[^>]*>(.*?)(</body>|$)', 1), '(?s)<!--.*?-->|<[^>]*>', '', 'g'), '^\s+|\s+$', '', 'g')) AS body_bytes,
  length(replace(regexp_replace(html, '<[^>]*>?', '', 'g'), '>', '')) AS stripped_chars FROM pages""",
    "css_refs": r"""WITH c AS (SELECT page_id, '@import ''base.css'';p{background:url( "/i/a.png" )}i{src:url(data:x)}' || array_to_string(regexp_extract_all(html, '(?is)<style\b[^>]*>(.*?)</style>', 1), chr(10)) AS css FROM pages),
r AS (SELECT page_id, list_concat(list_filter(list_transform(regexp_extract_all(css, 'url\(\s*[''"]?([^''")]+)[''"]?\s*\)', 1), lambda x: trim(x)), lambda x: NOT starts_with(x, 'data:')), regexp_extract_all(css, '@import\s+[''"]([^''"]+)[''"]', 1)) AS rs FROM c)
SELECT page_id, i AS pos, rs[i + 1] AS ref FROM (SELECT page_id, rs, unnest(range(len(rs))) AS i FROM r)""",
    "local_refs": f"SELECT page_id, unnest({_LOCAL.format(t='html')}) AS ref FROM pages",
    "closure_missing": f"""WITH {_REWRITTEN}, f AS (SELECT page_id, page_id || '/' || opath AS path, unnest({_LOCAL.format(t='text')}) AS ref FROM newpage WHERE regexp_matches(opath, '[.](html|htm|css)$')),
g AS (SELECT path, ref, string_split(path, '/')[:-2] AS d, len(regexp_extract_all(ref, '[.][.]/')) AS up FROM f WHERE NOT starts_with(ref, '/'))
SELECT path, ref FROM g WHERE len(d) >= up AND array_to_string(list_concat(d[:len(d) - up], [regexp_replace(ref, '^([.][.]/)*', '')]), '/') NOT IN (SELECT page_id || '/' || opath FROM newpage)""",
    "closure_escaped": f"WITH {PAGES}, f AS (SELECT page_id || '/' || opath AS path, unnest({_LOCAL.format(t='html')}) AS ref FROM canon WHERE regexp_matches(opath, '[.](html|htm|css)$')) SELECT path, ref FROM f WHERE starts_with(ref, '/')",
    "manifest_rows": f"WITH {_REWRITTEN} SELECT canonical_url, opath AS path, strlen(text) AS size, 'sha256:' || sha256(text) AS hash, 'page' AS rtype, nullif(url, canonical_url) AS original_url FROM newpage",
    "incremental_actions": f"""WITH {PAGES}, {_KNOWN}, f AS (SELECT opath AS path, 'sha256:' || sha256(arg_max(html, page_id)) AS h FROM canon WHERE page_id % 7 <> 0 GROUP BY 1),
j AS (SELECT c.canonical_url, k.path IS NOT NULL AS known, f.h IS NOT NULL AS there, coalesce(f.h = k.hash, false) AS fresh, k.etag FROM (SELECT DISTINCT canonical_url FROM canon) c LEFT JOIN known k USING (canonical_url) LEFT JOIN f ON f.path = k.path)
SELECT canonical_url, CASE WHEN known AND fresh AND there AND etag IS NULL THEN 'reuse_local' WHEN known AND there AND etag IS NOT NULL THEN 'conditional_get' ELSE 'get' END AS action, CASE WHEN known AND there AND etag IS NOT NULL THEN etag END AS etag, CASE WHEN known THEN 'page' END AS prior_rtype FROM j""",
    "manifest_upsert": f"""WITH {PAGES}, {_KNOWN}, n0 AS (SELECT canonical_url, opath AS path, strlen(html) AS size, 'sha256:' || sha256(html) AS hash, row_number() OVER (PARTITION BY canonical_url ORDER BY page_id DESC) AS rn FROM canon WHERE page_id % 4 <> 0)
SELECT canonical_url, path, size, hash, 'new' AS mtime FROM n0 WHERE rn = 1 UNION ALL SELECT canonical_url, path, size, hash, NULL FROM known WHERE canonical_url NOT IN (SELECT canonical_url FROM n0)""",
    "robots_allowed": f"WITH {LINKS}, r(rule, ok) AS (VALUES {_rules()}), p AS (SELECT DISTINCT lpath AS path FROM lk) SELECT path, coalesce((SELECT ok FROM r WHERE starts_with(path, rule) ORDER BY length(rule) DESC, ok DESC LIMIT 1), true) AS allowed FROM p",
    "crawl_summary": f"""WITH {LINKS}, x AS (SELECT {_bare('host')} AS site, {_rtype('lpath')} AS rtype, length({_RESOLVED}) * 97 AS size, pos % 5 = 4 AS reused, length(href) = 3 AS failed FROM lk),
s AS (SELECT site, {_SIZES.format('page')} AS pages, {_SIZES.format('image')} AS images, {_SIZES.format('css')} AS css, {_SIZES.format('js')} AS js, CAST(coalesce(sum(size) FILTER (NOT failed AND NOT reused), 0) AS BIGINT) AS total_bytes, count(*) FILTER (failed) AS errors FROM x GROUP BY 1)
SELECT *, CASE WHEN total_bytes < 1024 THEN total_bytes || ' B' WHEN total_bytes < 1048576 THEN printf('%.1f KB', total_bytes / 1024) WHEN total_bytes < 1073741824 THEN printf('%.1f MB', total_bytes / 1048576) ELSE printf('%.1f GB', total_bytes / 1073741824) END AS size_text,
  CASE WHEN pages = 0 AND errors > 0 THEN 'failed' WHEN errors > 0 THEN 'partial' ELSE 'complete' END AS outcome FROM s""",
    "archive_listing": f"WITH {PAGES} SELECT page_id, opath AS path, strlen(html) AS size FROM canon WHERE page_id % 10 <> 0",
    "charset_sniff": "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'gb2312' ELSE 'utf-8' END AS charset FROM pages",
    "formatted_sizes": "WITH s AS (SELECT page_id, strlen(html) * page_id * page_id AS n FROM pages) SELECT page_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576) ELSE printf('%.1f GB', n / 1073741824) END AS size_text FROM s",
    "bfs_depths": _bfs(2),
    "bfs_deep": _bfs(3),
    "page_assets": f"""WITH {PAGES}, a(seq, ref, rest) AS (VALUES (0, 'https://fonts.example.net/css2?family=A', NULL), (1, 'i.png', '/zz/i.png'), (2, '../l.gif', '/l.gif'), (3, 'https://cdn.example.net:8443/p.jpg', NULL), (4, 'go.svg', '/zz/go.svg'), (5, 'a.png', '/zz/a.png'), (6, '/zz/c.webp', '/zz/c.webp'))
SELECT page_id, CAST(seq + CASE WHEN seq = 0 THEN 0 ELSE 1 END AS BIGINT) AS seq, ref, coalesce(scheme || '://' || host || rest, ref) AS url FROM pg, a""",
    "asset_fan_out": f"""WITH {PAGES}, a(rest) AS (VALUES ('/zz/i.png'), ('/l.gif'), ('/zz/go.svg'), ('/zz/a.png'), ('/zz/c.webp')), f(url, round) AS (VALUES ('https://fonts.example.net/css2?family=A', 0), ('https://fonts.example.net/b.css', 1), ('https://fonts.example.net/f.woff2', 1), ('https://fonts.example.net/g.png', 2))
SELECT DISTINCT scheme || '://' || host || rest AS canonical_url, scheme || '://' || host || rest AS url, CAST(0 AS BIGINT) AS round FROM pg, a UNION ALL SELECT url, url, round FROM f""",
    "rewritten_assets": f"""WITH {PAGES}, x AS (SELECT page_id, repeat('../', len(string_split(opath, '/')) - 1) AS up FROM canon)
SELECT page_id, '<img src="' || up || 'zz/i.png" srcset="' || up || 'zz/a.png 1x, ' || up || 'zz/c.webp 2x"><p style="background:url(' || up || 'zz/bg.png) no-repeat"><video poster="' || up || '_external/cdn.example.net_8443/p.jpg"></video><script type="module" src="' || up || 'zz/m.js"></script>' AS new_html,
  'url("' || up || 'zz/x.css"); b{{background:url("' || up || 'zz/bg.png")}} i{{src:url(data:y)}} u{{src:url(https://elsewhere.example/p)}}' AS new_css FROM x""",
    "captures_kept": f"""WITH {PAGES}, a(seq, url, resource_type) AS (VALUES (0, '/a.js', 'Script'), (4, '/p/q', 'Document'), (5, '//cdn.example.net/f.woff2', 'Font'), (8, ':81/a.css', 'Stylesheet'))
SELECT page_id, CASE WHEN starts_with(a.url, '//') THEN scheme || ':' || a.url ELSE scheme || '://' || host || a.url END AS url, CAST(seq AS BIGINT) AS seq, resource_type FROM pg, a""",
    "rendered_links": f"""WITH {LINKS}, a(seq, rest) AS (VALUES (0, '/own#f'), (2, '/f.pdf'))
SELECT page_id, CAST(CASE WHEN seq = 2 THEN 2 ELSE seq END AS BIGINT) AS seq, scheme || '://' || host || rest AS url FROM pg, a
UNION ALL SELECT page_id, CAST(pos + 3 AS BIGINT), {_RESOLVED} FROM lk WHERE NOT ({_DYN})""",
    "rendered_resources": "SELECT page_id, url, rtype AS resource_type FROM pages p, (VALUES ('https://cdn.example.net/a.js', 'Script'), ('https://cdn.example.net/zz/i.png', 'Other')) a(url, rtype)".replace("url,", "a.url,", 1),
    "sql_functions": f"WITH {PAGES} SELECT page_id, canonical_url, opath AS path, CAST(NULL AS VARCHAR) AS problem, 'sha256:' || sha256(html) AS hash, CASE WHEN strlen(html) < 1024 THEN strlen(html) || ' B' ELSE printf('%.1f KB', strlen(html) / 1024) END AS size_text FROM canon",
    "start_problems": "SELECT page_id, CASE page_id % 4 WHEN 1 THEN 'neither http nor https' WHEN 2 THEN 'no URL' WHEN 3 THEN 'no host' END AS problem FROM pages",
    "decoded_bodies": """SELECT page_id, ['中文', '<meta charset="gbk">中文', 'é', '中', '\ufffdA'][page_id % 5 + 1] AS text FROM pages""",
}
