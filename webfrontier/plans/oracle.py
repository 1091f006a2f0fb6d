"""SQL twins of the registered queries for DuckDB, written from the rules and not from the Spark code."""

from __future__ import annotations

from webfrontier.plans import derived as D

WS = r"[ \t\n\x0B\f\r]"


def _text(value: str) -> str:
    """SQL literal of a text, newlines spelled out."""
    return " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in value.split("\n"))


def _list(values: list[str]) -> str:
    return "[" + ", ".join(_text(v) for v in values) + "]"


def _domain(url: str) -> str:
    """Host of a URL; every URL this is used on has lowercase hosts or wants them lowercased."""
    after = f"split_part({url}, '//', 2)"
    return (
        f"CASE WHEN contains({url}, '//') THEN translate(split_part({after}, '/', 1), "
        "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END"
    )


def _decode(text: str) -> str:
    """The references that occur in the tables, the ampersand last so that each is read once."""
    pairs = [
        ("&middot;", "·"),
        ("&copy;", "©"),
        ("&quot;", '"'),
        ("&eacute;", "é"),
        ("&#65;", "A"),
        ("&#x42;", "B"),
        ("&lt;", "<"),
        ("&gt;", ">"),
        ("&amp;", "&"),
    ]
    for name, value in pairs:
        text = f"replace({text}, '{name}', '{value}')"
    return text


def _visible(html: str) -> str:
    no_hidden = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
    return f"regexp_replace({html}, '{no_hidden}', ' ', 'g')"


def _body_text(html: str) -> str:
    spaced = f"replace(replace({html}, '&nbsp;', ' '), '&rsquo;', ' ')"
    inner = rf"regexp_extract({spaced}, '(?is)<body[^>]*>(.*?)(?:</body\s*>|\z)', 1)"
    body = f"CASE WHEN regexp_matches({html}, '(?i)<body') THEN {inner} ELSE {spaced} END"
    bare = f"regexp_replace({body}, '(?is)<script.*?>.*?</script>', '', 'g')"
    bare = f"regexp_replace({bare}, '(?is)<style.*?>.*?</style>', '', 'g')"
    text = f"regexp_replace({_decode(bare)}, '<[^>]+>', ' ', 'g')"
    return rf"trim(regexp_replace({text}, '{WS}+', ' ', 'g'))"


CRAWLABLE = "(code = 200 AND contains(content_type, 'text/html'))"

# Named sub-queries; each may use the ones above it.
STEPS: dict[str, str] = {
    "resp0": f"""
        SELECT page_id, url, {_domain('url')} AS host, lower(split_part(url, '://', 1)) AS scheme,
               CASE WHEN page_id % 10 = 0 THEN 404 ELSE 200 END AS code,
               CASE WHEN page_id % 7 = 0 THEN 'application/pdf'
                    WHEN page_id % 7 = 1 THEN 'text/html; charset=iso-8859-1'
                    ELSE 'text/html; charset=utf-8' END AS content_type,
               html, ({_list(D.HREFS)})[page_id % {len(D.HREFS)} + 1] AS href
        FROM pages""",
    "resp": f"""
        SELECT page_id, url, host, scheme, code, content_type, 'crawling_' || host || '_t1' AS tag,
               html || '<a href="' || replace(href, 'www.ex.com', host) || '">m</a>' AS body,
               {CRAWLABLE} AS crawlable
        FROM resp0""",
    "hrefs0": f"""
        SELECT page_id, tag, url AS page, scheme || '://' || host AS base,
               regexp_extract_all({_visible('body')}, '<a href="([^"]*)"', 1) AS found
        FROM resp WHERE crawlable""",
    "hrefs1": f"""
        SELECT page_id, tag, page, base, {_decode('href')} AS href, place
        FROM (SELECT page_id, tag, page, base, unnest(found) AS href,
                     generate_subscripts(found, 1) AS place FROM hrefs0)""",
    "hrefs": """
        SELECT page_id, tag, page, base, place,
               CASE WHEN starts_with(href, '//') THEN 'http:' || href ELSE href END AS href
        FROM hrefs1""",
    "classified": """
        SELECT page_id, tag, page, place,
               CASE WHEN contains(href, '#') THEN NULL
                    WHEN starts_with(href, '/') OR starts_with(href, '.') THEN 'internal'
                    WHEN starts_with(href, base) THEN 'internal'
                    WHEN starts_with(href, 'http') THEN 'external'
                    WHEN starts_with(href, 'mailto:') THEN NULL
                    ELSE 'internal' END AS link_type,
               trim(trim(CASE WHEN starts_with(href, '/') THEN base || href
                    WHEN starts_with(href, '.') THEN base || '/' || href
                    WHEN starts_with(href, base) OR starts_with(href, 'http') THEN href
                    ELSE base || '/' || href END), '/') AS link
        FROM hrefs""",
    "links": """
        SELECT page_id, tag, page, link_type, link, min(place) AS place FROM classified
        WHERE link_type IS NOT NULL GROUP BY ALL""",
    "hosts": f"""
        SELECT {_domain('url')} AS host, min(page_id) AS first_id,
               min(lower(split_part(url, '://', 1))) AS scheme
        FROM pages GROUP BY 1""",
    "configs": """
        SELECT *, '{"scheme":"' || scheme || '"'
            || CASE WHEN first_id % 11 <> 0 THEN ',"domain":"' || host || '"' ELSE '' END
            || CASE WHEN first_id % 2 = 0 THEN ',"authorizedDomains":["cdn.net","other.org"]' ELSE '' END
            || CASE WHEN first_id % 2 = 1 AND first_id % 3 = 0
                    THEN ',"authorizedDomains":"cdn.net , other.org"' ELSE '' END
            || CASE WHEN first_id % 3 = 0 THEN ',"maxPages":' || (first_id % 20) ELSE '' END
            || CASE WHEN first_id % 5 = 0 THEN ',"noDiscovery":true' ELSE '' END
            || CASE WHEN first_id % 4 = 0 THEN ',"ignoreSitemap":true' ELSE '' END
            || CASE WHEN first_id % 3 = 1 THEN ',"maxAge":259200' ELSE '' END
            || CASE WHEN first_id % 3 = 2 THEN ',"maxAge":864000' ELSE '' END
            || CASE WHEN first_id % 6 = 0 THEN ',"datasourceId":""' ELSE '' END
            || CASE WHEN first_id % 6 <> 0 THEN ',"datasourceId":"ds ' || first_id || '"' ELSE '' END
            || CASE WHEN first_id % 2 = 0 THEN ',"callbackUrl":"http://sink.example/' || host || '"' ELSE '' END
            || CASE WHEN first_id % 4 = 0 THEN ',"callback":"search"'
                    WHEN first_id % 4 = 2 THEN ',"callback":"other"' ELSE '' END
            || '}' AS config
        FROM hosts""",
    "sites": """
        SELECT 'crawling_' || host || '_t1' AS tag, host AS domain, scheme, first_id, config,
               first_id % 2 = 0 OR first_id % 3 = 0 AS has_domains,
               CAST(CASE WHEN first_id % 3 = 0 THEN first_id % 20 ELSE -1 END AS INTEGER) AS max_pages,
               first_id % 5 = 0 AS no_discovery, first_id % 4 = 0 AS ignore_sitemap,
               CAST(CASE first_id % 3 WHEN 0 THEN -1 WHEN 1 THEN 259200 ELSE 864000 END AS BIGINT) AS max_age,
               CASE WHEN first_id % 6 = 0 THEN '' ELSE 'ds ' || first_id END AS datasource_id,
               CASE WHEN first_id % 2 = 0 THEN 'http://sink.example/' || host END AS callback_url,
               CASE first_id % 4 WHEN 0 THEN 'search' WHEN 2 THEN 'other' END AS callback
        FROM configs WHERE first_id % 11 <> 0""",
    "chunks": f"""
        SELECT host, page_id // {D.CHUNK} AS chunk, min(page_id) % 2 = 0 AS nested,
               'http://' || host || '/sitemap-' || (page_id // {D.CHUNK}) || '.xml' AS root,
               'http://' || host || '/urls-' || (page_id // {D.CHUNK}) || '.xml' AS child
        FROM resp GROUP BY host, page_id // {D.CHUNK}""",
    "entries": f"""
        SELECT 'crawling_' || c.host || '_t1' AS tag, CASE WHEN nested THEN child ELSE root END AS sitemap_url,
               CAST(nested AS INTEGER) AS depth, url AS loc,
               CASE WHEN page_id % 5 <> 0
                    THEN strftime(TIMESTAMP '2024-01-01' + to_hours(page_id), '%Y-%m-%dT%H:%MZ') END AS lastmod,
               CASE WHEN page_id % 5 <> 0 THEN TIMESTAMP '2024-01-01' + to_hours(page_id) END AS written
        FROM chunks c JOIN resp r ON r.host = c.host AND r.page_id // {D.CHUNK} = c.chunk""",
    "resolved": "SELECT e.* FROM entries e JOIN sites s ON s.tag = e.tag WHERE NOT ignore_sitemap",
    "recent": f"""
        SELECT e.* FROM resolved e JOIN sites s ON s.tag = e.tag
        WHERE max_age < 0 OR depth > 0
           OR written > TIMESTAMP '{D.NOW}' - to_seconds(max_age)""",
    "seeds": """
        SELECT loc AS key, s.tag, 'Crawling domain ' || domain || ' from sitemap.xml' AS searchable, config AS data
        FROM recent r JOIN sites s ON s.tag = r.tag
        UNION ALL
        SELECT scheme || '://' || domain, tag, 'Crawling domain ' || domain, config FROM sites
        WHERE tag NOT IN (SELECT tag FROM recent)""",
    "robots": f"""
        SELECT 'crawling_' || host || '_t1' AS tag,
               CASE first_id % 3 WHEN 0 THEN {_text(D.ROBOTS_BODY)} ELSE {_text(D.ROBOTS_EMPTY)} END AS body
        FROM hosts WHERE first_id % 3 <> 2""",
    "robots_lines": r"""
        SELECT tag, place, lower(trim(split_part(line, ':', 1))) AS field,
               trim(substr(line, strpos(line, ':') + 1)) AS value
        FROM (SELECT tag, regexp_replace(unnest(string_split(body, chr(10))), '#.*', '') AS line,
                     generate_subscripts(string_split(body, chr(10)), 1) AS place FROM robots)
        WHERE contains(line, ':')""",
    "robots_useful": """
        SELECT *, lag(field) OVER (PARTITION BY tag ORDER BY place) AS before
        FROM robots_lines WHERE field IN ('user-agent', 'allow', 'disallow')""",
    "robots_blocks": """
        SELECT *, sum(CASE WHEN field = 'user-agent' AND before IS DISTINCT FROM 'user-agent' THEN 1 ELSE 0 END)
                  OVER (PARTITION BY tag ORDER BY place) - 1 AS block
        FROM robots_useful""",
    "robots_agents": """
        SELECT tag, block, string_agg(lower(value), ',' ORDER BY place) AS agents
        FROM robots_blocks WHERE field = 'user-agent' GROUP BY tag, block""",
    "rules": """
        SELECT b.tag, CAST(b.block AS BIGINT) AS block, agents, field AS kind, value AS pattern
        FROM robots_blocks b JOIN robots_agents a ON a.tag = b.tag AND a.block = b.block
        WHERE field <> 'user-agent' AND value <> ''""",
    "star_rules": r"""
        SELECT tag, kind, pattern,
               '^' || regexp_replace(replace(regexp_replace(pattern, '([.+?()\[\]{}])', '\\\1', 'g'), '*', '.*'),
                                     '\$$', '$') AS regex
        FROM rules WHERE list_contains(string_split(agents, ','), '*')""",
    "internal": r"""
        SELECT DISTINCT tag, page, link_type, link,
               CASE WHEN starts_with(rest, '/') THEN rest ELSE '/' || rest END AS path
        FROM (SELECT *, regexp_replace(link, '^[^:/?#]*://[^/?#]*', '') AS rest
              FROM links WHERE link_type = 'internal')""",
    "verdicts": """
        SELECT i.tag, i.page, i.link, arg_max(kind, length(pattern) * 2 + CAST(kind = 'allow' AS INTEGER)) AS kind
        FROM internal i JOIN star_rules s ON s.tag = i.tag AND regexp_matches(path, regex)
        GROUP BY i.tag, i.page, i.link""",
    "robots_ok": """
        SELECT i.tag, i.page, i.link_type, i.link FROM internal i
        LEFT JOIN verdicts v ON v.tag = i.tag AND v.page = i.page AND v.link = i.link
        WHERE v.kind IS DISTINCT FROM 'disallow'""",
    "external_ok": f"""
        SELECT l.tag, page, link_type, link FROM links l JOIN sites s ON s.tag = l.tag
        WHERE link_type = 'external' AND has_domains AND {_domain('link')} IN ('cdn.net', 'other.org')""",
    "followed": """
        SELECT f.* FROM (SELECT * FROM robots_ok UNION ALL SELECT * FROM external_ok) f
        JOIN sites s ON s.tag = f.tag WHERE NOT no_discovery""",
    "run_rows": f"""
        SELECT url AS key, tag, page_id % 3 AS flag FROM resp
        UNION ALL SELECT 'process-1', tag, -1 FROM sites""",
    "state": """
        SELECT id, key, tag, domain, CAST(flag AS INTEGER) AS flag, searchable, props,
               date_trunc('second', ts) AS datetime
        FROM (SELECT *, 'u' || user_id AS id, 'u' || user_id AS key, 't' || user_id % 5 AS tag,
                     't' || user_id % 5 || '.example.org' AS domain,
                     CASE event_type WHEN 'signup' THEN 2 WHEN 'view' THEN 1 WHEN 'click' THEN 1
                          WHEN 'purchase' THEN 0 WHEN 'error' THEN -1 END AS flag,
                     'Discovered u' || user_id || ' from Page-' || event_type AS searchable
              FROM events)
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC, event_id DESC) = 1""",
    "shown": """
        SELECT id, strftime(datetime, '%Y-%m-%d %H:%M:%S') AS datetime, key, tag, flag, searchable
        FROM state""",
    "counts": """
        SELECT tag, count(*) FILTER (flag = 0) AS done, count(*) FILTER (flag = 1) AS processing,
               count(*) FILTER (flag = 2) AS new, count(*) FILTER (flag IN (0, 1, 2)) AS total
        FROM state GROUP BY tag""",
    "run_counts": """
        SELECT tag, count(*) FILTER (flag = 0) AS done, count(*) FILTER (flag = 1) AS processing,
               count(*) FILTER (flag = 2) AS new, count(*) FILTER (flag IN (0, 1, 2)) AS total
        FROM run_rows GROUP BY tag""",
    "run_level0": """
        SELECT d.tag, d.key, searchable, data, 0 AS depth,
               r.url IS NOT NULL AND (max_pages <= 0 OR
                   row_number() OVER (PARTITION BY d.tag, r.url IS NOT NULL ORDER BY d.key) < max_pages) AS processed
        FROM (SELECT DISTINCT * FROM seeds) d JOIN sites s ON s.tag = d.tag
        LEFT JOIN resp r ON r.tag = d.tag AND r.url = d.key""",
    "any_payload": f"""
        SELECT r.tag, callback_url, callback, nullif(datasource_id, '') AS datasource_id,
               CASE WHEN crawlable THEN nullif(trim({_decode("regexp_extract(body, '<title>(.*?)</title>', 1)")}), '') END
                   AS title,
               CASE WHEN crawlable THEN body END AS html, url
        FROM resp r JOIN sites s ON s.tag = r.tag""",
    "payload": "SELECT * FROM any_payload WHERE callback_url IS NOT NULL AND callback = 'search'",
    "nodes": "SELECT count(*) AS n, min(page_id) AS low, max(page_id) AS high FROM pages",
    "addresses": "SELECT page_id, html, rtrim(split_part(url, '#', 1), '/') AS address FROM pages",
    "web": f"""
        SELECT p.page_id, 'web' AS tag, p.address AS url, {_domain('p.address')} AS host,
               lower(split_part(p.address, '://', 1)) AS scheme,
               p.html || '<a href="' || replace(a.address, '&', '&amp;') || '">n</a><a href="'
                      || replace(b.address, '&', '&amp;') || '">n</a>' AS body
        FROM addresses p CROSS JOIN nodes JOIN addresses a ON a.page_id = (p.page_id * 7 + 3) % n
        JOIN addresses b ON b.page_id = (p.page_id * 5 + 1) % n""",
    "web_links": "",
    "edges": "SELECT DISTINCT page AS src, link AS dst FROM web_links WHERE link_type IS NOT NULL",
    "starts": """
        SELECT 's0' AS tag, address AS node FROM addresses, nodes WHERE page_id = low
        UNION ALL SELECT 's1', address FROM addresses, nodes WHERE page_id = high""",
    "walk": """
        SELECT tag, node, 0 AS depth FROM starts
        UNION
        SELECT w.tag, e.dst, min(w.depth) + 1 FROM walk w JOIN edges e ON e.src = w.node
        WHERE NOT EXISTS (SELECT 1 FROM recurring.walk k WHERE k.tag = w.tag AND k.node = e.dst)
        GROUP BY w.tag, e.dst""",
    "levels": "SELECT tag, node, min(depth) AS depth FROM walk GROUP BY tag, node",
    "seen": """
        SELECT l.tag, l.node, l.depth,
               CASE WHEN l.tag = 's0'
                    THEN row_number() OVER (PARTITION BY l.tag ORDER BY l.depth, CAST(l.node AS VARCHAR))
                         < floor(n * 2 / 5)
                    ELSE true END AS processed
        FROM levels l, nodes""",
}

# The links of the pages of "web", by the same steps as those of "resp".
STEPS["web_links"] = f"""
        WITH hrefs0 AS ({STEPS["hrefs0"].replace("FROM resp WHERE crawlable", "FROM web")}),
        hrefs1 AS ({STEPS["hrefs1"]}), hrefs AS ({STEPS["hrefs"]}) {STEPS["classified"]}"""


def _used(body: str) -> list[str]:
    """Names of the steps a query needs, directly or through other steps."""
    needed: set[str] = set()
    texts = [body]
    while texts:
        text = texts.pop()
        words = set("".join(c if c.isalnum() or c == "_" else " " for c in text).split())
        for name in STEPS:
            if name in words and name not in needed:
                needed.add(name)
                texts.append(STEPS[name])
    return [name for name in STEPS if name in needed]


def _sql(body: str) -> str:
    steps = _used(body)
    if not steps:
        return body.strip()
    recursive = "RECURSIVE " if "walk" in steps else ""
    keys = {"walk": "(tag, node, depth) USING KEY (tag, node)"}
    parts = [f"{name}{keys.get(name, '')} AS ({STEPS[name].strip()})" for name in steps]
    return f"WITH {recursive}" + ",\n".join(parts) + "\n" + body.strip()


_HEADERS = """
    SELECT page_id, 'location' AS name, url AS value FROM resp0
    UNION ALL SELECT page_id, 'x-id', 'b:' || page_id FROM resp0
    UNION ALL SELECT page_id, 'content-type', content_type FROM resp0"""

_JSON_STATE = r"""
    SELECT id, '{"id":"' || id || '","class":"webfrontier.discovery","datetime":{"date":"'
        || strftime(datetime, '%Y-%m-%d %H:%M:%S') || '.000000","timezone_type":3,"timezone":"UTC"},"key":"'
        || key || '","domain":"' || domain || '","tag":"' || tag || '",'
        || CASE WHEN flag <> 0 THEN '"flag":' || flag || ',' ELSE '' END
        || '"searchable":"' || searchable || '","data":' || replace(props, ' ', '') || '}' AS json
    FROM state"""


def _form(value: str) -> str:
    coded = f"replace(replace(url_encode({value}), '%20', '+'), '~', '%7E')"
    return f"replace({coded}, '*', '%2A')"


_BODIES: dict[str, str] = {
    "responses_ok": "SELECT page_id, url, CAST(code AS INTEGER) AS code, crawlable FROM resp",
    "link_extract": "SELECT page_id, page, link_type, link FROM links",
    "page_titles": f"""
        SELECT page_id, crawlable,
               CASE WHEN crawlable THEN trim({_decode("regexp_extract(body, '<title>(.*?)</title>', 1)")}) END AS title
        FROM resp""",
    "page_text": f"""
        SELECT page_id, CASE WHEN crawlable THEN {_body_text('marked')} END AS text
        FROM (SELECT *, replace(body, '<article>', '<article>' || {_text(D.ENTITY_TEXT)}) AS marked FROM resp)""",
    "page_documents": f"""
        SELECT r.page_id,
               coalesce((SELECT string_agg(link, ' | ' ORDER BY place) FROM links l
                         WHERE l.page_id = r.page_id AND link_type = 'internal'), '') AS internal_links,
               coalesce((SELECT string_agg(link, ' | ' ORDER BY place) FROM links l
                         WHERE l.page_id = r.page_id AND link_type = 'external'), '') AS external_links,
               '{D.CRAWL_TIME}' AS crawl_time, host AS domain, {_body_text('body')} AS body, body AS html,
               content_type, trim({_decode("regexp_extract(body, '<title>(.*?)</title>', 1)")}) AS title
        FROM resp r WHERE crawlable""",
    "pages_by_domain": f"SELECT {_domain('url')} AS domain, count(*) AS pages FROM pages GROUP BY 1",
    "pages_by_scheme": "SELECT lower(split_part(url, '://', 1)) AS scheme, count(*) AS pages FROM pages GROUP BY 1",
    "query_params": """
        SELECT page_id, name, arg_max(value, place) AS value
        FROM (SELECT page_id, split_part(part, '=', 1) AS name, split_part(part, '=', 2) AS value, place
              FROM (SELECT page_id, unnest(string_split(split_part(url, '?', 2), '&')) AS part,
                           generate_subscripts(string_split(split_part(url, '?', 2), '&'), 1) AS place
                    FROM pages WHERE length(url) - length(replace(url, '?', '')) = 1)
              WHERE length(part) - length(replace(part, '=', '')) = 1)
        GROUP BY page_id, name""",
    "header_map": _HEADERS,
    "charset_fix": r"""
        SELECT page_id, CASE WHEN page_id % 7 = 1 THEN regexp_replace(html, '[^\x{0}-\x{FF}]', '?', 'g')
                             ELSE html END AS body
        FROM pages""",
    "utf8_clean": """
        SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN left(text, CAST(length(text) - 1 AS BIGINT)) ELSE text END AS text
        FROM documents""",
    "lang_label": f"""
        SELECT doc_id, CASE WHEN {{hits}} THEN 'fr' ELSE 'not_fr' END AS label
        FROM (SELECT doc_id, regexp_split_to_array(lower(text), '{WS}') AS words FROM documents)""",
    "lang_confusion": f"""
        SELECT lang, CASE WHEN {{hits}} THEN 'fr' ELSE 'not_fr' END AS label, count(*) AS documents
        FROM (SELECT lang, regexp_split_to_array(lower(text), '{WS}') AS words FROM documents)
        GROUP BY ALL""",
    "word_counts": f"""
        SELECT doc_id, word, count(*) AS n
        FROM (SELECT doc_id, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                  'abcdefghijklmnopqrstuvwxyz'), '{WS}')) AS word FROM documents)
        GROUP BY ALL""",
    "french_dates": f"""
        SELECT doc_id, CASE WHEN doc_id % {len(D.MONTH_WORDS)} < 12
                            THEN (doc_id % 28 + 1) || '/' || lpad(CAST(doc_id % {len(D.MONTH_WORDS)} + 1 AS VARCHAR), 2, '0')
                                 || '/' || (doc_id % 50 + 1990) END AS french_date
        FROM documents""",
    "site_config": """
        SELECT tag, domain, scheme, CASE WHEN has_domains THEN 'cdn.net,other.org' ELSE '' END AS authorized_domains,
               max_pages, no_discovery, ignore_sitemap, max_age, datasource_id, callback_url, config,
               true AS accepted
        FROM sites
        UNION ALL
        SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, config, false
        FROM configs WHERE first_id % 11 = 0""",
    "sitemap_urls": """
        SELECT sitemap_url, 'page' AS kind, loc, lastmod FROM entries
        UNION ALL SELECT root, 'sitemap', child, NULL FROM chunks WHERE nested
        UNION ALL SELECT root, 'sitemap', root, NULL FROM chunks WHERE nested""",
    "sitemap_tree": "SELECT tag, sitemap_url, depth, loc, lastmod FROM resolved",
    "sitemap_recent": "SELECT tag, depth, loc, lastmod FROM recent",
    "seed_urls": f"""
        SELECT sha256(length(tag) || ':' || tag || '|' || key) AS id, '{D.NOW}' AS datetime, key, {_domain('key')} AS domain, tag,
               CAST(2 AS INTEGER) AS flag, searchable, data FROM seeds""",
    "robots_rules": "SELECT tag, block, agents, kind, pattern FROM rules",
    "robots_from_responses": """
        SELECT r.tag, block, kind, pattern FROM rules r JOIN sites s ON s.tag = r.tag""",
    "sitemaps_from_responses": """
        SELECT e.tag, sitemap_url, depth, loc, lastmod FROM resolved e JOIN sites s ON s.tag = e.tag
        WHERE length(domain) % 3 <> 0 AND NOT (contains(sitemap_url, '/urls-') AND length(domain) % 4 = 0)""",
    "robots_filter": "SELECT tag, page, link_type, link FROM robots_ok",
    "external_allowed": "SELECT tag, page, link_type, link FROM external_ok",
    "frontier_upsert": "SELECT * FROM shown",
    "frontier_transition": "SELECT * REPLACE (CAST(CASE flag WHEN 2 THEN 1 ELSE flag END AS INTEGER) AS flag) FROM shown",
    "frontier_delete": "SELECT * FROM shown WHERE flag <> 0",
    "frontier_cleanup": "SELECT * FROM shown WHERE tag <> 't1'",
    "frontier_term_filter": "SELECT * FROM shown WHERE tag = 't2' AND searchable LIKE '%-click'",
    "frontier_by_id": "SELECT * FROM shown WHERE id = 'u8'",
    "frontier_open": "SELECT * FROM shown WHERE flag = 1 UNION ALL SELECT * FROM shown WHERE flag = 2",
    "frontier_fifo": """
        SELECT tag, key, row_number() OVER (PARTITION BY tag ORDER BY datetime, key) AS position FROM state""",
    "frontier_next_batch": """
        SELECT tag, key, row_number() OVER (PARTITION BY tag ORDER BY datetime, key) AS position FROM state
        WHERE flag = 2 QUALIFY position <= 3""",
    "item_to_json": _JSON_STATE,
    "item_from_json": f"""
        SELECT event_id,
               strftime(CASE event_id % 3 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN ts
                             ELSE TIMESTAMP '{D.NOW}' END, '%Y-%m-%d %H:%M:%S.%f') AS datetime,
               'u' || user_id AS key, CAST(NULL AS VARCHAR) AS domain, CAST(2 AS INTEGER) AS flag,
               replace(props, ' ', '') AS data
        FROM events""",
    "crawl_stats": "SELECT * FROM counts",
    "crawl_progress": """
        SELECT *, CASE WHEN total = 0 THEN CAST(0 AS DOUBLE) ELSE round(CAST(100.0 * done AS DOUBLE) / total, 2) END
                  AS progress FROM counts""",
    "active_crawls": f"""
        SELECT sha256(length(tag) || ':' || tag || '|process-1') AS id, tag, 'process-1' AS key,
               'Crawler for domain ' || domain AS searchable, '{D.NOW}' AS datetime FROM sites""",
    "crawl_configs": """
        SELECT tag, domain, scheme, CASE WHEN max_pages >= 0 THEN max_pages END AS max_pages, datasource_id
        FROM sites""",
    "crawl_report": f"""
        SELECT s.tag, 'Crawler for domain ' || domain AS label, '{D.NOW}' AS started, domain, scheme,
               CASE WHEN has_domains THEN 'cdn.net, other.org' ELSE '' END AS authorized_domains,
               CASE WHEN max_pages > -1 THEN CAST(max_pages AS VARCHAR) ELSE 'Unlimited' END AS max_pages,
               callback, callback_url, datasource_id, NOT no_discovery AS discovery,
               NOT ignore_sitemap AS sitemap, coalesce(done, 0) AS done, coalesce(processing, 0) AS processing,
               coalesce(new, 0) AS new, coalesce(total, 0) AS total,
               coalesce(round(CAST(100.0 * done AS DOUBLE) / nullif(total, 0), 2), 0) AS progress
        FROM sites s LEFT JOIN run_counts c ON c.tag = s.tag""",
    "callback_payload": "SELECT tag, datasource_id, title, html, url FROM payload",
    "callback_form": f"""
        SELECT url, concat_ws('&', 'datasourceId=' || {_form('datasource_id')}, 'title=' || {_form('title')},
                              'html=' || {_form('html')}, 'url=' || {_form('url')}) AS form FROM payload""",
    "discover_round": f"""
        SELECT sha256(length(f.tag) || ':' || f.tag || '|' || link) AS id, link AS key, {_domain('link')} AS domain, f.tag,
               CAST(2 AS INTEGER) AS flag, 'Discovered ' || link || ' from ' || min(page) AS searchable,
               any_value(config) AS data
        FROM followed f JOIN sites s ON s.tag = f.tag
        WHERE NOT EXISTS (SELECT 1 FROM seeds k WHERE k.tag = f.tag AND k.key = link)
          AND NOT EXISTS (SELECT 1 FROM run_rows k WHERE k.tag = f.tag AND k.key = link)
        GROUP BY f.tag, link""",
    "discover_closure": """
        SELECT l.tag, CAST(l.node AS VARCHAR) AS key, CAST(l.depth AS BIGINT) AS depth,
               (SELECT min(CAST(e.src AS VARCHAR)) FROM edges e JOIN levels p ON p.node = e.src
                WHERE e.dst = l.node AND p.tag = l.tag AND p.depth = l.depth - 1) AS parent
        FROM levels l""",
    "discover_capped": """
        SELECT s.tag, CAST(s.node AS VARCHAR) AS key, CAST(s.depth AS BIGINT) AS depth,
               CAST(CASE WHEN processed THEN 0 ELSE 2 END AS INTEGER) AS flag
        FROM seen s
        WHERE s.depth = 0 OR EXISTS (SELECT 1 FROM edges e JOIN seen p ON p.node = e.src
                                     WHERE e.dst = s.node AND p.tag = s.tag AND p.processed)""",
    "crawl_run": f"""
        SELECT sha256(length(tag) || ':' || tag || '|' || key) AS id, key, {_domain('key')} AS domain, tag,
               CAST(CASE WHEN processed THEN 0 ELSE 2 END AS INTEGER) AS flag, searchable, data,
               CAST(depth AS BIGINT) AS depth
        FROM run_level0
        UNION ALL
        SELECT sha256(length(f.tag) || ':' || f.tag || '|' || f.link), f.link, {_domain('f.link')}, f.tag, CAST(2 AS INTEGER),
               'Discovered ' || f.link || ' from ' || min(f.page), any_value(p.data), CAST(1 AS BIGINT)
        FROM followed f JOIN run_level0 p ON p.tag = f.tag AND p.key = f.page AND p.processed
        WHERE NOT EXISTS (SELECT 1 FROM run_level0 k WHERE k.tag = f.tag AND k.key = f.link)
        GROUP BY f.tag, f.link""",
    "crawl_payload": """
        SELECT datasource_id, p.tag, title, html, url FROM any_payload p
        JOIN run_level0 r ON r.tag = p.tag AND r.key = p.url AND r.processed""",
    "page_cap": """
        SELECT tag, key FROM (
            SELECT r.tag, key, max_pages, row_number() OVER (PARTITION BY r.tag ORDER BY key) AS place
            FROM run_rows r LEFT JOIN sites s ON s.tag = r.tag WHERE flag >= 0)
        WHERE coalesce(max_pages, -1) <= 0 OR place < max_pages""",
    "stream_discover": f"""
        SELECT f.tag, link AS key, {_domain('link')} AS domain, CAST(2 AS INTEGER) AS flag FROM followed f
        WHERE NOT EXISTS (SELECT 1 FROM run_rows k WHERE k.tag = f.tag AND k.key = link)
        GROUP BY f.tag, link""",
    "stream_stats": "SELECT * FROM counts",
    "stream_payload": "SELECT datasource_id, tag, title, html, url FROM payload",
}

_FRENCH = " OR ".join(
    f"len(list_filter(words, lambda w: w = '{word}')) > 3" for word in ("le", "la", "est", "et", "au")
)

ORACLE: dict[str, str] = {
    name: _sql(body.replace("{hits}", f"({_FRENCH})")) for name, body in _BODIES.items()
}
