"""Sitemaps, robots files, site settings and stored rows."""

from __future__ import annotations

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from webfrontier.model import FRONTIER
from webfrontier.sources import items, responses, robots, sitemaps, sites

NOW = "2024-01-10 00:00:00"


def _urlset(*locs):
    entries = "".join(f"<url><loc>{u}</loc></url>" for u in locs)
    return f'<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">{entries}</urlset>'


def _index(*locs):
    return "<sitemapindex>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in locs) + "</sitemapindex>"


def test_sitemap_tree_keeps_repeats_and_ends_on_cycles(spark):
    documents = spark.createDataFrame(
        [
            ("r", _index("c", "c", "r", "d", "missing")),
            ("c", _urlset("p1", "p1", "p2")),
            ("d", _index("c")),
            ("bad", "<urlset><url>"),
            ("s", _urlset("q")),
        ],
        "url string, xml string",
    )
    roots = spark.createDataFrame([("t", "r"), ("u", "s"), ("v", "bad"), ("w", "none")], "tag string, sitemap_url string")
    rows = sitemaps.resolve_sitemaps(roots, documents)
    got = sorted((r["tag"], r["depth"], r["loc"]) for r in rows.collect())
    assert got == sorted(
        [("t", 1, "p1")] * 4 + [("t", 1, "p2")] * 2 + [("t", 2, "p1")] * 2 + [("t", 2, "p2"), ("u", 0, "q")]
    )


def _index(*children):
    return "<sitemapindex>" + "".join(f"<sitemap><loc>{c}</loc></sitemap>" for c in children) + "</sitemapindex>"


def _ways(documents, url, trail=()):
    """Every way through the index files to the pages, one by one."""
    for child in documents.get(url, ([], []))[0]:
        if child not in (*trail, url):
            yield from _ways(documents, child, (*trail, url))
    for page in documents.get(url, ([], []))[1]:
        yield (url, len(trail), page)


def test_ways_are_counted_not_listed(spark):
    """A ladder of 26 documents: 4,096 ways lead to each end, by one open row per document."""
    steps = {f"{side}{n}": _index(f"a{n + 1}", f"b{n + 1}") for n in range(12) for side in "ab"}
    ends = {f"{side}12": "<urlset><url><loc>p</loc></url></urlset>" for side in "ab"}
    documents = spark.createDataFrame(list({**steps, **ends}.items()), "url string, xml string")
    roots = spark.createDataFrame([("t", "a0"), ("t", "b0")], "tag string, sitemap_url string")
    walked = sitemaps.walk_sitemaps(roots, documents)
    assert [tuple(r) for r in walked.orderBy("sitemap_url").collect()] == [
        ("t", "a12", 12, "p", None, 4096), ("t", "b12", 12, "p", None, 4096),
    ]
    assert sitemaps.resolve_sitemaps(roots, documents).count() == 8192


@pytest.mark.parametrize("seed", range(3))
def test_ways_through_cycles(spark, seed):
    """Random index files with cycles, loops, repeated and missing children, and documents beyond the cycles."""
    rng = random.Random(seed)
    names = [f"d{n}" for n in range(9)]
    made = {}
    for n, name in enumerate(names):
        below = names[:6] + ["absent"] if n < 5 else names[n + 1 :]
        made[name] = ([rng.choice(below) for _ in range(rng.randint(0, 3)) if below], [f"p{n}"] * rng.randint(0, 2))
    xml = [
        (name, "<x>" + "".join(f"<sitemap><loc>{c}</loc></sitemap>" for c in children)
         + "".join(f"<url><loc>{p}</loc></url>" for p in pages) + "</x>")
        for name, (children, pages) in made.items()
    ]
    roots = [("t", "d0"), ("t", "d0"), ("u", "d1"), ("u", "d5")]
    found = sitemaps.resolve_sitemaps(
        spark.createDataFrame(roots, "tag string, sitemap_url string"), spark.createDataFrame(xml, "url string, xml string")
    )
    expected = [(tag, *way) for tag, root in roots for way in _ways(made, root)]
    assert sorted((r["tag"], r["sitemap_url"], r["depth"], r["loc"]) for r in found.collect()) == sorted(expected)


def test_sitemap_age(spark):
    urls = spark.createDataFrame(
        [
            ("t", 0, "exact", "2024-01-09T23:00Z"),
            ("t", 0, "young", "2024-01-09T23:01Z"),
            ("t", 0, "other format", "2024-01-09"),
            ("t", 0, "none", None),
            ("t", 1, "child", "2001-01-01T00:00Z"),
            ("u", 0, "any age", None),
        ],
        "tag string, depth int, loc string, lastmod string",
    )
    settings = spark.createDataFrame([("t", 3600), ("u", -1)], "tag string, maxAge bigint")
    kept = {r["loc"] for r in sitemaps.recent_urls(urls, settings, NOW).collect()}
    assert kept == {"young", "child", "any age"}


def test_root_sitemaps(spark):
    rows = spark.createDataFrame(
        [("t", "https", "a.b", False), ("u", "http", "c.d", True)],
        "tag string, scheme string, domain string, ignoreSitemap boolean",
    )
    assert [tuple(r) for r in sitemaps.root_sitemaps(rows).collect()] == [("t", "https://a.b/sitemap.xml")]


ROBOTS = (
    "Disallow: /before-any-agent\r\n"
    "User-agent: Alpha # first\r\n"
    "User-agent: beta\r\n"
    "Disallow: /private\r\n"
    "Allow: /private/open\r\n"
    "\r\n"
    "Crawl-delay: 3\r\n"
    "User-agent: *\r\n"
    "Disallow: /*.pdf$\r\n"
    "Disallow: /a.b\r\n"
    "Disallow:\r\n"
    "USER-AGENT: alpha\r\n"
    "DISALLOW : /more\r\n"
)


@pytest.mark.parametrize(
    ("agent", "path", "allowed"),
    [
        ("alpha", "/private/x", False),
        ("ALPHA", "/private/open/x", True),
        ("alpha", "/more", False),
        ("alpha", "/x.pdf", True),
        ("beta", "/more", True),
        ("beta", "/private", False),
        ("gamma", "/private", True),
        ("gamma", "/x.pdf", False),
        ("gamma", "/x.pdf?y", True),
        ("gamma", "/a.b", False),
        ("gamma", "/aXb", True),
        ("gamma", "/before-any-agent", True),
    ],
)
def test_robots(spark, agent, path, allowed):
    table = spark.createDataFrame([("t", ROBOTS)], "tag string, body string")
    rules = robots.robots_policy(table, agent)
    got = rules.select(robots.robots_allow(F.lit(path), F.col("robots_rules"))).first()[0]
    assert got is allowed


def test_robots_ties_and_missing_rules(spark):
    table = spark.createDataFrame(
        [("t", "User-agent: *\nDisallow: /x\nAllow: /x"), ("u", ""), ("v", None)], "tag string, body string"
    )
    rows = robots.robots_policy(table).select(
        "tag", robots.robots_allow(F.lit("/x"), F.col("robots_rules")).alias("ok")
    )
    assert {tuple(r) for r in rows.collect()} == {("t", True), ("u", True), ("v", True)}


def test_robots_rule_table(spark):
    table = spark.createDataFrame([("t", ROBOTS)], "tag string, body string")
    got = [tuple(r) for r in robots.parse_robots(table).orderBy("block", "pattern").collect()]
    assert got == [
        ("t", 1, ["alpha", "beta"], "disallow", "/private"),
        ("t", 1, ["alpha", "beta"], "allow", "/private/open"),
        ("t", 2, ["*"], "disallow", "/*.pdf$"),
        ("t", 2, ["*"], "disallow", "/a.b"),
        ("t", 3, ["alpha"], "disallow", "/more"),
    ]


def test_site_configs(spark, tmp_path):
    lines = [
        '{"domain":"a.b","scheme":"https"}',
        '{"domain":"c.d","scheme":"http","authorizedDomains":" x.y , z ","maxPages":5,"noDiscovery":true,'
        '"ignoreSitemap":1,"maxAge":60,"datasourceId":7,"callbackUrl":"u","callback":"search"}',
        '{"domain":"e.f","scheme":"http","authorizedDomains":["p","q"],"maxPages":null,"noDiscovery":false}',
        '{"domain":"no scheme"}',
        "not json",
    ]
    (tmp_path / "sites.jsonl").write_text("\n".join(lines))
    accepted, rejected = sites.read_site_configs(spark, str(tmp_path / "sites.jsonl"), "p1")
    rows = {r["domain"]: r for r in accepted.drop("data").collect()}
    assert tuple(rows["a.b"]) == (
        "crawling_a.b_p1", "a.b", "https", [], -1, None, False, False, -1, None, None,
    )
    assert tuple(rows["c.d"]) == (
        "crawling_c.d_p1", "c.d", "http", ["x.y", "z"], 5, "search", True, True, 60, "7", "u",
    )
    assert rows["e.f"]["authorizedDomains"] == ["p", "q"]
    assert rows["e.f"]["maxPages"] == -1 and rows["e.f"]["noDiscovery"] is False
    assert sorted(r["config"] for r in rejected.collect()) == sorted(lines[3:])


def test_item_json(spark):
    rows = spark.createDataFrame(
        [
            (None, None, None, "k", None, "", 0, None, "[]"),
            ("i", "c", dt.datetime(2016, 10, 17, 23, 29, 55), "k", "d", "t", 2, "s", '{"b":1}'),
        ],
        FRONTIER,
    )
    got = [r["json"] for r in items.item_to_json(rows).collect()]
    assert got[0] == '{"key":"k"}'
    assert got[1] == (
        '{"id":"i","class":"c","datetime":{"date":"2016-10-17 23:29:55.000000","timezone_type":3,'
        '"timezone":"UTC"},"key":"k","domain":"d","tag":"t","flag":2,"searchable":"s","data":{"b":1}}'
    )
    back = items.item_from_json(items.item_to_json(rows).select("json")).collect()
    assert tuple(back[1]) == tuple(rows.collect()[1])


def test_item_times(spark):
    texts = [
        '{"id":"a","datetime":"2016-10-17T23:29:55","x":1}',
        '{"id":"b","datetime":{"date":"2016-10-17 23:29:55.250000"}}',
        '{"id":"c"}',
        '{"id":"d","datetime":"17/10/2016"}',
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "json string")
    got = {r["id"]: r["datetime"] for r in items.item_from_json(rows, now=NOW).collect()}
    assert got == {
        "a": dt.datetime(2016, 10, 17, 23, 29, 55),
        "b": dt.datetime(2016, 10, 17, 23, 29, 55, 250000),
        "c": dt.datetime(2024, 1, 10),
        "d": None,
    }


def test_stored_data_is_decoded(spark):
    rows = spark.createDataFrame([("a", '{"domain":"x","n":1}'), ("b", None)], "id string, data string")
    got = items.decode_data(rows, "domain string").orderBy("id").select("data.domain").collect()
    assert [r[0] for r in got] == ["x", None]


def test_responses(spark, tmp_path):
    raw = spark.createDataFrame(
        [
            ("u1", 200, "Content-Type: text/html; charset=iso-8859-1\r\n", b"\xe9"),
            ("u2", 200, "Content-Type: TEXT/HTML\r\n", b"x"),
            ("u3", 500, "Content-Type: text/html\r\n", b"x"),
            ("u4", 200, "", b"x"),
        ],
        "url string, code int, raw_headers string, raw_body binary",
    )
    responses.parse_raw_responses(raw).write.parquet(str(tmp_path / "r"))
    stored = responses.read_responses(spark, str(tmp_path / "r"))
    marked = responses.mark_crawlable(stored).orderBy("url").collect()
    assert [r["crawlable"] for r in marked] == [True, False, False, False]
    assert marked[0]["body"] == "é"


@pytest.mark.parametrize(
    ("pattern", "path", "ok"),
    [
        ("/a*b$", "/axbxb", False),
        ("/a*b$", "/axbxc", True),
        ("/a*b", "/axbxc", False),
        ("/ab$", "/ab", False),
        ("/ab$", "/abc", True),
        ("/a*", "/a", False),
        ("/*$", "/anything", False),
        ("/a*a$", "/a", True),
        ("/a**c.html", "/abbc.html?x", False),
        ("/a.c", "/abc", True),
    ],
)
def test_globs(spark, pattern, path, ok):
    table = spark.createDataFrame([("t", f"User-agent: *\nDisallow: {pattern}")], "tag string, body string")
    rules = robots.robots_policy(table)
    assert rules.select(robots.robots_allow(F.lit(path), F.col("robots_rules"))).first()[0] is ok


def test_many_stars_cost_linear_time(spark):
    body = "User-agent: *\nDisallow: /" + "*a" * 8 + "b"
    table = spark.createDataFrame([("t", body, "/" + "a" * 2000)], "tag string, body string, path string")
    rules = robots.robots_policy(table.select("tag", "body")).crossJoin(table.select("path"))
    began = time.perf_counter()
    assert rules.select(robots.robots_allow(F.col("path"), F.col("robots_rules"))).first()[0] is True
    assert time.perf_counter() - began < 5


def test_repeated_domains_are_rejected(spark):
    texts = [('{"domain":"a.org","scheme":"http","maxPages":%d}' % n,) for n in (1, 2)]
    accepted, rejected = sites.site_configs(spark.createDataFrame(texts, "config string"), "p")
    assert [r["maxPages"] for r in accepted.collect()] == [1]
    assert [r["reason"] for r in rejected.collect()] == ["the domain has other settings in this run"]


def test_robots_come_from_answers_with_code_200(spark):
    hosts = spark.createDataFrame(
        [("a", "http", "a.org"), ("b", "https", "b.org"), ("c", "http", "c.org"), ("d", "http", "d.org")],
        "tag string, scheme string, domain string",
    )
    body = "User-agent: *\nDisallow: /x"
    answers = [
        ("a", "http://a.org/robots.txt", 200, body),
        ("a", "http://a.org/robots.txt", 200, body),
        ("a", "http://a.org/", 200, "<p>"),
        ("b", "https://b.org/robots.txt", 404, body),
        ("c", "https://c.org/robots.txt", 200, body),
        ("d", "http://d.org/robots.txt", 200, None),
        ("d", None, 200, body),
    ]
    answered = spark.createDataFrame(answers, "tag string, url string, code int, body string")
    found = robots.robots_from_responses(answered, hosts)
    assert sorted(map(tuple, found.collect())) == [("a", "a.org", body), ("d", "d.org", "")]
    assert [r["pattern"] for r in robots.parse_robots(found).collect()] == ["/x"]


def test_sitemaps_come_from_answers_with_code_200(spark):
    listing = "<urlset><url><loc>http://a.org/{}</loc></url></urlset>"
    answers = [
        ("http://a.org/sitemap.xml", 200, listing.format(2)),
        ("http://a.org/sitemap.xml", 200, listing.format(1)),
        ("http://a.org/gone.xml", 404, listing.format(3)),
        ("http://a.org/odd.xml", None, listing.format(4)),
        ("http://a.org/", 200, "<html></html>"),
        ("http://a.org/none", 200, None),
    ]
    answered = spark.createDataFrame(answers, "url string, code int, body string")
    found = sitemaps.parse_sitemaps(sitemaps.sitemaps_from_responses(answered)).collect()
    assert [(r["sitemap_url"], r["loc"]) for r in found] == [("http://a.org/sitemap.xml", "http://a.org/1")]
