"""Seeds, link rules, rounds and the closure, against small brute-force versions."""

from __future__ import annotations

import re

import random

import pytest
from pyspark.sql import functions as F

from webfrontier.model import DONE, NEW, SIGNATURE
from webfrontier.operators import callbacks, discovery, links, seeds, skew

NOW = "2024-01-01 00:00:00"
SITES = (
    "tag string, domain string, scheme string, authorizedDomains array<string>, noDiscovery boolean, "
    "ignoreSitemap boolean, data string"
)


@pytest.fixture(scope="module")
def sites(spark):
    return spark.createDataFrame(
        [
            ("t", "a.b", "http", ["c.d", "e.f", "c.d"], False, False, "{t}"),
            ("u", "u.u", "https", [], False, True, "{u}"),
            ("v", "v.v", "https", ["c.d"], True, False, "{v}"),
        ],
        SITES,
    )


LINKS = [
    ("t", "http://a.b", "internal", "http://a.b/ok"),
    ("t", "http://a.b/2", "internal", "http://a.b/ok"),
    ("t", "http://a.b", "internal", "http://a.b/no/x"),
    ("t", "http://a.b", "internal", "http://a.b"),
    ("t", "http://a.b", "external", "http://c.d/no/1"),
    ("t", "http://a.b", "external", "http://x.c.d/1"),
    ("t", "http://a.b", "external", "http://E.F/1"),
    ("u", "https://u.u", "internal", "https://u.u/no/x"),
    ("u", "https://u.u", "external", "http://c.d/1"),
    ("v", "https://v.v", "internal", "https://v.v/1"),
    ("gone", "https://g", "internal", "https://g/1"),
]


@pytest.fixture(scope="module")
def found(spark):
    return spark.createDataFrame(LINKS, "tag string, page string, link_type string, link string")


@pytest.fixture(scope="module")
def robots(spark):
    rows = [("t", "a.b", "User-agent: *\nDisallow: /no"), ("v", "v.v", "")]
    return spark.createDataFrame(rows, "tag string, host string, body string")


def test_link_rules(found, sites, robots):
    by_robots = links.allowed_by_robots(found, robots)
    assert {r["link"] for r in by_robots.collect()} == {
        "http://a.b/ok", "http://a.b", "https://u.u/no/x", "https://v.v/1", "https://g/1",
    }
    domains = links.in_allowed_domains(found, sites)
    assert sorted(r["link"] for r in domains.collect()) == ["http://E.F/1", "http://c.d/no/1"]
    allowed = links.allowed_links(found, links.site_policy(sites, robots))
    assert {r["link"] for r in allowed.collect()} == {
        "http://a.b/ok", "http://a.b", "http://c.d/no/1", "http://E.F/1", "https://u.u/no/x",
    }


def test_robots_of_the_links_own_host(spark, robots):
    rows = [("t", "p", "internal", "http://a.b/no"), ("z", "p", "internal", "http://a.b/no"), ("t", "p", "internal", "http://q/no")]
    table = spark.createDataFrame(rows, "tag string, page string, link_type string, link string")
    kept = links.allowed_by_robots(table, robots, scope="host").collect()
    assert [tuple(r) for r in kept] == [rows[2]]


def test_one_round(spark, found, sites, robots):
    known = spark.createDataFrame([("t", "http://a.b"), ("t", "http://E.F/1")], "tag string, key string")
    rows = discovery.discover_round(known, found, links.site_policy(sites, robots), NOW).collect()
    got = {(r["tag"], r["key"], r["domain"], r["flag"], r["searchable"], r["data"]) for r in rows}
    assert got == {
        ("t", "http://a.b/ok", "a.b", NEW, "Discovered http://a.b/ok from http://a.b", "{t}"),
        ("t", "http://c.d/no/1", "c.d", NEW, "Discovered http://c.d/no/1 from http://a.b", "{t}"),
        ("u", "https://u.u/no/x", "u.u", NEW, "Discovered https://u.u/no/x from https://u.u", "{u}"),
    }
    assert len(rows) == 3


def test_seeds(spark, sites):
    urls = spark.createDataFrame([("t", "http://a.b/1"), ("t", "http://a.b/1"), ("u", "ignored")], "tag string, loc string")
    rows = seeds.seed_urls(sites, urls, NOW)
    assert sorted((r["tag"], r["key"], r["searchable"]) for r in rows.collect()) == [
        ("t", "http://a.b/1", "Crawling domain a.b from sitemap.xml"),
        ("t", "http://a.b/1", "Crawling domain a.b from sitemap.xml"),
        ("u", "https://u.u", "Crawling domain u.u"),
        ("v", "https://v.v", "Crawling domain v.v"),
    ]
    signed = seeds.signature_rows(sites, NOW, "77").collect()
    assert {(r["tag"], r["key"], r["flag"], r["data"]) for r in signed} == {
        (t, "77", SIGNATURE, "{" + t + "}") for t in "tuv"
    }


def _walk(starts, edges, caps, silent):
    """Breadth-first by plain Python: {(tag, key): (depth, parent, flag)}."""
    out = {}
    for tag in {t for t, _ in starts}:
        level = {k: None for t, k in starts if t == tag}
        depth, used, cap = 0, 0, caps.get(tag, -1)
        while level:
            active = sorted(k for k in level if k not in silent)
            if cap > 0:
                active = active[: max(cap - 1 - used, 0)]
            used += len(active)
            for key, parent in level.items():
                out[tag, key] = (depth, parent, DONE if key in active else NEW)
            nxt = {}
            for t, s, d in edges:
                if t == tag and s in active and (tag, d) not in out:
                    nxt[d] = min(s, nxt.get(d, s))
            level, depth = nxt, depth + 1
    return out


@pytest.mark.parametrize(
    ("caps", "heavy_rows", "silent", "shrink_rows"),
    [
        ({}, 10**9, (), 10**9),
        ({}, 1, (), 1),
        ({"a": 20, "b": 1, "c": 0}, 10**9, (), 1),
        ({"a": 9}, 1, ("hub", "3", "c4"), 10**9),
    ],
)
def test_closure(spark, caps, heavy_rows, silent, shrink_rows):
    rng = random.Random(7)
    edges = [(t, str(rng.randrange(60)), str(rng.randrange(60))) for t in "abc" for _ in range(90)]
    # A hub whose links are a third of all, and a chain that outlasts the merging of known pieces.
    edges += [("a", "hub", str(i)) for i in range(100)] + [("a", "5", "hub"), ("a", "5", "hub")]
    edges += [("b", f"c{i}", f"c{i + 1}") for i in range(9)] + [("b", "0", "c0")]
    starts = [("a", "0"), ("a", "hub"), ("b", "0"), ("b", "0"), ("c", "1"), ("lonely", "x")]
    table = discovery.discover(
        spark.createDataFrame(starts, "tag string, key string"),
        spark.createDataFrame(edges, "tag string, src string, dst string"),
        spark.createDataFrame(list(caps.items()), "tag string, maxPages int") if caps else None,
        answered=_answered(spark, edges, starts, silent) if silent else None,
        heavy_rows=heavy_rows,
        shrink_rows=shrink_rows,
    )
    rows = table.collect()
    got = {(r["tag"], r["key"]): (r["depth"], r["parent"], r["flag"]) for r in rows}
    assert len(rows) == len(got)
    assert got == _walk(starts, edges, caps, silent)


def _answered(spark, edges, starts, silent):
    names = {(t, k) for t, s, d in edges for k in (s, d)} | set(starts)
    rows = [(t, k) for t, k in names if k not in silent]
    return spark.createDataFrame(rows, "tag string, key string")


@pytest.mark.parametrize("shrink_rows", [2, 10**9])
def test_a_chain_is_walked_to_its_end(spark, shrink_rows):
    names = [f"{i:02}" for i in range(22)]
    back = [("t", names[i], names[i // 2]) for i in range(0, 22, 3)]
    edges = spark.createDataFrame([*zip("t" * 21, names, names[1:]), *back], "tag string, src string, dst string")
    start = spark.createDataFrame([("t", "00")], "tag string, key string")
    rows = discovery.discover(start, edges, shrink_rows=shrink_rows).collect()
    assert sorted((r["key"], r["depth"], r["flag"]) for r in rows) == [(x, i, 0) for i, x in enumerate(names)]


def test_known_urls_lie_in_few_pieces_and_are_merged_once_per_size(spark, monkeypatch):
    """Sizes alone: pieces stay few over many rounds, and merges touch a URL a logarithm of times."""
    moved = []

    class Piece:
        def unionByName(self, other):  # noqa: N802
            return self

    monkeypatch.setattr(discovery, "_placed", lambda rows, *on: moved.append(1) or rows)
    monkeypatch.setattr(discovery, "reduce", lambda function, pieces: pieces[0])
    known, merged = [(Piece(), 1)], 0
    for _ in range(3000):
        before = dict((id(p), n) for p, n in known)
        known = discovery._merged([*known, (Piece(), 1)])
        merged += sum(n for p, n in known if before.get(id(p), n) != n)
    assert sum(n for _, n in known) == 3001 and len(known) <= 3 * 7
    assert merged <= 3001 * 7


@pytest.mark.parametrize(("cap", "kept"), [(5, 4), (1, 0), (-1, 10), (0, 10), (11, 10), (10, 9)])
def test_page_cap(spark, cap, kept):
    rows = spark.createDataFrame([("t", f"k{i}") for i in range(10)] + [("free", "x")], "tag string, key string")
    caps = spark.createDataFrame([("t", cap)], "tag string, maxPages int")
    got = discovery.cap_pages(rows, caps, ["key"]).collect()
    assert sorted(r["key"] for r in got if r["tag"] == "t") == [f"k{i}" for i in range(kept)]
    assert [r["key"] for r in got if r["tag"] == "free"] == ["x"]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_equals_a_plain_join(spark, how):
    facts = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot"))
        .when(F.col("id") % 7 == 0, F.lit(None))
        .otherwise(F.concat(F.lit("k"), F.col("id") % 50))
        .alias("tag"),
        F.col("id").alias("row"),
    )
    lookup = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), ("k2", 4), ("unused", 5)], "tag string, v int")
    heavy = skew.heavy_keys(facts, ["tag"], min_rows=100)
    splits = {r["tag"]: r["splits"] for r in heavy.collect()}
    assert set(splits) == {"hot", None} and splits["hot"] == 334
    spread = skew.spread_join(facts, lookup, ["tag"], how, ["row"], heavy)
    plain = facts.join(lookup, "tag", how)
    order = lambda df: sorted(map(repr, df.select(sorted(df.columns)).collect()))
    assert order(spread) == order(plain)


def test_few_rows_have_no_heavy_keys(spark):
    facts = spark.createDataFrame([("t",)] * 10, "tag string")
    assert skew.heavy_keys(facts, ["tag"]) is None
    assert skew.heavy_keys(facts, ["tag"], min_rows=5, at_most=4) is None


def test_payload(spark, tmp_path):
    html = {"content-type": "text/html"}
    pages = spark.createDataFrame(
        [
            ("t", "u1", 200, html, "<title>x</title>b"),
            ("t", "u2", 404, html, "<title>y</title>"),
            ("t", "u3", 200, html, "<title> </title>"),
            ("no sink", "u4", 200, html, "z"),
        ],
        "tag string, url string, code int, headers map<string,string>, body string",
    )
    rows = [("t", "", "http://sink", "search"), ("no sink", "d", None, "search")]
    rows += [("other", "d", "http://sink", "unknown"), ("none", "d", "http://sink", None)]
    table = spark.createDataFrame(rows, "tag string, datasourceId string, callbackUrl string, callback string")
    more = pages.where("url = 'u4'")
    for tag in ("other", "none"):
        pages = pages.unionByName(more.withColumn("tag", F.lit(tag)))
    got = {r["url"]: tuple(r)[1:4] for r in callbacks.payload(pages, table, "search").collect()}
    assert got == {
        "u1": (None, "x", "<title>x</title>b"),
        "u2": (None, None, None),
        "u3": (None, None, "<title> </title>"),
    }
    callbacks.deliver(pages, table, str(tmp_path / "sink"))
    assert spark.read.parquet(str(tmp_path / "sink")).count() == 3
    done = spark.createDataFrame([("t", "u1")], "tag string, key string")
    assert [r["url"] for r in callbacks.payload(pages, table, "search", done).collect()] == ["u1"]
    forms = callbacks.with_form_body(callbacks.payload(pages, table, "search")).where("url = 'u1'").first()
    assert forms["form"] == "title=x&html=%3Ctitle%3Ex%3C%2Ftitle%3Eb&url=u1"


def test_bodies_of_stored_responses_are_not_shuffled(spark, tmp_path):
    pages = spark.range(40).selectExpr(
        "concat('t', id % 2) AS tag", "concat('u', id) AS url", "200 AS code",
        "map('content-type', 'text/html') AS headers", "concat('<title>', id, '</title>') AS body",
    )
    rows = [("t0", "d", "http://sink", "search"), ("t1", "d", "http://sink", None)]
    table = spark.createDataFrame(rows, "tag string, datasourceId string, callbackUrl string, callback string")
    # A cap stopped the others.
    done = pages.where("url IN ('u1', 'u2', 'u4', 'u6')").select("tag", F.col("url").alias("key"))
    stored = callbacks.store_responses(pages, "stored_responses", str(tmp_path / "responses"), 4)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = callbacks.payload(stored, table, "search", done)
        assert sorted(r["title"] for r in found.collect()) == ["2", "4", "6"]
        text = found._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        )
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    inputs = re.findall(r"Exchange\s*\nInput \[\d+\]: \[(.*)\]", text)
    assert inputs and not any("body" in columns for columns in inputs)
    spark.sql("DROP TABLE stored_responses")


def test_own_callback(spark):
    class Lengths:
        settings_fields: list[str] = []

        def project(self, documents):
            return documents.select("url", F.length("html").alias("n"))

    callbacks.register("lengths", Lengths())
    pages = spark.createDataFrame(
        [("t", "u", 200, {"content-type": "text/html"}, "abc")],
        "tag string, url string, code int, headers map<string,string>, body string",
    )
    sites = spark.createDataFrame([("t", "lengths")], "tag string, callback string")
    assert [tuple(r) for r in callbacks.payload(pages, sites, "lengths").collect()] == [("u", 3)]
    del callbacks.REGISTRY["lengths"]


def test_host_files_of_several_runs_give_each_link_once(spark):
    found = spark.createDataFrame(
        [("t", "p", "internal", "http://h.org/a"), ("t", "p", "internal", "http://h.org/b")],
        "tag string, page string, link_type string, link string",
    )
    body = "User-agent: *\nDisallow: /b"
    files = spark.createDataFrame([("t", "h.org", body), ("t2", "h.org", body)], "tag string, host string, body string")
    heavy = spark.createDataFrame([("t", 3)], "tag string, splits int")
    for known in (skew.MEASURE, None, heavy):
        rows = links.allowed_by_robots(found, files, scope="host", heavy=known).collect()
        assert [r["link"] for r in rows] == ["http://h.org/a"]
