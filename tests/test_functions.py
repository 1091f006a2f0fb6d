"""Golden rows of the column rules."""

from __future__ import annotations

import html
import random
import time
from html.entities import name2codepoint

import pytest
from pyspark.sql import functions as F

from webfrontier.functions import entities, http, text, urls
from webfrontier.functions import html as page

X = F.col("x")

LINKS = [
    ("/a/b/", "internal", "https://www.ex.com/a/b"),
    ("//www.ex.com/a", "external", "http://www.ex.com/a"),
    ("//cdn.net/x.js", "external", "http://cdn.net/x.js"),
    ("#top", None, None),
    ("/a#b", None, None),
    ("mailto:a@b.c", None, None),
    ("mailto:a@b.c#x", None, None),
    ("../up", "internal", "https://www.ex.com/../up"),
    ("./x", "internal", "https://www.ex.com/./x"),
    ("https://www.ex.com", "internal", "https://www.ex.com"),
    ("https://www.ex.com.evil.org/", "internal", "https://www.ex.com.evil.org"),
    ("HTTPS://WWW.EX.COM/a", "internal", "https://www.ex.com/HTTPS://WWW.EX.COM/a"),
    ("http://www.ex.com/a", "external", "http://www.ex.com/a"),
    ("https://other.org//", "external", "https://other.org"),
    ("MAILTO:a@b.c", "internal", "https://www.ex.com/MAILTO:a@b.c"),
    ("javascript:void(0)", "internal", "https://www.ex.com/javascript:void(0)"),
    ("tel:+33", "internal", "https://www.ex.com/tel:+33"),
    ("?page=2", "internal", "https://www.ex.com/?page=2"),
    ("", "internal", "https://www.ex.com"),
    ("page.html", "internal", "https://www.ex.com/page.html"),
    ("httpdocs/x", "external", "httpdocs/x"),
    (" /a", "internal", "https://www.ex.com/ /a"),
    ("x\t\n/ ", "internal", "https://www.ex.com/x\t\n"),
]


def test_link_classification(spark):
    rows = spark.createDataFrame([(href,) for href, _, _ in LINKS], "x string")
    got = {
        r["x"]: r["c"]
        for r in rows.select(
            X, urls.classify_link(X, F.lit("www.ex.com"), F.lit("https")).alias("c")
        ).collect()
    }
    for href, kind, link in LINKS:
        expected = None if kind is None else (link, kind)
        assert (None if got[href] is None else tuple(got[href])) == expected, href


def test_protocol_relative_link_of_an_http_page_is_internal(one):
    c = one(urls.classify_link(X, F.lit("a.b"), F.lit("http")), "//a.b/c")
    assert tuple(c) == ("http://a.b/c", "internal")


@pytest.mark.parametrize(
    ("url", "domain", "scheme"),
    [
        ("HTTP://User@Ex.com:80/a", "user@ex.com:80", "http"),
        ("http://a.com?x=1", "a.com?x=1", "http"),
        ("http://É.com/", "É.com", "http"),
        ("a/b", None, None),
        ("a//B/c", "b", None),
        ("mailto:x", None, None),
        ("http://a.b/c//d", "a.b", "http"),
        (None, None, None),
    ],
)
def test_domain_and_scheme(one, url, domain, scheme):
    assert one(urls.url_domain(X), url) == domain
    assert one(urls.url_scheme(X), url) == scheme


ANCHORS = """<a class=x href='/q'><A
HREF="/w"><a href=/z><a href=""><abbr href="/no"><a data-href="/bad"><a href>
<a title="a>b" href="/gt"><a href=/it's>x</a><a title="href=/no" class='c'href=/c>
<!-- <a href=/hidden> --><script>"<a href=/script>"</script><style>a<a href=/style></style>
<a/href=/slash><a href = "/e&amp;x&eacute;" ><a name=q>"""


def test_anchor_extraction(one):
    assert one(page.anchor_hrefs(X), ANCHORS) == [
        "/q", "/w", "/z", "", "", "/gt", "/it's", "/c", "/slash", "/e&xé",
    ]


def test_long_tags_do_not_exhaust_the_stack(one):
    many = "".join(f' data-{i}="v{i}"' for i in range(20_000))
    assert one(page.anchor_hrefs(X), f"<a{many} href='/deep'>") == ["/deep"]


def test_links_once_per_type_in_page_order(one):
    body = '<a href="/b"><a href="/a"><a href="/b/"><a href="http://c.d/"><a href="/x y"><a href="http">'
    links = one(page.page_link_array(X, F.lit("e.f"), F.lit("http")), body)
    assert [tuple(r) for r in links] == [
        ("http://e.f/b", "internal"),
        ("http://e.f/a", "internal"),
        ("http://c.d", "external"),
        ("http://e.f/x y", "internal"),
        ("http", "external"),
    ]


def test_pages_with_very_many_links(one):
    body = "".join(f"<a href=/{i % 30_000}>" for i in range(60_000))
    links = one(page.page_link_array(X, F.lit("e.f"), F.lit("http")), body)
    assert len(links) == 30_000 and links[-1]["link"] == "http://e.f/29999"


def test_entities_are_decoded_once(one):
    given_text = "a &amp;lt; &copy; &middot; &eacute;&rsquo; &zz; &amp; x &"
    assert one(entities.decode_entities(X), given_text) == "a &lt; © · é’ &zz; & x &"
    numbers = "&#65;&#x42;&#X43;&#39;&#128;&#8364;&#xD800;&#0;&#99999999;"
    assert one(entities.decode_entities(X), numbers) == "ABC&#39;&#128;€&#xD800;&#0;&#99999999;"


def test_entities_agree_with_the_standard_library(spark):
    rng = random.Random(3)
    parts = ["&lt;", "&gt;", "&amp;", "&quot;", "&eacute;", "&#233;", "&Alpha;", "x", " ", "é", ";"]
    values = ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(500)]
    # The names of HTML 4, two of which later got another character.
    expected = {v: html.unescape(v) for v in values}
    expected |= {f"&{name};": chr(code) for name, code in name2codepoint.items()}
    rows = spark.createDataFrame([(v,) for v in expected], "x string")
    assert dict(rows.select(X, entities.decode_entities(X)).collect()) == expected


@pytest.mark.parametrize(
    ("markup", "expected"),
    [
        ("<body><p>x&nbsp;y</p><script>z</script>&lt;b&gt;w</body>", "x y w"),
        ("<head><title>t</title></head><BODY class=a>in <i>side</i>\n\n", "in side"),
        ("no body &amp; more", "no body & more"),
        ("<body>a<style>b</style><!-- c -->d</body> after", "a d"),
        ("<body>l&rsquo;x</body>", "l x"),
        ("", ""),
    ],
)
def test_visible_text(one, markup, expected):
    assert one(page.page_text(X), markup) == expected


@pytest.mark.parametrize(
    ("markup", "expected"),
    [
        ("<title> a &amp;  b\n</title><title>c</title>", "a &  b"),
        ("<TITLE lang=x>y</TITLE>", "y"),
        ("<!-- <title>no</title> --><title>yes</title>", "yes"),
        ("<p>none</p>", None),
    ],
)
def test_title(one, markup, expected):
    assert one(page.page_title(X), markup) == expected


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        ("http://h/p?a=1&b&a=2&c=3=4", [("a", "2")]),
        ("http://h/p?a=1?b=2", None),
        ("http://h/p?a=1#top", [("a", "1#top")]),
        ("http://h/p?=v&x=", [("", "v"), ("x", "")]),
        ("http://h/p", None),
    ],
)
def test_query_pairs(one, url, expected):
    got = one(urls.query_pairs(X), url)
    assert (None if got is None else [tuple(p) for p in got]) == expected


@pytest.mark.parametrize(
    ("words", "label"),
    [
        ("le le le", "not_fr"),
        ("le le le le", "fr"),
        ("LE\tle\nLe le", "fr"),
        ("le, le, le, le,", "not_fr"),
        ("le la est et au le la est et au le la est et au", "not_fr"),
        ("ale le le le", "not_fr"),
        ("", "not_fr"),
    ],
)
def test_french_label(one, words, label):
    assert one(text.french_label(X), words) == label


@pytest.mark.parametrize(
    ("words", "date"),
    [
        ("17 avril 2016 par", "17/04/2016"),
        ("7 mai 2016", "7/05/2016"),
        ("le 3 brumaire 1800", None),
        ("avril 2016", None),
    ],
)
def test_french_date(one, words, date):
    assert one(text.french_date(X), words) == date


def test_header_map(one):
    raw = (
        "HTTP/1.1 301 X\r\nLocation: /b\r\n\r\nHTTP/1.1 200 OK\r\n"
        "Content-Type: text/html\r\nX-A: 1:2\r\nx-a: 3\r\n"
    )
    assert one(http.header_map(X), raw) == {
        "location": "/b",
        "content-type": "text/html",
        "x-a": "3",
    }


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        (b"a\xc3b", "ab"),
        (b"\x80\xbfx", "x"),
        ("é€𝄞�".encode(), "é€𝄞�"),
        ("�".encode() + b"\xff", "�"),
        ("é€𝄞".encode()[:-1], "é€"),
        (b"\xed\xa0\x80y", "y"),
        (b"", ""),
    ],
)
def test_broken_bytes_are_dropped(one, raw, expected):
    assert one(http.drop_broken_bytes(X), raw, "binary") == expected


def test_broken_bytes_agree_with_the_standard_library(spark):
    rng = random.Random(5)
    parts = [b"a", "é".encode(), "€".encode(), "𝄞".encode(), b"\xc3", b"\xe2\x82", b"\x80", b"\xff", b"\xf4\x90"]
    values = [b"".join(rng.choices(parts, k=rng.randrange(10))) for _ in range(500)]
    values += [rng.randbytes(rng.randrange(40)) for _ in range(500)]
    rows = spark.createDataFrame([(bytearray(v),) for v in values], "x binary")
    for raw, clean in rows.select(X, http.drop_broken_bytes(X)).collect():
        assert clean == bytes(raw).decode("utf-8", "ignore"), raw


def test_charset(one):
    raw = "é".encode("latin-1")
    assert one(http.body_text(X, F.lit("text/html; charset=ISO-8859-1")), raw, "binary") == "é"
    assert one(http.body_text(X, F.lit("text/html")), raw, "binary") == ""
    assert one(http.body_text(X, F.lit(None).cast("string")), "é".encode(), "binary") == "é"


def test_form_body(one):
    body = http.form_body({"a": X, "b": F.lit(None).cast("string"), "c": F.lit("")})
    assert one(body, "x y*~é&") == "a=x+y%2A%7E%C3%A9%26&c="


def test_search_tokens(one):
    value = "Discovered https://www.ex.com/a page2.html 1,000 l'Été x_y"
    assert one(text.search_tokens(X), value) == [
        "discovered", "https", "www.ex.com", "a", "page2", "html", "1,000", "l'été", "x_y",
    ]


@pytest.mark.parametrize("start", ["<script>", "<style>", "<!--", "<title>", "<script ", "<title ", "<a ", "<body ", "<"])
@pytest.mark.parametrize("reader", [page.page_text, page.page_title, page.anchor_hrefs])
def test_unclosed_elements_cost_linear_time(spark, start, reader):
    body = start * (1_000_000 // len(start))
    row = spark.createDataFrame([(body,)], "body string")
    began = time.perf_counter()
    row.select(reader(F.col("body"))).collect()
    assert time.perf_counter() - began < 8  # a second or less alone; quadratic time would be minutes


def test_unclosed_blocks(spark):
    def read(function, body):
        return spark.createDataFrame([(body,)], "body string").select(function(F.col("body"))).first()[0]

    assert read(page.page_title, "<title>a") is None
    assert read(page.page_title, "<script>x<title>a</title>") is None
    assert read(page.page_title, "<title></title>") == ""
    assert read(page.page_text, "a<script>b") == "a b"
    assert read(page.page_text, "a<script>b</script>c<script>d") == "ac d"
    assert read(page.page_text, "a<script <script>b</script>c < d") == "ac < d"
    assert read(page.page_text, "a<style>b</script>c</style>d</script") == "ad</script"
    assert read(page.anchor_hrefs, "<a href=x>1</a><!-- <a href=y>") == ["x"]
    assert read(page.anchor_hrefs, "<a href=x>1</a><a href=y") == ["x"]
