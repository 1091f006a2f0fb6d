"""The URL filter: rules, the model against a plain fit of its weights, odd rows, and its SQL."""

from __future__ import annotations

import glob
import hashlib
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from webfrontier.llm import url_filter
from webfrontier.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, host int, score string, rule int, html string"


@pytest.fixture(scope="module")
def model(spark):
    return url_filter.train(url_filter.labelled_urls(spark))


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [rest.find(c) for c in "/?#" if c in rest]
    host, rest = (rest[: min(ends)], rest[min(ends) :]) if ends else (rest, "")
    ends = [rest.find(c) for c in "?#" if c in rest]
    return "".join(c.lower() if c.isascii() else c for c in host), rest[: min(ends)] if ends else rest


def numbers(url):
    found = set()
    for mark, part in zip("hp", parts(url)):
        text = f"^{part}$"
        for size in url_filter.SIZES:
            for at in range(len(text) - size + 1):
                found.add(int(hashlib.md5((mark + text[at : at + size]).encode()).hexdigest()[:4], 16))
    return found


def plain_weights():
    """The same descent on the weights themselves."""
    lines = [line.split(" ", 1) for line in url_filter.LABELLED.strip().split("\n")]
    rows = [(float(label == "block"), numbers(url)) for label, url in lines]
    weights, bias = dict.fromkeys(set().union(*(x for _, x in rows)), 0.0), 0.0
    for _ in range(url_filter.STEPS):
        errors = []
        for y, x in rows:
            score = bias + sum(weights[b] for b in x) / math.sqrt(len(x))
            errors.append((y - 1 / (1 + math.exp(-score))) * url_filter.RATE / len(rows))
        keep = 1 - url_filter.RATE * url_filter.DECAY
        bias = bias * keep + sum(errors)
        weights = {b: w * keep for b, w in weights.items()}
        for error, (_, x) in zip(errors, rows):
            for b in x:
                weights[b] += error / math.sqrt(len(x))
    return bias, weights


def test_weights_are_those_of_the_plain_descent(model):
    bias, weights = plain_weights()
    assert model["bias"] / url_filter.SCALE == pytest.approx(bias, abs=1e-6)
    found = {b: w / url_filter.SCALE for b, w in enumerate(model["weights"]) if w}
    assert found == pytest.approx({b: weights[b] for b in found}, abs=1e-6)
    assert all(abs(w) < 1e-6 for b, w in weights.items() if b not in found)


URLS = [
    ("http://com/x", "com", "/x", "com/", "allow"),
    ("http://a.com/", "a.com", "/", "com/", "allow"),
    ("http://com", "com", "", None, None),
    ("http://xcom/", "xcom", "/", None, None),
    ("HTTPS://Example.COM/en/1?q#f", "example.com", "/en/1", "example.com/en/", "block"),
    ("http://m.example.com/en/", "m.example.com", "/en/", "example.com/en/", "block"),
    ("http://example.com/en", "example.com", "/en", "com/", "allow"),
    ("http://example.com/EN/", "example.com", "/EN/", "com/", "allow"),
    ("http://www.example.com/en/7", "www.example.com", "/en/7", "www.example.com/en/", "allow"),
    ("http://a.www.example.com/en/7", "a.www.example.com", "/en/7", "www.example.com/en/", "allow"),
    ("http://x.net/es/", "x.net", "/es/", "net/es/", "block"),
    ("http://x.net?/es/", "x.net", "", None, None),
    ("http://x.net/fr/#a", "x.net", "/fr/", "net/fr/", "block"),
    ("http://x.net:80/fr/", "x.net:80", "/fr/", None, None),
    ("ftp://É.com/ü", "É.com", "/ü", "com/", "allow"),
    ("a://b://c.com/", "b:", "//c.com/", None, None),
    ("no scheme", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("://", "", "", None, "allow"),
    ("http://line\nbreak.org/a\nb", "line\nbreak.org", "/a\nb", None, None),
    ("http://www.casino-bets.org/win", "www.casino-bets.org", "/win", None, "block"),
    ("http://thornhill.org/de/5", "thornhill.org", "/de/5", None, "allow"),
]


def test_odd_urls(spark, model):
    rows = [(None if n == 1 else n, url, 1, "s", 2, None) for n, (url, *_) in enumerate(URLS)]
    found = url_filter.judge_urls(spark.createDataFrame([*rows, rows[0]], SCHEMA), model).collect()
    assert len(found) == len(rows) + 1 and found[0] == found[-1]
    bias, weights = model["bias"], model["weights"]
    for row, (url, host, path, rule, verdict) in zip(found, URLS):
        assert (row["host"], row["path"], row["rule"]) == (host, path, rule) == (*parts(url), rule)
        if rule is None:
            x = numbers(url)
            score = bias + sum(weights[b] for b in x) / math.sqrt(max(len(x), 1))
            assert row["score"] == pytest.approx(score)
            assert row["verdict"] == ("block" if score > 0 else "allow")
        assert verdict in (None, row["verdict"])


def test_long_urls_and_empty_tables(spark, model):
    long = f"http://{'casino-' * 3_000}.org/{'slots/' * 3_000}"
    found = url_filter.judge_urls(spark.createDataFrame([(1, long, 1, "s", 2, "h")], SCHEMA), model).first()
    assert (len(found["path"]), found["verdict"]) == (18_001, "block")
    nothing = url_filter.judge_urls(spark.createDataFrame([], SCHEMA), model)
    assert nothing.columns == ["page_id", "host", "path", "rule", "score", "verdict"] and nothing.isEmpty()


def test_learning_without_rows(spark):
    model = url_filter.train(spark.createDataFrame([], "url string, label string"))
    assert (model["bias"], set(model["weights"]), len(model["weights"])) == (0, {0}, url_filter.BUCKETS)


def test_repeated_and_unlabelled_rows_change_nothing(spark, model):
    labelled = url_filter.labelled_urls(spark)
    again = labelled.unionByName(labelled.limit(5)).unionByName(labelled.withColumn("label", F.lit(None).cast("string")))
    assert url_filter.train(again) == model


def test_query_and_its_sql(spark):
    found = QUERIES["op11_url_filter"](spark, SF)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{glob.glob(SF + '/pages.parquet')[0]}'")
    expected = duck.execute(f"SELECT {', '.join(found.columns)} FROM ({ORACLE['op11_url_filter']})").fetchall()
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, expected))
    assert expected


def test_spam_hosts_are_told_from_others(spark, model):
    """Held-out accuracy: none of these hosts is in the labelled table."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    spam = F.col("host").rlike("casino|pills|bets|adult|ads-|spam")
    judged = url_filter.judge_urls(pages, model, rules=[]).select(spam.alias("spam"), (F.col("verdict") == "block").alias("block"))
    right = judged.agg(F.avg((F.col("spam") == F.col("block")).cast("double"))).first()[0]
    caught = judged.where("spam").agg(F.avg(F.col("block").cast("double"))).first()[0]
    print(f"held out: accuracy {right:.4f}, caught {caught:.4f}")
    assert right > 0.99 and caught > 0.8
