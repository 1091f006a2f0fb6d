"""Row layouts and the states of a frontier row."""

from __future__ import annotations

from pyspark.sql import types as T

# States of a frontier row (fixed values).
NEW = 2
PROCESSING = 1
DONE = 0
SIGNATURE = -1

FRONTIER = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("class", T.StringType()),
        T.StructField("datetime", T.TimestampType()),
        T.StructField("key", T.StringType()),
        T.StructField("domain", T.StringType()),
        T.StructField("tag", T.StringType()),
        T.StructField("flag", T.IntegerType()),
        T.StructField("searchable", T.StringType()),
        T.StructField("data", T.StringType()),
    ]
)

# An event is a frontier row plus its place in time; `deleted` marks a tombstone.
EVENT_ORDER = ["event_time", "event_no"]

RESPONSES = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("code", T.IntegerType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("body", T.StringType()),
    ]
)

# Site settings as they come in; typed values and defaults follow when they are read.
SITE = T.StructType(
    [
        T.StructField("domain", T.StringType()),
        T.StructField("scheme", T.StringType()),
        T.StructField("authorizedDomains", T.StringType()),
        T.StructField("maxPages", T.StringType()),
        T.StructField("callback", T.StringType()),
        T.StructField("noDiscovery", T.StringType()),
        T.StructField("ignoreSitemap", T.StringType()),
        T.StructField("maxAge", T.StringType()),
        T.StructField("datasourceId", T.StringType()),
        T.StructField("callbackUrl", T.StringType()),
    ]
)

SITEMAP_XML = (
    "struct<url:array<struct<loc:string,lastmod:string>>,sitemap:array<struct<loc:string>>>"
)
