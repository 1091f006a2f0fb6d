"""Runs the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

A query runs twice and the second time counts, so that code generation and JVM warm-up do not; queries that
walk many rounds run once.
"""

from __future__ import annotations

import json
import os
import time

from webfrontier.plans.queries import QUERIES
from webfrontier.session import build_session

ROUNDS = {"discover_closure", "discover_capped", "crawl_run"}
HEADLINE = [
    "link_extract",
    "page_titles",
    "page_text",
    "page_documents",
    "lang_label",
    "lang_confusion",
    "word_counts",
    "query_params",
    "header_map",
    "charset_fix",
    "utf8_clean",
    "item_from_json",
    "frontier_upsert",
    "frontier_fifo",
    "frontier_next_batch",
    "crawl_stats",
    "crawl_report",
    "sitemap_tree",
    "seed_urls",
    "robots_filter",
    "external_allowed",
    "callback_payload",
    "discover_round",
    "discover_closure",
    "discover_capped",
    "crawl_run",
    "stream_discover",
    "stream_stats",
    "stream_payload",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["pages_by_domain"](spark, sf_dir).collect()  # starts the JVM side
    seconds = {}
    for name in HEADLINE:
        for _ in range(1 if name in ROUNDS else 2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    result = {
        "metric": "headline queries, total time",
        "value": total,
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
