"""From known pages to new URLs: one round, and all rounds until nothing new appears."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from webfrontier.model import DONE, NEW
from webfrontier.operators.links import may_follow
from webfrontier.operators.ranking import selected
from webfrontier.operators.seeds import frontier_row
from webfrontier.operators.skew import HEAVY_ROWS, MEASURE, heavy_keys, spread_join
from webfrontier.session import cut_and_count, cut_lineage, scratch_table

# Known URLs are kept in co-partitioned pieces; so many of about the same size are merged into one of the next size.
KNOWN_PIECES = 4
# Edges one task of a round should handle, at most and at least.
EDGES_PER_PARTITION = 1_000_000
MIN_EDGES_PER_PARTITION = 20_000


def new_urls(
    links: DataFrame,
    known: DataFrame,
    policy: DataFrame,
    heavy: DataFrame | None | str = MEASURE,
) -> DataFrame:
    """``(tag, key, parent, data)``: URLs that may be followed and have no row yet, each once.

    ``links`` is ``(tag, page, link_type, link)``. Repeated links are folded into one row per URL before
    and after the only shuffle of links, known URLs drop out in the same partitions, and the rules
    are applied to what is left, with one join on the tag. The parent is the first page by name of
    those whose link is allowed.
    """
    page, kind = F.col("page"), F.col("link_type")
    folded = links.groupBy("tag", F.col("link").alias("key")).agg(
        F.min(F.when(kind == "internal", page)).alias("_inside"),
        F.min(F.when(kind == "external", page)).alias("_outside"),
    )
    unknown = folded.join(known.select("tag", "key"), ["tag", "key"], "left_anti")
    ruled = spread_join(unknown, policy, ["tag"], "inner", ["key"], heavy)
    parent = F.least(
        F.when(may_follow(F.col("key"), F.lit("internal")), F.col("_inside")),
        F.when(may_follow(F.col("key"), F.lit("external")), F.col("_outside")),
    )
    # The array keeps the filter from being merged with the rules, which would then be tested twice.
    tested = ruled.select("tag", "key", "data", F.array(parent).alias("_parents"))
    found = tested.select("tag", "key", F.explode_outer("_parents").alias("parent"), "data")
    return found.where(F.col("parent").isNotNull())


def discover_round(
    frontier: DataFrame,
    links: DataFrame,
    policy: DataFrame,
    now: str,
    heavy: DataFrame | None | str = MEASURE,
) -> DataFrame:
    """New frontier rows from the links ``(tag, page, link_type, link)`` of the pages of one round.

    ``heavy`` names the large tags; by default their shares are taken from the frontier.
    """
    if isinstance(heavy, str):
        heavy = heavy_keys(frontier, ["tag"])
    return discovered_rows(new_urls(links, frontier, policy, heavy), now)


def discovered_rows(urls: DataFrame, now: str) -> DataFrame:
    """Frontier rows of new URLs; they inherit the settings of their run."""
    label = F.concat(F.lit("Discovered "), F.col("key"), F.lit(" from "), F.col("parent"))
    return urls.select(*frontier_row(F.col("key"), F.col("tag"), label, F.col("data"), now))


def cap_pages(rows: DataFrame, caps: DataFrame, order: list[str]) -> DataFrame:
    """Pages processed under each site's page cap: a cap of N lets N - 1 pages through.

    ``caps`` is ``(tag, maxPages)``; a cap of 0 or below is none. Only rows of tags that exceed their cap are
    exchanged, and only the piece around a tag's last kept row is sorted.
    """
    sizes = rows.groupBy("tag").agg(F.count(F.lit(1)).alias("_size"))
    limited = (
        caps.where(F.col("maxPages") > 0)
        .join(sizes, "tag")
        .where(F.col("_size") >= F.col("maxPages"))
        .select("tag", (F.col("maxPages") - 1).alias("_keep"))
    )
    return keep_first(rows, limited, order)


def keep_first(rows: DataFrame, limited: DataFrame, order: list[str]) -> DataFrame:
    """Keeps the first ``_keep`` rows of the tags in ``limited`` and all rows of other tags."""
    marked = cut_lineage(spread_join(rows, limited, ["tag"], "left", order))
    free = marked.where(F.col("_keep").isNull()).drop("_keep")
    first = selected(marked.where(F.col("_keep").isNotNull()), ["tag"], order, "_keep")
    return free.unionByName(first.drop("_keep"))


def _loop_session(spark: SparkSession, edge_rows: int) -> SparkSession:
    """A session for the rounds. Adaptive planning is off in it, because only then does a checkpoint
    keep its hash partitioning and order, so that a round merges edges and known URLs where they lie,
    without a shuffle, a sort or a broadcast. The number of partitions follows the number of edges."""
    session = spark.newSession()
    small = min(spark.sparkContext.defaultParallelism, edge_rows // MIN_EDGES_PER_PARTITION)
    partitions = max(1, small, edge_rows // EDGES_PER_PARTITION)
    session.conf.set("spark.sql.shuffle.partitions", partitions)
    session.conf.set("spark.sql.adaptive.enabled", "false")
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    session.conf.set("spark.sql.session.timeZone", "UTC")
    return session


def _handed_over(rows: DataFrame, session: SparkSession, name: str) -> DataFrame:
    """The rows as a table of the other session."""
    return session.read.parquet(_stored(rows, name))


def _stored(rows: DataFrame, name: str) -> str:
    path = scratch_table(rows.sparkSession, name)
    rows.write.parquet(path)
    return path


def _placed(rows: DataFrame, *on: str) -> DataFrame:
    """Checkpoint hash-partitioned by the given columns and sorted by them within each partition."""
    return cut_lineage(rows.repartition(*on).sortWithinPartitions(*on))


def discover(
    seeds: DataFrame,
    edges: DataFrame,
    caps: DataFrame | None = None,
    answered: DataFrame | None = None,
    heavy_rows: int = HEAVY_ROWS,
    shrink_rows: int = EDGES_PER_PARTITION,
) -> DataFrame:
    """All URLs reachable from the seeds: ``(tag, key, depth, parent, flag)``.

    ``seeds`` is ``(tag, key)``, ``edges`` is ``(tag, src, dst)`` of links that may be followed, ``caps``
    is ``(tag, maxPages)``, ``answered`` is ``(tag, key)`` of URLs that have a response (all, when not
    given). Rows without a response, and rows a cap leaves unprocessed, stay in the state "new"; only
    processed rows count for the cap and are followed further.

    Edges are written and partitioned once by (tag, src). A round joins them with the URLs found
    last, which lie in the same partitions, reduces the targets to distinct URLs (the only shuffle) and
    removes the known ones. The URLs found last lead the merge, so a partition without any of them reads no
    edges. A source is followed once: when half of the edges, and ``shrink_rows`` at least, have been followed since the last
    time, those of all known sources are dropped in place, so all these passes together read two times the edges. Known URLs lie
    in pieces of growing sizes, and a URL is merged once per size. Sources with very many edges are joined apart: there are at
    most ``SHARES`` of them, so their side is broadcast.
    """
    spark = seeds.sparkSession
    edge_path = _stored(edges.select("tag", "src", "dst"), "edges")
    unfollowed, followed = spark.read.parquet(edge_path).count(), 0
    session = _loop_session(spark, unfollowed)
    edges = session.read.parquet(edge_path)
    large = heavy_keys(edges, ["tag", "src"], heavy_rows)
    wide = None
    if large is not None:
        large = F.broadcast(large.drop("splits"))
        wide = cut_lineage(edges.join(large, ["tag", "src"], "left_semi"))
        edges = edges.join(large, ["tag", "src"], "left_anti")
    edges = _placed(edges, "tag", "src")
    limits = None
    if caps is not None:
        limited = caps.select("tag", "maxPages").where(F.col("maxPages") > 0)
        limits = _handed_over(limited, session, "caps")
        if limits.isEmpty():
            limits = None
    if answered is not None:
        answered = answered.select("tag", "key").distinct()
        answered = _placed(_handed_over(answered, session, "answered"), "tag", "key")
    done = None

    first = _handed_over(seeds.select("tag", "key").distinct(), session, "seeds")
    fresh = _placed(first.withColumn("parent", F.lit(None).cast("string")), "tag", "key")
    known: list[tuple[DataFrame, int]] = [(fresh.select("tag", "key"), 1)]
    levels: list[DataFrame] = []
    out = scratch_table(spark, "found")
    depth = 0
    while True:
        active = fresh
        if answered is not None:
            active = fresh.join(answered, ["tag", "key"], "left_semi")
        if limits is not None:
            active, done = _within_caps(active, limits, done)
        levels.append(_level(fresh, active).withColumn("depth", F.lit(depth)))
        sources = active.select("tag", F.col("key").alias("src"))
        targets = sources.join(edges, ["tag", "src"])
        if wide is not None:
            # At most SHARES sources are large, so this side is small whatever the input.
            few = F.broadcast(sources.join(large, ["tag", "src"], "left_semi"))
            targets = targets.unionByName(wide.join(few, ["tag", "src"]).select(*targets.columns))
        seen = Observation()
        targets = targets.observe(seen, F.count(F.lit(1)).alias("rows"))
        found = targets.groupBy("tag", F.col("dst").alias("key")).agg(F.min("src").alias("parent"))
        for piece, _ in known:
            found = found.join(piece, ["tag", "key"], "left_anti")
        fresh, size = cut_and_count(found)
        if not size:
            break
        followed += seen.get["rows"]
        if followed >= max(shrink_rows, unfollowed / 2):
            edges = cut_lineage(_without(edges, known))
            if wide is not None:
                gone = reduce(DataFrame.unionByName, [_as_sources(piece) for piece, _ in known])
                large = cut_lineage(large.join(gone, ["tag", "src"], "left_anti"))
                large = F.broadcast(large)  # Still at most SHARES rows.
                wide = cut_lineage(wide.join(large, ["tag", "src"], "left_semi"))
            unfollowed, followed = max(0, unfollowed - followed), 0
        known = _merged([*known, (fresh.select("tag", "key"), size)])
        if len(levels) >= KNOWN_PIECES:
            _append(levels, out)
            levels = []
        depth += 1
    _append(levels, out)
    return spark.read.parquet(out).select("tag", "key", "depth", "parent", "flag")


def _as_sources(urls: DataFrame) -> DataFrame:
    return urls.select("tag", F.col("key").alias("src"))


def _without(edges: DataFrame, known: list[tuple[DataFrame, int]]) -> DataFrame:
    """The edges whose source is in no piece; pieces and edges lie in the same partitions, in the same order."""
    for piece, _ in known:
        edges = edges.join(_as_sources(piece), ["tag", "src"], "left_anti")
    return edges


def _merged(known: list[tuple[DataFrame, int]]) -> list[tuple[DataFrame, int]]:
    """The pieces with their sizes, after the last ones have been merged if enough of them are no larger than the last, counted
    in powers of KNOWN_PIECES. So there are at most a few pieces of each power, and a merge lifts all its URLs by one."""

    def power(size: int) -> int:
        return int(math.log(size, KNOWN_PIECES))

    start = len(known)
    while start and power(known[start - 1][1]) <= power(known[-1][1]):
        start -= 1
    last = known[start:]
    if len(last) < KNOWN_PIECES:
        return known
    together = _placed(reduce(DataFrame.unionByName, [piece for piece, _ in last]), "tag", "key")
    return _merged([*known[:start], (together, sum(size for _, size in last))])


def _level(fresh: DataFrame, active: DataFrame) -> DataFrame:
    """The URLs of one round with their state: done when active, else still new."""
    if active is fresh:
        return fresh.withColumn("flag", F.lit(DONE))
    processed = active.select("tag", "key", F.lit(DONE).alias("flag"))
    return fresh.join(processed, ["tag", "key"], "left").fillna(NEW, ["flag"])


def _append(levels: list[DataFrame], path: str) -> None:
    if levels:
        reduce(DataFrame.unionByName, levels).write.mode("append").parquet(path)


def _within_caps(
    fresh: DataFrame, limits: DataFrame, done: DataFrame | None
) -> tuple[DataFrame, DataFrame]:
    """The part of this level its tags may still process, and the pages that tags with a cap have
    processed so far."""
    sizes = fresh.groupBy("tag").agg(F.count(F.lit(1)).alias("_size"))
    if done is None:
        sizes = sizes.withColumn("_done", F.lit(0).cast("bigint"))
    else:
        sizes = sizes.join(done, "tag", "full").fillna(0, ["_size", "_done"])
    keep = F.greatest(F.col("maxPages") - 1 - F.col("_done"), F.lit(0))
    beyond = F.col("_size") > F.col("_keep")
    counted, over = cut_and_count(sizes.join(limits, "tag").withColumn("_keep", keep), beyond)
    done = counted.select("tag", (F.col("_done") + F.least("_size", "_keep")).alias("_done"))
    if not over:
        return fresh, done
    limited = counted.where(beyond).select("tag", "_keep")
    return cut_lineage(keep_first(fresh, limited, ["key"])), done
