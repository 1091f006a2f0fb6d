"""Joins of many rows with one row per key, where a single key may own a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is heavy when it owns more than 1/SHARES of all rows, so there are never more than SHARES
# heavy keys, and the splits of all of them together stay below 2 * SHARES.
SHARES = 1000
# Below this many rows a key fits one task anyway.
HEAVY_ROWS = 200_000
# Default of `heavy`: measure the keys of the rows to be joined.
MEASURE = "measure"


def heavy_keys(
    rows: DataFrame, on: list[str], min_rows: int = HEAVY_ROWS, at_most: int | None = None
) -> DataFrame | None:
    """``(*on, splits)`` for the heavy keys of ``rows``, or None when there are none.

    Runs one counting pass over the key columns, unless ``rows`` is known to hold ``at_most`` too few
    rows, and a second one only when a key may be heavy. The result holds at most ``SHARES`` rows,
    whatever the input, so it is fetched and becomes a local table.
    """
    if at_most is not None and at_most < min_rows:
        return None
    counts = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    total, largest = counts.agg(F.sum("_rows"), F.max("_rows")).first()
    if largest is None or largest < min_rows or largest * SHARES <= total:
        return None
    share = F.col("_rows") * SHARES / F.lit(total)
    heavy = counts.where((share > 1) & (F.col("_rows") >= min_rows)).select(
        *on, F.ceil(share).cast("int").alias("splits")
    )
    found = heavy.collect()
    return rows.sparkSession.createDataFrame(found, heavy.schema) if found else None


def spread_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: list[str],
    how: str = "left",
    spread_by: list[str] | None = None,
    heavy: DataFrame | None | str = MEASURE,
) -> DataFrame:
    """Joins ``facts`` with a ``lookup`` table, splitting the ``heavy`` keys of ``facts`` over many tasks.

    Rows of a heavy key get one of ``splits`` salts from a hash of ``spread_by``, and the lookup rows of
    that key are repeated once per salt. Without heavy keys it is a plain join: Spark broadcasts a
    lookup side that is small by its own size check, and shuffles both sides otherwise.
    ``heavy`` is measured on ``facts``, or given as a result of ``heavy_keys`` on a smaller table with the
    same shares and on some of the columns in ``on``. ``how``: inner, left, left_semi or left_anti.
    """
    if isinstance(heavy, str):
        heavy = heavy_keys(facts, on)
    if heavy is None:
        return facts.join(lookup, on, how)
    keys = [c for c in heavy.columns if c != "splits"]
    spread_by = spread_by or [c for c in facts.columns if c not in on]
    salt = _salt(keys, spread_by)
    salted = facts.join(heavy, keys, "left").withColumn("_salt", salt).drop("splits")
    repeated = (
        lookup.join(heavy, keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("splits", F.lit(1)) - 1)))
        .drop("splits")
    )
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


def _salt(keys: list[str], spread_by: list[str]) -> Column:
    spread = F.xxhash64(*spread_by)
    no_key = F.lit(False)
    for name in keys:
        no_key = no_key | F.col(name).isNull()
    # Rows without a key match nothing, so any salt will do for them.
    parts = F.when(no_key, F.lit(SHARES)).otherwise(F.coalesce("splits", F.lit(1)))
    return F.pmod(spread, parts).cast("int")
