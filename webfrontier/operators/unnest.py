"""Arrays to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(rows: DataFrame, keep: list[str], array: Column, name: str | None = None) -> DataFrame:
    """One row per element of ``array``: its fields for structs, else one column called ``name``.

    The elements (or their first field) must not be NULL. The outer form is used because Spark puts a
    filter on the array below a plain one, and so would compute a costly array a second time.
    """
    made = F.inline_outer(array) if name is None else F.explode_outer(array).alias(name)
    out = rows.select(*keep, made)
    return out.where(F.col(out.columns[len(keep)]).isNotNull())
