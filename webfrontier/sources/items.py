"""Frontier rows to and from JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"
OBJECT_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"

_ITEM = (
    "struct<id:string,class:string,datetime:string,key:string,domain:string,tag:string,"
    "flag:int,searchable:string,data:string>"
)


def item_to_json(frontier: DataFrame, out: str = "json") -> DataFrame:
    """Adds the row as JSON; empty text, flag 0, and empty data are left out, like NULLs."""

    def text(name: str) -> Column:
        return F.nullif(F.col(name), F.lit("")).alias(name)

    moment = F.when(
        F.col("datetime").isNotNull(),
        F.struct(
            F.date_format("datetime", OBJECT_FORMAT).alias("date"),
            F.lit(3).alias("timezone_type"),
            F.current_timezone().alias("timezone"),
        ),
    )
    data = F.when(~F.col("data").isin("", "[]", "{}", "0", "false", "null", '""'), F.col("data"))
    fields = [
        text("id"),
        text("class"),
        moment.alias("datetime"),
        text("key"),
        text("domain"),
        text("tag"),
        F.nullif(F.col("flag"), F.lit(0)).alias("flag"),
        text("searchable"),
        F.try_parse_json(data).alias("data"),
    ]
    return frontier.withColumn(out, F.to_json(F.struct(*fields)))


def item_from_json(rows: DataFrame, json_col: str = "json", now: str | None = None) -> DataFrame:
    """JSON text to frontier columns; the time is ISO text or an object with a ``date``.

    Without a time the row gets ``now``; a time in any other form becomes NULL.
    """
    item = F.from_json(json_col, _ITEM)
    written = F.col("_item.datetime")
    inner = F.get_json_object(F.when(F.startswith(written, F.lit("{")), written), "$.date")
    # A failed parse is costly, so only text that may be a time is tried.
    plain = F.when(~F.startswith(written, F.lit("{")), written)
    moment = F.coalesce(
        F.try_to_timestamp(plain, F.lit(ISO_FORMAT)),
        F.try_to_timestamp(inner, F.lit(OBJECT_FORMAT)),
        F.when(written.isNull(), F.to_timestamp(F.lit(now))) if now else F.lit(None),
    )
    others = [c for c in rows.columns if c != json_col]
    return rows.withColumn("_item", item).select(
        *others,
        "_item.id",
        "_item.class",
        moment.alias("datetime"),
        "_item.key",
        "_item.domain",
        "_item.tag",
        "_item.flag",
        "_item.searchable",
        "_item.data",
    )


def decode_data(frontier: DataFrame, schema: str, out: str = "data") -> DataFrame:
    """Stored rows with their ``data`` JSON text turned into a struct of the given schema."""
    return frontier.withColumn(out, F.from_json("data", schema))
