"""Exact positions within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webfrontier.operators.skew import spread_join
from webfrontier.session import cut_and_count, cut_lineage

# Up to this k Spark keeps the first k rows per group before it shuffles them (its default threshold).
TOP_K_LIMIT = 1000
# Bits of a row's number within its partition, as Spark's increasing ids have them (fixed value).
PIECE_BITS = 33
PIECE_ROWS = 1 << PIECE_BITS
# A table with one row per group is broadcast when it was counted to have at most this many rows.
BROADCAST_GROUPS = 100_000


def ranked(
    rows: DataFrame,
    group: list[str],
    order: list[str],
    name: str = "position",
    broadcast_groups: int = BROADCAST_GROUPS,
) -> DataFrame:
    """Adds the 1-based position of each row in its group; no group is gathered in one task. Rows without a group are left out.

    Rows are exchanged once, into ranges of group and order, and numbered where they lie in the order they are written in. A
    row's place among all rows is that number plus the rows of earlier pieces, and its position is the distance to the place
    of the group's first row. What is joined for that is one row per piece and one row per group.
    """
    number = F.monotonically_increasing_id()  # The piece, and 33 bits for the place in it.
    pieces = cut_lineage(
        rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("_number", number)
    )
    # One row per piece, so its size is that of the shuffle's partition count.
    sizes = pieces.groupBy(_piece("_number").alias("_piece")).agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1))
    earlier = F.broadcast(cut_lineage(sizes.select("_piece", F.coalesce(before, F.lit(0)).alias("_before"))))

    def placed(numbered: DataFrame, place: str) -> DataFrame:
        joined = numbered.withColumn("_piece", _piece("_number")).join(earlier, "_piece")
        within = F.col("_number").bitwiseAND(F.lit(PIECE_ROWS - 1))
        return joined.withColumn(place, within + F.col("_before")).drop("_piece", "_before", "_number")

    first = placed(pieces.groupBy(*group).agg(F.min("_number").alias("_number")), "_first")
    joined = _with_group(placed(pieces, name), first, group, order, broadcast_groups)
    return joined.withColumn(name, F.col(name) - F.col("_first") + 1).drop("_first")


def _with_group(
    rows: DataFrame, groups: DataFrame, on: list[str], order: list[str], broadcast_groups: int
) -> DataFrame:
    """The rows with the one row of their group: in place while there are few groups, else by a join that splits large ones."""
    groups, count = cut_and_count(groups)
    if count <= broadcast_groups:
        return rows.join(F.broadcast(groups), on)
    return spread_join(rows, groups, on, "inner", order)


def _piece(number: str) -> Column:
    return F.shiftright(number, PIECE_BITS)


def selected(
    rows: DataFrame, group: list[str], order: list[str], keep: str, broadcast_groups: int = BROADCAST_GROUPS
) -> DataFrame:
    """The first ``keep`` rows of every group, a column with one value per group; rows with equal order count one by one.

    Nothing is sorted but the one piece of a group in which its last kept row lies: rows are exchanged into ranges, and the
    sizes of the pieces tell which of them are kept or dropped whole.
    """
    pieces = cut_lineage(rows.repartitionByRange(*group, *order).withColumn("_piece", F.spark_partition_id()))
    sizes = pieces.groupBy(*group, "_piece").agg(F.count(F.lit(1)).alias("_rows"), F.first(keep).alias("_keep"))
    earlier = Window.partitionBy(*group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("_keep") - F.coalesce(F.sum("_rows").over(earlier), F.lit(0))
    reached = sizes.withColumn("_room", room).where(F.col("_room") > 0)
    last = reached.groupBy(*group).agg(
        F.max("_piece").alias("_last"),
        F.max_by(F.struct("_room", "_rows"), "_piece").alias("_at"),
    )
    joined = _with_group(pieces, last, group, order, broadcast_groups).where(F.col("_piece") <= F.col("_last"))
    cut = (F.col("_piece") == F.col("_last")) & (F.col("_at")["_room"] < F.col("_at")["_rows"])
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    border = joined.where(cut).withColumn("_place", place).where(F.col("_place") <= F.col("_at")["_room"])
    return joined.where(~cut).unionByName(border.drop("_place")).drop("_piece", "_last", "_at")


def first_rows(rows: DataFrame, group: list[str], order: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of every group, with their position."""
    if k > TOP_K_LIMIT:
        return ranked(rows, group, order).where(F.col("position") <= k)
    window = Window.partitionBy(*group).orderBy(*order)
    placed = rows.withColumn("position", F.row_number().over(window)).where(F.col("position") <= k)
    return placed.withColumn("position", F.col("position").cast("bigint"))
