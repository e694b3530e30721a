"""Order within groups of any size: rows are sorted over range partitions, so that a group with a third of all rows
lies in many of them, and what a row needs from before its partition is a sum over partitions.

A window over a group would sort all of it in one task. Here one shuffle sorts, and a table with one row for
each group and partition that it lies in carries the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared_folder import cut

#: Bits of a row's place within its partition, as monotonically_increasing_id() packs it.
PLACE_BITS = 33


def in_order(rows: DataFrame, by: list[str], order: list[Column], parts: int | None = None) -> DataFrame:
    """rows with _part and _at, the range partition of the order (by, order) that each lies in and its place there,
    from a checkpoint: bounds of ranges are sampled, so what follows must see one division only. The order
    should be total, or equal rows may take either place."""
    keys = [F.col(f"`{c}`").asc_nulls_first() for c in by] + order
    ranged = rows.repartitionByRange(parts, *keys) if parts else rows.repartitionByRange(*keys)
    place = ranged.sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    part, at = F.shiftright("_id", PLACE_BITS), F.col("_id").bitwiseAND((1 << PLACE_BITS) - 1)
    return cut(place.withColumn("_part", part).withColumn("_at", at).drop("_id"))


def same(a: str, b: str, columns: list[str]) -> Column:
    """Equal in all columns, nulls too, for a join of DataFrames with these aliases."""
    found = F.lit(True)
    for c in columns:
        found = found & F.col(f"{a}.`{c}`").eqNullSafe(F.col(f"{b}.`{c}`"))
    return found


def carried(ordered: DataFrame, by: list[str], measures: dict[str, Column], before: dict[str, Column]) -> DataFrame:
    """Of each group in each partition: the measures of its rows there, and values ``before`` of those measures, each
    an aggregate over the group's partitions before this one (it becomes a window; null if there is none)."""
    runs = ordered.groupBy(*(F.col(f"`{c}`") for c in by), "_part").agg(*(m.alias(n) for n, m in measures.items()))
    earlier = Window.partitionBy(*(F.col(f"`{c}`") for c in by)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumns({n: c.over(earlier) for n, c in before.items()})


def joined(ordered: DataFrame, runs: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """ordered with values of the runs that carried() gave. A run is no larger than a partition, so the key of this
    join is never hot."""
    keys = [*by, "_part"]
    return ordered.alias("l").join(runs.alias("r"), same("l", "r", keys)).select("l.*", *(F.col(f"r.`{v}`") for v in values))


def numbered(ordered: DataFrame, by: list[str], name: str, size: str | None = None) -> DataFrame:
    """ordered with each row's place in its group, from 0, and with the group's size."""
    measures = {"_first": F.min("_at"), "_n": F.count("*")}
    runs = carried(ordered, by, measures, {"_before": F.sum("_n")})
    runs = runs.withColumn("_offset", F.coalesce("_before", F.lit(0)) - F.col("_first"))
    more = []
    if size:
        runs = runs.withColumn(size, F.sum("_n").over(Window.partitionBy(*(F.col(f"`{c}`") for c in by))))
        more = [size]
    return joined(ordered, runs, by, ["_offset", *more]).withColumn(name, F.col("_at") + F.col("_offset")).drop("_offset")
