"""Ranks within groups of any size: a few hot groups with most of the rows are spread over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared_folder import cut
from . import ranges

KINDS = ("row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile")


def ranks(rows: DataFrame, by: list[str], order: list[str], names: dict[str, str], ties: list[str] | None = None, tiles: int = 4) -> DataFrame:
    """rows with the ranks that names asks for (kind: column name), as window functions over by and order (ascending,
    nulls first) give them. Rows with equal values of order are peers; ties orders peers for row_number and ntile.

    Rows lie in range partitions of (by, order, ties), and each rank is a figure of its partition plus one carried over
    the group's other partitions: rows and first peers before it, the next first peer after it. Use a plain window
    where every group is small."""
    unknown = set(names) - set(KINDS)
    if unknown:
        raise ValueError(f"{sorted(unknown)} are none of {KINDS}")
    keys = [F.col(f"`{c}`") for c in by]
    value = F.struct(*(F.col(f"`{c}`") for c in order))
    ordered = ranges.in_order(rows, by, [F.col(f"`{c}`").asc_nulls_first() for c in [*order, *(ties or [])]])
    measures = {"_first": F.min("_at"), "_n": F.count("*"), "_tail": F.max_by(value, "_at")}
    runs = ranges.carried(ordered, by, measures, {"_rows": F.sum("_n"), "_previous": F.last("_tail")})
    runs = runs.withColumn("_size", F.sum("_n").over(Window.partitionBy(*keys)))
    placed = ranges.joined(ordered, runs, by, ["_first", "_rows", "_previous", "_size"])
    here = Window.partitionBy(*keys, "_part").orderBy("_at")
    place = F.col("_at") - F.col("_first") + F.coalesce("_rows", F.lit(0))
    before = F.when(F.col("_at") == F.col("_first"), F.col("_previous")).otherwise(F.lag(value).over(here))
    placed = placed.withColumn("_place", place).withColumn("_new", (F.col("_place") == 0) | ~value.eqNullSafe(before))
    placed = cut(placed.withColumn("_start", F.when(F.col("_new"), F.col("_place"))).drop("_first", "_rows", "_previous"))
    # The first peers of each partition, carried forward and back.
    measures = {"_peers": F.count("_start"), "_last": F.max("_start"), "_least": F.min("_start")}
    runs = ranges.carried(placed, by, measures, {"_groups": F.sum("_peers"), "_open": F.max("_last")})
    # What is ahead is looked up backwards: Spark reads a frame that ends the group anew for each row.
    later = Window.partitionBy(*keys).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_next", F.min("_least").over(later))
    both = ranges.joined(placed, runs, by, ["_groups", "_open", "_next"])
    so_far = here.rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys, "_part").orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, -1)
    rank = F.coalesce(F.max("_start").over(so_far), F.col("_open")) + 1
    end = F.coalesce(F.min("_start").over(ahead), F.col("_next"), F.col("_size"))
    found = {
        "row_number": F.col("_place") + 1,
        "rank": rank,
        "dense_rank": F.coalesce("_groups", F.lit(0)) + F.count("_start").over(so_far),
        "percent_rank": F.when(F.col("_size") > 1, (rank - 1) / (F.col("_size") - 1)).otherwise(F.lit(0.0)),
        "cume_dist": end / F.col("_size"),
        "ntile": _tile(F.col("_place"), F.col("_size"), tiles),
    }
    return both.select(*(F.col(f"`{c}`") for c in rows.columns), *(found[k].alias(n) for k, n in names.items()))


def _tile(place: Column, size: Column, tiles: int) -> Column:
    """Tiles differ by one row at most, the larger ones first."""
    small, more = F.floor(size / tiles), size % tiles
    large = more * (small + 1)
    return F.when(place < large, F.floor(place / (small + 1))).otherwise(more + F.floor((place - large) / F.greatest(small, F.lit(1)))).cast("long") + 1
