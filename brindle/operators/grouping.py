"""Grouping, ranking and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(rows: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, numbered. Spark cuts each group to k rows before the shuffle
    (WindowGroupLimit). The order should end in a unique key."""
    window = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(window).cast("long")).filter(F.col(rank) <= k)


def sessions(events: DataFrame, by: str, at: str, gap_seconds: int, measures: dict[str, Column]) -> DataFrame:
    """One row a session: events of one key with no gap of gap_seconds or more between them."""
    before = F.lag(at).over(Window.partitionBy(by).orderBy(at))
    starts = before.isNull() | (F.col(at).cast("timestamp").cast("double") - before.cast("timestamp").cast("double") >= gap_seconds)
    number = F.sum(starts.cast("long")).over(Window.partitionBy(by).orderBy(at).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = events.withColumn("session", number)
    own = [F.min(at).alias("session_start"), F.max(at).alias("session_end"), F.count("*").alias("n_events")]
    return numbered.groupBy(by, "session").agg(*own, *(c.alias(n) for n, c in measures.items()))
