"""Connected components of links between ids, on Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def _state(links: DataFrame) -> tuple:
    """Equal for equal sets of links; one row reaches the driver."""
    row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return tuple(row)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component, the smallest id reachable, for every id that has a link.

    Alternates large stars (each node's larger neighbours link to its smallest) and small stars (its
    smaller ones do) until nothing changes. The smallest is an aggregate with a map-side combine and
    is joined back, so a node with very many links is not gathered in one task."""
    u, v = F.greatest(a, b), F.least(a, b)
    links = cut(links.select(u.alias("u"), v.alias("v")).filter("u > v").distinct())
    state = _state(links)
    while state[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.filter("u > v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v")))
        links = cut(small.filter("u > v").distinct())
        before, state = state, _state(links)
        if state == before:
            break
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
