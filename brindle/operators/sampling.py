"""Samples that depend on keys alone: the same rows on every run, engine and division into partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a key's draw.
BITS = 48


def draw(key: Column, seed: str) -> Column:
    """A number in [0, 1) for each key, null for null: 48 bits of a digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("double") / float(1 << BITS)


def by_key(rows: DataFrame, key: str, share: float, seed: str) -> DataFrame:
    """Rows whose key is drawn, all rows of a key or none: tables sampled by one key and seed still join."""
    return rows.filter(draw(F.col(f"`{key}`"), seed) < share)


def stratified(rows: DataFrame, key: str, stratum: str, shares: dict, seed: str, other: float = 0.0) -> DataFrame:
    """Rows whose key is drawn with the share of their stratum; other is that of strata without one, null among them."""
    share = F.lit(other)
    for value, own in shares.items():
        share = F.when(F.col(f"`{stratum}`") == value, own).otherwise(share)
    return rows.filter(draw(F.col(f"`{key}`"), seed) < share)
