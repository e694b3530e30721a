"""Exact percentiles by distributed selection: no task sees a group's values in order, however many there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared_folder import cut

#: Bins into which an interval is cut in each round.
BINS = 1024
#: Intervals (groups by wanted ranks) that are broadcast, some 10 MB; more are joined by a shuffle.
MOST = 50_000


def quantiles(values: DataFrame, by: str, value: str, places: list[tuple[str, float]]) -> DataFrame:
    """by and, for each (name, share) of places, the interpolated percentile of the group's values, exactly.

    The values at the ranks that a share lies between are searched by intervals: each round counts the values of
    every open interval in BINS bins, with partial counts before the shuffle, and goes on with the bins that hold a
    wanted rank, from their least to their greatest value, until these are equal. A round is one pass over the
    values, kept narrow in a checkpoint; two or three are enough for most, as each divides an interval by BINS. Null and
    non-finite values are left out; a group without others has no row."""
    number = F.col(f"`{value}`").cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < F.lit(float("inf")))
    rows = cut(values.filter(finite).select(F.col(f"`{by}`").alias("_k"), number.alias("_v")))
    sizes = cut(rows.groupBy("_k").agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))

    def place(share: float) -> Column:
        return (F.col("_n") - 1) * F.lit(share)

    wanted = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(place(s)), F.ceil(place(s))) for _, s in places))))
    intervals = sizes.select("_k", "_lo", "_hi", F.lit(0).cast("long").alias("_before"), wanted.alias("_ranks"))
    found = []
    while True:
        intervals = cut(intervals)
        found.append(intervals.filter("_lo = _hi"))
        left = intervals.filter("_lo < _hi")
        n = left.count()
        if not n:
            break
        intervals = _refined(rows, F.broadcast(left) if n <= MOST else left)
    at = found[0]
    for other in found[1:]:
        at = at.unionByName(other)
    at = at.select("_k", "_lo", F.explode("_ranks").alias("_r")).groupBy("_k").agg(F.map_from_entries(F.collect_list(F.struct("_r", "_lo"))).alias("_at"))
    both = sizes.alias("s").join(at.alias("a"), F.col("s._k").eqNullSafe(F.col("a._k"))).select("s._k", "_n", "_at")

    def between(share: float) -> Column:
        low, high = (F.element_at("_at", f(place(share))) for f in (F.floor, F.ceil))
        return low + (high - low) * (place(share) - F.floor(place(share)))

    return both.select(F.col("_k").alias(by), *(between(s).alias(name) for name, s in places))


def _refined(rows: DataFrame, intervals: DataFrame) -> DataFrame:
    """The bins of intervals that hold wanted ranks, as intervals."""
    inside = F.col("r._k").eqNullSafe(F.col("i._k")) & F.col("_v").between(F.col("_lo"), F.col("_hi"))
    # A difference of doubles may be infinite, that of their halves can't; it may be 0 for the least ones.
    wide = F.col("_hi") - F.col("_lo")
    halves = F.try_divide(F.col("_v") / 2 - F.col("_lo") / 2, F.col("_hi") / 2 - F.col("_lo") / 2)
    share = F.when(wide < F.lit(float("inf")), F.try_divide(F.col("_v") - F.col("_lo"), wide)).otherwise(halves)
    bin_ = F.least(F.floor(share * BINS), F.lit(BINS - 1))
    hits = rows.alias("r").join(intervals.alias("i"), inside).select("i._k", "_lo", "_hi", "_before", "_ranks", bin_.alias("_bin"), "_v")
    bins = hits.groupBy("_k", "_lo", "_hi", "_before", "_ranks", "_bin").agg(F.count("*").alias("_n"), F.min("_v").alias("_l"), F.max("_v").alias("_h"))
    # BINS rows at most for each interval.
    up_to = F.col("_before") + F.sum("_n").over(Window.partitionBy("_k", "_lo", "_before").orderBy("_bin"))
    bins = bins.withColumn("_to", up_to).withColumn("_from", F.col("_to") - F.col("_n"))
    own = F.filter("_ranks", lambda r: (r >= F.col("_from")) & (r < F.col("_to")))
    return bins.select("_k", F.col("_l").alias("_lo"), F.col("_h").alias("_hi"), F.col("_from").alias("_before"), own.alias("_ranks")).filter("size(_ranks) > 0")
