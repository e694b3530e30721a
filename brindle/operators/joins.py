"""As-of and interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _seconds(df: DataFrame, at: str, column: Column) -> Column:
    """A time as seconds; a number as it is."""
    kind = df.schema[at].dataType.typeName()
    return column.cast("timestamp").cast("double") if kind.startswith("timestamp") or kind == "date" else column


def as_of(
    left: DataFrame, right: DataFrame, by: list[str], at: str, values: list[str],
    strict: bool = False, width: int = 86_400, forward: bool = False, tolerance: float | None = None,
) -> DataFrame:
    """left with the values of the last right row of the same keys at or before (strict: before) its
    time; null where there is none. forward: of the first one at or after (after) it. tolerance: only of one that is no
    further away (in seconds of a timestamp, else units of the number).

    Time is cut into buckets of width (likewise). Both sides are united and
    a window over key and bucket carries the values forward; what a bucket takes over from the ones before is the
    last value of the nearest that has any, found on a table of one row a bucket. Linear in the rows, and a key
    with very many is spread over its buckets. Rows with a null key or time match nothing. Of right rows at one time the
    greatest by values counts.
    """
    packed = F.struct(*values)
    keyed = [F.col(k) for k in by]
    first, second = (1, 0) if strict else (0, 1)
    facts = right.groupBy(*by, at).agg(F.max(packed).alias("_value"))
    value = F.struct(F.col(at).alias("at"), F.col("_value").alias("of"))
    facts = facts.select(*keyed, F.col(at).alias("_at"), F.lit(first).alias("_side"), value.alias("_value"), F.lit(None).alias("_row"))
    rows = left.select(
        *keyed, F.col(at).alias("_at"), F.lit(second).alias("_side"), F.lit(None).alias("_value"), F.struct(*left.columns).alias("_row")
    )
    both = rows.unionByName(facts.filter(F.col("_at").isNotNull())).withColumn("_bucket", F.floor(_seconds(left, at, F.col("_at")) / width))

    def ordered(name: str) -> Column:
        return F.col(name).desc() if forward else F.col(name).asc()

    here = Window.partitionBy(*by, "_bucket").orderBy(ordered("_at"), "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Left rows' own columns play no part in the buckets' table.
    end = (F.min_by if forward else F.max_by)("_value", F.when(F.col("_value").isNotNull(), F.col("_at")))
    buckets = both.groupBy(*by, "_bucket").agg(end.alias("_end"))
    earlier = Window.partitionBy(*by).orderBy(ordered("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select(*keyed, "_bucket", F.last("_end", ignorenulls=True).over(earlier).alias("_carry"))
    matched = both.withColumn("_last", F.last("_value", ignorenulls=True).over(here)).filter("_row IS NOT NULL")
    matched = matched.join(buckets, [*by, "_bucket"], "left")
    known = F.lit(True)
    for column in [*keyed, F.col("_at")]:
        known = known & column.isNotNull()
    found = F.coalesce("_last", "_carry")
    if tolerance is not None:
        known = known & (F.abs(_seconds(left, at, F.col("_at")) - _seconds(left, at, found["at"])) <= tolerance)
    return matched.select("_row.*", *(F.when(known, found["of"][v]).alias(v) for v in values))


def interval(left: DataFrame, right: DataFrame, on: Column, left_at: str, right_at: str, width: int, within: Column) -> DataFrame:
    """Pairs that satisfy ``on`` and ``within``, where within implies that the times (as numbers) are
    less than ``width`` apart. Times are cut into bins of that width and each left row looks into
    its own bin and both neighbours, so Spark can hash-join on the bin instead of comparing all."""
    bins = F.array(*(F.floor(F.col(left_at) / width) + d for d in (-1, 0, 1)))
    a = left.withColumn("_bin", F.explode(bins))
    b = right.withColumn("_near", F.floor(F.col(right_at) / width))
    return a.join(b, on & (F.col("_bin") == F.col("_near")) & within).drop("_bin", "_near")
