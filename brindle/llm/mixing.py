"""Mixing sources to target weights by Pareto order sampling.

Each source's target is its weight's share of all words, but at most MAX_COPIES times its own words;
what is cut off goes to the others by weight. A target of k whole times the source and a rest takes
every document k times for certain, and a sample once more. A document's chance to be in the sample is
proportional to a weight, by default the number of bits of its size, so that a document of twice the
words is a little likelier, and 1 at most; what that cuts off raises the chances of the others, and
chances times sizes add up to the rest. Documents are ranked by random odds divided by their inclusion
odds (Pareto order sampling; the odds of the random number u are u / (1 - u)), those of chance 1 first,
and taken in this order while they come nearer to the rest. The sample's size is fixed in words, so a
source misses its target by half of one document at most.

No source is gathered anywhere: chances follow from the words of each weight (few if weights are few,
as numbers of bits are), a histogram of ranks gives each source's bucket where its sample
ends, only that bucket is ranked exactly, and the last rank taken becomes a threshold that each row
is held against. The rows with their texts are never shuffled unless there are more than
BROADCAST_SOURCES sources.

Defined results: a null text has no words. A null source is a source of its own, after all others.
The random number comes from the key and a seed, so reruns agree; rows with equal keys (null is a
key) are taken or left together. A source without words has target 0. An empty table gives none.
Input columns named like a result's are replaced. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
#: Parts of the range of ranks; the sample ends in one of them.
BUCKETS = 1 << 14
BROADCAST_SOURCES = 50_000
SEED = "mix-1"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(key: Column, seed: str = SEED) -> Column:
    """A random number between 0 and 1, of 48 bits, from the key."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def n_bits(size: Column) -> Column:
    return F.length(F.bin(size))


def _odds(u: Column) -> Column:
    return u / (1 - u)


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """_source, source_size and target of each source. Sources by code point, null last, have the
    weights in turn. A source is capped if the level at which the uncapped share out what the
    capped leave is above its own; sorted by their caps per weight, the capped come first."""
    sources = sized.groupBy("_source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    by_cap = Window.orderBy("_limit", F.col("_source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    capped = F.col("_level") >= F.col("_limit")
    level = F.min(F.when(~capped, F.struct("_at", "_level"))).over(everything)["_level"]
    return (
        sources.withColumn("_weight", weight.cast("double"))
        .withColumn("_cap", MAX_COPIES * F.col("source_size"))
        .withColumn("_limit", F.col("_cap") / F.col("_weight"))
        .withColumn("_at", F.row_number().over(by_cap))
        .withColumn("_left", F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
        .withColumn("_level", F.col("_left") / F.sum("_weight").over(after))
        .withColumn("target", F.when(capped, F.col("_cap").cast("double")).otherwise(level * F.col("_weight")))
        .select("_source", "source_size", "target")
    )


def _levels(weighed: DataFrame) -> DataFrame:
    """_source and _level, by which a weight is multiplied for the chance, from the words of each weight
    and _rest. The largest weights, whose chance would be over 1, come first and are cut off."""
    order = Window.partitionBy("_source").orderBy(F.col("_w").desc())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("_rest") - F.coalesce(F.sum("_words").over(before), F.lit(0))) / F.sum(F.col("_w") * F.col("_words")).over(after)
    levels = weighed.withColumn("_level", level).filter(F.col("_level") * F.col("_w") < 1)
    return levels.groupBy("_source").agg(F.max_by("_level", "_w").alias("_level"))


def mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weight: Column | None = None, seed: str = SEED
) -> DataFrame:
    """docs with size, source_size, target and copies, the times that the mix takes the row whole.
    weight: relative chances, over 0, of documents of one source to be in the sample; may use size."""
    given = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies")]
    sized = (
        docs.select(*(F.col(f"`{c}`") for c in given), n_words(F.col(f"`{text}`")).alias("size"), F.col(f"`{source}`").alias("_source"))
        .withColumn("_u", draw(F.col(f"`{key}`"), seed))
        .withColumn("_w", n_bits(F.col("size")) if weight is None else weight)
    )
    narrow = cut(sized.select("_source", "size", "_u", "_w"))
    per_source = (
        targets(narrow)
        .withColumn("_whole", F.coalesce(F.floor(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size"))), F.lit(0)))
        .withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
    )
    per_source = cut(per_source)
    few = per_source.count() <= BROADCAST_SOURCES

    def with_source(rows: DataFrame, facts: DataFrame) -> DataFrame:
        facts = facts.withColumnRenamed("_source", "_its")
        joined = rows.join(F.broadcast(facts) if few else facts, F.col("_source").eqNullSafe(F.col("_its")), "left")
        return joined.drop("_its")

    words = narrow.filter("size > 0").groupBy("_source", "_w").agg(F.sum("size").alias("_words"))
    levels = cut(_levels(with_source(words, per_source).filter("_rest > 0")))
    per_source = cut(with_source(per_source, levels))
    chance = F.col("_level") * F.col("_w")
    rank = F.when(F.col("_rest") > 0, F.when(chance >= 1, 0.0).otherwise(_odds(F.col("_u")) / _odds(chance)))
    bucket = F.floor(F.col("_rank") / (1 + F.col("_rank")) * BUCKETS)
    ranked = with_source(narrow, per_source).withColumn("_rank", rank).filter("_rank IS NOT NULL").withColumn("_bucket", bucket)
    running = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        ranked.groupBy("_source", "_bucket")
        .agg(F.sum("size").alias("_words"), F.first("_rest").alias("_rest"))
        .withColumn("_before", F.coalesce(F.sum("_words").over(running), F.lit(0)))
        .filter("_before <= _rest")
        .groupBy("_source")
        .agg(F.max(F.struct("_bucket", "_before")).alias("_end"))
        .select("_source", F.col("_end._bucket").alias("_last"), F.col("_end._before").alias("_before"))
    )
    in_order = Window.partitionBy("_source").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    # The last bucket's rows; equal ranks count as one. _so_far + _words / 2 grows with the rank, so
    # those that fit come first; if none does, the sample ends below the bucket's lowest rank.
    last = (
        with_source(ranked, cut(ends))
        .filter("_bucket = _last")
        .groupBy("_source", "_rank")
        .agg(F.sum("size").alias("_words"), F.first("_before").alias("_before"), F.first("_rest").alias("_rest"))
        .withColumn("_so_far", F.col("_before") + F.coalesce(F.sum("_words").over(in_order), F.lit(0)))
        .withColumn("_fits", F.col("_so_far") + F.col("_words") / 2 <= F.col("_rest"))
        .groupBy("_source")
        .agg(F.max(F.when(F.col("_fits"), F.col("_rank"))).alias("_highest"), F.min("_rank").alias("_lowest"))
    )
    facts = per_source.alias("p").join(last.alias("l"), F.col("p._source").eqNullSafe(F.col("l._source")), "left")
    facts = cut(facts.select("p.*", "l._highest", "l._lowest"))
    taken = F.when(F.col("_highest").isNotNull(), F.col("_rank") <= F.col("_highest")).otherwise(F.col("_rank") < F.col("_lowest"))
    return (
        with_source(sized, facts)
        .withColumn("_rank", rank)
        .withColumn("copies", (F.col("_whole") + F.when(taken, 1).otherwise(0)).cast("int"))
        .select(*(F.col(f"`{c}`") for c in given), "size", "source_size", "target", "copies")
    )


def repeat(mixed: DataFrame) -> DataFrame:
    """Each row as often as its copies say."""
    return mixed.withColumn("_copy", F.explode(F.expr("IF(copies > 0, sequence(1, copies), array())"))).drop("_copy")
