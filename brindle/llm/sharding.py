"""Sharding by a k-d tree over the documents' metadata.

What is dealt out are units: all rows of equal texts together, or, of a group heavier than both the largest
document and 1 / PIECES of a shard, pieces of at most about that size. Every node is split along its widest
dimension (log of the size, then the metadata: numbers as they are, strings by their rank among the column's
distinct ones, whatever they begin with; each scaled to the corpus, and a unit has the least value of its rows) at the weighted median, or the
quantile that fits an odd number of shards, until there are as many leaves as shards, each of about the same
bytes. The low part of each coordinate is a hash of the unit, so a median can cut through units of equal
metadata, be they a third of all.

Medians are found for all nodes of a level at once: histograms of bytes over BINS ranges of the coordinate,
narrowed to the range with the median until it holds one coordinate. A range is found within Spark; the
driver receives one row a node, at most as many as there are shards, and sends back one comparison a node.
Rows are numbered within their shard by parts: a count of each part, then their order in it.

Sizes come near each other as far as units allow: a shard is off by some units' bytes at most, so a corpus
of a few documents a shard has uneven shards.

Defined results: a null text has 0 bytes and crc32 0. Null metadata sorts first. A null key is a key. Repeated
rows are equal texts, with slots of their own. A very long text is one row of its bytes. An empty table gives
none. Columns other than key, text and metadata, whatever their names, play no part. Only DataFrame
functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..operators import ranges
from .shared import cut

LAW = "bytes"
BINS = 1024
#: A group of equal texts is cut in pieces if it is heavier than this part of a shard and any document.
PIECES = 32
#: A coordinate is a scaled value of VALUE_BITS bits and a hash of HASH_BITS bits.
VALUE_BITS, HASH_BITS = 20, 32
#: Parts of a shard that are numbered apart.
PARTS = 1024
#: Rows of small tables (heavy groups, nodes, parts) up to which they are sent to every task.
SENT = 1 << 17
#: Bytes of such a table's strings.
SENT_BYTES = 16 << 20
UNIT = ["_text", "text_crc32", "size", "_piece"]


def _small(rows: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rows) if n <= SENT else rows


def _is_number(docs: DataFrame, name: str) -> bool:
    return isinstance(docs.schema[name].dataType, NumericType)


def _value(docs: DataFrame, name: str) -> Column:
    """A column's value as a number, or as a string to be ranked."""
    value = F.col(f"`{name}`")
    if not _is_number(docs, name):
        return value.cast("string")
    number = value.cast("double")
    return F.when(F.isnan(number), None).otherwise(number)


def _by_rank(rows: DataFrame, name: str) -> DataFrame:
    """rows with a string column replaced by each value's rank among the distinct ones, found over range partitions."""
    values = rows.select(name).filter(F.col(name).isNotNull()).distinct()
    ordered = ranges.in_order(values.withColumn("_all", F.when(F.spark_partition_id() >= 0, 0)), ["_all"], [F.col(name)])
    ranks = cut(ranges.numbered(ordered, ["_all"], "_rank").select(name, F.col("_rank").cast("double").alias("_rank")))
    n, size = ranks.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(name)), F.lit(0))).first()
    both = rows.join(F.broadcast(ranks) if n <= SENT and size <= SENT_BYTES else ranks, name, "left")
    return both.select(*(F.col("_rank").alias(c) if c == name else F.col(c) for c in rows.columns))


def rows_and_units(docs: DataFrame, shards: int | None, target_bytes: int | None, key: str, text: str, metadata: tuple[str, ...]) -> tuple[DataFrame, DataFrame, int]:
    """The narrow rows with their unit; the units with size, _weight and coordinates _d0, _d1 and so on; and the
    number of shards."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{key}`").alias("_key"),
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.xxhash64(body).alias("_text"),
        *(_value(docs, m).alias(f"_m{i}") for i, m in enumerate(metadata)),
    )
    rows = cut(rows)
    strings = [f"_m{i}" for i, m in enumerate(metadata) if not _is_number(docs, m)]
    for name in strings:
        rows = _by_rank(rows, name)
    rows = cut(rows) if strings else rows
    values = {"_d0": F.log2(F.col("size").cast("double"))} | {f"_d{i + 1}": F.col(f"_m{i}") for i in range(len(metadata))}
    ends = [f(v).alias(f"{n}{d}") for d, v in values.items() for n, f in (("min", F.min), ("max", F.max))]
    facts = rows.agg(F.sum("size").alias("total"), F.max("size").alias("largest"), *ends).first()
    total = facts["total"] or 0
    if shards is None:
        shards = max(1, -(-total // target_bytes))
    most = max(facts["largest"] or 0, total / shards / PIECES, 1)
    heavy = rows.groupBy(*UNIT[:3]).agg(F.count("*").alias("_n")).filter((F.col("_n") > 1) & (F.col("_n") * F.col("size") > most))
    heavy = cut(heavy.select(*UNIT[:3], F.ceil(F.col("_n") * F.col("size") / F.lit(most)).alias("_pieces")))
    piece = F.coalesce(F.pmod(F.xxhash64("_key"), F.col("_pieces")), F.lit(0)).alias("_piece")
    rows = rows.join(_small(heavy, heavy.count()), UNIT[:3], "left").select(*rows.columns, piece)
    units = rows.groupBy(*UNIT).agg(F.sum(F.col("size")).alias("_weight"), *(F.min(f"_m{i}").alias(f"_m{i}") for i in range(len(metadata))))

    def coordinate(d: str, value: Column) -> Column:
        low, high = facts[f"min{d}"], facts[f"max{d}"]
        if low is None or high <= low:
            return F.col("_hash")
        scaled = F.floor((F.coalesce(value, F.lit(low)) - low) / (high - low) * ((1 << VALUE_BITS) - 1))
        return scaled.cast("long") * (1 << HASH_BITS) + F.col("_hash")

    units = units.withColumn("_hash", F.pmod(F.xxhash64(*UNIT), F.lit(1 << HASH_BITS)))
    return rows, cut(units.select(*UNIT, "_weight", *(coordinate(d, v).alias(d) for d, v in values.items()))), int(shards)


def _cuts(at: DataFrame, nodes: dict[int, int], dimensions: list[str]) -> list[tuple]:
    """For each node (its first shard, and how many it has): that, the dimension's place from 1, and the cut;
    units up to the cut go left."""
    spark = at.sparkSession
    ends = [f(d).alias(f"{n}{d}") for d in dimensions for n, f in (("min", F.min), ("max", F.max))]
    known = {r["_leaf"]: r for r in at.groupBy("_leaf").agg(F.sum("_weight").alias("_weight"), *ends).collect()}
    own = F.element_at(F.array(*dimensions), F.col("_dim"))
    searched, found = {}, []
    for leaf, shards in nodes.items():
        if r := known.get(leaf):
            d = max(dimensions, key=lambda d: (r[f"max{d}"] >> HASH_BITS) - (r[f"min{d}"] >> HASH_BITS))
            searched[leaf] = (dimensions.index(d) + 1, r[f"min{d}"], r[f"max{d}"], r["_weight"] * (shards // 2) / shards)
        else:
            found.append((leaf, 1, 0))
    while searched:
        facts = [(leaf, d, low, high, -(-(high - low + 1) // BINS), goal) for leaf, (d, low, high, goal) in searched.items()]
        facts = spark.createDataFrame(facts, "_leaf int, _dim int, _low long, _high long, _step long, _goal double")
        inside = at.join(_small(facts, len(searched)), "_leaf").withColumn("_own", own).filter("_own BETWEEN _low AND _high")
        bins = inside.groupBy("_leaf", F.expr("(_own - _low) DIV _step").alias("_bin")).agg(
            F.sum("_weight").alias("_bytes"), F.min("_own").alias("_first"), F.max("_own").alias("_last"), F.first("_goal").alias("_goal")
        )
        # At most BINS rows a node.
        up_to = Window.partitionBy("_leaf").orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        passing = bins.withColumn("_sum", F.sum("_bytes").over(up_to)).filter("_sum >= _goal").groupBy("_leaf")
        for r in passing.agg(F.min(F.struct("_bin", "_first", "_last", "_bytes", "_sum")).alias("_at")).collect():
            leaf, b = r["_leaf"], r["_at"]
            d, _, _, goal = searched[leaf]
            goal -= b["_sum"] - b["_bytes"]
            if b["_first"] < b["_last"]:
                searched[leaf] = (d, b["_first"], b["_last"], goal)
            else:
                # The coordinate with the median goes to the side that it brings nearer to its goal.
                found.append((leaf, d, b["_first"] if goal >= b["_bytes"] / 2 else b["_first"] - 1))
                del searched[leaf]
    return found


def _placed(units: DataFrame, shards: int, dimensions: list[str]) -> DataFrame:
    """units with _leaf, their shard."""
    at, nodes = units.withColumn("_leaf", F.lit(0)), {0: shards}
    while any(n > 1 for n in nodes.values()):
        open_ = {leaf: n for leaf, n in nodes.items() if n > 1}
        cuts = [(leaf, d, c, leaf + open_[leaf] // 2) for leaf, d, c in _cuts(at.filter(F.col("_leaf").isin(list(open_))) if len(open_) < min(len(nodes), 256) else at, open_, dimensions)]
        table = _small(units.sparkSession.createDataFrame(cuts, "_leaf int, _dim int, _cut long, _right int"), len(cuts))
        above = F.element_at(F.array(*dimensions), F.col("_dim")) > F.col("_cut")
        at = cut(at.join(table, "_leaf", "left").select(*units.columns, F.when(above, F.col("_right")).otherwise(F.col("_leaf")).alias("_leaf")))
        nodes = {leaf: n for leaf, n in nodes.items() if n == 1} | {k: m for leaf, n in open_.items() for k, m in ((leaf, n // 2), (leaf + n // 2, n - n // 2))}
    return at


def shard(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, key: str = "doc_id", text: str = "text", metadata: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """The key, size, text_crc32, law, shard, slot and grown_shard of every row. The number of
    shards is given, or follows from the bytes that one is to have."""
    rows, units, shards = rows_and_units(docs, shards, target_bytes, key, text, metadata)
    at = _placed(units, shards, [f"_d{i}" for i in range(len(metadata) + 1)])
    part = F.pmod(F.xxhash64("_key", "_text"), F.lit(PARTS)).cast("int")
    named = rows.join(at.select(*UNIT, F.col("_leaf").alias("shard")), UNIT).withColumn("_part", part)
    named = cut(named.select("_key", "size", "text_crc32", "shard", "_part"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # At most PARTS rows a shard.
    starts = named.groupBy("shard", "_part").count().withColumn("_start", F.coalesce(F.sum("count").over(before), F.lit(0)))
    starts = _small(starts.select("shard", "_part", "_start"), shards * PARTS)
    within = Window.partitionBy("shard", "_part").orderBy("_key", "text_crc32", "size")
    return (
        named.withColumn("_row", F.row_number().over(within) - 1)
        .join(starts, ["shard", "_part"])
        .select(
            F.col("_key").alias(key),
            "size",
            "text_crc32",
            F.lit(LAW).alias("law"),
            "shard",
            (F.col("_start") + F.col("_row")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
