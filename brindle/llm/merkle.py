"""A manifest of a dataset as hash trees: any change of a row shows in one root, and a proof of a few digests a level
says of a single row that it is the one that was listed.

Every row is a leaf. The leaves of each group (by a column) are ordered and every FAN consecutive nodes become their
parent until one is left, the group's subroot; the subroots, ordered by group, become the root in the same way.
``build`` goes bottom-up: each level is one aggregation of FAN rows a key, an eighth of the level below, and is
persisted. ``proofs`` goes top-down: a level's runs join what their node has inherited from above, and every child
prepends its siblings to that. Leaves lie in the first level's runs with what is to be returned of them, so a
proof of a leaf is made, used and dropped within one row and never shuffled.

Places in the order come from range partitions (operators.ranges): a group with most of the rows lies in many tasks.
Nothing reaches the driver but the size of the largest group.

A null group is a group, the first one. Null values have a mark of their own in a leaf, so they differ from empty
texts. Rows that tie in the order are ordered by their leaf; equal rows are equal leaves, side by side. Texts of any
length are hashed whole. An empty table gives an empty manifest. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import ranges
from .shared import cut

FAN = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """text with A-Z lower-cased and nothing else. lower() does just that, faster, where there are ASCII characters only."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def leaf(values: list[Column]) -> Column:
    """The digest of a row: of each value its bytes' number, a colon and itself, or - for null."""

    def field(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(field, values)), 256)


@dataclass
class Tree:
    """nodes: the lowest ones (group, _i, _n, digest, payload). levels: from below, the runs of each, with group, _i (the
    parent's place), _n (how many parents the group has), digest and children (structs of digest, payload)."""

    group: str
    nodes: DataFrame
    levels: list[DataFrame]

    def tops(self) -> DataFrame:
        """The last node of each group, with the number of levels below it."""
        found = [level.filter("_n = 1").select(self.group, "digest", F.lit(k).alias("_height")) for k, level in enumerate([self.nodes, *self.levels])]
        for other in found[1:]:
            found[0] = found[0].unionByName(other)
        return found[0]


def build(nodes: DataFrame, group: str, order: list[Column], payload: list[str]) -> Tree:
    """The tree over nodes, which have a digest, a group and the payload's columns; it comes from below."""
    place = ranges.in_order(nodes, [group], [*order, F.col("digest")])
    own = F.struct("digest", *payload)
    base = cut(ranges.numbered(place, [group], "_i", size="_n").select(group, "_i", "_n", "digest", own.alias("_child")))
    most = base.agg(F.max("_n")).first()[0] or 0
    levels: list[DataFrame] = []
    below = base
    while most > 1:
        parent = F.floor(F.col("_i") / FAN).cast("long")
        child = F.struct("_i", F.col("_child") if not levels else F.struct("digest").alias("_child"))
        runs = below.filter("_n > 1").groupBy(group, parent.alias("_parent"), F.ceil(F.col("_n") / FAN).cast("long").alias("_above"))
        runs = runs.agg(F.transform(F.array_sort(F.collect_list(child)), lambda c: c["_child"]).alias("children"))
        joined = F.array_join(F.transform("children", lambda c: c["digest"]), "")
        below = cut(runs.select(group, F.col("_parent").alias("_i"), F.col("_above").alias("_n"), F.sha2(joined, 256).alias("digest"), "children"))
        levels.append(below)
        most = -(-most // FAN)
    return Tree(group, base, levels)


def _down(inherited: DataFrame, runs: DataFrame, group: str) -> DataFrame:
    """Each run's children with their proofs: a child's siblings before what the run's node has inherited."""
    both = runs.select(group, "_i", "children").alias("r").join(inherited.alias("t"), ranges.same("r", "t", [group, "_i"]))
    at = both.select("r.*", *(F.col(f"t.`{c}`") for c in inherited.columns if c not in (group, "_i")), F.posexplode("children").alias("_at", "_child"))
    digests = F.transform("children", lambda c: c["digest"])
    left = F.array_join(F.slice(digests, 1, F.col("_at")), "")
    right = F.array_join(F.slice(digests, F.col("_at") + 2, F.lit(FAN)), "")
    step = F.array(F.struct(left.alias("left"), right.alias("right")))
    place = (F.col("_i") * FAN + F.col("_at")).alias("_place")
    kept = [c for c in inherited.columns if c not in (group, "_i", "proof")]
    return at.select(group, place, F.concat(step, "proof").alias("proof"), *kept, "_child").withColumnRenamed("_place", "_i")


def proofs(tree: Tree, tops: DataFrame) -> DataFrame:
    """The lowest nodes, as _child, with their proofs and whatever else tops carries down. tops has group, _height (of
    the group's last node), the proof of that node and other columns."""
    carried = tops.withColumn("_i", F.lit(0).cast("long"))
    inherited = None
    for k in range(len(tree.levels), 0, -1):
        here = carried.filter(F.col("_height") == k).drop("_height")
        here = here if inherited is None else inherited.unionByName(here)
        # Inherited proofs are written once a level, and the next one reads them from there.
        inherited = _down(here, tree.levels[k - 1], tree.group)
        if k > 1:
            inherited = cut(inherited.drop("_child"))
    lone = carried.filter("_height = 0").drop("_height").alias("t")
    lone = lone.join(tree.nodes.filter("_n = 1").alias("n"), ranges.same("t", "n", [tree.group])).select("t.*", "n._child")
    return lone if inherited is None else inherited.unionByName(lone)


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, start, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def manifest(leaves: DataFrame, group: str, order: list[Column], payload: list[str]) -> DataFrame:
    """group, the payload's columns, digest, subroot, root and proof (from the leaf up, what stands left and right of
    its node in each run) of each of leaves, which have a digest."""
    tree = build(leaves, group, order, payload)
    subroots = cut(tree.tops())
    # One group for all, 0, as a column that may be null: of others the optimizer keeps a constraint that unions of
    # checkpoints can't resolve.
    above = build(subroots.withColumn("_all", F.when(F.spark_partition_id() >= 0, 0)), "_all", [F.col(f"`{group}`").asc_nulls_first()], [group, "_height"])
    root = above.tops().select("_all", "_height", F.col("digest").alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("proof"))
    tops = proofs(above, cut(root)).select(
        F.col(f"_child.`{group}`").alias(group), F.col("_child._height").alias("_height"), F.col("_child.digest").alias("subroot"), "root", "proof"
    )
    return proofs(tree, cut(tops)).select(group, "_child.*", "subroot", "root", "proof")


def write(entries: DataFrame, path: str) -> None:
    """A manifest as Parquet, to be verified later."""
    entries.write.parquet(path)


def verify(rows: DataFrame, entries: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row for each key of rows or entries (which come from manifest() with key as payload), with its verdict:
    ok, changed (other leaves than those listed), unlisted, missing (no row left), or forged (an entry whose proof
    doesn't give the root)."""
    own = leaf([F.col(f"`{c}`") for c in columns])
    now = rows.select(F.col(f"`{key}`").alias(key), own.alias("_leaf"), F.lit(1).alias("_here"), F.lit(0).alias("_listed"), F.lit(True).alias("_sound"))
    sound = folded(F.col("digest"), F.col("proof")) == F.col("root")
    then = entries.select(F.col(f"`{key}`").alias(key), F.col("digest").alias("_leaf"), F.lit(0).alias("_here"), F.lit(1).alias("_listed"), sound.alias("_sound"))
    each = now.unionByName(then).groupBy(F.col(f"`{key}`").alias(key), "_leaf").agg(F.sum("_here").alias("_here"), F.sum("_listed").alias("_listed"), F.bool_and("_sound").alias("_sound"))
    found = each.groupBy(F.col(f"`{key}`").alias(key)).agg(
        F.sum("_here").alias("_h"), F.sum("_listed").alias("_l"), F.bool_and(F.col("_here") == F.col("_listed")).alias("_equal"), F.bool_and("_sound").alias("_s")
    )
    verdict = F.when(F.col("_l") == 0, "unlisted").when(F.col("_h") == 0, "missing").when(~F.col("_equal"), "changed").when(~F.col("_s"), "forged")
    return found.select(key, verdict.otherwise("ok").alias("verdict"))
