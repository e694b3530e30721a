"""Repair of conversations: faults of turns, and the cheapest edits after which roles follow ``(s?(ua)+)?``.

A conversation's turns go by their number, nulls first (of equal numbers by digest, so copies are side by side). A
turn is blank (nothing but spaces), a duplicate (role and text came before) or truncated (its last character is none
of ``.!?``); the first of these that holds counts. Edits: keep 0, a new role (user or assistant) 2, removal 3
(required for blank turns and duplicates), an empty user or assistant turn inserted 2; a truncated turn that isn't
removed adds 1. Among the cheapest audits, strings of the edits' initials, the least in ASCII is taken. Layers of
equal cost find it (cost_layers).

A conversation may hold any share of all turns. Turns are sorted over range partitions and cut into blocks of BLOCK
turns by their place there, so a block is all that a task holds. A conversation within one block, nearly every one, is
repaired at once. Of the others each block gives a matrix of 16 costs, from each state of the grammar to each; of
these, an BLOCK-th of the turns, one group a conversation computes what is to be paid after each block; with that every
block is walked from each state, and one more group picks the states that follow on each other. The digest of a
repaired conversation is one stream of bytes by definition: its turns pass through one task, which holds a batch.

A null role or text is one space; a null id is a conversation of its own; null numbers come first and are ignored in gaps.
Duplicates are found by 128 bits of hashes. Empty tables give no rows; texts of any length are read whole; columns but
the four aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import ranges
from . import cost_layers
from .shared import cut, in_batches

BLOCK = 1024
#: The characters that count as spaces.
SPACES = " \t\n\x0b\f\r"
_AT = ["_part", "_block"]
_PARTS = "letters array<string>, roles array<string>"


def key(column: Column) -> Column:
    """An id as a string that is never null."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def turns(rows: DataFrame, by: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns in their order (_part, _at): _c (key of the conversation), turn, role, text and what faults() needs of them."""
    given = {"_c": key(F.col(f"`{by}`")), "turn": F.col(f"`{turn}`")} | {n: F.coalesce(F.col(f"`{c}`"), F.lit(" ")) for n, c in (("role", role), ("text", text))}
    plain = rows.select(*(c.alias(n) for n, c in given.items()))
    end = F.rtrim(F.col("text"), F.lit(SPACES))
    plain = plain.withColumn("blank", end == "").withColumn("_open", ~F.right(end, F.lit(1)).isin(".", "!", "?"))
    plain = plain.withColumn("_h1", F.xxhash64("role", "text")).withColumn("_h2", F.xxhash64(F.lit(1), "role", "text"))
    return ranges.in_order(plain, ["_c"], [F.col("turn").asc_nulls_first(), F.col("_h1"), F.col("_h2")])


def faults(ordered: DataFrame) -> DataFrame:
    """_c, turn, blank, duplicate, truncated and code (see cost_layers) of each turn, without its text."""
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    narrow = ordered.select("_c", "turn", "blank", "_open", "_h1", "_h2", initial.alias("_initial"), "_part", "_at")
    place = F.struct("_part", "_at")
    again = narrow.filter("NOT blank").groupBy("_c", "_h1", "_h2").agg(F.min(place).alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    found = narrow.join(again, ["_c", "_h1", "_h2"], "left")
    duplicate = ~F.col("blank") & F.coalesce(place > F.col("_first"), F.lit(False))
    found = found.withColumn("duplicate", duplicate).withColumn("truncated", ~F.col("blank") & ~F.col("duplicate") & F.col("_open"))
    gone = F.translate("_initial", cost_layers.ROLES, "0123")
    code = F.when(F.col("blank") | F.col("duplicate"), gone).when(F.col("truncated"), F.upper("_initial")).otherwise(F.col("_initial"))
    return cut(found.select("_c", "turn", "blank", "duplicate", "truncated", code.alias("code"), "_part", "_at"))


def _blocks(found: DataFrame, block: int) -> DataFrame:
    """_c, _part, _block, _ats (places of its turns) and _codes of each run of a conversation within a block."""
    each = found.groupBy("_c", "_part", F.floor(F.col("_at") / block).cast("long").alias("_block"))
    each = each.agg(F.array_sort(F.collect_list(F.struct("_at", "code"))).alias("_all"))
    return each.select("_c", *_AT, F.col("_all._at").alias("_ats"), F.array_join("_all.code", "").alias("_codes"))


def illegal(codes: str) -> int:
    """Neighbours that are none of su, ua, au."""
    roles = codes.lower().translate(str.maketrans("0123", cost_layers.ROLES))
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))


def _marked(audit: list[str], roles: list[str]) -> list[str]:
    """Roles with a turn's own one in upper case, so that it differs from inserted ones."""
    return [r[:-1] + r[-1].upper() if a[-1:] in ("K", "R") else r for a, r in zip(audit, roles)]


def _mapped(rows: DataFrame, run, kept: list[str], schema: str) -> DataFrame:
    """Columns kept of rows and those that run makes of each row."""
    types = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    new = [c.split(" ")[0] for c in schema.split(", ")]

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            made = [run(r) for r in batch.to_pylist()]
            columns = {c: batch.column(c) for c in kept} | {c: pa.array([m[k] for m in made], _ARROW[c]) for k, c in enumerate(new)}
            yield pa.RecordBatch.from_pydict(columns)

    return in_batches(rows).mapInArrow(batches, f"{types}, {schema}")


_LONGS, _STRINGS = pa.list_(pa.int64()), pa.list_(pa.string())
_ARROW = {
    "cost": pa.int64(), "illegal": pa.int64(), "letters": _STRINGS, "roles": _STRINGS, "matrix": _LONGS,
    "exits": _LONGS, "letters_of": pa.list_(_STRINGS), "roles_of": pa.list_(_STRINGS),
}


def _whole(row: dict) -> tuple:
    cost, audit, roles = cost_layers.repair(row["_codes"])
    return cost, illegal(row["_codes"]), audit, _marked(audit, roles)


def _summary(row: dict) -> tuple:
    if row["_last"]:
        return ([*cost_layers.to_go(row["_codes"], cost_layers._ACCEPTED, True)],)
    return (cost_layers.matrix(row["_codes"]),)


def _after(blocks: pd.DataFrame) -> pd.DataFrame:
    """Of a conversation's blocks, from the last on: what is to be paid before and after each of them."""
    blocks = blocks.sort_values(_AT)
    before, after, ends = [], [], [*cost_layers._ACCEPTED]
    for matrix in reversed(blocks["matrix"].tolist()):
        after.append(ends)
        ends = [int(x) for x in matrix] if len(matrix) == 4 else [min(int(matrix[4 * s + e]) + ends[e] for e in range(4)) for s in range(4)]
        before.append(ends)
    codes = blocks["_codes"].tolist()
    pairs = [0] + [illegal(a[-1] + b[0]) for a, b in zip(codes, codes[1:])]
    out = blocks[["_c", *_AT]].assign(cost=[before[-1][0]] + [0] * (len(codes) - 1), ends=after[::-1])
    return out.assign(illegal=[p + illegal(c) for p, c in zip(pairs, codes)])


def _walks(row: dict) -> tuple:
    found = [cost_layers.repair_part(row["_codes"], tuple(row["ends"]), row["_last"], s) for s in range(4)]
    return [f[2] for f in found], [f[0] for f in found], [_marked(f[0], f[1]) for f in found]


def _entered(blocks: pd.DataFrame) -> pd.DataFrame:
    """The state in which each of a conversation's blocks is entered."""
    blocks = blocks.sort_values(_AT)
    state, states = 0, []
    for exits in blocks["exits"]:
        states.append(state)
        state = int(exits[state])
    return blocks[["_c", *_AT]].assign(state=states)


def edits(found: DataFrame, block: int = BLOCK) -> DataFrame:
    """_c, _part, _block, _ats, cost, illegal, letters and roles of each block; costs of a conversation add up, and its
    blocks' letters in order are its audit."""
    blocks = cut(_blocks(found, block))
    spans = blocks.groupBy("_c").agg(F.count("*").alias("_n"), F.max(F.struct(*_AT)).alias("_end")).filter("_n > 1")
    spans = cut(spans)
    one = _mapped(blocks.join(spans, "_c", "left_anti"), _whole, ["_c", *_AT, "_ats"], f"cost bigint, illegal bigint, {_PARTS}")
    some = blocks.join(spans, "_c").withColumn("_last", F.struct(*_AT) == F.col("_end")).select("_c", *_AT, "_ats", "_codes", "_last")
    summed = _mapped(some, _summary, ["_c", *_AT, "_codes"], "matrix array<bigint>")
    paid = summed.groupBy("_c").applyInPandas(_after, "_c string, _part bigint, _block bigint, cost bigint, ends array<bigint>, illegal bigint")
    walked = cut(_mapped(some.join(paid, ["_c", *_AT]), _walks, ["_c", *_AT, "_ats", "cost", "illegal"], "exits array<bigint>, letters_of array<array<string>>, roles_of array<array<string>>"))
    entered = walked.select("_c", *_AT, "exits").groupBy("_c").applyInPandas(_entered, "_c string, _part bigint, _block bigint, state bigint")
    chosen = walked.join(entered, ["_c", *_AT]).withColumn("state", F.col("state").cast("int"))
    own = [F.element_at(f"{c}_of", F.col("state") + 1).alias(c) for c in ("letters", "roles")]
    return cut(one.unionByName(chosen.select("_c", *_AT, "_ats", "cost", "illegal", *own)))


def _lines(stream: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, str]]:
    """Key, role and text of repaired turns, from rows of marks, each before the turn it is for."""
    mark = ""
    for batch in stream:
        for c, given, role, text in zip(*(batch.column(k).to_pylist() for k in ("_c", "_mark", "role", "text"))):
            if given is not None:
                mark = given
                continue
            for m in mark:
                new = "user" if m in "uU" else "assistant"
                yield (c, role, text) if m == "=" else (c, new, text if m.isupper() else "")
            mark = ""


def _marks(ordered: DataFrame, edited: DataFrame) -> DataFrame:
    """The turns and, before each, its mark, a task's conversations whole and in order. Texts are shuffled once here."""
    n = F.size("_ats")
    # What is inserted after the last turn goes with it.
    marks = F.transform(F.slice("roles", 1, n), lambda r, i: F.when(i == n - 1, F.concat(r, F.element_at("roles", n + 1))).otherwise(r))
    each = edited.select("_c", "_part", F.explode(F.arrays_zip(F.col("_ats").alias("at"), marks.alias("mark"))).alias("_e"))
    each = each.select("_c", "_part", F.col("_e.at").alias("_at"), F.lit(0).alias("_kind"), F.col("_e.mark").alias("_mark"), *(F.lit(None).cast("string").alias(c) for c in ("role", "text")))
    own = ordered.select("_c", "_part", "_at", F.lit(1).alias("_kind"), F.lit(None).cast("string").alias("_mark"), "role", "text")
    both = each.unionByName(own).repartition("_c").sortWithinPartitions("_c", "_part", "_at", "_kind")
    return in_batches(both.select("_c", "_mark", "role", "text"))


def repaired(ordered: DataFrame, edited: DataFrame) -> DataFrame:
    """The turns after the edits: _c, place (from 0), role and text."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, place, held, size = None, 0, [], 0
        for c, role, text in _lines(stream):
            now, place = c, place + 1 if c == now else 0
            held.append((c, place, role, text))
            size += len(text)
            if len(held) >= 2_000 or size >= 4 << 20:
                yield _batch(held)
                held, size = [], 0
        yield _batch(held)

    def _batch(held: list) -> pa.RecordBatch:
        columns = list(zip(*held)) or [()] * 4
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_pydict({n: pa.array(v, k) for n, v, k in zip(("_c", "place", "role", "text"), columns, kinds)})

    return _marks(ordered, edited).mapInArrow(batches, "_c string, place bigint, role string, text string")


def _digests(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, made, digest = [], [], None

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"_c": pa.array(keys, pa.string()), "repaired_sha256": pa.array(made, pa.string())})

    for c, role, text in _lines(stream):
        if keys and c == keys[-1]:
            digest.update(b"\n")
        else:
            if digest is not None:
                made.append(digest.hexdigest())
            if len(made) >= 10_000:
                yield batch()
                keys, made = [], []
            keys.append(c)
            digest = hashlib.sha256()
        digest.update(f"{role}:{text}".encode())
    if digest is not None:
        made.append(digest.hexdigest())
    yield batch()


def digests(ordered: DataFrame, edited: DataFrame) -> DataFrame:
    """_c and the digest of ``role:text`` of all repaired turns of each conversation, joined by newlines; none where none
    is left."""
    return _marks(ordered, edited).mapInArrow(_digests, "_c string, repaired_sha256 string")


def report(found: DataFrame, edited: DataFrame) -> DataFrame:
    """_c, gaps (numbers missing between the least and the greatest), blank, duplicate, truncated, illegal (neighbours
    whose roles don't follow each other), cost and audit of each conversation that has turns."""
    span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    flags = [F.count_if(c).alias(c) for c in ("blank", "duplicate", "truncated")]
    counts = found.groupBy("_c").agg(F.coalesce(span, F.lit(0)).cast("long").alias("gaps"), *flags)
    audits = edited.select("_c", "cost", "illegal", F.struct(*_AT, F.array_join("letters", "").alias("a")).alias("_a"))
    audits = audits.groupBy("_c").agg(F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal"), F.array_sort(F.collect_list("_a")).alias("_a"))
    return counts.join(audits, "_c").withColumn("audit", F.array_join("_a.a", "")).drop("_a")


def repair(rows: DataFrame, ids: DataFrame, by: str = "conv_id", block: int = BLOCK, **names: str) -> DataFrame:
    """One row for every id of ids (a column named by): report() of its turns in rows and the digest of the repaired ones;
    zeros, an empty audit and the digest of nothing where it has no turn."""
    ordered = turns(rows, by, **names)
    found = faults(ordered)
    edited = edits(found, block)
    facts = report(found, edited).join(digests(ordered, edited), "_c", "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    every = ids.select(F.col(f"`{by}`").alias(by)).distinct().withColumn("_c", key(F.col(f"`{by}`"))).join(facts, "_c", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return every.select(
        by, *(F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in numbers), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256")
    )
