"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from comparing import DATA
from pyspark.sql import functions as F

from brindle.llm import conversations, cost_layers
from brindle.llm.queries import damaged, op12_conversation_repair

NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
SPACES = " \t\n\x0b\f\r"
ROLE = {"u": "user", "a": "assistant"}


def search(turns):
    """The least (cost, audit) and the repaired turns; turns are (initial, fault), fault one of '', 'gone', 'truncated'."""
    n = len(turns)
    best = [dict() for _ in range(n + 1)]
    best[n] = {0: (0, "", ()), 3: (0, "", ())}
    for i in range(n, -1, -1):
        if i < n:
            initial, fault = turns[i]
            for state in range(4):
                options = []
                if state in best[i + 1]:
                    c, a, r = best[i + 1][state]
                    options.append((c + 3, "D" + a, r))
                if fault != "gone":
                    more = int(fault == "truncated")
                    for symbol, to in NEXT[state].items():
                        if to not in best[i + 1]:
                            continue
                        c, a, r = best[i + 1][to]
                        if symbol == initial:
                            options.append((c + more, "K" + a, (("K", i, symbol), *r)))
                        if symbol in ROLE:
                            options.append((c + more + 2, "R" + a, (("R", i, symbol), *r)))
                if options:
                    best[i][state] = min(options)
        for _ in range(8):
            for state in range(4):
                for symbol, to in NEXT[state].items():
                    if symbol in ROLE and to in best[i]:
                        c, a, r = best[i][to]
                        option = (c + 2, "I" + a, (("I", None, symbol), *r))
                        best[i][state] = min(best[i].get(state, option), option)
    return best[0][0]


def brute(rows, ids):
    """rows: (conv_id, turn, role, text) after damage, no nulls but in ids and turns."""
    convs = defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append((t is not None, t or 0, t, r, x))
    out = {}
    for c in ids:
        own = sorted(convs.get(c, []), key=lambda r: r[:2])
        seen, turns, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for *_, role, text in own:
            end = text.rstrip(SPACES)
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                n[fault] += 1
            turns.append((role[:1], "gone" if fault in ("blank", "duplicate") else fault))
        numbers = [t for *_, t, _, _ in own if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, kept = search(turns)
        lines = [f"{ROLE[s]}:" if e == "I" else f"{own[i][3]}:{own[i][4]}" if e == "K" else f"{ROLE[s]}:{own[i][4]}" for e, i, s in kept]
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[c] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, digest)
    return out


def found(df):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = df.collect()
    got = {r.conv_id: tuple(r[n] for n in names) for r in rows}
    assert len(got) == len(rows)
    return got


def damage(rows):
    """Damaged rows by another path than Spark."""
    out = []
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (c, t)).encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = text.translate(str.maketrans("", "", ".!?"))
        if kind == 4:
            role = "user"
        out += [(c, t, role, text)] * (2 if kind == 3 else 1)
    return out


def test_layers_give_the_least_audit():
    """Random turns, whole and cut into parts: cost, audit and roles of a plain search."""
    rng = random.Random(5)
    for k in range(400):
        codes = "".join(rng.choice("suax" "uaua" "SUAX" "0123") for _ in range(rng.randint(0, 9) if k % 8 else 30))
        turns = [(cost_layers.ROLES[int(c)] if c.isdigit() else c.lower(), "gone" if c.isdigit() else "truncated" if c.isupper() else "") for c in codes]
        cost, audit, _ = search(turns)
        got = cost_layers.repair(codes)
        assert (got[0], "".join(got[1])) == (cost, audit), codes


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = brute(damage(rows), {r[0] for r in rows})
    assert found(op12_conversation_repair(spark, f"{DATA}/{sf}")) == want


def _made(seed, n, most):
    rng = random.Random(seed)
    texts = ["One.", "Two!", "Three?", "no end", " \n", "", "Ends. \t", "One.", "x" * 5000 + ".", "a.b"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", " ", ""]
    out = []
    for c in range(n):
        for t in range(rng.randint(1, most)):
            out.append((c if c % 7 else None, None if rng.random() < 0.03 else 2 * t, rng.choice(roles), rng.choice(texts) + str(t) * rng.randint(0, 1) + rng.choice(["", "."])))
    # One turn a number, but for equal ones, since the order of others is by hash.
    held = {}
    return [held.setdefault((c, t), (c, t, r, x)) for c, t, r, x in out]


@pytest.mark.parametrize("block", [3, 7, 1024])
def test_blocks_and_partitions(spark, block):
    """Long conversations over many blocks and partitions; null ids and numbers."""
    rows = _made(block, 40, 30)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    ids = spark.createDataFrame([(c,) for c in {r[0] for r in rows} | {1000}], "conv_id long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = found(conversations.repair(df, ids, block=block))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute(rows, {r[0] for r in rows} | {1000})


def test_repaired_turns(spark):
    """The turns themselves give the digest, and their roles follow the grammar."""
    rows = _made(1, 20, 12)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    ordered = conversations.turns(df)
    edited = conversations.edits(conversations.faults(ordered), block=5)
    convs = defaultdict(list)
    for r in conversations.repaired(ordered, edited).collect():
        convs[r._c].append((r.place, r.role, r.text))
    want = brute(rows, {r[0] for r in rows})
    for c, (*_, digest) in want.items():
        own = sorted(convs["" if c is None else f"={c}"])
        assert [p for p, *_ in own] == list(range(len(own)))
        assert hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in own).encode()).hexdigest() == digest
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for _, r, _ in own))


def test_edges(spark):
    """Nulls in any column, empty and very long texts, no rows, clashing names, ids as strings."""
    schema = "conv_id string, turn long, role string, text string, _c string, code int, cost string"
    rows = [
        ("a", 0, "user", "y" * 300_000 + ".", None, 1, "q"),
        ("a", 1, None, None, "z", 1, None),
        ("a", 2, "assistant", None, "z", 1, None),
        (None, None, None, None, None, None, None),
        ("", 3, "user", "Yes.", None, None, None),
        ("", 9, "assistant", "é.", None, None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    plain = [(r[0], r[1], r[2] or " ", r[3] or " ") for r in rows]
    assert found(conversations.repair(df, df)) == brute(plain, {"a", None, ""})
    none = found(conversations.repair(df.limit(0), df.limit(0)))
    assert none == {}
    gone = found(conversations.repair(df.limit(0), df))
    assert set(gone.values()) == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_damage_of_nulls(spark):
    rows = [(c, t, r, x) for c in (None, 1, 2) for t in (None, 0, 1, 2, 3) for r, x in ((None, "Hi."), ("system", None))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("_kind", F.lit("x"))
    assert sorted(map(str, (tuple(r) for r in damaged(df).collect()))) == sorted(map(str, damage(rows)))
