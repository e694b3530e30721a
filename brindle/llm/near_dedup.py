"""Near-duplicate documents by HyperMinHash.

A document is its set of 5-word shingles, folded to lower case. Documents with the same folded words in
the same order form a class, found by an aggregate on a 128-bit digest of these words, and one
representative goes on; equal sets of other words' orders are pairs like any others. Its shingles fall into
REGISTERS buckets; a bucket keeps the least hash as a count of leading zeros and MANTISSA bits. Empty
buckets borrow by a fixed probing order. Bands of registers propose pairs, the share of equal registers
estimates their similarity, corrected for chance collisions by the sizes of both sets, and pairs that come
near the threshold, by a margin that is wider for fewer filled registers, are confirmed on the full sets of
words.

Within a band no group is expanded into all pairs. First each member meets the group's smallest, and
the confirmed links are joined into components. Then groups that are still in several components are
dealt into tiles of about TILE rows. Each tile of a large group is gone through by itself, and the
components are joined again. Last, cells of any two tiles are gone through, but for two tiles of the
group's largest component. Within a cell, a task takes the pairs whose estimate comes near the
threshold from the highest down, passes over those that are connected by then, and sends on only the
links between components. So every pair that shares a band is confirmed or refused, or already
connected, and no list of a group's pairs is ever shuffled.

There are 20 bands of 5 registers: a pair at 0.85 shares one with chance 1 - (1 - 0.85 ** 5) ** 20 = 0.999992, a
pair at just 0.80 with 0.9996. (25 bands of 4 would make that 0.999998, but bring together many more documents
that don't link.)

Defined results: a text without words has an empty set and links with nothing; one of fewer words
than a shingle is one shingle. Rows with a null key link with nothing, are kept and have no
component. Repeated rows share a class; rows of one key and other texts count as one document. An
empty table gives none. Only the key and the text are read, so other columns' names can't clash. A very long
text is one set: its task holds it whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batches, words
from .graph import components
from .shared import cut, in_batches, thin, without

SHINGLE = 5
BANDS, ROWS = 20, 5
REGISTERS = BANDS * ROWS
MANTISSA = 10
#: An estimate may lie so many deviations below the threshold and still lead to confirmation.
DEVIATIONS = 5
#: Rows, or shingles, of a tile on average; a cell of two tiles is held by one task at once.
TILE, TILE_SHINGLES = 128, 1 << 18
_PROBES = 64


def shingles(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """For each text, the sorted distinct hashes of its shingles."""
    h, offsets = words.fingerprints(texts, fold=True)
    long = words.runs(h, size)
    out = []
    for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        n = end - start
        out.append(np.unique(long[start : end - size + 1]) if n >= size else words.runs(h[start:end], n)[: n > 0])
    return out


def _probe_table() -> np.ndarray:
    at = np.arange(REGISTERS * _PROBES, dtype=np.uint64)
    return (words.mix(at + np.uint64(1 << 40)) % np.uint64(REGISTERS)).astype(np.int64).reshape(_PROBES, REGISTERS)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """The HyperMinHash registers of each set, [sets, REGISTERS] of uint16; 0 for an empty set."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    least = np.full((len(sets), REGISTERS), np.iinfo(np.uint64).max, np.uint64)
    if size.sum():
        h = np.concatenate(sets)
        bucket = ((h >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)
        owner = np.repeat(np.arange(len(sets)), size)
        np.minimum.at(least.reshape(-1), owner * REGISTERS + bucket.astype(np.int64), words.mix(h ^ np.uint64(0x5BD1E995)))
    empty = least == np.iinfo(np.uint64).max
    zeros = (64 - np.frexp(least.astype(np.float64))[1]).clip(0, 62)
    mantissa = (least << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    out = ((zeros.astype(np.uint64) << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)
    # A bucket without a shingle takes the first that has one, in an order of its own.
    open_ = np.argwhere(empty & (size > 0)[:, None])
    table = _probe_table()
    for k in range(_PROBES + REGISTERS):
        if not len(open_):
            break
        row, bucket = open_[:, 0], open_[:, 1]
        source = table[k, bucket] if k < _PROBES else (table[0, bucket] + k) % REGISTERS
        found = ~empty[row, source]
        out[row[found], bucket[found]] = out[row[found], source[found]]
        open_ = open_[~found]
    out[size == 0] = 0
    return out


def _collisions() -> np.ndarray:
    """The chance that one register of two sets without a common element is equal by chance, by the numbers
    of elements that fall into it, 2 ** (i / 2) and 2 ** (j / 2). The least of n hashes lies near x with
    density n * exp(-n * x); both sets' lie in the same cell, of 2 ** MANTISSA cells for each number of zeros."""
    n = 2.0 ** (np.arange(120) / 2)
    total = n[:, None] + n
    out = np.zeros_like(total)
    for zeros in range(63):
        low, high = 0.5 ** (zeros + 1), 0.5**zeros
        out += (high - low) / (1 << MANTISSA) * n[:, None] * n / total * (np.exp(-total * low) - np.exp(-total * high))
    return out


_COLLISIONS = _collisions()


def _scale(n: np.ndarray) -> np.ndarray:
    return np.rint(2 * np.log2(np.maximum(np.asarray(n) / REGISTERS, 1))).astype(np.int64)


def similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard estimates from registers, corrected for collisions of sets of these sizes."""
    chance = _COLLISIONS[_scale(n_a), _scale(n_b)]
    return ((a == b).mean(axis=-1) - chance) / (1 - chance)


def _sketch(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches.sliced(stream):
        texts = batches.as_bytes(batch.column("text"))
        sets = shingles(texts)
        regs = registers(sets)
        same = [hashlib.blake2b(b" ".join(words.split(t.lower())), digest_size=16).digest() if len(s) else None for t, s in zip(texts, sets, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"),
                pa.array(same, pa.binary()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([r.tobytes() for r in regs], pa.binary()),
            ],
            names=["id", "same", "n", "regs"],
        )


def _array(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _likely(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether the sets' sizes and the estimate allow a link. As many registers as are filled count as drawn."""
    least = percent / 100
    filled = REGISTERS * -np.expm1(-np.minimum(n_a, n_b) / REGISTERS)
    margin = DEVIATIONS * np.sqrt(least * (1 - least) / filled)
    sizes = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    return sizes & (similarity(a, b, n_a, n_b) >= least - margin)


def _promising(percent: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            if batch.num_rows:
                sizes = [batch.column(c).to_numpy() for c in ("n_a", "n_b")]
                ok = _likely(_array(batch.column("regs_a")), _array(batch.column("regs_b")), *sizes, percent)
                yield batch.select(["a", "b"]).filter(pa.array(ok))

    return run


def _equal(a: np.ndarray, b: np.ndarray) -> int:
    """Elements that two sorted sets have in common."""
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def _across(percent: int, size: int):
    """Links that join the components within each cell of a band's group: candidates are taken from the
    highest estimate down, and one whose sides are joined by then is passed over."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches.groups(stream, ["band", "i", "j"]):
            rows = table.combine_chunks().to_batches()[0]
            tile, i, j = (rows.column(c).to_numpy() for c in ("tile", "i", "j"))
            node = rows.column("node").to_numpy(zero_copy_only=False)
            comp = np.unique(rows.column("comp").to_numpy(zero_copy_only=False), return_inverse=True)[1]
            if comp.max() == 0:
                continue
            sets = shingles(batches.as_bytes(rows.column("text")), size)
            regs, n = registers(sets), np.fromiter(map(len, sets), np.int64, len(sets))
            left = np.flatnonzero(tile == i)
            right = left if i[0] == j[0] else np.flatnonzero(tile == j)
            found, close = [], []
            for x in left:
                y = right[(comp[right] != comp[x]) & ((right > x) | (i[0] != j[0]))]
                y = y[_likely(regs[x], regs[y], n[x], n[y], percent)]
                found.append(np.stack([np.full(len(y), x), y]))
                close.append(similarity(regs[x], regs[y], n[x], n[y]))
            pairs = np.concatenate(found, axis=1)[:, np.argsort(-np.concatenate(close), kind="stable")] if found else np.empty((2, 0), int)
            links = []
            for x, y in pairs.T.tolist():
                if comp[x] != comp[y]:
                    both = _equal(sets[x], sets[y])
                    if 100 * both >= percent * (n[x] + n[y] - both):
                        comp[comp == comp[y]] = comp[x]
                        links.append((min(node[x], node[y]), max(node[x], node[y])))
            if links:
                low, high = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(low, rows.column("node").type), pa.array(high, rows.column("node").type)], names=["a", "b"])

    return run


def _confirm(percent: int, size: int):
    def words_of(text: bytes) -> set:
        w = words.split(text.lower())
        return set(zip(*(w[i:] for i in range(size)), strict=False)) if len(w) >= size else {tuple(w)}

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, set()
        for batch in batches.sliced(stream, "text_a", "text_b"):
            found = []
            for text_a, text_b in zip(*(batches.as_bytes(batch.column(c)) for c in ("text_a", "text_b")), strict=True):
                if text_a != last:
                    last, left = text_a, words_of(text_a)
                right = words_of(text_b)
                both = len(left & right)
                found.append(100 * both >= percent * (len(left) + len(right) - both))
            yield batch.select(["a", "b"]).filter(pa.array(found, pa.bool_()))

    return run


def _links(pairs: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """The pairs a, b whose sets have that share in common, by their whole texts."""
    pairs = cut(pairs)
    ids = cut(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    # Both sides of the join below share its shuffle.
    own = thin(texts, ids, "id").join(ids, "id", "left_semi").distinct()
    both = pairs.join(own.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(
        own.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b"
    )
    kind = pairs.schema["a"].dataType.simpleString()
    return cut(in_batches(both).mapInArrow(batches.released(_confirm(percent, size)), f"a {kind}, b {kind}").distinct())


def _apart(members: DataFrame, joined: DataFrame) -> DataFrame:
    """Of bands' groups that are in more than one component, the members but the smallest (all have met
    it), each with its component, and the tiles of the members of the largest component and of others."""
    others = members.filter("node <> hub").join(joined, "node", "left")
    others = cut(others.groupBy("band", "node").agg(F.max("n").alias("n"), F.min(F.coalesce("component", "node")).alias("comp")))
    parts = others.groupBy("band", "comp").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    groups = parts.groupBy("band").agg(
        F.max(F.struct("rows", "comp", "n")).alias("main"), F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.count("*").alias("parts")
    )

    def tiles(rows, n):
        return F.ceil(F.greatest(rows / F.lit(TILE), n / F.lit(TILE_SHINGLES))).cast("int")

    open_ = groups.filter("parts > 1").select(
        "band",
        F.col("main.comp").alias("main"),
        tiles(F.col("rows"), F.col("n")).alias("tiles"),
        tiles(F.col("main.rows"), F.col("main.n")).alias("main_tiles"),
        tiles(F.col("rows") - F.col("main.rows"), F.col("n") - F.col("main.n")).alias("other_tiles"),
    )
    return others.drop("n").join(open_, "band")


def _cells(apart: DataFrame, whole: bool) -> DataFrame:
    """band, node, comp and tile in each cell i, j of two tiles. Not whole: each tile of a group of
    several by itself, so each row once. Whole: any two tiles but two of the largest component."""
    place = F.xxhash64("node")
    if not whole:
        tile = F.pmod(place, F.col("tiles")).cast("int")
        return cut(apart.filter("tiles > 1").select("band", "node", "comp", tile.alias("tile"), tile.alias("i"), tile.alias("j")))
    last = F.when(F.col("comp") == F.col("main"), F.col("other_tiles") - 1).otherwise(F.col("other_tiles") + F.col("main_tiles") - 1)
    own = F.when(F.col("comp") == F.col("main"), F.col("other_tiles") + F.pmod(place, F.col("main_tiles"))).otherwise(F.pmod(place, F.col("other_tiles")))
    each = apart.select("band", "node", "comp", own.cast("int").alias("tile"), F.explode(F.sequence(F.lit(0), last)).alias("_other"))
    return cut(each.select("band", "node", "comp", "tile", F.least("tile", "_other").alias("i"), F.greatest("tile", "_other").alias("j")))


def _meet(cells: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """Links between components within the cells, by hashes of their whole sets."""
    nodes = cut(cells.select(F.col("node").alias("id")).distinct())
    own = thin(texts, nodes, "id").join(nodes, "id", "left_semi").distinct().withColumnRenamed("id", "node")
    both = cells.join(own, "node").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    kind = cells.schema["node"].dataType.simpleString()
    return in_batches(both).mapInArrow(batches.released(_across(percent, size)), f"a {kind}, b {kind}").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80, size: int = SHINGLE) -> DataFrame:
    """The key, n_shingles, component_id (the smallest key reachable by links) and kept of every
    row. Links are pairs with 100 * intersection >= percent * union of their sets of shingles."""
    kind = docs.schema[key].dataType.simpleString()
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    sketched = cut(in_batches(texts).mapInArrow(batches.released(_sketch), f"id {kind}, same binary, n long, regs binary"))
    classes = (
        sketched.filter("n > 0 AND id IS NOT NULL")
        .groupBy("same")
        .agg(F.min(F.struct("id", "n", "regs")).alias("first"))
        .select("same", F.col("first.id").alias("node"), "first.n", "first.regs")
    )
    classes = cut(classes)
    width = 2 * ROWS
    hashes = [F.xxhash64(F.lit(i), F.substring("regs", i * width + 1, width)) for i in range(BANDS)]
    bands = classes.select("node", "n", F.explode(F.array(*hashes)).alias("band"))
    shared = bands.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("_top")).filter("hub < _top").drop("_top")
    members = cut(bands.join(shared, "band").select("band", "hub", "node", "n"))
    facts = classes.select("node", "n", "regs")

    stars = members.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    compared = stars.join(facts.toDF("a", "n_a", "regs_a"), "a").join(facts.toDF("b", "n_b", "regs_b"), "b")
    links = _links(compared.mapInArrow(_promising(percent), f"a {kind}, b {kind}"), texts, percent, size)

    joined = cut(components(links))
    for whole in (False, True):
        cells = _cells(_apart(members, joined), whole)
        if not cells.isEmpty():
            links = _links(_meet(cells, texts, percent, size), texts, percent, size)
            stars = joined.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
            joined = cut(components(stars.unionByName(links)))
    by_class = classes.join(joined, "node", "left").select("same", F.coalesce("component", "node").alias("component"))
    return (
        sketched.select("id", "same", "n")
        .join(by_class, "same", "left")
        .select(
            F.col("id").alias(key),
            F.col("n").alias("n_shingles"),
            F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"),
            F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(True)).alias("kept"),
        )
    )


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """docs without the rows of near-duplicates but their component's smallest key."""
    found = near_duplicates(docs, key, text, percent)
    return without(docs, cut(found.filter("NOT kept").select(key)), key)
