"""Near-duplicate vectors by sorted projection passes.

Vectors with equal labels and lengths are compared. Equal vectors form a class, found by an aggregate,
and one representative goes on with the number of its copies. In each pass the representatives of a
label are ordered lexicographically by SIGNS concatenated hashes, the sides of random planes through the
label's mean on which they lie, and each is compared with those up to a window before it. Only the links
that connect what a task's links connect leave it; they are joined into components over all passes.

Passes and window follow each label's density, so that a pair of the least cosine is missed with a chance of
MISS at most. With squared distances d of the label's vectors from its mean (their lower tenth), such a pair
has the angle t = arccos(1 - (1 - least) / d) as seen from the mean, and shares one hash with chance
1 - t / pi. It meets where it shares so many first hashes that no more than a window of vectors share them;
PROFILED orders made beforehand tell how many that are for all but CROWDED of the label's vectors. Of the windows
from 2 ** LEAST_WINDOW to 2 ** MOST_WINDOW the one is taken whose passes, as many as bring the chance of never
meeting below MISS, compare least. So dense labels take more passes, and a label of up to one window is
compared whole, in one.

A dense cluster that is a small part of its label shares more hashes than that. So vectors whose first hashes
are shared with more than a window in over a quarter of the passes (of which there are a third more then) are
a label of their own, with a mean, a density and passes of their own, and so on with what is still crowded there.
A pair misses these only if either vector is in a window often enough to meet the other there. What doesn't
thin out so, such as vectors that differ by rounding only, is compared whole, in cells of tiles.

Ranks in an order are counted over all of its partitions, and the vectors dealt out in blocks of ranks
that take the window before them along, so what is compared depends on no partition's bounds.

Then n_links is counted within each component, exactly: its vectors are dealt into tiles, any two tiles
meet in a cell, and a cell's task counts pairs without listing them, first in single precision, where
rounding can't hide a link, then in double precision where one may be.

Defined results: a vector that is null, empty or zero, or has a null or non-finite component, a null
label or a null id, links with nothing and is kept. Vectors of different lengths don't link. Equal
vectors (repeated rows too) link with each other. An empty table gives none. Only the key, label and
vector are read; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import batches
from .graph import components
from .shared import cut

#: The chance that a pair of the least cosine meets in no pass.
MISS = 1e-4
#: log2 of the windows to choose from, and hashes of an order.
LEAST_WINDOW, MOST_WINDOW, SIGNS = 7, 12, 64
WINDOWS = range(LEAST_WINDOW, MOST_WINDOW + 1)
#: Numbers of first hashes that are looked at, and the share of vectors that may share them with too many.
DEPTHS, CROWDED = range(4, SIGNS + 1, 4), 0.05
#: Orders made beforehand.
PROFILED = 4
#: Levels of crowded vectors that are ordered anew; on the last one, or where over half of them stay, all pairs are compared.
LEVELS = 6
#: Ranks of a block, in windows.
BLOCK = 4
#: Vectors of a component's tile: at least LEAST_TILE while it has under SPREAD tiles, then up to TILE.
LEAST_TILE, SPREAD, TILE = 1024, 8, 1 << 15
#: Vectors that are compared with others at once.
STEP = 256
#: Bytes of labels' means up to which they are sent to every task, and rows of other small tables.
SENT_BYTES, SENT_ROWS = 16 << 20, 1 << 16
SEED = 20


def passes(n: int, spread: float, crowded: dict[int, dict[int, int]], least: float) -> tuple[int, int, int, int]:
    """The number of passes and the window for n vectors whose squared distance from their mean is spread, the hashes
    that a pair should share to meet, and how many vectors share so many with more than the window. crowded: for
    each number of first hashes and each window's log2, the vectors that share so many hashes with more vectors
    than the window."""
    angle = math.acos(max(-1.0, min(1.0, 1 - (1 - least) / max(spread, 1e-12))))
    same = max(1 - angle / math.pi, 1e-3)
    whole = next((w for w in WINDOWS if n <= 1 << w), None)
    if whole:
        return 1, 1 << whole, 0, 0
    best = None
    for w in WINDOWS:
        depth = next((d for d in sorted(crowded) if crowded[d][w] <= CROWDED * n), SIGNS)
        over, meet = crowded[depth][w], same**depth
        k = math.ceil(math.log(MISS) / math.log1p(-meet))
        if over:
            k = math.ceil(k * 4 / 3)
        if best is None or k * ((1 << w) + STEP) < best[0] * (best[1] + STEP):
            best = k, 1 << w, depth, over
    return best


def _normal(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, and which of the vectors have one."""
    # + 0.0 makes zeros of either sign equal.
    vectors = vectors.astype(np.float64) + 0.0
    top = np.abs(vectors).max(axis=1, initial=0)
    good = np.isfinite(vectors).all(axis=1) & (top > 0)
    vectors = vectors[good] / top[good, None]
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None], good


def _raw(column: pa.Array, kind: pa.DataType) -> tuple[list[bytes | None], list[bytes | None]]:
    """The bytes of each vector, and a digest of its unit vector; None where it has none."""
    lists = column.cast(pa.large_list(kind))
    size = np.diff(lists.offsets.to_numpy())
    flat = lists.values.to_numpy(zero_copy_only=False)
    start = lists.offsets.to_numpy()[:-1]
    raw: list[bytes | None] = [None] * len(lists)
    same: list[bytes | None] = [None] * len(lists)
    valid = lists.is_valid().to_numpy(zero_copy_only=False)
    for n in np.unique(size[valid & (size > 0)]).tolist():
        rows = np.flatnonzero(valid & (size == n))
        vectors = flat[start[rows][:, None] + np.arange(n)]
        units, good = _normal(vectors)
        for row, vector, unit in zip(rows[good].tolist(), vectors[good], units, strict=True):
            raw[row], same[row] = vector.tobytes(), xxhash.xxh3_128_digest(unit)
    return raw, same


def _prepare(single: bool):
    kind = pa.float32() if single else pa.float64()

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            if not batch.num_rows:
                continue
            raw, same = _raw(batch.column("vector"), kind)
            able = batch.column("label").is_valid().to_numpy(False) & batch.column("id").is_valid().to_numpy(False)
            same = [d if ok else None for d, ok in zip(same, able, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array(same, pa.binary()), pa.array(raw, pa.binary())],
                names=["id", "label", "same", "raw"],
            )

    return run


def _matrix(column: pa.Array, single: bool) -> np.ndarray:
    """The unit vectors of vectors' bytes."""
    rows = column.to_pylist()
    return _normal(np.frombuffer(b"".join(rows), np.float32 if single else np.float64).reshape(len(rows), -1))[0]


def _sums(single: bool):
    """For each group in a batch: its vectors, and the sums of their components."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in stream:
            group = table.column("group").to_numpy()
            for g in np.unique(group).tolist():
                at = np.flatnonzero(group == g)
                total = _matrix(table.column("raw").take(pa.array(at)), single).sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array([g]), pa.array([total.tolist()])], names=["group", "sums"])

    return run


def _centred(batch: pa.RecordBatch, single: bool) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of the batch with vectors of one length, and these from their groups' means."""
    length = np.array([len(r) for r in batch.column("raw").to_pylist()])
    for n in np.unique(length).tolist():
        part = batch.take(pa.array(np.flatnonzero(length == n)))
        means = np.frombuffer(b"".join(part.column("mean").to_pylist()), np.float64)
        vectors = _matrix(part.column("raw"), single)
        yield part, vectors - means.reshape(vectors.shape)


def _distances(single: bool):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for part, vectors in _centred(batch, single):
                yield pa.RecordBatch.from_arrays([part.column("group"), pa.array((vectors * vectors).sum(axis=1))], names=["group", "d"])

    return run


def _orders(single: bool, level: int):
    """A row for each vector and pass, with its place in the order as a number."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for part, vectors in _centred(batch, single):
                n = part.column("passes").to_numpy()
                for k in range(int(n.max(initial=0))):
                    at = np.flatnonzero(n > k)
                    planes = np.random.default_rng([SEED, k, vectors.shape[1], *[level] * (level > 0)]).standard_normal((vectors.shape[1], SIGNS))
                    signs = np.packbits(vectors[at] @ planes > 0, axis=1)
                    # As a signed number in the same order.
                    order = signs.view(">u8").astype(np.uint64)[:, 0] ^ np.uint64(1 << 63)
                    own = part.select(["group", "node"]).take(pa.array(at))
                    yield pa.RecordBatch.from_arrays(
                        [own.column("group"), pa.array(np.full(len(at), k), pa.int32()), pa.array(order.view(np.int64)), own.column("node")],
                        names=["group", "pass", "order", "node"],
                    )

    return run


def _close(low: np.ndarray, vectors: np.ndarray, x: slice, y: slice, own: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Those rows of x that link with some of y, and with which; own says which pairs count."""
    # Rounding takes less from a product of two unit vectors.
    near_least = np.float32(least - (vectors.shape[1] + 8) * 1.2e-7)
    near = (low[x] @ low[y].T >= near_least) & own
    rows = np.flatnonzero(near.any(axis=1))
    near = near[rows]
    if len(rows):
        near &= vectors[x][rows] @ vectors[y].T >= least
    return rows, near


def _windows(least: float, single: bool):
    """Of each block: links that connect what its links within the windows connect."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches.groups(stream, ["group", "pass", "block"]):
            rows = table.combine_chunks().to_batches()[0]
            rank, window, node = rows.column("rank").to_numpy(), int(rows.column("window")[0].as_py()), rows.column("node")
            vectors = _matrix(rows.column("raw"), single)
            low, comp = vectors.astype(np.float32), np.arange(len(rank))
            a, b = [], []
            for at in range(int(np.searchsorted(rank, rows.column("block")[0].as_py() * BLOCK * window)), len(rank), STEP):
                x, y = slice(at, min(at + STEP, len(rank))), slice(max(0, at - window), min(at + STEP, len(rank)))
                gap = rank[x, None] - rank[None, y]
                found, near = _close(low, vectors, x, y, (gap > 0) & (gap <= window), least)
                for k, links in zip((found + at).tolist(), near, strict=True):
                    others = _connected(comp, k, np.flatnonzero(links) + y.start)
                    a += [k] * len(others)
                    b += others
            if a:
                yield pa.RecordBatch.from_arrays([node.take(pa.array(a)), node.take(pa.array(b))], names=["a", "b"])

    return run


def _connected(comp: np.ndarray, k: int, to: np.ndarray) -> list[int]:
    """Some of to, one for each component that k isn't in yet; comp then has them in k's."""
    parts, first = np.unique(comp[to], return_index=True)
    found = []
    for part, other in zip(parts.tolist(), to[first].tolist(), strict=True):
        if part != comp[k]:
            comp[comp == part] = comp[k]
            found.append(other)
    return found


def _cells(least: float, single: bool):
    """Of each cell: links that connect what all links in it connect."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches.groups(stream, ["component", "i", "j"]):
            rows = table.combine_chunks().to_batches()[0]
            node, vectors = rows.column("node"), _matrix(rows.column("raw"), single)
            low, comp = vectors.astype(np.float32), np.arange(len(vectors))
            a, b = [], []
            for at in range(0, len(vectors), STEP):
                x, y = slice(at, min(at + STEP, len(vectors))), slice(0, min(at + STEP, len(vectors)))
                own = np.arange(y.start, y.stop) < np.arange(x.start, x.stop)[:, None]
                found, near = _close(low, vectors, x, y, own, least)
                for k, links in zip((found + at).tolist(), near, strict=True):
                    others = _connected(comp, k, np.flatnonzero(links))
                    a += [k] * len(others)
                    b += others
            if a:
                yield pa.RecordBatch.from_arrays([node.take(pa.array(a)), node.take(pa.array(b))], names=["a", "b"])

    return run


def _counts(least: float, single: bool):
    """For each vector of a cell, the copies of the vectors in it that it links with."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches.groups(stream, ["component", "i", "j"]):
            rows = table.combine_chunks().to_batches()[0]
            tile, i, j = (rows.column(c).to_numpy() for c in ("tile", "i", "j"))
            order = np.argsort(tile != i, kind="stable")
            rows = rows.take(pa.array(order))
            n, whole = int((tile == i).sum()), i[0] == j[0]
            copies, found = rows.column("copies").to_numpy().astype(float), np.zeros(len(order))
            vectors = _matrix(rows.column("raw"), single)
            low = vectors.astype(np.float32)
            for at in range(0, n, STEP):
                x, y = slice(at, min(at + STEP, n)), slice(at if whole else n, len(order))
                own = np.arange(y.start, y.stop) > np.arange(x.start, x.stop)[:, None]
                own, near = _close(low, vectors, x, y, own, least)
                if len(own):
                    found[own + at] += near @ copies[y]
                    found[y] += copies[own + at] @ near
            at = pa.array(np.flatnonzero(found))
            yield pa.RecordBatch.from_arrays([rows.column("node").take(at), pa.array(found[found > 0].astype(np.int64))], names=["node", "n"])

    return run


def _small(rows: DataFrame, bound: int = SENT_ROWS) -> DataFrame:
    """rows, sent to every task if they are few."""
    return F.broadcast(rows) if rows.count() <= bound else rows


def _grouped(classes: DataFrame, least: float, single: bool, level: int) -> tuple[DataFrame, DataFrame]:
    """The classes that have another to compare with, with their group (of a label and length) and its mean;
    and each group's number of passes, window, hashes to share and crowded vectors."""
    sizes = classes.groupBy("label", F.length("raw").alias("length")).agg(F.count("*").alias("n")).filter("n > 1")
    groups = cut(sizes.withColumn("group", F.monotonically_increasing_id()))
    rows = classes.select("label", "node", "raw", F.length("raw").alias("length")).join(_small(groups.drop("n")), ["label", "length"]).select("group", "node", "raw")
    sums = rows.select("group", "raw").mapInArrow(_sums(single), "group long, sums array<double>")
    each = sums.select("group", F.posexplode("sums").alias("i", "x")).groupBy("group", "i").agg(F.sum("x").alias("x"))
    means = each.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("x")).join(groups, "group")
    means = cut(means.select("group", "n", F.transform("x", lambda v: v["x"] / F.col("n")).alias("mean")))
    width = means.agg(F.sum(F.size("mean"))).first()[0] or 0
    centres = means.select("group", "mean")
    rows = rows.join(F.broadcast(centres) if 8 * width <= SENT_BYTES else centres, "group")

    def packed(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            lists = [np.array(m, np.float64).tobytes() for m in batch.column("mean").to_pylist()]
            yield batch.drop_columns(["mean"]).append_column("mean", pa.array(lists, pa.binary()))

    kind = rows.schema["node"].dataType.simpleString()
    rows = cut(rows.select("group", "node", "raw", "mean").mapInArrow(packed, f"group long, node {kind}, raw binary, mean binary"))
    def chosen(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            profiles = [own or [] for own in batch.column("profile").to_pylist()]
            crowded = [{r["depth"]: {w: -(-r[f"w{w}"] // PROFILED) for w in WINDOWS} for r in own} for own in profiles]
            facts = zip(batch.column("n").to_pylist(), batch.column("spread").to_pylist(), crowded, strict=True)
            found = [passes(n, d or 0.0, own, least) for n, d, own in facts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("group"), *(pa.array(v, pa.int32()) for v in list(zip(*found)) or [()] * 4)], names=["group", "passes", "window", "depth", "over"]
            )

    # What one window holds needs no profile.
    large = cut(groups.filter(F.col("n") > 1 << MOST_WINDOW).select("group"))
    if not large.count():
        facts = groups.select("group", "n", F.lit(None).cast("double").alias("spread"), F.lit(None).cast("array<struct<depth:int>>").alias("profile"))
        return rows, cut(facts.mapInArrow(chosen, "group long, passes int, window int, depth int, over int"))
    some = rows.join(_small(large), "group")
    spread = some.mapInArrow(_distances(single), "group long, d double").groupBy("group").agg(F.percentile_approx("d", 0.1, 1000).alias("spread"))
    order = some.withColumn("passes", F.lit(PROFILED)).mapInArrow(_orders(single, level), f"group long, pass int, order long, node {kind}")
    first = F.array(*(F.struct(F.lit(d).alias("depth"), F.shiftright("order", 64 - d).alias("prefix")) for d in DEPTHS))
    shared = order.select("group", "pass", F.explode(first).alias("first")).groupBy("group", "pass", "first").agg(F.count("*").alias("m"))
    over = [F.sum(F.when(F.col("m") > 1 << w, F.col("m")).otherwise(0)).alias(f"w{w}") for w in WINDOWS]
    crowded = shared.groupBy("group", "first.depth").agg(*over)
    # len(DEPTHS) rows a group.
    profile = crowded.groupBy("group").agg(F.collect_list(F.struct("depth", *(f"w{w}" for w in WINDOWS))).alias("profile"))
    facts = groups.select("group", "n").join(spread, "group", "left").join(profile, "group", "left").select("group", "n", "spread", "profile")
    return rows, cut(facts.mapInArrow(chosen, "group long, passes int, window int, depth int, over int"))


def _linked(classes: DataFrame, least: float, single: bool, level: int = 0) -> DataFrame:
    """Links a, b between classes' nodes that the passes find, as many as connect what they connect."""
    kind = classes.schema["node"].dataType.simpleString()
    rows, facts = _grouped(classes, least, single, level)
    facts = _small(facts)
    orders = rows.join(facts, "group").select("group", "node", "raw", "mean", "passes")
    orders = orders.mapInArrow(_orders(single, level), f"group long, pass int, order long, node {kind}")
    sort = ["group", "pass", "order", "node"]
    ordered = orders.repartitionByRange(*sort).sortWithinPartitions(*sort)
    # Numbers go up within a partition, whose own number is in the upper bits.
    numbered = cut(ordered.select("group", "pass", "order", "node", F.monotonically_increasing_id().alias("number")))
    ranked = numbered.drop("order").withColumn("part", F.expr("number >> 33"))
    pieces = ranked.groupBy("group", "pass", "part").agg(F.min("number").alias("first"), F.count("*").alias("rows"))
    before = Window.partitionBy("group", "pass").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = cut(pieces.withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).drop("first", "rows"))
    ranked = ranked.join(_small(pieces), ["group", "pass", "part"]).join(facts.select("group", "window"), "group")
    width = F.col("window") * BLOCK
    ranked = ranked.withColumn("rank", F.col("number") + F.col("start"))
    last = F.floor((F.col("rank") + F.col("window")) / width)
    blocks = ranked.select("group", "pass", "node", "rank", "window", F.explode(F.sequence(F.floor(F.col("rank") / width), last)).alias("block"))
    own = blocks.join(rows.select("node", "raw"), "node").repartition("group", "pass", "block").sortWithinPartitions("group", "pass", "block", "rank")
    links = own.mapInArrow(_windows(least, single), f"a {kind}, b {kind}")
    full = facts.filter("over > 0")
    if not full.limit(1).count():
        return links
    left = cut(_crowded(numbered, full))
    n = left.count()
    if not n:
        return links
    again = cut(classes.join(left, "node", "left_semi"))
    if level + 1 >= LEVELS or 2 * n > rows.count():
        return links.unionByName(_all_pairs(again, least, single))
    return links.unionByName(_linked(again, least, single, level + 1))


def _crowded(numbered: DataFrame, full: DataFrame) -> DataFrame:
    """The nodes of groups of full whose first hashes are shared with more than the window in over a quarter of the
    passes."""
    prefix = F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.expr("shiftright(order, 64 - depth)"))
    each = numbered.join(F.broadcast(full) if full.count() <= SENT_ROWS else full, "group")
    each = each.select("group", "pass", "node", "passes", "window", prefix.alias("prefix"))
    shared = each.groupBy("group", "pass", "prefix", "window").agg(F.count("*").alias("m")).filter("m > window")
    # Each of these has more than a window of vectors, so there are few.
    hits = each.join(_small(cut(shared.select("group", "pass", "prefix"))), ["group", "pass", "prefix"])
    return hits.groupBy("node", "passes").agg(F.count("*").alias("m")).filter("4 * m > passes").select("node")


def _all_pairs(classes: DataFrame, least: float, single: bool) -> DataFrame:
    """Links between all classes of equal labels and lengths: two tiles meet in a cell, whose task sends on what connects."""
    kind = classes.schema["node"].dataType.simpleString()
    sizes = classes.groupBy("label", F.length("raw").alias("length")).agg(F.count("*").alias("n")).filter("n > 1")
    sizes = cut(sizes.withColumn("component", F.monotonically_increasing_id()))
    tiles = F.ceil(F.col("n") / F.lit(LEAST_TILE)).cast("int")
    tiled = classes.withColumn("length", F.length("raw")).join(sizes.withColumn("tiles", tiles), ["label", "length"])
    tiled = tiled.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    cells = tiled.select("component", F.least("tile", "_other").alias("i"), F.greatest("tile", "_other").alias("j"), "node", "raw")
    cells = cells.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    return cells.mapInArrow(_cells(least, single), f"a {kind}, b {kind}")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.98) -> DataFrame:
    """The key, n_links (other vectors of cosine >= least), component_id (the smallest key reachable)
    and kept of every row."""
    kind, labels, given_kind = (vectors.schema[c].dataType.simpleString() for c in (key, label, vector))
    single = given_kind == "array<float>"
    given = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    prepared = cut(given.mapInArrow(_prepare(single), f"id {kind}, label {labels}, same binary, raw binary"))
    able = prepared.filter("same IS NOT NULL")
    classes = able.groupBy("label", "same").agg(F.min(F.struct("id", "raw")).alias("first"), F.count("*").alias("copies"))
    classes = cut(classes.select("label", "same", F.col("first.id").alias("node"), "first.raw", "copies"))
    joined = cut(components(_linked(classes, least, single)))

    sizes = joined.groupBy("component").agg(F.count("*").alias("n"))
    tiles = F.greatest(F.ceil(F.col("n") / F.lit(TILE)), F.least(F.lit(SPREAD), F.ceil(F.col("n") / F.lit(LEAST_TILE)))).cast("int")
    cells = (
        classes.join(joined, "node")
        .join(sizes.select("component", tiles.alias("tiles")), "component")
        .withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("component", F.least("tile", "_other").alias("i"), F.greatest("tile", "_other").alias("j"), "tile", "node", "raw", "copies")
    )
    cells = cells.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    counted = cells.mapInArrow(_counts(least, single), f"node {kind}, n long").groupBy("node").agg(F.sum("n").alias("n"))
    facts = (
        classes.select("label", "same", "node", "copies")
        .join(joined, "node", "left")
        .join(counted, "node", "left")
        .select("label", "same", F.coalesce("component", "node").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links"))
    )
    return (
        prepared.select("id", "label", "same")
        .join(facts, ["label", "same"], "left")
        .select(
            F.col("id").alias(key),
            F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
            F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(True)).alias("kept"),
        )
    )
