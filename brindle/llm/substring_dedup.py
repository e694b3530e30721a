"""Substring dedup: words covered by a window of words that an earlier document has too.

First a count-min sketch finds windows that may repeat. Each task counts its windows in DEPTH rows of
cells, counters stopping at 2, and sends the cells it used; the counters of all tasks are added up by
block of cells. A window whose counters all reach 2 may repeat; every window that does repeat is
among these, since counters only overestimate.

The merged sketch is one bit a cell and grows with the texts, in parts: the highest bits of a window's
hash choose its part, so a part has all counters of its windows. Driver and tasks hold one part of
2 ** PART_BITS cells a row at a time (16 MB), and a task reads each part once for HELD windows. At most
2 ** MAX_BITS cells a row are sent (2 GB in all parts, some 70 GB of text at one window a cell). Beyond
that the first sketch passes more windows, and the second one, below, sees them.

Then only those windows are grouped, by 96 bits made of two independent 64-bit hashes of each word. A
task marks by itself every place whose window a smaller key of its own has; only the places of its
smallest key are sent on, packed by bucket of the window, so a window that very many documents share
comes once from each task. A bucket's task counts its windows in a second sketch, of its own size, and
groups those that reach 2; it marks the places whose key isn't the window's smallest, and once it holds
MOST places keeps of each window only those of the smallest key. So a bucket is bounded by its windows,
not by the documents that share them. Marks go on packed by bucket of their text, where they become one row
a text, and are joined to the texts by key and hash of the text; texts that have none are not shuffled.

Defined results: the key must be of an integer type. A null or empty text has no words. Windows of rows
with a null key are neither removed nor make others so. Repeated rows with one key never remove each
other's words, and are marked alike; rows of one key and other texts are marked each by its own text.
A very long text is one row like any other: its task holds it whole. An empty table gives none. Words
are joined by one space where something was removed; other texts stay as they are. Columns n_words and
n_removed of the input are replaced by the results; all others are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from . import batches, words
from .shared import cut, flagged, in_batches

WINDOW = 13
DEPTH = 2
#: Bits of the cells of a block that is merged at once, of a part's row, and of a row of all parts.
BLOCK_BITS, PART_BITS, MIN_BITS, MAX_BITS = 22, 26, 16, 33
#: Windows that a task counts at once, or compares with the sketch at once, and places that it sends or a
#: bucket holds at once.
COUNTED, HELD, MOST = 3 << 20, 1 << 19, 1 << 17
#: Windows whose cells are worked out at once.
STEP = 1 << 16
#: Texts' bytes for each bucket of windows, and the least number of buckets.
BUCKET_BYTES, MIN_BUCKETS = 2 << 20, 256


def _cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The cells of windows in a row of 2 ** bits cells, bits being 32 at most. Work arrays are those of STEP windows."""
    out = np.empty(len(h), np.uint32)
    for i in range(0, len(h), STEP):
        out[i : i + STEP] = words.mix(h[i : i + STEP] + np.uint64(row + 1)) >> np.uint64(64 - bits)
    return out


def _sizes(total: int) -> tuple[int, int]:
    """Bits of the number of parts and of a part's row for texts of total bytes: three times as many cells as
    windows or more, at six bytes a word, up to MAX_BITS."""
    bits = int(np.clip(int(total / 2).bit_length(), MIN_BITS, MAX_BITS))
    return max(0, bits - PART_BITS), min(bits, PART_BITS)


def _by_part(h: np.ndarray, part_bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each part that windows fall in, and their places in h."""
    if not part_bits:
        yield 0, np.arange(len(h))
        return
    part = (h >> np.uint64(64 - part_bits)).astype(np.uint8)
    for p in np.unique(part).tolist():
        yield p, np.flatnonzero(part == p)


def _binary(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The bytes of data cut at the n + 1 starts."""
    offsets = (starts * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _packed_places(places: np.ndarray) -> bytes:
    """Rising places as steps of one byte, or of two where that is shorter; the greatest number steps on
    without a place, and the first byte tells the width."""
    steps = np.diff(places, prepend=-1)
    kind = np.uint8 if len(steps) + int((steps // 255).sum()) < 2 * len(steps) else np.uint16
    most = np.iinfo(kind).max
    skips = steps // most
    out = np.full(len(steps) + int(skips.sum()), most, kind)
    out[np.cumsum(skips + 1) - 1] = steps % most
    return bytes([out.itemsize]) + out.tobytes()


def _places(data: bytes) -> np.ndarray:
    kind = np.uint8 if data[0] == 1 else np.uint16
    steps = np.frombuffer(data, kind, offset=1)
    return np.cumsum(steps, dtype=np.int64)[steps < np.iinfo(kind).max] - 1


def _counted(part_bits: int, bits: int, size: int):
    def cells_of(part: int, row: int, cells: np.ndarray) -> pa.RecordBatch:
        """The sorted cells of a part's row, by block."""
        block = np.arange((int(cells[-1]) >> BLOCK_BITS) + 2, dtype=np.int64)
        starts = np.searchsorted(cells, (block << BLOCK_BITS).astype(np.uint32)).tolist()
        own = [(k, i, j) for k, i, j in zip(block.tolist(), starts[:-1], starts[1:], strict=False) if i < j]
        packed = [_packed_places((cells[i:j] & np.uint32((1 << BLOCK_BITS) - 1)).astype(np.int64)) for _, i, j in own]
        n = len(packed)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, part), pa.int32()), pa.array(np.full(n, row), pa.int32()), pa.array([k for k, _, _ in own], pa.int32()), pa.array(packed, pa.binary())],
            names=["part", "row", "block", "places"],
        )

    def send(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        bounds = [np.searchsorted(h, np.arange(1 << part_bits, dtype=np.uint64) << np.uint64(64 - part_bits)) for h in held] if part_bits else [[0]] * len(held)
        for part in range(1 << part_bits):
            own = [h[b[part] : b[part + 1] if part + 1 < len(b) else None] for h, b in zip(held, bounds, strict=True)]
            for row in range(DEPTH if any(map(len, own)) else 0):
                cells = np.concatenate([_cells(h, row, bits) for h in own])
                cells.sort()
                first = np.r_[True, cells[1:] != cells[:-1]]
                again = np.r_[False, ~first[1:] & first[:-1]]
                # A cell that is listed again counts 2.
                yield cells_of(part, row, cells[first])
                if again.any():
                    yield cells_of(part, row, cells[again])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches.sliced(stream):
            h, offsets = words.fingerprints(batches.as_bytes(batch.column("text")))
            starts, _ = words.inside(offsets, size)
            held.append(np.sort(words.runs(h, size)[starts]))
            if sum(map(len, held)) > COUNTED:
                yield from send(held)
                held.clear()
        if held:
            yield from send(held)

    return batches.released(run)


def _merged(bits: int):
    """For each block, one bit a cell: whether its counters add up to 2."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, counts = None, np.zeros(1 << min(bits, BLOCK_BITS), np.uint8)

        def block() -> pa.RecordBatch:
            data = pa.compress(np.packbits(counts >= 2, bitorder="little").tobytes(), codec="zstd", asbytes=True)
            counts[:] = 0
            arrays = [pa.array([k], pa.int32()) for k in key] + [pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["part", "row", "block", "bits"])

        for batch in stream:
            for *own, places in zip(*(batch.column(c).to_pylist() for c in ("part", "row", "block", "places")), strict=True):
                if key != own:
                    if key:
                        yield block()
                    key = own
                at = _places(places)
                counts[at] = np.minimum(counts[at] + 1, 2)
        if key:
            yield block()

    return run


class Sketch:
    """The merged sketch of texts of total bytes, each part broadcast for itself: for each cell, whether it
    counted 2 windows or more. A part is sent as its blocks, compressed; the driver holds one at a time."""

    def __init__(self, texts: DataFrame, total: int, size: int = WINDOW) -> None:
        self.part_bits, self.bits = _sizes(total)
        spark = texts.sparkSession
        counted = texts.mapInArrow(_counted(self.part_bits, self.bits, size), "part int, row int, block int, places binary")
        ordered = counted.repartition("part", "row", "block").sortWithinPartitions("part", "row", "block")
        merged = cut(ordered.mapInArrow(_merged(self.bits), "part int, row int, block int, bits binary"))
        self.parts: list[Broadcast] = []
        for p in range(1 << self.part_bits):
            own = merged.filter(F.col("part") == p).toArrow()
            self.parts.append(spark.sparkContext.broadcast([own.column(c).to_pylist() for c in ("row", "block", "bits")]))

    def cells(self, part: int) -> np.ndarray:
        """The part's cells, [DEPTH, bytes]."""
        size = 1 << (min(self.bits, BLOCK_BITS) - 3)
        out = np.zeros((DEPTH, 1 << (self.bits - 3)), np.uint8)
        sent = self.parts[part]
        for row, block, data in zip(*sent.value, strict=True):
            out[row, block * size : (block + 1) * size] = np.frombuffer(pa.decompress(data, size, codec="zstd"), np.uint8)
        # Or the worker would hold all parts.
        if hasattr(sent, "_value"):
            del sent._value
        return out

    def may_repeat(self, h: np.ndarray) -> np.ndarray:
        """For each window whether all its counters reach 2."""
        out = np.zeros(len(h), bool)
        for part, open_ in _by_part(h, self.part_bits):
            cells_set = self.cells(part)
            for i in range(0, len(open_), STEP):
                some = open_[i : i + STEP]
                for row in range(DEPTH):
                    cells = _cells(h[some], row, self.bits)
                    some = some[(cells_set[row, cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 > 0]
                out[some] = True
        return out


#: What is sent of a place: its window's two hashes, the text's hash and key, and the window's first word;
#: of a marked place, the last three.
_SENT = (np.uint64, np.uint32, np.int32, np.int64, np.uint32)
_MARK = _SENT[2:]


def _pack(columns: list[np.ndarray], kinds: tuple[type, ...]) -> bytes:
    """The columns' bytes, all first bytes first: high bytes that are mostly equal compress well."""
    return b"".join(c.astype(t, copy=False).view(np.uint8).reshape(len(c), -1).T.tobytes() for c, t in zip(columns, kinds, strict=True))


def _unpack(data: bytes, kinds: tuple[type, ...]) -> list[np.ndarray]:
    n, at, out = len(data) // sum(np.dtype(t).itemsize for t in kinds), 0, []
    for t in kinds:
        width = np.dtype(t).itemsize
        planes = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(t)[:, 0])
        at += n * width
    return out


def _packets(bucket: np.ndarray, columns: list[np.ndarray], kinds: tuple[type, ...], marks: bool) -> pa.RecordBatch:
    """The columns' rows, which are in the order of buckets, as one packet a bucket."""
    starts = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(bucket)]
    packed = [_pack([c[i:j] for c in columns], kinds) for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[starts[:-1]].astype(np.int32)), pa.array(np.full(len(packed), marks)), pa.array(packed, pa.binary())], names=["bucket", "marks", "data"]
    )


def _marked(columns: list[np.ndarray], bucket_bits: int) -> pa.RecordBatch:
    """Packets of marked places, by bucket of their texts."""
    th, key, place = columns
    bucket = words.mix(key.view(np.uint64) ^ words.mix(th.astype(np.uint64))) >> np.uint64(64 - bucket_bits)
    order = np.lexsort((place, th, key, bucket))
    return _packets(bucket[order].astype(np.int64), [c[order] for c in columns], _MARK, True)


def _above_least(h: np.ndarray, g: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by window and key, and whether each place in it has a key above its window's least."""
    order = np.lexsort((key, g, h))
    h, g, key = h[order], g[order], key[order]
    first = np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])]
    least = key[np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))]
    return order, key > least


def _windows(sketch: Sketch, size: int, bucket_bits: int):
    """Windows that may repeat: places of each task's smallest key by bucket, and the marks of others."""

    def send(parts: list) -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
        parts.clear()
        order, above = _above_least(columns[0], columns[1], columns[3])
        own, rest = order[above], order[~above]
        if len(own):
            yield _marked([c[own] for c in columns[2:]], bucket_bits)
        columns = [c[rest] for c in columns]
        yield _packets((columns[0] >> np.uint64(64 - bucket_bits)).astype(np.int64), columns, _SENT, False)

    def chosen(batch: pa.RecordBatch, h: np.ndarray, ok: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
        """The columns to send of a slice's windows that may repeat. Their texts are read once more, for the
        second hash."""
        rows = np.unique(owner[ok])
        texts = batches.as_bytes(batch.column("text").take(pa.array(rows)))
        w, offsets = words.fingerprints(texts, second=True)
        starts, again = words.inside(offsets, size)
        g = (words.runs(w, size, seed=1)[starts] >> np.uint64(32)).astype(np.uint32)
        among = np.isin(owner, rows)
        ok = ok[among]
        own, key, th = again[ok], batch.column("key").to_numpy()[rows], batch.column("th").to_numpy()[rows]
        return h[among][ok], g[ok], th[own], key[own], (starts[ok] - offsets[own]).astype(np.uint32)

    def compared(held: list, parts: list) -> Iterator[pa.RecordBatch]:
        ok = sketch.may_repeat(np.concatenate([h for _, h, _ in held]))
        at = 0
        for batch, h, owner in held:
            own = ok[at : at + len(h)]
            at += len(h)
            if own.any():
                parts.append(chosen(batch, h, own, owner))
                if sum(len(p[0]) for p in parts) > MOST:
                    yield from send(parts)
        held.clear()

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts = [], []
        for batch in batches.sliced(stream):
            w, offsets = words.fingerprints(batches.as_bytes(batch.column("text")))
            starts, owner = words.inside(offsets, size)
            if len(starts):
                held.append((batch, words.runs(w, size)[starts], owner.astype(np.int32)))
                if sum(len(h) for _, h, _ in held) > HELD:
                    yield from compared(held, parts)
        if held:
            yield from compared(held, parts)
        if parts:
            yield from send(parts)

    return batches.released(run)


def _likely(h: np.ndarray) -> np.ndarray:
    """The places of a bucket whose windows reach 2 in a row of cells of the bucket's own."""
    bits = max(MIN_BITS, int(4 * len(h)).bit_length())
    cells = _cells(h, DEPTH, bits)
    return np.flatnonzero(np.bincount(cells, minlength=1 << bits)[cells] >= 2)


def _later(bucket_bits: int):
    """Of packets in the order of buckets, the marks that tasks made and those of each bucket's places whose
    key isn't their window's least."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, packed, size, most, parts = None, [], 0, MOST, []

        def merge(more: bool) -> None:
            """Marks places above their window's least key, and keeps the others if more of the bucket may come."""
            nonlocal size, most
            columns = [np.concatenate(c) for c in zip(*packed, strict=True)]
            packed.clear()
            at = np.arange(len(columns[0])) if more else _likely(columns[0])
            order, above = _above_least(columns[0][at], columns[1][at], columns[3][at])
            own = at[order[above]]
            if len(own):
                parts.append([c[own] for c in columns[2:]])
            size = 0
            if more:
                rest = at[order[~above]]
                packed.append([c[rest] for c in columns])
                size = len(rest)
                most = max(most, 2 * size)

        def send() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
            parts.clear()
            return _marked(columns, bucket_bits).select(["bucket", "data"])

        for batch in stream:
            passing = batch.column("marks")
            yield batch.filter(passing).select(["bucket", "data"])
            rest = batch.filter(pc.invert(passing))
            for bucket, data in zip(rest.column("bucket").to_pylist(), rest.column("data"), strict=True):
                if packed and (bucket != last or size > most):
                    merge(bucket == last)
                    if bucket != last:
                        most = MOST
                    if sum(len(p[0]) for p in parts) > MOST:
                        yield send()
                last = bucket
                packed.append(_unpack(data.as_py(), _SENT))
                size += len(packed[-1][0])
        if packed:
            merge(False)
        if parts:
            yield send()

    return batches.released(run)


def _by_text(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of packets of marks in the order of buckets, one row for each text, with its places as uint32."""
    last, packed, size, most = None, [], 0, MOST

    def merge() -> list[np.ndarray]:
        """Each place once, by text."""
        th, key, place = (np.concatenate(c) for c in zip(*packed, strict=True))
        packed.clear()
        order = np.lexsort((place, th, key))
        th, key, place = th[order], key[order], place[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (th[1:] != th[:-1]) | (place[1:] != place[:-1])]
        return [th[new], key[new], place[new]]

    def rows() -> pa.RecordBatch:
        th, key, place = merge()
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (th[1:] != th[:-1])])
        return pa.RecordBatch.from_arrays([pa.array(key[starts]), pa.array(th[starts]), _binary(place, np.r_[starts, len(place)])], names=["key", "th", "places"])

    for batch in stream:
        for bucket, data in zip(batch.column("bucket").to_pylist(), batch.column("data"), strict=True):
            if packed and bucket != last:
                yield rows()
                size, most = 0, MOST
            elif size > most:
                packed.append(merge())
                size = len(packed[0][0])
                most = max(most, 2 * size)
            last = bucket
            packed.append(_unpack(data.as_py(), _MARK))
            size += len(packed[-1][0])
    if packed:
        yield rows()


def repeats(texts: DataFrame, size: int = WINDOW) -> DataFrame:
    """key, th and places (uint32 in binary) of each text with windows that a smaller key has too, from
    columns key, th (a hash of the text) and text."""
    texts = in_batches(texts.filter("key IS NOT NULL AND text IS NOT NULL"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bucket_bits = max(MIN_BUCKETS, total // BUCKET_BYTES).bit_length()
    found = texts.mapInArrow(_windows(Sketch(texts, total, size), size, bucket_bits), "bucket int, marks boolean, data binary")
    ordered = found.repartition("bucket").sortWithinPartitions("bucket")
    marks = ordered.mapInArrow(_later(bucket_bits), "bucket int, data binary")
    ordered = marks.repartition("bucket").sortWithinPartitions("bucket")
    return ordered.mapInArrow(batches.released(_by_text), "key long, th int, places binary")


def _removed(size: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches.sliced(stream):
            marks = batch.column("places").to_pylist()
            total, gone, kept = [], [], []
            for text, own_marks in zip(batches.as_bytes(batch.column("text")), marks, strict=True):
                own = words.split(text)
                n = len(own)
                total.append(n)
                places = np.frombuffer(own_marks or b"", np.uint32).astype(np.int64)
                places = places[places + size <= n]
                if not len(places):
                    gone.append(0)
                    kept.append(text)
                    continue
                change = np.bincount(places, minlength=n + 1) - np.bincount(places + size, minlength=n + 1)
                covered = np.cumsum(change[:-1]) > 0
                gone.append(int(covered.sum()))
                kept.append(b" ".join([w for w, c in zip(own, covered.tolist(), strict=True) if not c]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("rest"),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                    pa.array(total, pa.int64()),
                    pa.array(gone, pa.int64()),
                ],
                names=["rest", "text", "n_words", "n_removed"],
            )

    return batches.released(run)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """docs, the text without its repeated words, with n_words (before) and n_removed."""
    if not isinstance(docs.schema[key].dataType, IntegralType):
        raise TypeError(f"{key}: an integer key is needed, since the smallest one counts")
    names = [c for c in docs.columns if c != text]
    beside = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in names)).alias("rest"),
        F.col(f"`{text}`").alias("text"),
        F.col(f"`{key}`").cast("long").alias("key"),
        F.hash(F.col(f"`{text}`")).alias("th"),
    )
    kind = beside.schema["rest"].dataType.simpleString()
    marks = cut(repeats(beside.select("key", "th", "text"), size))
    may = flagged(beside, marks, "key")
    near = may.filter("_flag").join(marks, ["key", "th"], "left").select("rest", "text", "places")
    far = may.filter("NOT _flag").select("rest", "text", F.lit(None).cast("binary").alias("places"))
    out = near.unionByName(far).mapInArrow(_removed(size), f"rest {kind}, text string, n_words long, n_removed long")
    columns = [F.col("text").alias(c) if c == text else F.col(f"rest.`{c}`") for c in docs.columns if c not in ("n_words", "n_removed")]
    return out.select(*columns, "n_words", "n_removed")
