"""Arrow batches cut to a bounded number of text bytes, and views of their bytes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import words

#: Text bytes a task holds in work arrays at once (a single longer text goes alone).
SLICE_BYTES = 1 << 20


def sliced(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of each batch whose texts, in the given columns, have about SLICE_BYTES bytes together."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = [pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False) for c in columns or ("text",)]
        size = np.sum(sizes, axis=0)
        part = (np.cumsum(size, dtype=np.int64) - size) // SLICE_BYTES
        cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, batch.num_rows]
        for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield batch.slice(start, end - start)


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Such slices put together until their texts have about most bytes or they are most / 256 rows."""
    held, size, rows = [], 0, 0
    for part in sliced(batches):
        held.append(part)
        size += pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
        rows += part.num_rows
        if size >= most or 256 * rows >= most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size, rows = [], 0, 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _give_back() -> None:
    """Frees what Arrow and the C library keep for later, as far as the platform can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def released(run: Callable, *forget: Callable) -> Callable:
    """run for mapInArrow; at a task's end its Python worker, which stays for other tasks and stages, gives
    back the memory of what it remembered."""

    def wrapped(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(stream)
        finally:
            for each in (words.forget, *forget, _give_back):
                each()

    return wrapped


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    large = pa.types.is_large_string(column.type)
    return pc.fill_null(column.cast(pa.large_binary() if large else pa.binary()), b"").to_pylist()


def byte_view(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in a row, and the n + 1 offsets of the texts in them."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=offsets[1:])
    return np.frombuffer(b"".join(texts), np.uint8), offsets


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of values between each two offsets; 0 where they are equal."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def groups(stream: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, over the ends of batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in stream:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy() for k in keys], axis=1)
        cuts = np.r_[0, np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, batch.num_rows].tolist()
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            own = tuple(key[start])
            if held and own != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            last = own
        # Copied, or it would keep the whole batch.
        held[-1] = held[-1].take(pa.array(np.arange(held[-1].num_rows)))
    if held:
        yield pa.Table.from_batches(held)
