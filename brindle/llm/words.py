"""Words ``[^\\x20\\x09-\\x0D]+`` of texts as 64-bit fingerprints, and hashes of runs of words."""

from __future__ import annotations

import numpy as np
import xxhash

#: Distinct words, of SHORT bytes at most, whose fingerprint a Python worker remembers, some 6 MB.
REMEMBERED, SHORT = 1 << 15, 64


class _Fingerprints(dict):
    def __init__(self, seed: int) -> None:
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word, self.seed)
        if len(self) < REMEMBERED and len(word) <= SHORT:
            self[word] = value
        return value


_known = _Fingerprints(0), _Fingerprints(1)


def forget() -> None:
    """Frees what is remembered, at the end of a task."""
    for known in _known:
        known.clear()


def split(text: bytes) -> list[bytes]:
    """bytes.split() parts at exactly space, tab, newline, VT, FF and CR."""
    return text.split()


def fingerprints(texts: list[bytes], fold: bool = False, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all words in a row, and the n + 1 offsets of the texts in them.
    fold lower-cases A-Z (bytes.lower() touches nothing else); second takes another hash of the words."""
    known = _known[second]
    if len(known) >= REMEMBERED:
        known.clear()
    words: list[bytes] = []
    offsets = np.zeros(len(texts) + 1, np.int64)
    for i, text in enumerate(texts):
        words += (text.lower() if fold else text).split()
        offsets[i + 1] = len(words)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), offsets


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads each bit over all."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def runs(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A hash of each n consecutive fingerprints: len(h) - n + 1 values."""
    m = max(0, len(h) - n + 1)
    out = np.full(m, mix(np.array([seed + n], np.uint64))[0], np.uint64)
    for i in range(n):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[i : i + m]
    return mix(out)


def owners(offsets: np.ndarray) -> np.ndarray:
    """The index of the text that each word belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def inside(offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of n words within one text, and those texts' indexes."""
    owner = owners(offsets)
    m = max(0, len(owner) - n + 1)
    starts = np.flatnonzero(owner[:m] == owner[n - 1 : n - 1 + m])
    return starts, owner[starts]
