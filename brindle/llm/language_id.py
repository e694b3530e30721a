"""Language identification by prediction by partial matching (PPM).

For each language a context tree over bytes of depth ORDER gives the code length of the next byte:
from the longest context that the language has seen, with escapes (method C, without exclusions) to
shorter ones and last to 256 equal bytes. The statistics are frozen after training, so the cost of
a byte depends on it and the ORDER bytes before it alone, and a text's code length is a sum of
looked-up costs. The language with the shortest code wins; the first by name where codes are equal.

Training counts the (ORDER + 1)-byte strings of every labelled text, combined in each task and then
by key, and every string is kept, so the trees grow with the corpus. Languages are scored in groups of
LANGUAGES. A group's strings go out in parts by the two bytes before the last one: all strings of such
a context and of its longer ones are in one part, and the two lowest orders, counted over all strings,
in every part. So a part gives whole costs of the strings of its contexts, and a text's code length is
their sum over parts. The driver and a task hold one part at a time, of about PART costs; only for a
model of several parts does a task read them anew for each HELD bytes of texts.

Defined results: a null text, an empty one and one without a letter are "und" with score 0, as is
every text if nothing was learned. Null labels are not learned from. Repeated rows count each time. A very
long text is scored whole, in its task. An empty table to predict gives none. Columns other than key, text
and label, whatever their names, play no part.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import batches
from .shared import cut, in_batches

ORDER = 3
#: Languages of a group; costs (strings times languages) of a part; text bytes scored with a part at once.
LANGUAGES, PART, HELD = 16, 1 << 22, 16 << 20
#: Strings that a task gathers before it counts them.
GATHERED = 8 << 20
_BEFORE = b"\n" * ORDER


def _strings(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of the texts, it and the ORDER bytes before it as one number; the n + 1
    offsets of the texts. A text starts as if after newlines."""
    data, padded = batches.byte_view([_BEFORE + t for t in texts])
    if not len(data):
        return np.zeros(0, np.uint32), padded
    wide = data.astype(np.uint32)
    n = len(wide) - ORDER
    out = np.zeros(n, np.uint32)
    for i in range(ORDER + 1):
        out = (out << np.uint32(8)) | wide[i : i + n]
    within = np.ones(n, bool)
    for i in range(1, ORDER + 1):
        within[padded[1:-1] - i] = False
    return out[within], padded - ORDER * np.arange(len(padded))


def _count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[np.ndarray]] = defaultdict(list)
    gathered = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            found, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(n)],
                names=["lang", "gram", "n"],
            )
        held.clear()

    for batch in batches.sliced(stream):
        langs, texts = batch.column("lang").to_pylist(), batches.as_bytes(batch.column("text"))
        by_lang = defaultdict(list)
        for lang, text in zip(langs, texts, strict=True):
            by_lang[lang].append(text)
        for lang, own in by_lang.items():
            grams, _ = _strings(own)
            held[lang].append(grams)
            gathered += len(grams)
        if gathered > GATHERED:
            yield from flush()
            gathered = 0
    yield from flush()


@dataclass
class Tree:
    """One language's context tree, as sorted strings of each length with their counts: the longer ones
    of some contexts, pairs of bytes from all strings."""

    strings: np.ndarray
    counts: np.ndarray
    pairs: np.ndarray
    pair_counts: np.ndarray

    def __post_init__(self) -> None:
        self.levels = []
        for k in range(ORDER, -1, -1):
            given, counts = (self.strings, self.counts) if k > 1 else (self.pairs, self.pair_counts)
            own = given & np.uint32((1 << (8 * k + 8)) - 1)
            found, at = np.unique(own, return_inverse=True)
            n = np.bincount(at, counts, len(found))
            contexts, of, distinct = np.unique(found >> np.uint32(8), return_inverse=True, return_counts=True)
            total = np.bincount(of, n, len(contexts)) + distinct
            bits = np.log2(total[of]) - np.log2(n)
            self.levels.append((k, found, bits, contexts, np.log2(total) - np.log2(distinct)))

    def cost(self, strings: np.ndarray) -> np.ndarray:
        """Bits that the last byte of each string takes after the bytes before it."""
        out = np.zeros(len(strings))
        open_ = np.arange(len(strings))
        for k, found, bits, contexts, escape in self.levels:
            if not len(found):
                continue
            own = strings[open_] & np.uint32((1 << (8 * k + 8)) - 1)
            at = np.minimum(np.searchsorted(found, own), len(found) - 1)
            hit = found[at] == own
            out[open_[hit]] += bits[at[hit]]
            open_, own = open_[~hit], own[~hit] >> np.uint32(8)
            at = np.minimum(np.searchsorted(contexts, own), len(contexts) - 1)
            known = contexts[at] == own
            out[open_[known]] += escape[at[known]]
        out[open_] += 8
        return out


class Scorer:
    """Costs of the strings that any tree of a part has, in a hash table; others are worked out."""

    def __init__(self, trees: list[tuple[np.ndarray, ...]]) -> None:
        self.trees = [Tree(*t) for t in trees]
        self.strings = np.unique(np.concatenate([t.strings for t in self.trees]))
        self.costs = [t.cost(self.strings) for t in self.trees]
        self.shift = np.uint32(32 - max(8, int(4 * len(self.strings)).bit_length()))
        self.slots = np.full(1 << (32 - int(self.shift)), -1, np.int32)
        todo, at = np.arange(len(self.strings)), self._slot(self.strings)
        while len(todo):
            free = todo[self.slots[at[todo]] < 0]
            self.slots[at[free]] = free
            todo = todo[self.slots[at[todo]] != todo]
            at[todo] = (at[todo] + 1) % len(self.slots)

    def _slot(self, strings: np.ndarray) -> np.ndarray:
        return ((strings * np.uint32(2654435761)) >> self.shift).astype(np.int64)

    def rows(self, strings: np.ndarray) -> np.ndarray:
        """The place of each string among the trees' ones, or -1."""
        at = self._slot(strings)
        out = self.slots[at]
        open_ = np.flatnonzero((out >= 0) & (self.strings[out] != strings))
        while len(open_):
            at[open_] = (at[open_] + 1) % len(self.slots)
            out[open_] = found = self.slots[at[open_]]
            open_ = open_[(found >= 0) & (self.strings[found] != strings[open_])]
        return out

    def costs_of(self, strings: np.ndarray) -> Iterator[np.ndarray]:
        """Of each language, the bits of each string."""
        rows = self.rows(strings)
        missing = np.flatnonzero(rows < 0)
        others, of = np.unique(strings[missing], return_inverse=True)
        for tree, costs in zip(self.trees, self.costs, strict=True):
            cost = costs[rows]
            cost[missing] = tree.cost(others)[of]
            yield cost


@dataclass
class Group:
    """Languages, and the first and last context of each part with its broadcast trees."""

    languages: list[str]
    parts: list[tuple[int, int, Broadcast]]


def _tree_arrays(rows: pa.Table, languages: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The sorted strings and the counts of each language."""
    out = []
    for name in languages:
        own = rows.filter(pc.equal(rows.column("lang"), name))
        gram, n = own.column("gram").to_numpy().astype(np.uint32), own.column("n").to_numpy()
        order = np.argsort(gram)
        out.append((gram[order], n[order]))
    return out


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> list[Group]:
    """The trees of each label of the rows, by groups of labels."""
    rows = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    rows = rows.filter("lang IS NOT NULL AND length(text) > 0")
    counted = in_batches(rows).mapInArrow(_count, "lang string, gram long, n long")
    grams = cut(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    names = sorted(r["lang"] for r in grams.select("lang").distinct().collect())
    context = F.col("gram").bitwiseAND(0xFFFF00)
    model = []
    for at in range(0, len(names), LANGUAGES):
        languages = names[at : at + LANGUAGES]
        own = grams.filter(F.col("lang").isin(languages))
        low = own.groupBy("lang", F.col("gram").bitwiseAND(0xFFFF).alias("gram")).agg(F.sum("n").alias("n"))
        low = _tree_arrays(low.toArrow(), languages)
        sizes = own.groupBy(context.alias("context")).agg(F.count("*").alias("n")).toArrow().sort_by("context")
        bounds, size = [], 0
        for c, n in zip(sizes.column("context").to_pylist(), sizes.column("n").to_pylist(), strict=True):
            if size and (size + n) * len(languages) > PART:
                bounds.append(c)
                size = 0
            size += n
        parts = []
        for first, end in zip([0, *bounds], [*bounds, 1 << 24], strict=True):
            high = _tree_arrays(own.filter((context >= first) & (context < end)).toArrow(), languages)
            trees = [(*h, *p) for h, p in zip(high, low, strict=True)]
            parts.append((first, end, labelled.sparkSession.sparkContext.broadcast(trees)))
        model.append(Group(languages, parts))
    return model


_last: list = [None, None]


def _scorer(sent: Broadcast, only: bool) -> Scorer:
    """The scorer of a part, kept in the Python worker for its next tasks if it's the only one."""
    if not only:
        scorer = Scorer(sent.value)
        # Or the worker would hold the arrays of all parts.
        del sent._value
        return scorer
    if _last[0] is not sent.value:
        _last[:] = [sent.value, Scorer(sent.value)]
    return _last[1]


def _code_lengths(group: Group, strings: np.ndarray, offsets: np.ndarray, only: bool) -> np.ndarray:
    """Bits of each text in each language of the group, [texts, languages]; 0 for an empty text."""
    out = np.zeros((len(offsets) - 1, len(group.languages)))
    full = np.flatnonzero(np.diff(offsets))
    for first, end, sent in group.parts:
        context = strings & np.uint32(0xFFFF00)
        here = np.flatnonzero((context >= first) & (context < end)) if len(group.parts) > 1 else slice(None)
        if not len(strings[here]):
            continue
        for i, cost in enumerate(_scorer(sent, only).costs_of(strings[here])):
            if len(group.parts) > 1:
                every = np.zeros(len(strings))
                every[here] = cost
                cost = every
            out[full, i] += np.add.reduceat(cost, offsets[full])
    return out


def predict(docs: DataFrame, model: list[Group], key: str = "doc_id", text: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """The key, extra columns, lang_pred and score (the chance of the language under equal
    chances before) of every whole text. One pass, no shuffle."""
    extra = extra or {}
    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    narrow = docs.select(F.col(key).alias("_key"), *(c.alias(n) for n, c in extra.items()), letter.alias("_letter"), F.col(text).alias("text"))
    if not model:
        return narrow.select(F.col("_key").alias(key), *extra, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    rest = ["_key", *extra]
    only = len(model) == 1 and len(model[0].parts) == 1

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches.sliced(stream) if only else batches.gathered(stream, HELD):
            strings, offsets = _strings(batches.as_bytes(batch.column("text")))
            best, least, total = np.full(batch.num_rows, "", object), np.full(batch.num_rows, np.inf), np.zeros(batch.num_rows)
            for group in model:
                bits = _code_lengths(group, strings, offsets, only)
                before, least = least, np.minimum(least, bits.min(axis=1))
                better = least < before
                best[better] = np.array(group.languages, object)[bits.argmin(axis=1)[better]]
                total = total * np.exp2(np.maximum(least - before, -1000)) + np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
            chance = 1 / total
            letter = batch.column("_letter").to_numpy(zero_copy_only=False)
            names = [name if ok else "und" for name, ok in zip(best, letter, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in rest), pa.array(names, pa.string()), pa.array(np.where(letter, chance, 0.0))],
                names=[*rest, "lang_pred", "score"],
            )

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema if f.name not in ("_letter", "text")]
    return in_batches(narrow).mapInArrow(run, ", ".join([*kinds, "lang_pred string", "score double"])).withColumnRenamed("_key", key)
