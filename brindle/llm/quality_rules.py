"""Quality rules as weak supervision: rules vote or abstain, EM estimates how accurate each is on
good documents and on junk, and the posterior probability of quality decides.

Every rule looks at one document's counts and votes 1 (good), -1 (bad) or 0 (abstains). EM needs
the votes alone, so its sufficient statistic is the number of documents with each pattern of
votes: at most 3 ** len(RULES) rows whatever the corpus, gathered over all documents with a
map-side combine. The posterior is a function of the pattern and is joined back by it.

Defined results: a null or empty text has no words, all counts 0, and fails the base. Repeated
rows are judged alike, each on its own. An empty table gives an empty table. Columns of the input
are kept only by ``filter_quality``; clashing names there are the input's.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import batches, words
from .shared import in_batches

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MIN_POSTERIOR = 0.5

COUNTS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lines long, n_upper long, n_marks long, n_letters long"
)

_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_HEAD = (np.arange(256) & 0xC0) != 0x80
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_MARK = np.isin(np.arange(256), list(b"!?"))
_LETTER = _UPPER | ((np.arange(256) >= 97) & (np.arange(256) <= 122)) | (np.arange(256) >= 0xC0)


def _repeated_words(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text, words in a 3-word window that the text has twice or more."""
    starts, owner = words.inside(offsets, 3)
    covered = np.zeros(len(h), bool)
    if len(starts):
        key = words.runs(h, 3)[starts] + words.mix(owner.astype(np.uint64))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        again = starts[order[np.r_[False, same] | np.r_[same, False]]]
        for shift in range(3):
            covered[again + shift] = True
    return batches.sums(covered, offsets)


def _duplicate_lines(text: bytes) -> tuple[int, int]:
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines), len(lines) - len(set(lines))


def _measure(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches.sliced(stream):
        texts = batches.as_bytes(batch.column("text"))
        h, offsets = words.fingerprints(texts)
        data, ends = batches.byte_view(texts)
        lines = np.array([_duplicate_lines(t) for t in texts], np.int64).reshape(-1, 2)
        counts = {
            "n_words": np.diff(offsets),
            "word_chars": batches.sums((_HEAD & ~_SPACE)[data], ends),
            "n_symbols": batches.sums(_SYMBOL[data], ends),
            "n_dup_lines": lines[:, 1],
            "n_repeat_words": _repeated_words(h, offsets),
            "n_lines": lines[:, 0],
            "n_upper": batches.sums(_UPPER[data], ends),
            "n_marks": batches.sums(_MARK[data], ends),
            "n_letters": batches.sums(_LETTER[data], ends),
        }
        rest = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in rest] + [pa.array(v) for v in counts.values()],
            names=rest + list(counts),
        )


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and the counts of every whole text. One pass, no shuffle."""
    narrow = docs.select(F.col(key).alias("_key"), F.col(text).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    return in_batches(narrow).mapInArrow(batches.released(_measure), f"_key {kind}, {COUNTS}").withColumnRenamed("_key", key)


def _per(n: str, d: str) -> Column:
    return F.col(n) / F.greatest(F.col(d), F.lit(1))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0).cast("tinyint")


def rules() -> dict[str, Column]:
    """Votes from the counts: 1 good, -1 bad, 0 abstains."""
    word = _per("word_chars", "n_words")
    symbols, marks = _per("n_symbols", "n_words"), _per("n_marks", "n_words")
    repeats, dups = _per("n_repeat_words", "n_words"), _per("n_dup_lines", "n_lines")
    upper, letters = _per("n_upper", "n_letters"), _per("n_letters", "word_chars")
    return {
        "symbols": _vote(symbols > 0.1, symbols < 0.02),
        "repeats": _vote(repeats > MAX_REPEAT_PERCENT / 100, repeats < 0.1),
        "lines": _vote(dups > 0.5, (dups == 0) & (F.col("n_lines") > 1)),
        "shouting": _vote(upper > 0.5, upper < 0.15),
        "marks": _vote(marks > 0.3, marks < 0.05),
        "letters": _vote(letters < 0.6, letters > 0.85),
        "word_length": _vote((word < 2.5) | (word > 14), (word > 3.5) & (word < 9)),
    }


def fit(patterns: np.ndarray, n: np.ndarray, rounds: int = 500, decisive: Sequence[int] = ()) -> tuple[float, np.ndarray, np.ndarray]:
    """EM over vote patterns [P, R] that n [P] documents have. Returns the share of good
    documents; accuracy [2, R], the chance that a rule which does not abstain votes -1 on a bad
    document (row 0) and 1 on a good one (row 1); and the posterior of good for each pattern.

    Classes are good documents, junk that several rules find, and kinds of junk that one rule finds. Whether a rule's
    votes against are a kind of junk or its errors on good documents shows in the other rules: over errors these vote and
    abstain as over all good documents. So kinds are chosen by the likelihood of votes and abstentions: of the rules without
    one, that whose kind gains most is added while it gains more than its 2 R + 1 figures are worth by the Bayesian
    information criterion. decisive names rules that have one in any case, where more is known than votes can tell: of
    kinds on which all other rules vote as on good documents, votes alone can't. Errors bring no gain, however often they stand alone and however rare junk is. From there
    EM runs on votes alone: nothing is held against a document because rules abstain on it.
    On good documents a rule is held to be right more often than not; in other classes a prior of two votes stands in
    where votes are few."""
    kinds = sorted(decisive)
    best = _em(patterns, n, kinds, rounds, True)
    worth = (2 * patterns.shape[1] + 1) / 2 * np.log(max(n.sum(), 2))
    while len(kinds) < patterns.shape[1]:
        rest = [k for k in range(patterns.shape[1]) if k not in kinds and n @ (patterns[:, k] == -1)]
        found = {k: _em(patterns, n, sorted([*kinds, k]), rounds, True) for k in rest}
        top = max(rest, key=lambda k: found[k][0], default=None)
        if top is None or found[top][0] - best[0] <= worth:
            break
        kinds, best = sorted([*kinds, top]), found[top]
    _, share, fires, chance = _em(patterns, n, kinds, rounds, False, best[1:3])
    return share[0], np.stack([share[1:] @ fires[1:] / share[1:].sum(), 1 - fires[0]]), chance[:, 0]


def _em(patterns: np.ndarray, n: np.ndarray, kinds: list[int], rounds: int, silence: bool, start: tuple | None = None) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """The log likelihood, the classes' shares, their chances of votes against, and each pattern's chance of each class.
    silence: abstentions count, with a chance in each class. start: shares and chances of votes to begin with."""
    r = patterns.shape[1]
    bad, good, none = ((patterns == v).astype(float) for v in (-1, 1, 0))
    fires = np.vstack([np.full(r, 0.02), np.full(r, 0.5), (np.full((r, r), 0.05) + 0.85 * np.eye(r))[kinds]])
    share = np.r_[0.85, 0.05, np.full(len(kinds), 0.1 / max(1, len(kinds)))]
    share /= share.sum()
    abstains = np.tile((n @ none + 1) / (n.sum() + 2), (len(share), 1))
    before, usual = 2 * fires[1:], 2 * abstains[0]
    own = np.arange(len(kinds))
    if start:
        share, fires = start[0], start[1].copy()
    chance, likely = _classes(bad, good, none, share, fires, abstains)
    for _ in range(rounds):
        weight = chance * n[:, None]
        share = (weight.sum(axis=0) + 1) / (n.sum() + len(share))
        hits, misses = weight.T @ bad, weight.T @ good
        fires[1:] = (hits[1:] + before) / (hits[1:] + misses[1:] + 2)
        fires[0] = np.minimum((hits[0] + 1e-3) / (hits[0] + misses[0] + 1), 0.5)
        fires[own + 2, kinds] = np.maximum(fires[own + 2, kinds], 0.5)
        if silence:
            abstains = (weight.T @ none + usual) / (weight.sum(axis=0)[:, None] + 2)
        new, likely = _classes(bad, good, none, share, fires, abstains)
        moved, chance = np.abs(new - chance).max(initial=0), new
        if moved < 1e-9:
            break
    return float(n @ likely), share, fires, chance


def _classes(bad: np.ndarray, good: np.ndarray, none: np.ndarray, share: np.ndarray, fires: np.ndarray, abstains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chance of each class, the good one first, for each pattern of votes; and each pattern's log likelihood."""
    fires, abstains = np.clip(fires, 1e-6, 1 - 1e-6), np.clip(abstains, 1e-6, 1 - 1e-6)
    log = np.log(share) + bad @ np.log(fires * (1 - abstains)).T + good @ np.log((1 - fires) * (1 - abstains)).T + none @ np.log(abstains).T
    top = log.max(axis=1, keepdims=True, initial=-np.inf)
    odds = np.exp(log - top)
    total = odds.sum(axis=1, keepdims=True)
    return odds / total, (np.log(total) + top)[:, 0]


def judge(counts: DataFrame) -> DataFrame:
    """counts with posterior double, base_failed and kept boolean. The driver receives the number
    of documents with each pattern of votes, 3 ** len(rules) rows at most, and no more."""
    voted = rules()
    names = list(voted)
    code = sum(((voted[c].cast("int") + 1) * 3**i for i, c in enumerate(names)), F.lit(0))
    coded = counts.withColumn("_pattern", code)
    found = coded.groupBy("_pattern").count().orderBy("_pattern").collect()
    codes = np.array([r["_pattern"] for r in found], np.int64)
    patterns = (codes[:, None] // 3 ** np.arange(len(names))) % 3 - 1
    _, _, good = fit(patterns.astype(np.int64), np.array([r["count"] for r in found], float))
    table = [(int(c), float(p)) for c, p in zip(codes, good, strict=True)]
    scores = counts.sparkSession.createDataFrame(table, "_pattern int, posterior double")
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    return (
        coded.join(F.broadcast(scores), "_pattern", "left")
        .drop("_pattern")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("posterior") >= MIN_POSTERIOR))
    )


def filter_quality(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all columns, that the rules keep. Texts are measured twice, for the votes
    and beside the text, which costs less than a shuffle of all texts."""
    names = [c for c in docs.columns if c != text]
    kept_beside = F.struct(*(F.col(f"`{c}`") for c in names), F.lit(0).alias("_"))
    hidden = docs.select(kept_beside.alias("_rest"), F.col(f"`{text}`").alias("text"))
    rest = hidden.schema["_rest"].dataType.simpleString()

    def beside(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches.sliced(stream):
            measured = pa.Table.from_batches(_measure(iter([batch.select(["text"])])))
            both = pa.Table.from_batches([batch])
            for name in measured.column_names:
                both = both.append_column(name, measured.column(name))
            yield from both.combine_chunks().to_batches()

    counts = in_batches(hidden).mapInArrow(batches.released(beside), f"_rest {rest}, text string, {COUNTS}")
    columns = [F.col("text").alias(c) if c == text else F.col(f"_rest.`{c}`") for c in docs.columns]
    return judge(counts).filter("kept").select(*columns)

