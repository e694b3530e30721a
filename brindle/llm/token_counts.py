"""Token counts of unigram vocabularies without the tokens: a count-only Viterbi.

An Aho-Corasick automaton lists the pieces that end at each character. Dynamic programming carries
the best score and its number of pieces. Ties go as in unigram tokenizers: of equal scores at one
end the earliest start, that is the longest piece, wins. A character that is no piece scores the
least piece score less 10 and counts as its UTF-8 bytes. Where no piece crosses a space mark and all
scores are whole numbers, so that sums are exact in any order, words are counted one by one, cut
between characters that stand side by side in no piece, and frequent ones remembered; else a text is
one run.

Defined results: a null or empty text has 0 pieces and score 0. Repeated rows count alike. A very long text
is counted whole, in its task. An empty table gives none. Columns other than key and text, whatever their
names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batches
from .pieces import SPACE, Memory, Vocabulary, chunks, cut
from .shared import in_batches

UNKNOWN_PENALTY = 10.0


class Counter:
    def __init__(self, vocabulary: Vocabulary) -> None:
        import ahocorasick

        v = self.vocabulary = vocabulary
        self.automaton = ahocorasick.Automaton()
        for piece, score, normal in zip(v.pieces, v.scores, v.normal, strict=True):
            if normal:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        scores = [s for s, normal in zip(v.scores, v.normal, strict=True) if normal]
        self.unknown = min(scores) - UNKNOWN_PENALTY
        self.apart = v.by_chunk and all(s == int(s) for s in scores)
        self.memory, self.parts = Memory(self._sum, note=False), Memory(self.best, note=False)

    def best(self, text: str) -> tuple[int, float]:
        """The number of pieces and the score of the best way to cut a text whose spaces are marks."""
        n = len(text)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        at, top, pieces, single = 0, None, 0, False

        def close(end: int) -> None:
            nonlocal top, pieces
            if not single:
                other = score[end] + self.unknown
                if top is None or other > top:
                    top, pieces = other, count[end] + len(text[end].encode())
            score[end + 1], count[end + 1] = top, pieces

        # The automaton lists the pieces of one end from the longest to the shortest.
        for end, (length, own) in self.automaton.iter(text):
            while at < end:
                close(at)
                at, top, single = at + 1, None, False
            start = end + 1 - length
            other = score[start] + own
            if top is None or other > top:
                top, pieces = other, count[start] + 1
            single = single or length == 1
        while at < n:
            close(at)
            at, top, single = at + 1, None, False
        return count[n], score[n]

    def _sum(self, chunk: str) -> tuple[int, float]:
        found = [self.parts[part] for part in cut(SPACE + chunk, self.vocabulary.neighbours if self.apart else None)]
        return sum(n for n, _ in found), sum(s for _, s in found)

    def count(self, text: str) -> tuple[int, float]:
        parts = chunks(text, self.apart)
        if not parts:
            return 0, 0.0
        counts, scores = zip(*map(self.memory.__getitem__, parts), strict=True)
        return sum(counts), sum(scores)


_last: list = [None, None]


def _counter(vocabulary: Vocabulary) -> Counter:
    """The counter of a vocabulary, kept in the Python worker for its next tasks."""
    if _last[0] is None or _last[0].model != vocabulary.model:
        _last[:] = [vocabulary, Counter(vocabulary)]
    return _last[1]


def count(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key, n_tokens long and score double of every whole text. One pass, no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(sent.value)
        for batch in batches.sliced(stream):
            found = [counter.count(t) for t in pc.fill_null(batch.column("text"), "").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())],
                names=["_key", "n_tokens", "score"],
            )

    narrow = docs.select(F.col(key).alias("_key"), F.col(text).alias("text"))
    kind = narrow.schema["_key"].dataType.simpleString()
    return in_batches(narrow).mapInArrow(run, f"_key {kind}, n_tokens long, score double").withColumnRenamed("_key", key)
