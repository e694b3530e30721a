"""Encoding and decoding with merge-type (BPE) sentencepiece vocabularies.

Encoding keeps an agenda of adjacent symbol pairs whose join is a piece, by score and then from the
left; the best pair is joined and its new neighbours enter the agenda, until it is empty. Symbols
left over that are no pieces become bytes. Where no piece crosses a space mark, as load() finds out,
words are encoded one by one, cut between characters that stand side by side in no piece, and
frequent ones remembered, which gives the same ids.

In each Arrow batch all chunks that were worked out anew are encoded and decoded once more by the
sentencepiece library, and a difference stops the job.

Defined results: a null or empty text has no ids but the end id, and decodes to "". Repeated rows
are encoded alike. U+2581 in a text decodes to a space, as in the library. A very long text is encoded whole,
in its task. An empty table gives none. Columns other than key and text, whatever their names, play no part.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batches
from .pieces import SPACE, Memory, Vocabulary, chunks, cut
from .shared import in_batches


class Codec:
    def __init__(self, vocabulary: Vocabulary) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=vocabulary.model)
        v = self.vocabulary = vocabulary
        self.ids = {p: i for i, p in enumerate(v.pieces) if v.normal[i]}
        self.cost = {p: -v.scores[i] for p, i in self.ids.items()}
        self.spelled = np.empty(len(v.pieces), object)
        self.spelled[:] = [p.replace(SPACE, " ").encode() if v.normal[i] else b"" for i, p in enumerate(v.pieces)]
        for byte, i in enumerate(v.byte_ids):
            self.spelled[i] = bytes([byte])
        self.memory, self.parts = Memory(self._chunk), Memory(self._part, note=False)

    def encode_symbols(self, text: str) -> list[int]:
        """Ids of a text whose spaces are marks."""
        cost, ids = self.cost, self.ids
        agenda = [(cost[pair], left, pair) for left, pair in enumerate(map(add, text, text[1:])) if pair in cost]
        heapify(agenda)
        symbols = list(text)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        while agenda:
            _, left, pair = heappop(agenda)
            right = after[left]
            # A pair of which a symbol was joined since is not there any more.
            if right < 0 or symbols[left] + symbols[right] != pair:
                continue
            symbols[left], symbols[right] = pair, ""
            after[left] = following = after[right]
            after[right] = -1
            if following >= 0:
                before[following] = left
                joined = pair + symbols[following]
                if joined in cost:
                    heappush(agenda, (cost[joined], left, joined))
            previous = before[left]
            if previous >= 0:
                joined = symbols[previous] + pair
                if joined in cost:
                    heappush(agenda, (cost[joined], previous, joined))
        out: list[int] = []
        for symbol in symbols:
            if symbol in ids:
                out.append(ids[symbol])
            elif symbol:
                out += [self.vocabulary.byte_ids[b] for b in symbol.encode()]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, without the space that stands before a text."""
        return b"".join(self.spelled[ids])[1:].decode("utf-8", "replace")

    def _part(self, text: str) -> bytes:
        return array("i", self.encode_symbols(text)).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        return b"".join([self.parts[p] for p in cut(SPACE + chunk, self.vocabulary.neighbours)])

    def encode(self, text: str) -> bytes:
        """The text's ids, without the end id, as int32 in a row."""
        return b"".join(map(self.memory.__getitem__, chunks(text, self.vocabulary.by_chunk)))

    def check(self) -> None:
        """Holds all chunks worked out since the last call against the library, as one text; those
        that end in a space mark, which would run into the next, one by one."""
        new = self.memory.taken()
        runs = [[c for c in new if c[0] and c[0][-1] != SPACE], *([c] for c in new if c[0][-1:] == SPACE)]
        for run in filter(None, runs):
            want = self.library.encode(" ".join([c for c, _ in run]).replace(SPACE, " "), num_threads=1)
            ids = np.frombuffer(b"".join([own for _, own in run]), np.int32)
            if not np.array_equal(ids, want) or self.library.decode(want) != self.decode(ids):
                raise RuntimeError(f"ids differ from the library's in {run[:100]!r}")


_last: list = [None, None]


def _codec(vocabulary: Vocabulary) -> Codec:
    """The codec of a vocabulary, kept in the Python worker for its next tasks."""
    if _last[0] is None or _last[0].model != vocabulary.model:
        _last[:] = [vocabulary, Codec(vocabulary)]
    return _last[1]


def encode(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key, ids array<int> with the end id last, and decoded string of every whole text. One
    pass, no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent.value)
        end = np.array([codec.vocabulary.end_id], np.int32).tobytes()
        for batch in batches.sliced(stream):
            coded = [codec.encode(t) + end for t in pc.fill_null(batch.column("text"), "").to_pylist()]
            codec.check()
            decoded = pa.array([codec.decode(np.frombuffer(ids, np.int32)) for ids in coded], pa.string())
            offsets = np.zeros(len(coded) + 1, np.int32)
            np.cumsum([len(ids) // 4 for ids in coded], out=offsets[1:])
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(coded), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("_key"), ids, decoded], names=["_key", "ids", "decoded"])

    narrow = docs.select(F.col(key).alias("_key"), F.col(text).alias("text"))
    kind = narrow.schema["_key"].dataType.simpleString()
    return in_batches(narrow).mapInArrow(run, f"_key {kind}, ids array<int>, decoded string").withColumnRenamed("_key", key)


def digests(coded: DataFrame) -> DataFrame:
    """coded with n_tokens, ids_sha256 and decoded_sha256 in place of ids and decoded."""
    return coded.select(
        *(c for c in coded.columns if c not in ("ids", "decoded")),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
