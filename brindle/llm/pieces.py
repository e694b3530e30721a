"""Vocabularies of sentencepiece models, and the chunks of a text that they treat one by one."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

SPACE = "▁"
#: Chunks that a Python worker remembers in each of two generations, and the longest of them.
REMEMBERED, LONGEST = 150_000, 48
_CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*")
#: A round trip of this shows that a model neither rewrites characters nor drops spaces.
_PROBE = "  ﬁ Ａ\téé  ß\n x  "


@dataclass(frozen=True)
class Vocabulary:
    """What encoding needs of a model. model: its file's bytes, sent to the executors as they are,
    so that these need no file."""

    model: bytes
    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    normal: tuple[bool, ...]
    byte_ids: tuple[int, ...]
    end_id: int
    by_chunk: bool
    neighbours: frozenset[str]


def load(path: str) -> Vocabulary:
    """Reads a model with byte fallback, a space before the text and no other rewriting; refuses
    others. Chunks are independent if no piece has a space mark after another character."""
    import sentencepiece

    with open(path, "rb") as f:
        model = f.read()
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    n = sp.vocab_size()
    pieces = tuple(sp.id_to_piece(i) for i in range(n))
    normal = tuple(not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n))
    byte_ids = tuple(i for i in range(n) if sp.is_byte(i))
    plain = sp.decode(sp.encode(_PROBE)) == _PROBE and sp.encode("a", out_type=str)[0].startswith(SPACE)
    if not plain or len(byte_ids) != 256 or any(sp.is_unused(i) for i in range(n)):
        raise ValueError(f"{path}: only models with byte fallback, a leading space and no rewriting")
    apart = not any(SPACE in p.lstrip(SPACE) for p, ok in zip(pieces, normal, strict=True) if ok)
    pairs = {p[i : i + 2] for p, ok in zip(pieces, normal, strict=True) if ok for i in range(len(p) - 1)}
    scores = tuple(sp.get_score(i) for i in range(n))
    return Vocabulary(model, pieces, scores, normal, byte_ids, sp.eos_id(), apart, frozenset(pairs))


def cut(chunk: str, neighbours: frozenset[str] | None) -> list[str]:
    """The chunk cut between characters that are neighbours in no piece: no piece crosses there.
    Uncut if no neighbours are given."""
    if neighbours is None:
        return [chunk]
    start, out = 0, []
    for i in range(1, len(chunk)):
        if chunk[i - 1 : i + 1] not in neighbours:
            out.append(chunk[start:i])
            start = i
    out.append(chunk[start:])
    return out


def chunks(text: str, apart: bool) -> list[str]:
    """The text's chunks, each without the first of its leading space marks; the text starts as if
    after a space. All of it is one chunk if pieces may cross words."""
    if not text:
        return []
    marked = text.replace(" ", SPACE)
    if not apart:
        return [marked]
    if SPACE * 2 in marked or marked[0] == SPACE:
        return [c[1:] for c in _CHUNK.findall(SPACE + marked)]
    return marked.split(SPACE)


class Memory(dict):
    """Results by chunk; with note, new ones are also listed until they are taken. Two generations: when the young one is full the old one goes, so memory is
    bounded and frequent chunks stay."""

    def __init__(self, work: Callable, note: bool = True) -> None:
        self.work, self.note, self.old, self.new = work, note, {}, []

    def __missing__(self, chunk: str):
        value = self.old.get(chunk)
        if value is None:
            value = self.work(chunk)
            if self.note:
                self.new.append((chunk, value))
        if len(chunk) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[chunk] = value
        return value

    def taken(self) -> list:
        """Chunks worked out since the last call, with their results."""
        new, self.new = self.new, []
        return new
