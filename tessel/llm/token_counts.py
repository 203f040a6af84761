"""Token counts of a unigram tokenizer by a count-only Viterbi search.

An Aho-Corasick automaton lists all vocabulary pieces that end at each character; the search carries only the best score
and that path's number of pieces, never the path. Ties go as in the tokenizer: of equal scores the piece that starts first
(the longest) stays. A character that no piece covers costs the least piece score less 10 and counts as its UTF-8 bytes
(byte fallback). Scores are sums of the file's numbers in double precision, as the tokenizer adds them.

If no piece has a word mark behind another character, and a piece never holds a character outside the vocabulary's, the
best path of a text is made of best paths of its parts between such places (a constant added to all scores changes no
choice), so parts are searched once each and remembered in a bounded table. Both conditions are read from the vocabulary;
without them whole texts are searched.

Vocabulary: a SentencePiece model file gives pieces and scores; only its normal pieces match. Spaces become the mark, one
mark is put in front. Defined cases: a null or empty text has no tokens; equal rows get equal counts; other columns are
not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessel.llm.common import rows_by

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
#: Parts that a worker remembers, and their greatest length.
MEMORY, SHORT = 1 << 19, 64


def _fields(data: bytes, lo: int, hi: int) -> Iterator[tuple[int, int, int, int]]:
    """Fields of a protocol buffer message: number, kind, and where the value lies (or the value itself)."""

    def number() -> int:
        nonlocal lo
        out = shift = 0
        while True:
            b = data[lo]
            lo += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while lo < hi:
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, 0, number(), 0
        else:
            size = number() if kind == 2 else 4 if kind == 5 else 8
            yield tag >> 3, kind, lo, lo + size
            lo += size


def read_pieces(path: str) -> list[tuple[str, float]]:
    """Normal pieces and their scores. In the format's message, field 1 is a piece: text (1), score (2), type (3)."""
    with open(path, "rb") as f:
        data = f.read()
    out = []
    for field, kind, a, b in _fields(data, 0, len(data)):
        if field != 1 or kind != 2:
            continue
        text, score, type_ = "", 0.0, 1
        for inner, _, x, y in _fields(data, a, b):
            if inner == 1:
                text = data[x:y].decode()
            elif inner == 2:
                score = float(np.frombuffer(data[x:y], "<f4")[0])
            elif inner == 3:
                type_ = x
        if type_ == 1:
            out.append((text, score))
    return out


class Counter:
    """Counts and scores of best segmentations."""

    def __init__(self, pieces: list[tuple[str, float]]) -> None:
        self.found = ahocorasick.Automaton()
        for text, score in pieces:
            self.found.add_word(text, (len(text), score))
        self.found.make_automaton()
        self.unknown = min(score for _, score in pieces) - 10
        known = set("".join(text for text, _ in pieces))
        self.apart = all(MARK not in text.lstrip(MARK) for text, _ in pieces)
        alone = "\n" not in known
        self.parts = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+" if alone else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.memory: dict[str, tuple[int, float]] = {}

    def search(self, text: str) -> tuple[int, float]:
        """Pieces and score of the best segmentation of a whole string."""
        n = len(text)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        stops: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for stop, piece in self.found.iter(text):
            stops[stop].append(piece)
        for i, ending in enumerate(stops):
            top, of = None, 0
            for size, score in sorted(ending, reverse=True):  # the earliest start first
                value = best[i + 1 - size] + score
                if top is None or value > top:
                    top, of = value, count[i + 1 - size] + 1
            if not ending or ending_alone(ending):
                value = best[i] + self.unknown
                if top is None or value > top:
                    top, of = value, count[i] + len(text[i].encode())
            best[i + 1], count[i + 1] = top, of
        return count[n], best[n]

    def count(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        text = MARK + text.replace(" ", MARK)
        if not self.apart:
            return self.search(text)
        memory, pieces, score = self.memory, 0, 0.0
        for part in self.parts.findall(text):
            got = memory.get(part)
            if got is None:
                got = self.search(part)
                if len(part) <= SHORT:
                    if len(memory) >= MEMORY:
                        memory.clear()
                    memory[part] = got
            pieces += got[0]
            score += got[1]
        return pieces, score


def ending_alone(ending: list[tuple[int, float]]) -> bool:
    """Whether no piece of one character ends here, so the character may also stand as an unknown."""
    return all(size > 1 for size, _ in ending)


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(read_pieces(path))


def resolve(vocabulary: str | None) -> str:
    import public_tokenizers

    return vocabulary or public_tokenizers.path(VOCABULARY)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row for each row: id, n_tokens (long), score (double, of the best segmentation)."""
    source = rows_by(docs, id_col, text_col)
    kind = source.schema["rid"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(resolve(vocabulary))
        for batch in batches:
            got = [own.count(x.as_py() or "") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.float64())], ["rid", "n_tokens", "score"])

    return source.mapInArrow(work, f"rid {kind}, n_tokens long, score double").withColumnRenamed("rid", id_col)
