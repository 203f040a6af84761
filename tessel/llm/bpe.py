"""Byte-level BPE by a monoid tree reduction.

Splitting. A text is cut in halves until a leaf is short; a leaf is split by the pattern, and neighbours are joined up the
tree. The pattern never looks behind, so what it finds from some place on depends on the text from there on only: a join
re-splits a growing window, from the left part's last finds that may have seen its end, until a find's end falls on one of
the right part's own ends. All finds outside the window then provably stand.

Merging. Each find is encoded on its own. A token list is the encoding of its bytes exactly if each two neighbours are the
encoding of theirs, so halves of a find are joined by re-encoding a growing window of boundary tokens until the pairs at the
window's edges stand. Leaves of ``PIECE`` bytes and the windows are merged here, by least rank; ``LEAF`` and ``PIECE`` change
how high the tree is and nothing else. Short finds are remembered in a bounded table.

Decoding concatenates the tokens' bytes up the same tree. A null text counts as empty: no tokens, no bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessel.llm.common import rows_by

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
NONE = 1 << 60
#: Characters of a leaf's text, bytes of a leaf of one find, finds that a worker remembers, bytes of a remembered find.
LEAF, PIECE, MEMORY, SHORT = 512, 8, 1 << 19, 64


class Coder:
    """Encodes by ranks from a file in the format of tiktoken."""

    def __init__(self, path: str, pattern: str, leaf: int = LEAF, piece: int = PIECE) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.split = regex.compile(pattern)
        self.leaf, self.piece = leaf, piece
        self.known: dict[str, bytes] = {}
        self.byte = [self.ranks[bytes([x])] for x in range(256)]
        #: Which token two tokens make.
        self.joined = {(self.ranks[t[:i]], self.ranks[t[i:]]): rank for t, rank in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks}
        self.window = lru_cache(1 << 17)(lambda a, b: self.again([a, b]))  # the least windows come again and again

    def merge(self, ids: list[int]) -> list[int]:
        """Encode a short run, given as ids of its bytes: the neighbours of least rank become one, leftmost first, until none has a rank."""
        joined = self.joined.get
        ranks = [joined(x, NONE) for x in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) != NONE:
            i = ranks.index(least)
            ids[i : i + 2] = [least]
            del ranks[i]
            if i:
                ranks[i - 1] = joined((ids[i - 1], least), NONE)
            if i < len(ranks):
                ranks[i] = joined((least, ids[i + 1]), NONE)
        return ids

    def again(self, tokens: list[int]) -> list[int]:
        """Encode the bytes of a window of tokens anew."""
        return self.merge([self.byte[x] for t in tokens for x in self.bytes_of[t]])

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of both: only a boundary window changes."""
        if not left or not right:
            return left + right
        middle = self.window(left[-1], right[0])
        if middle[0] == left[-1] and len(middle) == 2:
            return left + right
        a = b = 1
        while True:
            good = a == len(left) or self.stands(left[len(left) - a - 1], middle[0])
            fine = b == len(right) or self.stands(middle[-1], right[b])
            if good and fine:
                return left[: len(left) - a] + middle + right[b:]
            a, b = min(a * (1 if good else 2), len(left)), min(b * (1 if fine else 2), len(right))
            middle = self.again(left[len(left) - a :] + right[:b])

    def stands(self, a: int, b: int) -> bool:
        """Whether two tokens are the encoding of their bytes."""
        got = self.window(a, b)
        return len(got) == 2 and got[0] == a

    def tokens(self, piece: bytes) -> list[int]:
        """The encoding of one find: halves, joined."""
        if len(piece) <= self.piece:
            return self.merge([self.byte[x] for x in piece])
        half = len(piece) // 2
        return self.join_tokens(self.tokens(piece[:half]), self.tokens(piece[half:]))

    def join_finds(self, left: list[str], right: list[str]) -> list[str]:
        """The finds in the joined text. A find may depend on 3 characters from its start and 2 behind its end."""
        if not left or not right:
            return left + right
        keep, tail = len(left), 0
        while keep and tail < 5:
            keep -= 1
            tail += len(left[keep])
        base, own = "".join(left[keep:]), 1
        while True:
            own = min(own, len(right))
            ends, at = {0: 0} if own == 0 else {}, len(base)
            for i, x in enumerate(right[:own]):
                at += len(x)
                ends[at] = i + 1
            text = base + "".join(right[:own])
            found, at = [], 0
            for m in self.split.finditer(text):
                found.append(m.group())
                at = m.end()
                # Inside the window's last 5 characters a find may have seen the window's end rather than the text's.
                if at in ends and (at + 5 <= len(text) or own == len(right)) and at >= len(base):
                    return left[:keep] + found + right[ends[at] :]
            if own == len(right):
                return left[:keep] + found
            own *= 2

    def finds(self, text: str) -> list[str]:
        if len(text) <= self.leaf:
            return self.split.findall(text)
        half = len(text) // 2
        return self.join_finds(self.finds(text[:half]), self.finds(text[half:]))

    def packed(self, find: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out = self.known.get(find)
        if out is None:
            piece = find.encode()
            out = b"".join(t.to_bytes(4, "little") for t in self.tokens(piece))
            if len(piece) <= SHORT:
                if len(self.known) >= MEMORY:
                    self.known.clear()
                self.known[find] = out
        return out

    def encode_packed(self, text: str) -> bytes:
        known, packed = self.known, self.packed
        return b"".join([known.get(x) or packed(x) for x in self.finds(text)])

    def encode(self, text: str) -> list[int]:
        return memoryview(self.encode_packed(text)).cast("I").tolist()

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the tokens, concatenated by halves."""
        if len(ids) <= self.leaf:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(2)
def coder(path: str, pattern: str) -> Coder:
    """One for each worker and vocabulary."""
    return Coder(path, pattern)


def resolve(vocabulary: str | None) -> tuple[str, str]:
    """Path of the rank file and the pattern; by default those of the installed public vocabularies."""
    import public_tokenizers

    return vocabulary or public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row for each row: id, n_tokens, ids (array<int>, or null unless ``with_ids``), digests of ids and decoded bytes.

    ``vocabulary`` is a path that all workers can read; None takes each worker's installed file.
    """
    source = rows_by(docs, id_col, text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(*resolve(vocabulary))
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                counts, ids, digests, decoded = [], [], [], []
                for text in part.column(1):
                    packed = own.encode_packed(text.as_py() or "")
                    got = memoryview(packed).cast("I").tolist()
                    counts.append(len(got))
                    ids.append(got if with_ids else None)
                    digests.append(hashlib.sha256(packed).hexdigest())
                    decoded.append(hashlib.sha256(own.decode(got)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(digests), pa.array(decoded)], ["rid", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    kind = source.schema["rid"].dataType.simpleString()
    return source.mapInArrow(work, f"rid {kind}, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string").withColumnRenamed("rid", id_col)


def decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """One row for each row: id and decoded bytes (null ids: null)."""
    source = tokens.select(tokens[id_col].alias("rid"), tokens[ids_col].alias("ids"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(*resolve(vocabulary))
        for batch in batches:
            got = [None if x is None else own.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.binary())], ["rid", "decoded"])

    kind = source.schema["rid"].dataType.simpleString()
    return source.mapInArrow(work, f"rid {kind}, decoded binary").withColumnRenamed("rid", id_col)
