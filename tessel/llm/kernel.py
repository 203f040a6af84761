"""Vectorised work on whole Arrow batches of texts: word bounds, word hashes, n-gram hashes.

Texts are looked at as one run of UTF-8 bytes with row offsets, so numpy handles all rows of a batch at once and no
Python object is made for a word. Separators of every word rule here are ASCII, so byte positions are safe.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
SPACED = np.ones(256, bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: Words are runs of ASCII letters and digits and of all that is not ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

#: Bytes with A-Z in lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_P = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def _splitmix(n: int, seed: int) -> np.ndarray:
    x = np.arange(1, n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(seed)
    return mix(x)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_TABLE = _splitmix(256, 7)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << max(20, (n - 1).bit_length())
        for at, base in ((0, _P), (1, pow(_P, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[at] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and the offsets of each row; a null counts as empty. Nothing is copied unless there are nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return bytes_[at[0] : at[-1]], at - at[0]


def pieces(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each, a longer row on its own: what numpy holds at once stays small."""
    if not len(column):
        return
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(column):
        base = sizes[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(sizes, base + most, side="right")))
        yield lo, hi
        lo = hi


def word_bounds(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of each word, and for each row (and after the last) the index of its first word."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = table[data]
    full = offsets[:-1] < offsets[1:]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][full]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = offsets[1:][full] - 1
    last[tails] = inside[tails]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same wherever the word stands."""
    up, down = _power_tables(max(1, len(data)))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def row_of(woff: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(woff) - 1), np.diff(woff))


def room(woff: np.ndarray) -> np.ndarray:
    """For each word, how many words its row has from it on."""
    return np.repeat(woff[1:], np.diff(woff)) - np.arange(woff[-1])


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for k words from each start on, row bounds not minded (see ``room``); k fewer one values."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= _U(0x2545F4914F6CDD1D)
        out += hashes[j : j + n]
    return mix(out + _U(k))


def grams_at(hashes: np.ndarray, k: int, at: np.ndarray) -> np.ndarray:
    """As ``grams``, at the given starts only."""
    out = hashes[at]
    for j in range(1, k):
        out = out * _U(0x2545F4914F6CDD1D) + hashes[at + j]
    return mix(out + _U(k))


def slide(x: np.ndarray, w: int, op) -> np.ndarray:
    """op (np.minimum or np.maximum) over each w neighbours; w fewer one values. Doubles its reach in each step."""
    out, reach = x, 1
    while reach < w:
        step = min(reach, w - reach)
        out = op(out[:-step], out[step:]) if len(out) > step else out[:0]
        reach += step
    return out


def winnow(hashes: np.ndarray, fits: np.ndarray, w: int) -> np.ndarray:
    """Starts of values that are the least of some w neighbours lying in one row.

    ``fits`` tells whether w values from a start on lie in one row. Ties are all kept, so equal runs of w values always
    keep equal values.
    """
    if len(hashes) < w:
        return np.zeros(0, np.int64)
    low = np.where(fits[: len(hashes) - w + 1], slide(hashes, w, np.minimum), _U(0))
    edge = np.zeros(w - 1, np.uint64)
    return np.flatnonzero(slide(np.concatenate([edge, low, edge]), w, np.maximum) == np.maximum(hashes, _U(1)))


def strings(column: pa.Array) -> list[bytes]:
    """The rows' bytes as Python objects, null as empty."""
    data, offsets = byte_view(column)
    whole = data.tobytes()
    return [whole[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
