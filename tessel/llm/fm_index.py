"""A compressed full-text index in numpy: suffix array, Burrows-Wheeler transform, wavelet matrix, backward search.

Rank uses packed bits with one count for each 64, so an index of n symbols of s kinds takes about 0.19 n log2(s) bytes.
Searches of many patterns step together.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64


def suffix_array(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Order of all suffixes. ``ids`` from 1 on; 0 closes each run at ``ends``. Closing symbols differ, in their order."""
    n = len(ids)
    rank = ids.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    reach, done = 1, np.zeros(n, bool)
    done[ends] = True
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[:-reach] = rank[reach:] + 1 if reach < n else 0
        ahead[done] = 0  # a run that is closed within reach differs from all others
        key = rank * (n + len(ends) + int(ids.max(initial=0)) + 2) + ahead
        order = np.argsort(key, kind="stable")
        fresh = np.empty(n, bool)
        fresh[:1] = True
        np.not_equal(key[order][1:], key[order][:-1], out=fresh[1:])
        rank[order] = np.cumsum(fresh) - 1
        if fresh.all():
            return order
        closed = done.copy()
        closed[:-reach] |= done[reach:] if reach < n else False
        done, reach = closed, reach * 2


class Bits:
    """A bit vector with rank."""

    def __init__(self, bits: np.ndarray) -> None:
        size = len(bits) // 64 + 1
        padded = np.zeros(size * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))]).astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many bits before each place are set."""
        word = at >> 6
        mask = (_U(1) << (at & 63).astype(np.uint64)) - _U(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class FMIndex:
    """Index of runs of symbols. ``runs`` holds ids from 1 on, a 0 behind each run; ``weight`` counts each run so often."""

    def __init__(self, runs: np.ndarray, ends: np.ndarray, weight: np.ndarray) -> None:
        n = len(runs)
        order = suffix_array(runs, ends)
        bwt = runs[order - 1]  # symbol before each suffix; of the first one the last symbol, a 0
        self.levels = max(1, int(runs.max(initial=1)).bit_length())
        self.less = np.concatenate([[0], np.cumsum(np.bincount(runs, minlength=1 << min(self.levels, 1)))])
        self.bits, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (bwt >> level) & 1
            self.bits.append(Bits(bit.astype(np.uint8)))
            self.zeros.append(int(n - bit.sum()))
            bwt = np.concatenate([bwt[bit == 0], bwt[bit == 1]])
        of = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[-1], ends])))
        self.sums = np.concatenate([[0], np.cumsum(weight[of[order]])])
        self.first = np.zeros(len(self.less), np.int64)  # where each symbol's zone begins in the last level
        self._zones()

    def _zones(self) -> None:
        kinds = np.arange(len(self.less) - 1)
        lo = np.zeros(len(kinds), np.int64)
        for level, bits, zeros in zip(range(self.levels - 1, -1, -1), self.bits, self.zeros, strict=True):
            one = bits.rank(lo)
            lo = np.where((kinds >> level) & 1, zeros + one, lo - one)
        self.first[: len(kinds)] = lo

    def start(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of one symbol."""
        return self.less[symbol], self.less[symbol + 1]

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals with a symbol put in front."""
        k = len(lo)
        at = np.concatenate([lo, hi])
        both = np.concatenate([symbol, symbol])
        for level, bits, zeros in zip(range(self.levels - 1, -1, -1), self.bits, self.zeros, strict=True):
            one = bits.rank(at)
            at = np.where((both >> level) & 1, zeros + one, at - one)
        base = self.less[symbol] - self.first[symbol]
        return base + at[:k], base + at[k:]

    def count(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return self.sums[hi] - self.sums[lo]


def match_back(index: FMIndex, runs: np.ndarray, stop: np.ndarray, least: np.ndarray, need: int = 2) -> np.ndarray:
    """Matching statistics: for each end ``stop``, the least start >= ``least`` from which on it occurs ``need`` times."""
    out = stop.copy()
    live = np.flatnonzero(stop > least)
    at = stop[live] - 1
    lo, hi = index.start(runs[at])
    while len(live):
        good = index.count(lo, hi) >= need
        live, at, lo, hi = live[good], at[good], lo[good], hi[good]
        out[live] = at
        more = at > least[live]
        live, at, lo, hi = live[more], at[more] - 1, lo[more], hi[more]
        if len(live):
            lo, hi = index.extend(runs[at], lo, hi)
    return out


def repeated_windows(contents: list[np.ndarray], weight: np.ndarray, window: int, need: int = 2) -> list[np.ndarray]:
    """For each run, which of its windows occur ``need`` times among all runs (a run counts ``weight`` times).

    A backward search ends where the match gets too rare: windows right of that place are frequent, windows that hold the
    rare stretch are not, and neither is looked at again. Stretches grow after each success, so a run that is frequent as
    a whole takes one search.
    """
    size = np.array([len(c) for c in contents], np.int64)
    ends = np.cumsum(size + 1) - 1
    begin = ends - size
    symbols = np.concatenate([np.concatenate(contents), np.zeros(0, np.int64)]) if contents else np.zeros(0, np.int64)
    ids = np.unique(symbols, return_inverse=True)[1].astype(np.int64) + 1
    runs = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, np.int64)
    inside = np.ones(len(runs), bool)
    inside[ends] = False
    runs[inside] = ids
    index = FMIndex(runs, ends, weight)
    windows = np.maximum(size - window + 1, 0)
    most = int(windows.max(initial=0))
    state = np.full((len(contents), most), 3, np.int8)  # 0 open, 1 frequent, 2 not, 3 no window
    place = np.arange(most)[None, :]
    state[place < windows[:, None]] = 0
    reach = windows.copy()  # windows in the stretch tried next
    open_ = np.flatnonzero(windows > 0)
    while len(open_):
        first = (state[open_] == 0).argmax(1)
        last = np.minimum(first + reach[open_], windows[open_]) - 1
        stop = begin[open_] + last + window
        found = match_back(index, runs, stop, begin[open_] + first, need) - begin[open_]  # match from here on
        whole = found <= first
        rows, col, own = state[open_], place, found[:, None]
        frequent = (col >= np.maximum(own, first[:, None])) & (col <= last[:, None])
        rare = (col >= np.maximum(last, first)[:, None]) & (col < own) & (col < windows[open_][:, None])
        rows[frequent & (rows == 0)] = 1
        rows[rare & (rows == 0)] = 2
        state[open_] = rows
        reach[open_] = np.where(whole, reach[open_] * 2, 1)
        open_ = open_[(rows == 0).any(1)]
    return [state[r, : windows[r]] == 1 for r in range(len(contents))]
