import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tessel.llm import substring as S
from tessel.llm.fm_index import FMIndex, match_back, repeated_windows, suffix_array


def brute(rows, window):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    count = collections.Counter(tuple(w[p : p + window]) for _, w in split for p in range(len(w) - window + 1))
    out = []
    for i, w in split:
        gone = set()
        for p in range(len(w) - window + 1):
            if count[tuple(w[p : p + window])] > 1:
                gone.update(range(p, p + window))
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((str(i), len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_suffix_array_sorts_suffixes():
    rng = np.random.default_rng(1)
    for _ in range(50):
        runs = [rng.integers(1, 4, rng.integers(1, 12)).tolist() for _ in range(rng.integers(1, 6))]
        ends = np.cumsum([len(r) + 1 for r in runs]) - 1
        flat = np.array([x for r in runs for x in (*r, 0)])
        key = lambda i: [(int(flat[j]), j if flat[j] == 0 else 0) for j in range(i, len(flat))]  # noqa: B023, E731
        assert suffix_array(flat, ends).tolist() == sorted(range(len(flat)), key=key)


def test_index_counts_patterns():
    rng = np.random.default_rng(2)
    runs = [rng.integers(1, 5, 30) for _ in range(8)]
    ends = np.cumsum([31] * 8) - 1
    flat = np.concatenate([np.append(r, 0) for r in runs])
    index = FMIndex(flat, ends, np.ones(8, np.int64))
    for _ in range(200):
        p = rng.integers(1, 5, int(rng.integers(1, 5)))
        lo, hi = index.start(p[-1:])
        for s in p[-2::-1]:
            lo, hi = index.extend(np.array([s]), lo, hi)
        want = sum((r[i : i + len(p)] == p).all() for r in runs for i in range(len(r) - len(p) + 1))
        assert int(index.count(lo, hi)[0]) == want
    ms = match_back(index, flat, np.array([10]), np.array([0]), 1)
    assert ms[0] == 0  # a text matches itself whole


def test_frequent_windows_equal_counts():
    rng = np.random.default_rng(3)
    for _ in range(100):
        window, runs = int(rng.integers(2, 6)), [rng.integers(0, int(rng.integers(2, 5)), int(rng.integers(1, 20))) for _ in range(int(rng.integers(1, 10)))]
        weight = rng.integers(1, 3, len(runs))
        count = collections.Counter()
        for r, w in zip(runs, weight):
            for i in range(len(r) - window + 1):
                count[tuple(r[i : i + window])] += w
        for r, got in zip(runs, repeated_windows(runs, weight, window)):
            assert got.tolist() == [count[tuple(r[i : i + window])] > 1 for i in range(len(r) - window + 1)]


@pytest.mark.parametrize(("window", "hot", "levels"), [(35, S.HOT, S.LEVELS), (12, 2, S.LEVELS), (12, 2, 0), (12, 2, 1)])
def test_equals_brute_force(spark, docs, rows, nothing, window, hot, levels):
    got = S.dedup_substrings(docs, window=window, k=4, hot=hot, levels=levels, shard_words=3000).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute([(r[0], r[1]) for r in rows], window)
    assert all(r.n_removed == sum(s.stop - s.start for s in r.spans) for r in got)
    assert S.dedup_substrings(nothing, window=window).count() == 0


def test_a_passage_before_many_texts(spark):
    rng = random.Random(6)
    shared = " ".join(f"p{i}" for i in range(20))
    rows = [(i, shared + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))) for i in range(60)]
    got = S.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), hot=5).collect()
    assert all(r.n_removed == 0 for r in got)


def test_words_whose_short_hashes_collide_stay_apart(spark):
    """``w537126`` and ``w970173`` agree in the low 32 bits of their hashes."""
    words = [f"c{i}" for i in range(50)]
    rows = [(i, " ".join([*words[:25], middle, *words[25:]])) for i, middle in enumerate(["w537126", "w970173"])]
    got = S.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.n_removed for r in got] == [0, 0]


def test_words_with_equal_hashes_are_told_apart():
    """Numbers and digests come from the words' bytes, never from their hashes."""
    words = S.Words(pa.array(["a b", "a c a", None, "", "b\t\n a"]))
    runs = words.runs(words.woff[:-1][[0, 1, 4]], words.woff[1:][[0, 1, 4]])
    assert runs == [b"a b", b"a c a", b"b a"] and len({tuple(x) for x in S.digests(runs)}) == 3
    a, b, c = S.numbers(pa.array(runs, pa.binary()))
    assert a[0] == b[0] == b[2] == c[1] and a[1] == c[0] and len({a[0], a[1], b[1]}) == 3


def test_very_long_texts(spark):
    """Texts of some 100,000 words: one stands twice in part, one repeats itself all through."""
    rng = random.Random(8)
    long = [f"v{rng.randrange(10**7)}" for _ in range(100_000)]
    rows = [(1, " ".join(long)), (2, " ".join([*long[50_000:60_000], "end"])), (3, "x y " * 40_000), (4, " ".join(f"u{i}" for i in range(30_000)))]
    got = S.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute(rows, 35)
