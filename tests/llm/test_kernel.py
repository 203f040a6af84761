import random
import re

import numpy as np
import pyarrow as pa

from tessel.llm import kernel as K


def column(texts):
    return pa.array(texts, pa.string())


def test_words_are_those_of_the_pattern():
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", "B", "é", " ", "\n", "\x0b", "\x1f", "-", "9", "中", "\xa0"]) for _ in range(rng.randint(0, 30))) for _ in range(300)] + [None, ""]
    for table, pattern, low in ((K.SPACED, rb"[^\x20\x09-\x0D]+", False), (K.ALNUM, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", True)):
        data, off = K.byte_view(column(texts).slice(1))
        data = K.LOWER[data] if low else data
        starts, ends, woff = K.word_bounds(data, off, table)
        whole = data.tobytes()
        for i, t in enumerate(texts[1:]):
            raw = (t or "").encode()
            raw = raw.translate(bytes(K.LOWER)) if low else raw
            assert [whole[a:b] for a, b in zip(starts[woff[i] : woff[i + 1]], ends[woff[i] : woff[i + 1]])] == re.findall(pattern, raw)


def test_hashes_depend_on_the_word_only():
    a = column(["x yy yy", "pad pad pad x"])
    data, off = K.byte_view(a)
    starts, ends, _ = K.word_bounds(data, off, K.SPACED)
    h = K.word_hashes(data, starts, ends)
    assert h[0] == h[6] and h[1] == h[2] and len(set(h.tolist())) == 3


def test_winnowing_keeps_one_of_each_window_and_agrees_on_equal_windows():
    rng = np.random.default_rng(0)
    for w in (1, 2, 5, 9):
        h = rng.integers(1, 6 if w == 5 else 1 << 60, 200).astype(np.uint64)
        kept = set(K.winnow(h, np.ones(200, bool), w).tolist())
        for i in range(200 - w + 1):
            low = h[i : i + w].min()
            assert all(j in kept for j in range(i, i + w) if h[j] == low)


def test_pieces_cover_all_rows_once():
    texts = column(["a" * n for n in (5, 0, 100, 3, 3, 3)] + [None])
    got = list(K.pieces(texts, most=10))
    assert [i for lo, hi in got for i in range(lo, hi)] == list(range(7))
    assert list(K.pieces(column([]))) == []
