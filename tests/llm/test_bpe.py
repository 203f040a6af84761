import base64
import hashlib
import random
import struct

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tessel.llm import bpe

PATH = P.path(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def small():
    """Tiny leaves, so each text goes up many joins."""
    return bpe.Coder(PATH, P.PATTERN, leaf=5, piece=4)


@pytest.fixture(scope="module")
def library(small):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=small.ranks, special_tokens={})


def naive(ranks, piece: bytes) -> list[int]:
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: (ranks.get(parts[i] + parts[i + 1], 1 << 60), i))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


def test_ranks_file_is_read(small):
    assert small.ranks[base64.b64decode("IQ==")] == 0 and len(small.ranks) == 50256


def test_merges_equal_a_naive_loop(small):
    rng = random.Random(3)
    for _ in range(300):
        piece = "".join(rng.choice("aehinorst é") for _ in range(rng.randint(1, 40))).encode()
        assert small.tokens(piece) == naive(small.ranks, piece)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "the", " ", "  ", "\n", "\t", "'", "l", "s", "'ll", "'re", "é", "ß", "中", "12", "!", "###", "😀", "²", "½", "_", "\x1c", "\xa0", "٣", "ɐ"]), max_size=40))
def test_equals_the_library_and_decodes(small, library, parts):
    text = "".join(parts)
    ids = small.encode(text)
    assert ids == library.encode_ordinary(text)
    assert small.decode(ids) == text.encode()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_equals_the_library_on_any_text(small, library, text):
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    assert small.encode(text) == library.encode_ordinary(text)


def test_one_very_long_find(small, library):
    for text in (" " * 3000 + "x", "ab" * 3000, "'" * 500 + "ll", "中" * 2000):
        assert small.encode(text) == library.encode_ordinary(text)


def test_table(spark, docs, rows, nothing, library):
    got = bpe.encode(docs, with_ids=True).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), len(ids)) for i, t, ids in ((r[0], r[1], library.encode_ordinary(r[1] or "")) for r in rows))
    assert sorted((str(r.doc_id), r.ids_sha256, r.decoded_sha256, r.n_tokens) for r in got) == want
    back = bpe.decode(bpe.encode(docs), ids_col="ids").collect()
    assert sorted(bytes(r.decoded) for r in back) == sorted((r[1] or "").encode() for r in rows)
    assert bpe.encode(nothing).count() == 0
