import hashlib
import random
import re

import pytest

from tessel.llm import decontaminate as D

PATTERN = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(t):
    return PATTERN.findall((t or "").encode().translate(LOW))


def brute(docs, items, window=13):
    table = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for p in range(len(w) - n + 1 if w and i is not None else 0):
            table.setdefault(tuple(w[p : p + n]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in table}:
            for p in range(len(w) - n + 1):
                if (k := tuple(w[p : p + n])) in table:
                    hit.update(range(p, p + n))
                    found |= table[k]
        out.append((str(i), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("most", [D.MOST_BROADCAST, 0])
def test_both_ways_equal_brute_force(spark, docs, rows, nothing, most):
    rng = random.Random(8)
    texts = [r[1] for r in rows if r[1]]
    items = [(1, " ".join(texts[0].split()[10:40])), (2, texts[3].upper()), (3, "one-two THREE"), (4, None), (5, ""), (None, texts[5]), (6, "é ü 中文"), (7, "same"), (7, " ".join(texts[2].split()[:12])), (8, "changed"), (10, " ".join(rng.sample(texts[4].split(), 20)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.decontaminate(docs, bench, most_broadcast=most).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got) == brute([(r[0], r[1]) for r in rows], items)
    assert all(r.n_hit == sum(s.stop - s.start for s in r.spans) for r in got)
    assert D.decontaminate(nothing, bench, most_broadcast=most).count() == 0
    none = D.decontaminate(docs, bench.where("false"), most_broadcast=most).collect()
    assert len(none) == len(rows) and all(r.n_hit == 0 for r in none)
