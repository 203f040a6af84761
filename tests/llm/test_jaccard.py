import collections
import itertools
import math

import numpy as np
import pytest

from tessel.llm import jaccard_join as J


def shingles(t):
    w = (t or "").encode().split()
    return frozenset(tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    links, up = [0] * len(rows), list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            up[top(a)] = top(b)
    least = {}
    for i, (r, _) in enumerate(rows):
        t = top(i)
        if r is not None:
            least[t] = min(r, least.get(t, r))
    return sorted(((str(r), str(least.get(top(i))), links[i]) for i, (r, _) in enumerate(rows)))


def exact(rows):
    """Class and links of each row, by all pairs of different sets that share one of their rarest shingles."""
    weight, ids = collections.Counter(), collections.defaultdict(list)
    sets = [shingles(t) for _, t in rows]
    for (r, _), s in zip(rows, sets):
        weight[s] += 1
        ids[s].append(r)
    df = collections.Counter(x for s in weight for x in s)
    nodes = [s for s in weight if s]
    posts, links, up = collections.defaultdict(list), [0] * len(nodes), list(range(len(nodes)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in enumerate(nodes):
        # To reach 4/5 of the union, at most a fifth of a set may be missing, so one of the rarest must be shared.
        near = set()
        for x in sorted(s, key=lambda x: (df[x], x))[: len(s) // 5 + 1]:
            near.update(posts[x])
            posts[x].append(i)
        for j in near:
            o = nodes[j]
            if 5 * min(len(s), len(o)) >= 4 * max(len(s), len(o)):
                common = len(s & o)
                if 5 * common >= 4 * (len(s) + len(o) - common):
                    links[i] += weight[o]
                    links[j] += weight[s]
                    up[top(i)] = top(j)
    least = {}
    for i, s in enumerate(nodes):
        least[top(i)] = min([*ids[s], least.get(top(i), ids[s][0])])
    at = {s: i for i, s in enumerate(nodes)}
    return {r: (least[top(at[s])], weight[s] - 1 + links[at[s]]) if s else (r, 0) for (r, _), s in zip(rows, sets)}


def test_no_link_of_a_whole_table_is_lost(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = exact([tuple(r) for r in docs.collect()])
    assert {r.doc_id: (r.class_id, r.n_links) for r in J.jaccard_join(docs).collect()} == want
    assert sum(n for _, n in want.values()) > 100


def test_looks_keep_what_may_reach_the_threshold():
    least = J.least_equal(0.8, 1e-9)
    assert (np.diff(least) > 0).all() and least[-1] < 0.8 * J.VALUES
    for n, m in zip(range(J.LOOK, J.VALUES + 1, J.LOOK), least):
        below = sum(math.comb(n + 1, i) * 0.8**i * 0.2 ** (n + 1 - i) for i in range(m))
        assert below < 1e-9


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    b = np.concatenate([a[:300], rng.integers(0, 1 << 62, 100).astype(np.uint64)])
    s = J.signatures(np.concatenate([np.sort(a), np.sort(b)]), np.array([0, 400, 800]))
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.15


@pytest.mark.parametrize("block", [J.BLOCK, 2])
def test_equals_brute_force(spark, docs, rows, nothing, block):
    got = J.jaccard_join(docs, block=block).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in got) == brute([(r[0], r[1]) for r in rows])
    assert J.jaccard_join(nothing).count() == 0


def test_components(spark):
    from tessel.llm.components import components

    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 201)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    by = {}
    for r in got:
        by.setdefault(r.root, set()).add(r.node)
    assert sorted(map(sorted, by.values())) == [list(range(41)), list(range(100, 130)), [200, 201]]
