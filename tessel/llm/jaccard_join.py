"""N-gram Jaccard self-join with Bayesian pruning of candidates.

Texts with equal shingle sets form one class and are joined through one node. Nodes get a MinHash signature; nodes that
share one of ``BANDS`` bands are candidates. Their signatures are compared some values at a time; with a uniform prior on
the similarity and m of n values equal, the posterior is Beta(m + 1, n - m + 1), and a pair goes when the chance of reaching
the threshold falls below ``TOLERANCE``. What survives is verified exactly on the shingle sets.

No task holds an unbounded group, and pairs are never written out. Buckets and clusters of more than ``BLOCK`` nodes are
cut into blocks, and each two blocks meet in one task, which gives back only spanning edges and counts of links. First
survivors are tied into clusters; then each node travels once (with its shingles) to its cluster, where the links of its
candidates are verified by matrix products. Links within a class of equal sets need no work: they are its size.

What may be lost: a pair at exactly the threshold shares no band with chance (1 - 0.8**4)**32 = 5e-8, and is pruned with
chance TOLERANCE at most in each of 8 looks; more alike pairs fare better.

Defined cases: a text of one to four words has one shingle, all its words; a text without words (null, empty, blank) has
none and is joined with nothing, so it is a class of its own; equal rows are copies of each other; a class's id is the
least id in it, null only if all ids in it are; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm import kernel as K
from tessel.llm.common import rows_by, text_key
from tessel.llm.components import components
from tessel.sources.store import discard, stash

SHINGLE, THRESHOLD = 5, 0.8
#: Signature values of 16 bits, bands of them, values compared in one look, least posterior chance to go on.
VALUES, BANDS, LOOK, TOLERANCE = 128, 32, 16, 1e-9
#: Nodes of one block.
BLOCK = 256
_U = np.uint64
_ROWS = VALUES // BANDS
_MULT = K._splitmix(VALUES, 11) | _U(1)
_ADD = K._splitmix(VALUES, 13)


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, one after another, and their offsets."""
    data, off = K.byte_view(column)
    starts, ends, woff = K.word_bounds(data, off, K.SPACED)
    words = K.word_hashes(data, starts, ends)
    rows, room, count = K.row_of(woff), K.room(woff), np.diff(woff)
    g = K.grams(words, size)
    at = np.flatnonzero(room[: len(g)] >= size)
    hashes, owner = [g[at]], [rows[at]]
    for n in range(1, size):
        short = np.flatnonzero(count == n)
        hashes.append(K.grams_at(words, n, woff[short]))
        owner.append(short)
    h, o = np.concatenate(hashes), np.concatenate(owner)
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    h, o = h[keep], o[keep]
    return h, np.searchsorted(o, np.arange(len(column) + 1))


def signatures(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """16-bit MinHash values, a row for each set; sets must not be empty."""
    out = np.empty((len(off) - 1, VALUES), np.uint16)
    if not len(out):
        return out
    step = 1 << 15
    for k in range(VALUES):
        best = np.full(len(out), np.iinfo(np.uint64).max)
        for lo in range(0, len(h), step):
            x = h[lo : lo + step] * _MULT[k] + _ADD[k]
            x ^= x >> _U(29)
            a = max(0, int(np.searchsorted(off, lo, side="right")) - 1)
            b = int(np.searchsorted(off, lo + len(x), side="left"))
            low = np.minimum.reduceat(x, np.maximum(off[a:b] - lo, 0))
            np.minimum(best[a:b], low, out=best[a:b])
        out[:, k] = (K.mix(best) >> _U(48)).astype(np.uint16)
    return out


def _nodes(source: DataFrame, size: int) -> DataFrame:
    """For each row: rid, tk, node (a digest of its shingle set; null without shingles), n_shingles, sig."""
    kind = source.schema["rid"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in K.pieces(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                h, off = shingle_sets(part.column(1), size)
                count = np.diff(off)
                some = count > 0
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(K.mix(h))])
                node = K.mix(sums[off[1:]] - sums[off[:-1]] + count.astype(np.uint64)).view(np.int64)
                # Sets without shingles take no room in h, so dropping their offsets leaves the others' sets whole.
                sig = signatures(h, np.append(off[:-1][some], len(h)))
                raw = sig.tobytes()
                bytes_, at = [], 0
                for x in some.tolist():
                    bytes_.append(raw[at : at + 2 * VALUES] if x else None)
                    at += 2 * VALUES * x
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(node, mask=~some), pa.array(count, pa.int32()), pa.array(bytes_, pa.binary())], ["rid", "tk", "node", "n_shingles", "sig"]
                )

    return source.mapInArrow(work, f"rid {kind}, tk long, node long, n_shingles int, sig binary")


@lru_cache(8)
def least_equal(threshold: float, tolerance: float) -> np.ndarray:
    """For n = LOOK, 2 LOOK, ... compared values, how many must be equal for the posterior chance to reach ``tolerance``.

    P(similarity >= t | m of n) is the chance that a binomial of n + 1 trials with chance t has at most m successes.
    """
    out = []
    for n in range(LOOK, VALUES + 1, LOOK):
        sum_, m = 0.0, 0
        while True:
            sum_ += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if sum_ >= tolerance:
                break
            m += 1
        out.append(m)
    return np.array(out)


def prune(sig: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that survive all looks."""
    equal = np.zeros(len(i), np.int64)
    for look, least in enumerate(least_equal(threshold, tolerance).tolist()):
        cols = slice(look * LOOK, (look + 1) * LOOK)
        equal += (sig[i, cols] == sig[j, cols]).sum(1)
        stay = equal >= least
        i, j, equal = i[stay], j[stay], equal[stay]
        if not len(i):
            break
    return i, j


class Forest:
    """Union-find over small numbers; gives spanning edges."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def top(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def tie(self, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
        out = []
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            x, y = self.top(a), self.top(b)
            if x != y:
                self.up[max(x, y)] = min(x, y)
                out.append((min(x, y), max(x, y)))
        return out


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups of rows with equal keys, from sorted batches: many small groups at a time."""
    held: list[pa.Table] = []
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not t.num_rows:
            continue
        cols = [t.column(k).to_numpy() for k in keys]
        if held:
            last = [held[-1].column(k)[held[-1].num_rows - 1].as_py() for k in keys]
            if last != [c[0] for c in cols]:
                yield pa.concat_tables(held)
                held = []
        change = np.zeros(len(cols[0]), bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = np.flatnonzero(change)
        if not len(cuts):
            held.append(t)
            continue
        held.append(t.slice(0, int(cuts[-1])))
        yield pa.concat_tables(held)
        held = [t.slice(int(cuts[-1]))]
    if held:
        yield pa.concat_tables(held)


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(table.num_rows, bool)
    change[:1] = True
    for k in keys:
        c = table.column(k).to_numpy()
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def _blocked(rows: DataFrame, key: str, count: str, node: str, block: int) -> DataFrame:
    """Adds block numbers ``bi`` <= ``bj`` (and ``own``): each two blocks of a group meet once."""
    blocks = F.ceil(F.col(count) / block).cast("int")
    own = F.pmod(F.xxhash64(node, key), blocks).cast("int")
    rows = rows.withColumn("own", own)
    # A group of one block meets itself; else block o meets (o, j) for each j, itself included.
    return rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("bi", F.least("own", "other")).withColumn("bj", F.greatest("own", "other")).drop("other")


def _sigs(t: pa.Table, col: str = "sig") -> np.ndarray:
    return np.frombuffer(b"".join(t.column(col).to_pylist()), np.uint16).reshape(t.num_rows, VALUES)


def _meets(own: np.ndarray, bi: np.ndarray, bj: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """In a task of two blocks only pairs across them are looked at: the others meet in the blocks' own tasks."""
    return (bi[i] == bj[i]) | (own[i] != own[j])


def _survivors(members: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """From bucket members (band key, own, bi, bj, node, sig) sorted into groups: spanning edges of surviving pairs."""
    keys = ["key", "bi", "bj"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, keys):
            sig, node = _sigs(t), t.column("node").to_numpy()
            own, bi, bj = (t.column(c).to_numpy() for c in ("own", "bi", "bj"))
            starts = _starts(t, keys)
            stop = np.repeat(np.append(starts[1:], t.num_rows), np.diff(np.append(starts, t.num_rows)))
            forest, a, b = Forest(t.num_rows), [], []
            place = np.arange(t.num_rows)
            for d in range(1, int((stop - place).max(initial=0))):
                i = place[place + d < stop]
                i = i[_meets(own, bi, bj, i, i + d)]
                i, j = prune(sig, i, i + d, threshold, tolerance)
                for x, y in forest.tie(i, j):
                    a.append(node[x])
                    b.append(node[y])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return members.mapInArrow(work, "a long, b long")


def _verify(members: DataFrame, threshold: float, tolerance: float, size: int) -> DataFrame:
    """From cluster members with texts, sorted into groups: for each node, links found here and an edge to span them.

    Rows (node, links, a, b): either links of a node, counted in rows of the table, or a spanning edge.
    """
    keys = ["cluster", "bi", "bj"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _groups(batches, keys):
            cuts = np.append(_starts(whole, keys), whole.num_rows)
            out: list[tuple] = []
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                t = whole.slice(lo, hi - lo)
                _, keep = np.unique(t.column("node").to_numpy(), return_index=True)
                t = t.take(pa.array(keep))  # a repeated row brings its node twice
                n = t.num_rows
                if n < 2:
                    continue
                sig, node, weight = _sigs(t), t.column("node").to_numpy(), t.column("weight").to_numpy()
                own, bi, bj = (t.column(c).to_numpy() for c in ("own", "bi", "bj"))
                i, j = np.triu_indices(n, 1)
                ok = _meets(own, bi, bj, i, j)
                i, j = i[ok], j[ok]
                shared = np.zeros(len(i), bool)
                for k in range(0, VALUES, _ROWS):
                    shared |= (sig[i, k : k + _ROWS] == sig[j, k : k + _ROWS]).all(1)
                i, j = prune(sig, i[shared], j[shared], threshold, tolerance)
                if not len(i):
                    continue
                h, off = shingle_sets(t.column("txt").combine_chunks() if isinstance(t.column("txt"), pa.ChunkedArray) else t.column("txt"), size)
                common = shared_counts(h, off)
                count = np.diff(off)
                linked = common[i, j] >= threshold * (count[i] + count[j] - common[i, j]) - 1e-9
                i, j = i[linked], j[linked]
                links = np.bincount(i, weight[j], n) + np.bincount(j, weight[i], n)
                out += [(int(node[x]), int(links[x]), None, None) for x in np.flatnonzero(links).tolist()]
                out += [(None, 0, int(node[x]), int(node[y])) for x, y in Forest(n).tie(i, j)]
            columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["node", "links", "a", "b"])

    return members.mapInArrow(work, "node long, links long, a long, b long")


def shared_counts(h: np.ndarray, off: np.ndarray, width: int = 8192) -> np.ndarray:
    """How many values each two sets share, by products of 0-1 matrices over ``width`` values at a time."""
    n = len(off) - 1
    _, column = np.unique(h, return_inverse=True)
    row = np.repeat(np.arange(n), np.diff(off))
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    out = np.zeros((n, n), np.float32)
    total = int(column[-1]) + 1 if len(column) else 0
    for lo in range(0, total, width):
        a, b = np.searchsorted(column, [lo, lo + width])
        m = np.zeros((n, min(width, total - lo)), np.float32)
        m[row[a:b], column[a:b] - lo] = 1
        out += m @ m.T
    return out.astype(np.int64)


def jaccard_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, size: int = SHINGLE,
    tolerance: float = TOLERANCE, block: int = BLOCK,
) -> DataFrame:
    """One row for each row: id, class_id (least id among all rows tied by links), n_links (other rows within reach)."""
    source = rows_by(docs, id_col, text_col).withColumn("tk", text_key())
    rows = stash(_nodes(source, size), "nodes")
    full = rows.where("node is not null")
    nodes = full.groupBy("node").agg(F.count("*").alias("weight"), F.min(F.struct("rid", "tk")).alias("at"), F.min("rid").alias("least"))
    nodes = stash(nodes, "weights")
    sigs = stash(full.groupBy("node").agg(F.first("sig").alias("sig")), "sigs")

    bands = ", ".join(f"xxhash64({i}, substring(sig, {1 + i * 2 * _ROWS}, {2 * _ROWS}))" for i in range(BANDS))
    spread = sigs.select("node", F.expr(f"explode(array({bands})) AS key"))
    shared = spread.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = _blocked(spread.join(shared, "key"), "key", "n", "node", block).join(sigs, "node")
    ordered = members.select("key", "bi", "bj", "own", "node", "sig").repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    clusters = components(_survivors(ordered, threshold, tolerance))

    sized = clusters.groupBy("root").agg(F.count("*").alias("n"))
    placed = clusters.join(sized, "root").join(nodes, "node").join(sigs, "node").select(F.col("root").alias("cluster"), "n", "node", "weight", "sig", F.col("at.rid").alias("nid"), F.col("at.tk").alias("ntk"))
    texts = source.join(placed, source["rid"].eqNullSafe(placed["nid"]) & (source["tk"] == placed["ntk"])).select("cluster", "n", "node", "weight", "sig", "txt")
    met = _blocked(texts, "cluster", "n", "node", block).select("cluster", "bi", "bj", "own", "node", "weight", "sig", "txt")
    met = met.repartition("cluster", "bi", "bj").sortWithinPartitions("cluster", "bi", "bj")
    verified = stash(_verify(met, threshold, tolerance, size), "verified")
    tied = components(verified.where("a is not null").select("a", "b"))
    links = verified.where("node is not null").groupBy("node").agg(F.sum("links").alias("links"))
    root = nodes.join(tied, "node", "left").join(links, "node", "left")
    root = stash(root.select("node", "weight", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"), "least"), "roots")
    name = root.groupBy("root").agg(F.min("least").alias("class_id"))
    known = root.join(name, "root").select("node", "class_id", (F.col("weight") - 1 + F.col("links")).alias("n_links"))
    out = rows.join(known, "node", "left").select(
        F.col("rid").alias(id_col), F.when(F.col("node").isNull(), F.col("rid")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )
    discard(sigs, clusters, verified, tied)
    return out
