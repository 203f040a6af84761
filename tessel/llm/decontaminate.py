"""Benchmark decontamination by winnowing.

A k-gram hash is kept wherever it is the least of some w neighbouring k-grams. Two texts that share w + k - 1 words share
a kept hash there, so with w + k - 1 = ``window`` no shared window can be missed. Kept hashes of documents are joined with
those of the benchmark; around each hit all windows holding the k-gram are looked up exactly in the benchmark's windows.
An item of fewer words than a window is one window; for each such length all n-grams are kept (winnowing with w = 1).

Two ways to join, with equal results: the benchmark's windows are broadcast while their counted number stays within
``most_broadcast``; beyond, fingerprints and windows are joined by shuffles.

Defined cases: a null or empty text has no words, so no hit and no window; an item without words occurs nowhere; a null
item id is no item; equal item ids are one item; equal rows each get the same result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.llm import kernel as K
from tessel.llm.common import rows_by, text_key
from tessel.sources.store import stash

WINDOW, GRAM = 13, 5
#: Windows of a benchmark that may be broadcast: 24 bytes each, so 48 MB at most.
MOST_BROADCAST = 2_000_000


def _bounds(column: pa.Array):
    data, off = K.byte_view(column)
    data = K.LOWER[data]
    starts, ends, woff = K.word_bounds(data, off, K.ALNUM)
    return K.word_hashes(data, starts, ends), woff


def _kept(words: np.ndarray, room: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Kept k-gram starts, and all k-gram hashes."""
    g = K.grams(words, k)
    return K.winnow(g, room[: len(g)] >= window, window - k + 1), g


def _around(kept: np.ndarray, rows: np.ndarray, woff: np.ndarray, window: int, k: int) -> np.ndarray:
    """Starts of all windows in the same row that hold the k-gram at one of ``kept``."""
    if not len(kept):
        return kept
    at = (kept[:, None] - np.arange(window - k + 1)[None, :]).ravel()
    row = np.repeat(rows[kept], window - k + 1)
    return np.unique(at[(at >= woff[row]) & (at + window <= woff[row + 1])])


def item_windows(bench: DataFrame, id_col: str, text_col: str, window: int = WINDOW) -> DataFrame:
    """(item string, n int, h long): each distinct window hash of each item; n below ``window`` only for short items."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in K.pieces(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                words, woff = _bounds(part.column(1))
                room, rows, count = K.room(woff), K.row_of(woff), np.diff(woff)
                out: list[tuple[np.ndarray, int, np.ndarray]] = []
                g = K.grams(words, window)
                at = np.flatnonzero(room[: len(g)] >= window)
                out.append((rows[at], window, g[at]))
                for n in np.unique(count[(count > 0) & (count < window)]).tolist():
                    short = np.flatnonzero(count == n)
                    out.append((short, n, K.grams_at(words, n, woff[short])))
                for row, n, h in out:
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(row)), pa.array(np.full(len(row), n, np.int32)), pa.array(h.view(np.int64))], ["item", "n", "h"]
                    )

    found = rows_by(bench, id_col, text_col).where("rid is not null").withColumn("rid", F.col("rid").cast("string"))
    return found.mapInArrow(work, "item string, n int, h long").distinct()


def _digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _spans(hit: np.ndarray, woff: np.ndarray, row: int) -> list[dict]:
    """Word ranges [start, stop) of one row's hit words."""
    own = hit[woff[row] : woff[row + 1]].astype(np.int8)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], own, [0]])))
    return [{"start": int(a), "stop": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


RESULT = "n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, spans array<struct<start:int,stop:int>>"
_FIELDS = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))]


def _result_columns(counts: np.ndarray, woff: np.ndarray, hit: np.ndarray, pairs: dict[int, list[str]]) -> list[pa.Array]:
    sums = np.concatenate([[0], np.cumsum(hit)])
    n_hit = sums[woff[1:]] - sums[woff[:-1]]
    items = [pairs.get(r, []) for r in range(len(counts))]
    none = _digest([])
    values = [counts, n_hit, [len(x) for x in items], items, [_digest(x) if x else none for x in items], [_spans(hit, woff, r) if n_hit[r] else [] for r in range(len(counts))]]
    return [pa.array(v, t) for v, t in zip(values, _FIELDS, strict=True)]


def _cover(at: np.ndarray, n: int, total: int) -> np.ndarray:
    """How many of the spans [at, at + n) hold each of ``total`` words, as a difference array."""
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return edge


def decontaminate(
    docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, k: int = GRAM, most_broadcast: int = MOST_BROADCAST,
) -> DataFrame:
    """One row for each document: its id, words, hit words, the items with occurring windows, their digest, hit spans."""
    known = stash(item_windows(bench, item_id_col, item_text_col, window), "windows")
    if known.count() <= most_broadcast:
        return _by_broadcast(docs, known, id_col, text_col, window, k, bench, item_id_col, item_text_col)
    return _by_shuffle(docs, known, id_col, text_col, window, k, bench, item_id_col, item_text_col)


def _fingerprints(bench: DataFrame, id_col: str, text_col: str, window: int, k: int) -> DataFrame:
    """Kept k-gram hashes of the benchmark (h long)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in K.pieces(batch.column(1)):
                words, woff = _bounds(batch.column(1).slice(lo, hi - lo))
                kept, g = _kept(words, K.room(woff), window, k)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(g[kept]).view(np.int64))], ["h"])

    return rows_by(bench, id_col, text_col).where("rid is not null").mapInArrow(work, "h long").distinct()


def _by_broadcast(docs, known, id_col, text_col, window, k, bench, item_id_col, item_text_col) -> DataFrame:
    spark = docs.sparkSession
    # Within most_broadcast by the count above; fingerprints are no more than windows.
    got = known.toPandas()
    prints = np.sort(_fingerprints(bench, item_id_col, item_text_col, window, k).toPandas()["h"].to_numpy(np.int64).view(np.uint64))
    names = sorted(set(got["item"]))
    number = {x: i for i, x in enumerate(names)}
    tables = {}
    for n, part in got.groupby("n"):
        h, item = part["h"].to_numpy(np.int64).view(np.uint64), part["item"].map(number).to_numpy(np.int64)
        order = np.lexsort((item, h))
        h, item = h[order], item[order]
        keys, first = np.unique(h, return_index=True)
        tables[int(n)] = (keys, np.append(first, len(h)), item)
    shared = spark.sparkContext.broadcast((prints, names, tables))
    source = rows_by(docs, id_col, text_col)
    out_type = f"rid {source.schema['rid'].dataType.simpleString()}, {RESULT}"

    def found(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
        ok = np.flatnonzero(keys[at] == h) if len(keys) else np.zeros(0, np.int64)
        return ok, at[ok]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, names, tables = shared.value
        for batch in batches:
            for lo, hi in K.pieces(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                words, woff = _bounds(part.column(1))
                rows, room = K.row_of(woff), K.room(woff)
                edge = np.zeros(len(words) + 1, np.int64)
                pairs = []
                for n, (keys, first, item) in tables.items():
                    if n == window:
                        kept, g = _kept(words, room, window, k)
                        at = _around(kept[found(prints, g[kept])[0]], rows, woff, window, k)
                        h = K.grams_at(words, n, at)
                    else:
                        h = K.grams(words, n)
                        at = np.flatnonzero(room[: len(h)] >= n)
                        h = h[at]
                    ok, key = found(keys, h)
                    edge += _cover(at[ok], n, len(words))
                    many = first[key + 1] - first[key]
                    flat = np.repeat(first[key] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()) if len(key) else np.zeros(0, np.int64)
                    pairs.append(np.unique(np.repeat(rows[at[ok]], many) * len(names) + item[flat]))
                by: dict[int, list[str]] = {}
                for x in np.unique(np.concatenate(pairs)).tolist() if pairs else []:
                    by.setdefault(x // len(names), []).append(names[x % len(names)])
                hit = np.cumsum(edge[:-1]) > 0
                yield pa.RecordBatch.from_arrays([part.column(0), *_result_columns(np.diff(woff), woff, hit, by)], ["rid", *[x.split()[0] for x in RESULT.split(", ")]])

    return source.mapInArrow(work, out_type).withColumnRenamed("rid", id_col)


def _by_shuffle(docs, known, id_col, text_col, window, k, bench, item_id_col, item_text_col) -> DataFrame:
    """Fingerprints meet by a shuffled semi-join, then only the windows around hits do; no task holds the benchmark."""
    source = rows_by(docs, id_col, text_col).withColumn("tk", text_key())
    kind = source.schema["rid"].dataType.simpleString()
    lengths = [r[0] for r in known.select("n").distinct().collect() if r[0] < window]  # fewer than ``window`` values

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in K.pieces(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                words, woff = _bounds(part.column(1))
                rows, room = K.row_of(woff), K.room(woff)
                kept, g = _kept(words, room, window, k)
                sets = [(window, kept, g[kept])]
                for n in lengths:
                    h = K.grams(words, n)
                    at = np.flatnonzero(room[: len(h)] >= n)
                    sets.append((n, at, h[at]))
                for n, at, h in sets:
                    row = pa.array(rows[at])
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(row), part.column(2).take(row), pa.array(np.full(len(at), n, np.int32)), pa.array((at - woff[rows[at]]).astype(np.int32)), pa.array(h.view(np.int64))],
                        ["rid", "tk", "n", "at", "h"],
                    )

    marks = source.mapInArrow(prints, f"rid {kind}, tk long, n int, at int, h long")
    sought = _fingerprints(bench, item_id_col, item_text_col, window, k).select(F.lit(window).alias("n"), "h").union(known.where(F.col("n") < window).select("n", "h").distinct())
    hits = marks.join(sought, ["n", "h"], "left_semi").groupBy("rid", "tk").agg(F.collect_set(F.struct("n", "at")).alias("marks"))
    texts = source.dropDuplicates(["rid", "tk"])
    near = texts.join(hits, texts["rid"].eqNullSafe(hits["rid"]) & (texts["tk"] == hits["tk"])).select(texts["rid"], texts["txt"], texts["tk"], "marks")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                words, woff = _bounds(part.column(1))
                marks = part.column(3).flatten()
                n, at = marks.field(0).to_numpy(zero_copy_only=False), marks.field(1).to_numpy(zero_copy_only=False).astype(np.int64)
                for m in np.unique(n).tolist():
                    own = np.sort(at[n == m])
                    own = _around(own, np.zeros(len(words), np.int64), woff, window, k) if m == window else own
                    same = pa.array(np.zeros(len(own), np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(same), part.column(2).take(same), pa.array(np.full(len(own), m, np.int32)), pa.array(own.astype(np.int32)), pa.array(K.grams_at(words, m, own).view(np.int64))],
                        ["rid", "tk", "n", "at", "h"],
                    )

    met = near.mapInArrow(windows, f"rid {kind}, tk long, n int, at int, h long").join(known, ["n", "h"])
    per_doc = met.groupBy("rid", "tk").agg(F.collect_set(F.struct("n", "at")).alias("hits"), F.sort_array(F.collect_set("item")).alias("items"))
    whole = source.join(per_doc, source["rid"].eqNullSafe(per_doc["rid"]) & (source["tk"] == per_doc["tk"]), "left").select(source["rid"], "txt", "hits", "items")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in K.pieces(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                data, off = K.byte_view(part.column(1))
                starts, _, woff = K.word_bounds(data, off, K.ALNUM)
                edge = np.zeros(len(starts) + 1, np.int64)
                by = {}
                for r, (hits, items) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                    for x in hits or []:
                        edge[woff[r] + x["at"]] += 1
                        edge[woff[r] + x["at"] + x["n"]] -= 1
                    if items:
                        by[r] = items
                yield pa.RecordBatch.from_arrays([part.column(0), *_result_columns(np.diff(woff), woff, np.cumsum(edge[:-1]) > 0, by)], ["rid", *[x.split()[0] for x in RESULT.split(", ")]])

    return whole.mapInArrow(finish, f"rid {kind}, {RESULT}").withColumnRenamed("rid", id_col)


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
