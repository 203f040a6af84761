"""Substring deduplication: windows of words that also start elsewhere, found with an FM-index per shard.

Routing. Every window has a minimizer, the k-gram of least hash in it; neighbouring windows with one minimizer form a
segment. Equal windows have equal minimizers, so all places of a window meet under one key, and only keys that occur twice
go on. Equal segments, told by a 128-bit BLAKE2 digest of their words, are counted and sent once with their count. Keys are
spread over shards of bounded size, each shard gets an FM-index over its segments, and the same segments are streamed through
it by backward search: matching statistics give the stretches that occur at least twice, and windows inside these are
reported. Each window's place lies in exactly one segment, so counts are exact.

Hashes of words only choose keys. Shards get the segments' words themselves and number the different ones, so windows are
compared word for word, and words whose hashes collide merely meet under one key.

A key with very many different segments (a passage that stands in front of many texts) is cut again by another hash order,
so its segments spread over new keys and those met once drop out. What is still crowded after ``LEVELS`` cuts (windows that
share nearly all their words) is counted window by window, by the windows' digests, in a pre-aggregated group-by; so no shard
gets an unbounded group.

Defined cases: a null or empty text has no words and nothing is removed; a text of fewer words than a window has none;
equal rows are places of their own, so both lose their windows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm import kernel as K
from tessel.llm.common import rows_by, text_key
from tessel.llm.fm_index import repeated_windows
from tessel.sources.store import discard, stash

WINDOW, GRAM = 35, 8
#: Words of a shard's index; different segments of one key before it is cut again; how often that may be done.
SHARD_WORDS, HOT, LEVELS = 500_000, 4_000, 6
#: Tasks of the search; further shards are read one after another by these.
MOST_TASKS = 20_000
#: The two halves of a segment's digest.
DIGEST = ["d1", "d2"]
_U = np.uint64


def _least_place(g: np.ndarray, w: int) -> np.ndarray:
    """Place of the least of each w neighbours, the leftmost of equals."""
    at, reach = np.arange(len(g)), 1
    while reach < w:
        step = min(reach, w - reach)
        if len(at) <= step:
            return at[:0]
        a, b = at[:-step], at[step:]
        at = np.where(g[a] <= g[b], a, b)
        reach += step
    return at


def cut(ids: np.ndarray, woff: np.ndarray, window: int, k: int, level: int) -> tuple[np.ndarray, ...]:
    """Segments of all rows: row, minimizer, first word in the row, windows. ids: word hashes."""
    h = K.mix(ids ^ K.mix(np.full(1, level + 1, np.uint64)))
    g = K.grams(h, k)
    at = _least_place(g, window - k + 1)
    rows, room = K.row_of(woff), K.room(woff)
    ok = np.flatnonzero(room[: len(at)] >= window)
    if not len(ok):
        none = np.zeros(0, np.int64)
        return none, none.view(np.uint64), none, none
    new = np.ones(len(ok), bool)
    new[1:] = (at[ok][1:] != at[ok][:-1]) | (rows[ok][1:] != rows[ok][:-1])
    first = ok[new]
    count = np.diff(np.append(np.flatnonzero(new), len(ok)))
    return rows[first], g[at[first]], first - woff[rows[first]], count


class Words:
    """The words of a batch of texts: their hashes, and their bytes with one space behind each."""

    def __init__(self, column: pa.Array) -> None:
        self.data, self.off = K.byte_view(column)
        self.starts, self.ends, self.woff = K.word_bounds(self.data, self.off, K.SPACED)

    def hashes(self) -> np.ndarray:
        return K.word_hashes(self.data, self.starts, self.ends)

    def runs(self, first: np.ndarray, stop: np.ndarray) -> list[bytes]:
        """Words [first, stop) of the batch, joined by a space, for each pair."""
        place = np.concatenate([[0], np.cumsum(self.ends - self.starts + 1)])
        out = np.full(place[-1], 0x20, np.uint8)
        inside = np.ones(place[-1], bool)
        inside[place[1:] - 1] = False
        out[inside] = self.data[K.SPACED[self.data]]
        whole = out.tobytes()
        return [whole[a:b] for a, b in zip(place[first].tolist(), (place[stop] - 1).tolist(), strict=True)]


def digests(runs: list[bytes]) -> np.ndarray:
    """A 128-bit digest of each run of words, as two numbers."""
    return np.frombuffer(b"".join([hashlib.blake2b(x, digest_size=16).digest() for x in runs]), np.int64).reshape(len(runs), 2)


def numbers(content: pa.Array) -> list[np.ndarray]:
    """The words of each run as numbers, equal exactly for equal words."""
    words = Words(content)
    size = words.ends - words.starts
    bound = np.concatenate([[0], np.cumsum(size)])
    flat = words.data[K.SPACED[words.data]]
    column = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(bound.astype(np.int64)), pa.py_buffer(flat)])
    number = column.dictionary_encode().indices.to_numpy().astype(np.int64)
    return np.split(number, words.woff[1:-1])


def _lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _segments(source: DataFrame, window: int, k: int) -> DataFrame:
    """For each row: rid, tk, and of each different segment in it the key, digest, places and number of windows."""
    kind = source.schema["rid"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in K.pieces(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                words = Words(part.column(1))
                row, key, first, count = cut(words.hashes(), words.woff, window, k, 0)
                at = words.woff[row] + first
                digest = digests(words.runs(at, at + count + window - 1))
                order = np.lexsort((first, digest[:, 1], digest[:, 0], key, row))
                row, key, digest, first, count = (x[order] for x in (row, key, digest, first, count))
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1]) | (digest[1:] != digest[:-1]).any(1)
                at = np.flatnonzero(new)
                off = np.searchsorted(row[at], np.arange(hi - lo + 1))
                places = _lists(first, np.append(at, len(first)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(2), _lists(key[at].view(np.int64), off, pa.int64()), *[_lists(digest[at, i], off, pa.int64()) for i in range(2)],
                        pa.ListArray.from_arrays(pa.array(off, pa.int32()), places), _lists(count[at], off, pa.int32()),
                    ],
                    ["rid", "tk", "key", *DIGEST, "ss", "c"],
                )

    return source.mapInArrow(work, f"rid {kind}, tk long, key array<long>, d1 array<long>, d2 array<long>, ss array<array<int>>, c array<int>")


def _contents(texts: DataFrame, window: int) -> DataFrame:
    """From texts with segments (key, d1, d2, w, s, c): the segments' words, and how many these are."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in K.pieces(batch.column(0)):
                part = batch.slice(lo, hi - lo)
                words = Words(part.column(0))
                lists = part.column(1)
                flat = lists.flatten()
                row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
                size = flat.field(5).to_numpy(zero_copy_only=False) + window - 1
                first = words.woff[row] + flat.field(4).to_numpy(zero_copy_only=False)
                content = words.runs(first, first + size)
                yield pa.RecordBatch.from_arrays([*[flat.field(i) for i in range(4)], pa.array(size, pa.int32()), pa.array(content, pa.binary())], ["key", *DIGEST, "w", "size", "content"])

    return texts.mapInArrow(work, "key long, d1 long, d2 long, w long, size int, content binary")


def _shard_search(ready: DataFrame, shards: int, window: int, need: int) -> DataFrame:
    """(key, d1, d2, hits): ranges [a, b) of windows of each segment that are frequent; segments without any are left out."""

    def search(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        t = pa.concat_tables(tables)
        key, d1, d2, w = (t.column(c).to_numpy() for c in ("key", *DIGEST, "w"))
        order = np.lexsort((d2, d1, key))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (key[order][1:] != key[order][:-1]) | (d1[order][1:] != d1[order][:-1]) | (d2[order][1:] != d2[order][:-1])
        keep = np.sort(order[fresh])  # a repeated row brings its segments twice
        found = repeated_windows(numbers(t.column("content").combine_chunks().take(pa.array(keep))), w[keep], window, need)
        rows, hits = [], []
        for i, good in zip(keep.tolist(), found, strict=True):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], good.astype(np.int8), [0]])))
            if len(edge):
                rows.append(i)
                hits.append([{"a": int(a), "b": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        yield pa.RecordBatch.from_arrays([pa.array(key[rows]), pa.array(d1[rows]), pa.array(d2[rows]), pa.array(hits, kind)], ["key", *DIGEST, "hits"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        now = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            shard = t.column("shard").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]]).tolist()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if held and shard[a] != now:
                    yield from search(held)
                    held = []
                now = shard[a]
                held.append(t.slice(a, b - a))
        if held:
            yield from search(held)

    placed = ready.withColumn("shard", F.pmod("key", F.lit(shards)).cast("int"))
    sorted_ = placed.repartition(min(shards, MOST_TASKS), "shard").sortWithinPartitions("shard")
    return sorted_.mapInArrow(work, "key long, d1 long, d2 long, hits array<struct<a:int,b:int>>")


def _pieces(segments: DataFrame, window: int, k: int, level: int) -> DataFrame:
    """Segments cut by another hash order: of each piece its segment's key and digest (pkey, p1, p2), where it begins there
    (off), its own key and digest, the segment's count, and its words. ``level`` None cuts single windows, without words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in K.pieces(batch.column(5), 1 << 18):
                part = batch.slice(lo, hi - lo)
                words = Words(part.column(5))
                old = part.column(0).to_numpy()
                if level is None:
                    many = np.maximum(np.diff(words.woff) - window + 1, 0)
                    row = np.repeat(np.arange(len(many)), many)
                    first = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                    key, count = old[row], np.ones(len(row), np.int64)
                else:
                    row, least, first, count = cut(words.hashes(), words.woff, window, k, level)
                    key = K.mix(old[row].view(np.uint64) ^ K.mix(least)).view(np.int64)
                at = words.woff[row] + first
                runs = words.runs(at, at + count + window - 1)
                digest = digests(runs)
                take = pa.array(row)
                content = pa.nulls(len(row), pa.binary()) if level is None else pa.array(runs, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(i).take(take) for i in range(3)], pa.array(first.astype(np.int32)), pa.array(key), *[pa.array(digest[:, i]) for i in range(2)], part.column(3).take(take), pa.array((count + window - 1).astype(np.int32)), content],
                    ["pkey", "p1", "p2", "off", "key", *DIGEST, "w", "size", "content"],
                )

    return segments.select("key", *DIGEST, "w", "size", "content").mapInArrow(work, "pkey long, p1 long, p2 long, off int, key long, d1 long, d2 long, w long, size int, content binary")


def _upward(parts: DataFrame, below: DataFrame) -> DataFrame:
    """Hits of pieces as hits of the segments they were cut from."""
    hits = parts.select("pkey", "p1", "p2", "off", "key", *DIGEST).join(below, ["key", *DIGEST]).select("pkey", "p1", "p2", "off", F.explode("hits").alias("h"))
    shifted = F.struct((F.col("off") + F.col("h.a")).alias("a"), (F.col("off") + F.col("h.b")).alias("b"))
    return hits.select(F.col("pkey").alias("key"), F.col("p1").alias("d1"), F.col("p2").alias("d2"), shifted.alias("h")).groupBy("key", *DIGEST).agg(F.collect_list("h").alias("hits"))


def _resolve(segments: DataFrame, window: int, k: int, need: int, shard_words: int, hot: int, levels: int, level: int = 0) -> tuple[DataFrame, list[DataFrame]]:
    """(key, d1, d2, hits) of all segments, and the tables that were written for it."""
    per_key = segments.groupBy("key").agg(F.count("*").alias("n"))
    crowded = stash(per_key.where(F.col("n") > hot).select("key"), "crowded")
    again = bool(crowded.take(1))
    ready = segments.join(crowded, "key", "left_anti") if again else segments
    words = ready.agg(F.sum("size").alias("n")).first()["n"] or 0
    found = _shard_search(ready, max(1, -(-words // shard_words)), window, need)
    if not again:
        return found, [crowded]
    last = level == levels
    parts = stash(_pieces(segments.join(crowded, "key", "left_semi"), window, k, None if last else level + 1), "recut")
    if last:
        one = F.array(F.struct(F.lit(0).alias("a"), F.lit(1).alias("b")))
        below = parts.groupBy("key", *DIGEST).agg(F.sum("w").alias("w")).where(F.col("w") >= need).select("key", *DIGEST, one.alias("hits"))
        return found.unionByName(_upward(parts, below)), [crowded, parts]
    live = parts.groupBy("key").agg(F.sum("w").alias("all")).where(F.col("all") >= need).select("key")
    merged = stash(parts.join(live, "key").groupBy("key", *DIGEST).agg(F.sum("w").alias("w"), F.first("size").alias("size"), F.first("content").alias("content")), "merged")
    below, written = _resolve(merged, window, k, need, shard_words, hot, levels, level + 1)
    return found.unionByName(_upward(parts, below)), [crowded, parts, merged, *written]


def dedup_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, k: int = GRAM, need: int = 2,
    shard_words: int = SHARD_WORDS, hot: int = HOT, levels: int = LEVELS, with_text: bool = True,
) -> DataFrame:
    """One row for each row: id, n_words, n_removed, removed word ranges [start, stop), kept words and their digest.

    ``kept_text`` is null unless ``with_text``.
    """
    source = rows_by(docs, id_col, text_col).withColumn("tk", text_key())
    kind = source.schema["rid"].dataType.simpleString()
    cuts = stash(_segments(source, window, k).withColumn("no", F.monotonically_increasing_id()), "cuts")
    seg = cuts.select("no", F.explode(F.arrays_zip("key", *DIGEST, "ss", "c")).alias("g")).select("no", "g.*")
    # Written first, so the join reads two plain exchanges and the planner can split a key that many rows share.
    live = stash(seg.groupBy("key").agg(F.sum(F.size("ss")).alias("n")).where(F.col("n") >= need).select("key"), "live")
    places = stash(seg.join(live, "key"), "places")
    once = places.groupBy("key", *DIGEST).agg(F.sum(F.size("ss")).alias("w"), F.min(F.struct("no", F.col("ss")[0].alias("s"), "c")).alias("at"))
    wanted = once.groupBy(F.col("at.no").alias("no")).agg(F.collect_list(F.struct("key", *DIGEST, "w", "at.s", "at.c")).alias("segs"))
    names = cuts.select("no", F.col("rid").alias("nid"), F.col("tk").alias("ntk"))
    wanted = wanted.join(names, "no").select("nid", "ntk", "segs")
    texts = source.join(wanted, source["rid"].eqNullSafe(wanted["nid"]) & (source["tk"] == wanted["ntk"])).select("txt", "segs")
    segments = stash(_contents(texts, window), "segments")
    found, written = _resolve(segments, window, k, need, shard_words, hot, levels)
    found = stash(found, "found")
    discard(*written)
    # Places and ranges are combined inside a row, so a text that repeats one stretch makes no more rows.
    span = lambda at, h: F.struct((at + h["a"]).alias("start"), (at + h["b"] + (window - 1)).alias("stop"))
    each = F.flatten(F.transform("ss", lambda at: F.transform("hits", lambda h: span(at, h))))
    spans = places.join(found, ["key", *DIGEST]).select("no", each.alias("part")).groupBy("no").agg(F.flatten(F.collect_list("part")).alias("spans"))
    spans = stash(spans.join(names, "no").select("nid", "ntk", "spans").dropDuplicates(["nid", "ntk"]), "spans")
    discard(segments, places, cuts, live, found)
    joined = source.join(spans, source["rid"].eqNullSafe(spans["nid"]) & (source["tk"] == spans["ntk"]), "left").select("rid", "txt", "spans")
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in K.pieces(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                words = Words(part.column(1))
                woff, starts, ends, base = words.woff, words.starts, words.ends, words.off
                texts, lists = K.strings(part.column(1)), part.column(2)
                n_words = np.diff(woff)
                removed, ranges, kept, digest = [], [], [], []
                for r, text in enumerate(texts):
                    own = lists[r].as_py()
                    if not own:
                        rest, cutout = text.split(), []
                    else:
                        edge = np.zeros(n_words[r] + 1, np.int64)
                        for x in own:
                            edge[x["start"]] += 1
                            edge[x["stop"]] -= 1
                        gone = np.cumsum(edge[:-1]) > 0
                        turn = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))).tolist()
                        cutout = [{"start": a, "stop": b} for a, b in zip(turn[::2], turn[1::2], strict=True)]
                        at = woff[r] + np.flatnonzero(~gone)
                        rest = [text[a:b] for a, b in zip((starts[at] - base[r]).tolist(), (ends[at] - base[r]).tolist(), strict=True)]
                    text = b" ".join(rest)
                    removed.append(int(n_words[r]) - len(rest))
                    ranges.append(cutout)
                    kept.append(text.decode() if with_text else None)
                    digest.append(hashlib.sha256(text).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n_words), pa.array(removed, pa.int64()), pa.array(ranges, span_type), pa.array(kept, pa.string()), pa.array(digest)],
                    ["rid", "n_words", "n_removed", "spans", "kept_text", "kept_sha256"],
                )

    out = joined.mapInArrow(finish, f"rid {kind}, n_words long, n_removed long, spans array<struct<start:int,stop:int>>, kept_text string, kept_sha256 string")
    return out.withColumnRenamed("rid", id_col)
