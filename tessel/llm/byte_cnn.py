"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are cut into chunks that cover all of it; filters of ``WIDTH`` bytes read over a chunk's end, so chunks
overlap. Each position has the learned vectors of the next bytes and one more channel, how well the bytes there repeat
what stood 2 to ``LAGS`` bytes earlier (filters of fixed width can't see that a word follows itself). Each filter's
largest answer in a chunk is kept, a linear layer makes of these a chunk's log-odds, and their mean over all chunks is the
text's. Everything is learned here, from the whole texts of at most ``SAMPLE`` labelled rows of each label (a parameter of
``fit``); scores read whole texts too.

Defined cases: a null or empty text is one chunk of padding and gets a score like any other; a null id counts as held
out; null labels and labels of unknown rows are not learned from; equal rows get equal scores; with no row of one label
the score is the share of label 1 (a half if there are no labels); other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.llm import kernel as K
from tessel.llm.common import rows_by

CHUNK, WIDTH, FILTERS, VECTOR, LAGS, RUN = 256, 6, 16, 8, 20, 12
SAMPLE, EPOCHS, LEAST_STEPS, BATCH, RATE = 2000, 10, 500, 64, 0.01
THRESHOLD = 0.3


class Net(NamedTuple):
    vectors: np.ndarray  # 256 x VECTOR
    filters: np.ndarray  # WIDTH x VECTOR x FILTERS
    repeat: np.ndarray  # FILTERS
    bias: np.ndarray  # FILTERS
    out: np.ndarray  # FILTERS
    base: np.ndarray  # 1


def layout(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes in whole chunks, zeros behind each row, and the index of each row's first chunk (and one more).

    No lag or run reaches over the zeros; ``pool`` leaves out the places from which a filter would.
    """
    size = np.diff(off)
    chunks = -(-(size + LAGS + RUN) // CHUNK)
    first = np.concatenate([[0], np.cumsum(chunks)])
    flat = np.zeros(first[-1] * CHUNK + WIDTH, np.uint8)
    flat[np.arange(len(data)) + np.repeat(first[:-1] * CHUNK - off[:-1], size)] = data
    return flat, first


def repeats(flat: np.ndarray) -> np.ndarray:
    """For each place, 0 to 1: how far over a half of the next RUN bytes equal those a lag earlier, for the best lag."""
    flat = np.concatenate([np.zeros(LAGS, np.uint8), flat, np.zeros(RUN, np.uint8)])  # the first row is as the others
    n = len(flat)
    best = np.zeros(n, np.int32)
    real = flat != 0
    for lag in range(2, LAGS + 1):
        sums = np.zeros(n - lag + 1, np.int32)
        np.cumsum((flat[lag:] == flat[:-lag]) & real[lag:], out=sums[1:])
        run = sums[RUN:] - sums[:-RUN]
        np.maximum(best[lag : lag + len(run)], run, out=best[lag : lag + len(run)])
    best[~real] = 0  # from the zeros before a row, its beginning would show
    return np.maximum(best[LAGS:-RUN] - RUN // 2, 0).astype(np.float32) / (RUN - RUN // 2)


def _tables(net: Net) -> list[np.ndarray]:
    """For each pair of neighbouring bytes, what two taps of all filters answer."""
    return [((net.vectors @ net.filters[k])[:, None, :] + (net.vectors @ net.filters[k + 1])[None, :, :]).reshape(65536, FILTERS).astype(np.float32) for k in range(0, WIDTH, 2)]


def pool(net: Net, tables: list[np.ndarray], flat: np.ndarray, first: np.ndarray, again: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Largest answers of each chunk; with ``places`` also where in the chunk they stand."""
    n = (len(flat) - WIDTH) // CHUNK
    top = np.empty((n, FILTERS), np.float32)
    where = np.empty((n, FILTERS), np.int64) if places else None
    last = np.zeros(n, bool)
    last[first[1:] - 1] = True
    pair = flat[:-1].astype(np.int32) * 256 + flat[1:]
    for lo in range(0, n, 128):
        hi = min(n, lo + 128)
        a, b = lo * CHUNK, hi * CHUNK
        got = again[a:b, None] * net.repeat[None, :]
        for k, t in enumerate(tables):
            got += t[pair[a + 2 * k : b + 2 * k]]
        got = got.reshape(hi - lo, CHUNK, FILTERS)
        got[last[lo:hi], CHUNK - WIDTH + 1 :] = -np.inf  # these would read the next row's bytes
        if places:
            where[lo:hi] = got.argmax(1)
            top[lo:hi] = np.take_along_axis(got, where[lo:hi, None, :], 1)[:, 0]
        else:
            top[lo:hi] = got.max(1)
    return top + net.bias, where


def score(net: Net, tables: list[np.ndarray], column: pa.Array) -> np.ndarray:
    """Probability of label 1 for each row."""
    flat, first = layout(*K.byte_view(column))
    top, _ = pool(net, tables, flat, first, repeats(flat))
    chunk = np.maximum(top, 0).astype(np.float64) @ net.out + net.base
    odds = np.add.reduceat(chunk, first[:-1]) / np.diff(first) if len(first) > 1 else np.zeros(0)
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30).astype(np.float64)))


def train(texts: list[bytes], labels: np.ndarray, seed: int = 5) -> Net:
    """Fit by Adam on the logistic loss of whole rows; the same texts give the same net."""
    rng = np.random.default_rng(seed)
    net = [rng.normal(0, 0.3, (256, VECTOR)), rng.normal(0, 0.3, (WIDTH, VECTOR, FILTERS)), rng.uniform(0, 1, FILTERS), np.zeros(FILTERS), rng.normal(0, 0.3, FILTERS), np.zeros(1)]
    net = [x.astype(np.float32) for x in net]
    mean, square, step = [np.zeros_like(x) for x in net], [np.zeros_like(x) for x in net], 0
    weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
    sizes = np.array([len(t) for t in texts])
    ready = []
    for lo in range(0, len(texts), BATCH):
        own = np.argsort(sizes, kind="stable")[lo : lo + BATCH]
        data = np.frombuffer(b"".join(texts[i] for i in own), np.uint8)
        flat, first = layout(data, np.concatenate([[0], np.cumsum(sizes[own])]))
        ready.append((flat, first, repeats(flat), labels[own], weight[own]))
    epochs = max(EPOCHS, -(-LEAST_STEPS // len(ready)))
    for epoch in range(epochs):
        for at in rng.permutation(len(ready)):
            flat, first, again, y, w = ready[at]
            now = Net(*net)
            top, where = pool(now, _tables(now), flat, first, again, True)
            hidden = np.maximum(top, 0)
            chunks = np.diff(first)
            odds = np.add.reduceat(hidden @ now.out + now.base, first[:-1]) / chunks
            slope = np.repeat((1 / (1 + np.exp(-np.clip(odds, -30, 30))) - y) * w / len(y) / chunks, chunks)
            to_top = (slope[:, None] * now.out[None, :]) * (top > 0)
            place = where + (np.arange(len(top)) * CHUNK)[:, None]
            to_vectors, to_filters = np.zeros_like(now.vectors), np.zeros_like(now.filters)
            for k in range(WIDTH):
                seen = flat[place + k]
                for f in range(FILTERS):
                    by_byte = np.bincount(seen[:, f], to_top[:, f], 256)
                    to_filters[k, :, f] = now.vectors.T @ by_byte
                    to_vectors += by_byte[:, None] * now.filters[k, :, f][None, :]
            slopes = [to_vectors, to_filters, (to_top * again[place]).sum(0), to_top.sum(0), (slope[:, None] * hidden).sum(0), np.array([slope.sum()])]
            step += 1
            rate = RATE * (1 - 0.9 * epoch / epochs)
            for x, g, m, v in zip(net, slopes, mean, square, strict=True):
                g = g + 1e-4 * x
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Net(*net)


def held_out(id_col: str | Column = "doc_id") -> Column:
    """Whether a row's label must not be learned from."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit(""))), F.lit(5)) == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Net | float:
    """A net, or the share of label 1 where one label is missing. At most 2 x ``sample`` rows reach the driver."""
    known = labels.select(F.col(id_col).alias("lid"), F.col(label_col).cast("int").alias("label")).where("lid is not null and label in (0, 1)")
    known = known.where(~held_out("lid"))
    order = [F.xxhash64(F.col("lid").cast("string")), F.col("lid"), F.col("label")]
    picked = known.where("label = 1").orderBy(*order).limit(sample).union(known.where("label = 0").orderBy(*order).limit(sample))
    texts = rows_by(docs, id_col, text_col).withColumn("txt", F.coalesce("txt", F.lit("")))
    rows = texts.join(F.broadcast(picked), texts["rid"] == picked["lid"]).select("rid", "label", "txt")
    rows = rows.groupBy("rid", "label").agg(F.min("txt").alias("txt")).toPandas().sort_values(["rid", "label"], kind="stable").reset_index(drop=True)
    share = float(rows["label"].mean()) if len(rows) else 0.5
    if not len(rows) or not 0 < share < 1:
        return share
    return train([t.encode() for t in rows["txt"]], rows["label"].to_numpy(np.int64))


def classify(docs: DataFrame, net: Net | float, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row: id, held_out, score, predicted."""
    source = rows_by(docs, id_col, text_col)
    kind = source.schema["rid"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(net) if isinstance(net, Net) else None
        for batch in batches:
            for lo, hi in K.pieces(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                got = score(net, tables, part.column(1)) if tables else np.full(hi - lo, float(net))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got)], ["rid", "score"])

    scored = source.mapInArrow(work, f"rid {kind}, score double")
    return scored.select(F.col("rid").alias(id_col), held_out("rid").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
