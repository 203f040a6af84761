"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Rows lie in input partitions. How many rows each partition sends to each shard is drawn exactly: a binary tree over the
partitions splits the shards' sizes by multivariate hypergeometric draws, each seeded by its node, so every task finds its
own row of the matrix (one number for each shard) in log2(partitions) draws and the driver never holds the matrix. Each
partition deals its rows out by a seeded permutation. After the exchange each shard is permuted again: rows are ordered by a
seeded hash of their place, in ranges of the hash of about ``block`` rows each, whose counts give each range its first slot.
All orders of all rows are equally likely, sizes of shards differ by one row at most (law ``rows``).

At scale: no task holds more than its partition's rows or a range's; of all ranges (one for ``block`` rows) only the counts
are added up, for each shard in one window.

Recovery: rows are first written with their partition and place, so a task that runs again sees the same rows and seeds.

Defined cases: nulls in any column are kept as they are; equal rows are rows of their own; an empty table gives an empty
result; an input column that is named like an added one (whatever the case of its letters) comes back with underscores
behind its name, as many as it takes to be free.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessel.sources.store import stash

#: Rows of a range that is put in order at once, on average.
BLOCK = 16_384


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """Exact draw; numpy's refuses populations from a thousand million on, so those go by Stadlober's ratio of uniforms."""
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, sample))
    if not good or not sample:
        return 0
    lg, total = math.lgamma, good + bad
    low, high, m = min(good, bad), max(good, bad), min(sample, total - sample)
    p = low / total
    centre = m * p + 0.5
    spread = math.sqrt((total - m) * m * p * (1 - p) / (total - 1) + 0.5)
    width = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
    mode = (m + 1) * (low + 1) // (total + 2)
    top = lg(mode + 1) + lg(low - mode + 1) + lg(m - mode + 1) + lg(high - m + mode + 1)
    most = min(min(m, low) + 1.0, math.floor(centre + 16 * spread))
    while True:
        u, v = 1.0 - rng.random(), rng.random()
        z = centre + width * (v - 0.5) / u
        if not 0 <= z < most:
            continue
        k = int(z)
        if 2 * math.log(u) <= top - (lg(k + 1) + lg(low - k + 1) + lg(m - k + 1) + lg(high - m + k + 1)):
            break
    k = k if good <= bad else m - k
    return k if m == sample else good - k


def split_counts(rng: np.random.Generator, sizes: np.ndarray, sample: int) -> np.ndarray:
    """Multivariate hypergeometric: how many of ``sample`` rows fall into each shard."""
    if sizes.sum() < 1_000_000_000:
        return rng.multivariate_hypergeometric(sizes, sample, method="marginals")
    out, rest = np.zeros_like(sizes), int(sizes.sum())
    for i, size in enumerate(sizes.tolist()):
        out[i] = hypergeometric(rng, size, rest - size, sample) if sample else 0
        rest, sample = rest - size, sample - int(out[i])
    return out


def matrix_row(before: np.ndarray, sizes: np.ndarray, part: int, seed: int) -> np.ndarray:
    """Row ``part`` of the matrix; ``before`` has the rows before each partition, and all rows at its end."""
    lo, hi = 0, len(before) - 1
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        left = split_counts(rng, sizes, int(before[mid] - before[lo]))
        lo, hi, sizes = (lo, mid, left) if part < mid else (mid, hi, sizes - left)
    return sizes


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Equal sizes, the first shards one row larger where rows are left over."""
    return np.array([rows // shards + (s < rows % shards) for s in range(shards)], np.int64)


def free_names(names: list[str], taken: tuple[str, ...]) -> list[str]:
    """``names`` with underscores behind those that are in ``taken``, so that no two are alike."""
    used = {x.lower() for x in (*names, *taken)}
    out = []
    for name in names:
        if name.lower() in taken:
            while name.lower() in used:
                name += "_"
            used.add(name.lower())
        out.append(name)
    return out


def shuffle_shards(df: DataFrame, shards: int = 8, seed: int = 20240607, block: int = BLOCK) -> DataFrame:
    """All rows and columns of ``df`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard)."""
    names = [f"c{i}" for i in range(len(df.columns))]
    placed = df.toDF(*names).withColumn("pid", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    rows = stash(placed, "placed")
    counts = rows.groupBy("pid").count().orderBy("pid").collect()  # one number for each input partition
    before = np.concatenate([[0], np.cumsum([r["count"] for r in counts])]).astype(np.int64)
    sizes = shard_sizes(int(before[-1]), shards)
    shared = df.sparkSession.sparkContext.broadcast((before, np.array([r["pid"] for r in counts], np.int64)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, pids = shared.value

        @lru_cache(2)
        def targets(part: int) -> np.ndarray:
            row = matrix_row(before, sizes, part, seed)
            order = np.random.default_rng([seed, part]).permutation(int(row.sum()))
            return np.repeat(np.arange(shards, dtype=np.int32), row)[order]

        for batch in batches:
            pid, at = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            to = np.zeros(len(pid), np.int32)
            for p in np.unique(pid).tolist():
                own = pid == p
                to[own] = targets(int(np.searchsorted(pids, p)))[at[own]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(to)], [*batch.schema.names, "shard"])

    def dealt(columns: list[str]) -> DataFrame:
        slim = rows.select("pid", "at", *columns)
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields)
        place = F.xxhash64(F.lit(seed), "pid", "at")
        ranges = max(1, -(-int(sizes.max()) // block))
        # The hash's upper 31 bits, spread evenly over the ranges: rows of a lower range have lower hashes.
        upper = F.shiftright(place, 33) + F.lit(1 << 30)
        return slim.mapInArrow(deal, f"{kinds}, shard int").withColumn("order", place).withColumn("range", F.shiftright(upper * F.lit(ranges), 31))

    # Dealing is a function of a row's place, so the counts are taken from the places alone.
    per = dealt([]).groupBy("shard", "range").agg(F.count("*").alias("n"))
    whole = W.partitionBy("shard").orderBy("range")
    first = per.select("shard", "range", (F.sum("n").over(whole) - F.col("n")).alias("first"))
    sent = dealt(names).join(first, ["shard", "range"])
    slot = F.col("first") + F.row_number().over(W.partitionBy("shard", "range").orderBy("order", "pid", "at")) - 1
    back = free_names(df.columns, ("shard", "slot"))
    return sent.withColumn("slot", slot).select(*[F.col(n).alias(c) for n, c in zip(names, back, strict=True)], "shard", "slot")
