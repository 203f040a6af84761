"""Choosing rows: best of n by rule, strides, shards, samples by hash, greedy picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessel.sources.store import stash


def best_of_n(df: DataFrame, keys: Sequence[str], rule: Sequence[Column], seed: str) -> DataFrame:
    """One row of each key: the greatest by the rule's columns in turn, ties to the least seed."""
    w = W.partitionBy(*keys).orderBy(*[c.desc() for c in rule], F.col(seed))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def guarded(signals: Sequence[str], allowed: frozenset[str]) -> list[Column]:
    """Columns for signals, refused unless they are on the list of those known when choosing."""
    for s in signals:
        if s not in allowed:
            raise ValueError(f"{s} is not known when choosing")
    return [F.col(s) for s in signals]


def ranked(df: DataFrame, order: Sequence[str], name: str = "rank") -> DataFrame:
    """Global ranks from 0 without one task for all rows: range partitions are counted, ranks within them are shifted.

    The partitions' counts (one number each) go to the driver.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stash(parts.withColumn("_p", F.spark_partition_id()), "placed")  # range bounds are sampled anew in each run
    counts = {r["_p"]: r["count"] for r in placed.groupBy("_p").count().collect()}
    before, pairs = 0, []
    for p in sorted(counts):
        pairs += [F.lit(p), F.lit(before)]
        before += counts[p]
    w = W.partitionBy("_p").orderBy(*order)
    shift = F.create_map(*pairs)[F.col("_p")] if pairs else F.lit(0)
    return placed.withColumn(name, (F.row_number().over(w) - 1 + shift).cast("long")).drop("_p")


def hash_fraction(df: DataFrame, id_col: str, fraction: float) -> DataFrame:
    """Rows whose digest, read as a number in [0, 1), is less than the fraction."""
    edge = f"{min(int(fraction * (1 << 64)), (1 << 64) - 1):016x}"
    return df.where(F.substring(F.sha2(F.col(id_col).cast("string"), 256), 1, 16) < edge)


def hash_first(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """The n rows whose digests come first."""
    return df.orderBy(F.sha2(F.col(id_col).cast("string"), 256), id_col).limit(n)


def greedy(df: DataFrame, id_col: str, categories: Sequence[tuple[str, Column, Sequence[Column]]]) -> DataFrame:
    """For each category in turn, the first row by its order that no earlier category took: (category, id).

    One row for each category is brought to the driver, so a category's choice can depend on those before.
    """
    used: list = []
    out = []
    for name, condition, order in categories:
        free = df.where(condition)
        if used:
            free = free.where(~F.col(id_col).isin(used))
        got = free.orderBy(*order, id_col).select(id_col).first()
        if got:
            used.append(got[0])
            out.append((name, got[0]))
    kind = df.schema[id_col].dataType.simpleString()
    return df.sparkSession.createDataFrame(out, f"category string, {id_col} {kind}")
