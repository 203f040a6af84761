"""Ordered data: differences, runs, fills, sessions, n-grams, samples by rank.

All functions take a DataFrame, key columns and an order; the order should be total, or equal rows may swap. Each is one
window over the keys, so several in a row share one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Cols = Sequence[str]


def by(keys: Cols, order: Cols) -> WindowSpec:
    return W.partitionBy(*keys).orderBy(*order)


def clipped(value: Column, most: float) -> Column:
    return F.greatest(F.lit(-most), F.least(F.lit(most), value))


def delta(df: DataFrame, keys: Cols, order: Cols, value: str, name: str, most: float | None = None) -> DataFrame:
    """Next value less this one, clipped to +-most; null on the last row."""
    d = F.lead(value).over(by(keys, order)) - F.col(value)
    return df.withColumn(name, d if most is None else clipped(d, most))


def prefix_sum(df: DataFrame, keys: Cols, order: Cols, value: str, name: str) -> DataFrame:
    """Sum of all rows before this one."""
    w = by(keys, order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)))


def changed(keys: Cols, order: Cols, value: str) -> Column:
    """Whether a row's value differs from the previous row's; true on the first."""
    previous = F.lag(value).over(by(keys, order))
    first = F.row_number().over(by(keys, order)) == 1
    return first | ~F.col(value).eqNullSafe(previous)


def runs(df: DataFrame, keys: Cols, order: Cols, value: str, name: str = "run") -> DataFrame:
    """Numbers runs of equal values, from 1 on (gaps and islands)."""
    return df.withColumn("_new", changed(keys, order, value).cast("int")).withColumn(name, F.sum("_new").over(by(keys, order)).cast("long")).drop("_new")


def run_lengths(df: DataFrame, keys: Cols, order: Cols, value: str) -> DataFrame:
    """One row for each run: keys, run, value, length."""
    return runs(df, keys, order, value).groupBy(*keys, "run", value).agg(F.count("*").alias("length"))


def run_length_text(df: DataFrame, keys: Cols, order: Cols, value: str, name: str = "encoded") -> DataFrame:
    """Runs of each key as text, such as ``4x6 2 4x6``."""
    part = F.concat(F.col(value).cast("string"), F.when(F.col("length") > 1, F.concat(F.lit("x"), F.col("length").cast("string"))).otherwise(""))
    sorted_ = F.array_sort(F.collect_list(F.struct("run", part.alias("p"))))
    return run_lengths(df, keys, order, value).groupBy(*keys).agg(F.array_join(F.transform(sorted_, lambda x: x["p"]), " ").alias(name))


def forward_fill(df: DataFrame, keys: Cols, order: Cols, value: Column | str, name: str) -> DataFrame:
    """The latest value that is not null, this row's included."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(by(keys, order).rowsBetween(W.unboundedPreceding, 0)))


def flag_sessions(df: DataFrame, keys: Cols, order: Cols, flag: Column, name: str = "session") -> DataFrame:
    """A flagged row opens a session, but for a key's first row, which opens session 0 anyway."""
    w = by(keys, order)
    opens = (flag & (F.row_number().over(w) > 1)).cast("int")
    return df.withColumn("_open", opens).withColumn(name, F.sum("_open").over(w).cast("long")).drop("_open")


def gap_sessions(df: DataFrame, keys: Cols, order: Cols, start: Column, end: Column, gap: float, name: str = "session") -> DataFrame:
    """A row that starts more than ``gap`` behind the previous row's end opens a session."""
    w = by(keys, order)
    df = df.withColumn("_s", start).withColumn("_e", end)
    opens = F.coalesce((F.col("_s") - F.lag("_e").over(w) > gap).cast("int"), F.lit(0))
    return df.withColumn("_open", opens).withColumn(name, F.sum("_open").over(w).cast("long")).drop("_s", "_e", "_open")


def ngrams(items: Column, n: int) -> Column:
    """Windows of n neighbours as arrays; none if there are fewer than n."""
    return F.when(F.size(items) >= n, F.transform(F.sequence(F.lit(1), F.size(items) - (n - 1)), lambda i: F.slice(items, i, n))).otherwise(F.array().cast("array<array<string>>"))


def seen_before(df: DataFrame, keys: Cols, order: Cols, value: str, name: str = "seen") -> DataFrame:
    return df.withColumn(name, F.row_number().over(by([*keys, value], order)) > 1)


def countdown(df: DataFrame, keys: Cols, order: Cols, name: str = "left") -> DataFrame:
    """Rows from this one to the key's last, this one included."""
    return df.withColumn(name, (F.count("*").over(W.partitionBy(*keys)) - F.row_number().over(by(keys, order)) + 1).cast("long"))


def ordered_list(order: Cols, value: str) -> Column:
    """Aggregate: values in the given order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v")))), lambda x: x["_v"])


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays, for short arrays: one row of the table is kept."""
    zero = F.transform(F.concat(F.array(F.lit(0)), F.transform(b, lambda _: F.lit(0))), lambda x: x)

    def step(row: Column, x: Column) -> Column:
        nothing = F.array(F.lit(0))
        return F.aggregate(
            F.sequence(F.lit(1), F.size(b)), nothing,
            lambda out, j: F.concat(out, F.array(F.when(F.get(b, j - 1) == x, F.get(row, j - 1) + 1).otherwise(F.greatest(F.get(row, j), F.element_at(out, -1))))),
        )

    table = F.aggregate(a, zero, step)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0)).otherwise(F.element_at(table, -1))
