"""Evaluation statistics: percentiles by index, closed histograms, divergences, bootstrap intervals, paired differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def at_index(sorted_values: Column, index: Column) -> Column:
    """Value at a 0-based index."""
    return F.get(sorted_values, index.cast("int"))


def index_percentile(sorted_values: Column, q: float) -> Column:
    """Value at int(q (n - 1))."""
    return at_index(sorted_values, F.floor(F.lit(q) * (F.size(sorted_values) - 1)))


def count_percentile(sorted_values: Column, q: float) -> Column:
    """Value at min(int(q n), n - 1)."""
    n = F.size(sorted_values)
    return at_index(sorted_values, F.least(F.floor(F.lit(q) * n), n - 1))


def upper_median(sorted_values: Column) -> Column:
    return at_index(sorted_values, F.floor(F.size(sorted_values) / 2))


def ranked(df: DataFrame, keys: list[str], value: str, picks: dict[str, Column]) -> DataFrame:
    """Values at given ranks of each key without gathering a key's values: counts of equal values, then running counts.

    picks: name to a 0-based rank, as an expression over ``n`` (the key's number of values). Nulls and NaNs are left out.
    """
    from pyspark.sql import Window as W

    real = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    counts = real.groupBy(*keys, value).agg(F.count("*").alias("_c"), F.sum(value).alias("_s"))
    w = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    run = counts.withColumn("_upto", F.sum("_c").over(w.orderBy(value))).withColumn("n", F.sum("_c").over(w))
    hit = lambda rank: F.max(F.when((F.col("_upto") > rank) & (F.col("_upto") - F.col("_c") <= rank), F.col(value)))
    return run.groupBy(*keys).agg(F.max("n").alias("n"), (F.sum("_s") / F.sum("_c")).alias("mean"), *[hit(r).alias(name) for name, r in picks.items()])


def index_rank(q: float) -> Column:
    return F.floor(F.lit(q) * (F.col("n") - 1))


def count_rank(q: float) -> Column:
    return F.least(F.floor(F.lit(q) * F.col("n")), F.col("n") - 1)


def summary(long: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    """(metric, n, mean, median, p05, p95) by index, nulls and NaNs left out; metrics without values are absent."""
    return ranked(long, [metric], value, {"median": F.floor(F.col("n") / 2), "p05": index_rank(0.05), "p95": index_rank(0.95)})


def histogram(df: DataFrame, group: list[str], value: str, domain: DataFrame) -> DataFrame:
    """Shares of a closed domain (column ``key``) in each group: (group.., key, share); values outside are not counted."""
    counts = df.groupBy(*group, F.col(value).alias("key")).agg(F.count("*").alias("c"))
    inside = counts.join(domain, "key", "left_semi")
    totals = inside.groupBy(*group).agg(F.sum("c").alias("total"))
    full = totals.join(domain) if not group else df.select(*group).distinct().join(domain).join(totals, group, "left")
    joined = full.join(inside, [*group, "key"], "left")
    return joined.select(*group, "key", F.when(F.coalesce("total", F.lit(0)) > 0, F.coalesce("c", F.lit(0)) / F.col("total")).otherwise(0.0).alias("share"))


def js_divergence(p: str, q: str) -> Column:
    """Aggregate over a joined domain: Jensen-Shannon divergence in bits; null if a side is empty."""
    a, b = F.col(p), F.col(q)
    m = (a + b) / 2
    part = lambda x: F.sum(F.when(x > 0, x * F.log2(x / m)).otherwise(0.0))
    return F.when((F.sum(a) > 0) & (F.sum(b) > 0), 0.5 * part(a) + 0.5 * part(b))


def draw(rep: Column, at: Column, size: Column) -> Column:
    """A draw's index in [0, size) from a digest of its numbers: the same in every engine."""
    hex_ = F.substring(F.sha2(F.concat_ws(":", rep.cast("string"), at.cast("string")), 256), 1, 8)
    return F.pmod(F.conv(hex_, 16, 10).cast("long"), size)


def bootstrap(df: DataFrame, group: list[str], value: str, order: list[str], reps: int) -> DataFrame:
    """(group.., n, mean, lo, hi): interval of the mean over ``reps`` resamples, at indices int(.025 reps), int(.975 reps).

    Each row's values are looked up by rank, so resampling is one join on (group, rank) and two aggregations.
    """
    from pyspark.sql import Window as W

    w = W.partitionBy(*group)
    ranked_ = df.where(F.col(value).isNotNull()).withColumn("at", F.row_number().over(w.orderBy(*order)) - 1).withColumn("n", F.count("*").over(w)).select(*group, "at", "n", F.col(value).alias("v"))
    draws = ranked_.select(*group, "n", F.col("at").alias("i")).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    draws = draws.withColumn("at", draw(F.col("rep"), F.col("i"), F.col("n")).cast("int"))
    means = draws.join(ranked_.drop("n"), [*group, "at"]).groupBy(*group, "rep").agg(F.avg("v").alias("m"))
    ends = means.groupBy(*group).agg(F.array_sort(F.collect_list("m")).alias("ms"))  # ``reps`` numbers for each group
    base = ranked_.groupBy(*group).agg(F.count("*").alias("n"), F.avg("v").alias("mean"))
    lo, hi = at_index(F.col("ms"), F.lit(int(0.025 * reps))), at_index(F.col("ms"), F.lit(int(0.975 * reps)))
    return base.join(ends, group).select(*group, "n", "mean", lo.alias("lo"), hi.alias("hi"))
