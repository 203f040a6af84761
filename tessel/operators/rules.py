"""Named predicates: which rules a row fails, the first reason to exclude it, quarantine of bad rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rules = dict[str, Column]


def failed(rules: Rules) -> Column:
    """Names of the rules that a row does not meet, in the rules' order; a null condition counts as not met."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))


def first_reason(reasons: Rules) -> Column:
    """The first reason that holds, null if none does."""
    out = F.lit(None).cast("string")
    for name, holds in reversed(reasons.items()):
        out = F.when(F.coalesce(holds, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def quarantine(df: DataFrame, reasons: Rules) -> tuple[DataFrame, DataFrame]:
    """Rows without a reason, and rows with one (column ``reason``)."""
    marked = df.withColumn("reason", first_reason(reasons))
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def failure_counts(df: DataFrame, rules: Rules) -> DataFrame:
    """(rule, failures), rules that nothing fails included."""
    counts = [F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()]
    wide = df.agg(*counts)
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("failures")) for name in rules])).alias("p")
    return wide.select(pairs).select("p.*")
