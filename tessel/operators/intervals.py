"""As-of and half-open interval joins, splitting, sweeping and tidying of intervals.

The planner has no as-of join and takes a nested loop for a range condition alone. The forms here need one shuffle on the
keys: as-of joins are a union and a fill, range joins meet in buckets of time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, values: Sequence[str], prefix: str = "last_") -> DataFrame:
    """Each left row with the values of the latest right row at or before its time (null if none), left columns kept.

    Right rows at equal times: the one with the greatest values wins.
    """
    kept = [c for c in left.columns if c not in keys]
    a = left.select(*keys, F.col(time).alias("_t"), F.lit(1).alias("_side"), F.struct(*kept).alias("_row"), F.lit(None).alias("_new"))
    b = right.select(*keys, F.col(time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).alias("_row"), F.struct(F.col(time).alias(time), *values).alias("_new"))
    w = W.partitionBy(*keys).orderBy("_t", "_side", "_new").rowsBetween(W.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_found", F.last("_new", ignorenulls=True).over(w)).where("_side = 1")
    return both.select(*keys, "_row.*", F.col(f"_found.{time}").alias(prefix + time), *[F.col(f"_found.{v}").alias(prefix + v) for v in values])


def range_join(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, start: str, end: str, width: int, how: str = "inner") -> DataFrame:
    """Points in half-open spans [start, end) of the same key. ``width``: a bucket's, in the units of the columns.

    A span is sent to each bucket it touches; choose a width near the spans' lengths.
    """
    p = points.withColumn("_bucket", F.floor(F.col(at) / width))
    s = spans.where(F.col(end) > F.col(start)).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    inside = (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))
    if how == "inner":
        return p.join(s, [*keys, "_bucket"]).where(inside).drop("_bucket")
    s = s.toDF(*[f"_s_{c}" if c in (*keys, "_bucket") else c for c in s.columns])
    on = inside & (p["_bucket"] == s["_s__bucket"])
    for k in keys:
        on = on & (p[k] == s[f"_s_{k}"])
    return p.join(s, on, how).drop("_bucket", *[c for c in s.columns if c.startswith("_s_")])


def split_equal(df: DataFrame, start: str, count: str, span: str, most: float) -> DataFrame:
    """Cuts a run of ``count`` units into the fewest near-equal parts whose ``span`` is within ``most``: part, parts, first, units.

    Part k starts at start + round-half-even(k * count / parts).
    """
    parts = F.least(F.greatest(F.ceil(F.col(span) / most), F.lit(1)), F.col(count)).cast("long")
    df = df.withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cut = lambda k: F.bround(k * F.col(count) / F.col("parts"), 0).cast("long")
    return df.withColumn("first", F.col(start) + cut(F.col("part"))).withColumn("units", cut(F.col("part") + 1) - cut(F.col("part")))


def sweep(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Interval ends as events in time order, offs before ons at one time, with the time since the previous event."""
    kind = F.explode(F.array(F.struct(F.col(end).alias("at"), F.lit(0).alias("on")), F.struct(F.col(start).alias("at"), F.lit(1).alias("on"))))
    events = df.withColumn("_e", kind).select(*keys, *[c for c in df.columns if c not in (*keys, start, end)], "_e.at", "_e.on")
    rest = [c for c in events.columns if c not in (*keys, "at", "on")]
    w = W.partitionBy(*keys).orderBy("at", "on", *rest)
    return events.withColumn("since", F.col("at") - F.coalesce(F.lag("at").over(w), F.lit(0))).withColumn("seq", F.row_number().over(w).cast("long"))


def normalize(df: DataFrame, keys: Sequence[str], at: str, symbol: str, total: Column, order: str) -> DataFrame:
    """Change events that tile [first, total): the last of equal times wins, equal neighbours merge, each lasts to the next."""
    w = W.partitionBy(*keys, "_at").orderBy(F.col(order).desc())
    df = df.withColumn("_at", F.greatest(F.col(at), F.lit(0))).withColumn("_total", total).where(F.col(at) < F.col("_total"))
    one = df.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    line = W.partitionBy(*keys).orderBy("_at")
    kept = one.withColumn("_before", F.lag(symbol).over(line)).where(F.col("_before").isNull() | (F.col("_before") != F.col(symbol)))
    end = F.coalesce(F.lead("_at").over(line), F.col("_total"))
    return kept.withColumn("duration", end - F.col("_at")).where("duration > 0").select(*keys, F.col("_at").alias(at), symbol, "duration")
