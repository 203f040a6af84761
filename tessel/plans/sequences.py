"""Queries on ordered data: differences, runs, fills, sessions, intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessel.operators import intervals as iv
from tessel.operators import sequence as sq
from tessel.plans.registry import register
from tessel.sources.tables import read

_EV = "ev AS (SELECT event_id, user_id, event_type, value, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events)"
_UW = "(PARTITION BY user_id ORDER BY t, event_id)"
#: Line numbers repeat within an order, so ties are broken by what tells the rows apart.
_LORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
_LW = f"(PARTITION BY l_orderkey ORDER BY {_LORDER})"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"))


def _lines(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """Line items with the columns that order them."""
    return read(spark, d, "lineitem").select("l_orderkey", *dict.fromkeys([*_L, *more]))


_U, _T = ["user_id"], ["t", "event_id"]
_O, _L = ["l_orderkey"], _LORDER.split(", ")


@register("interval_deltas", "W1", f"""SELECT l_orderkey, l_linenumber, CAST(greatest(-12, least(12, lead(l_quantity) OVER {_LW} - l_quantity)) AS DOUBLE) AS step FROM lineitem""")
def interval_deltas(spark: SparkSession, d: str) -> DataFrame:
    return sq.delta(_lines(spark, d, "l_quantity"), _O, _L, "l_quantity", "step", 12.0).select("l_orderkey", "l_linenumber", "step")


@register("inter_event_gap", "W1", f"WITH {_EV} SELECT event_id, user_id, CASE WHEN lead(t) OVER {_UW} IS NOT NULL THEN least(16 * 3600, lead(t) OVER {_UW} - t) END AS gap FROM ev")
def inter_event_gap(spark: SparkSession, d: str) -> DataFrame:
    return sq.delta(_events(spark, d), _U, _T, "t", "g").select("event_id", "user_id", F.when(F.col("g").isNotNull(), F.least(F.lit(57600).cast("long"), F.col("g"))).alias("gap"))


@register("prefix_sum_offsets", "W2", f"SELECT l_orderkey, l_linenumber, CAST(coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY {_LORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS onset FROM lineitem")
def prefix_sum_offsets(spark: SparkSession, d: str) -> DataFrame:
    return sq.prefix_sum(_lines(spark, d, "l_quantity"), _O, _L, "l_quantity", "onset").select("l_orderkey", "l_linenumber", F.col("onset").cast("double").alias("onset"))


@register("countdown_per_group", "W14", f"SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey) - row_number() OVER {_LW} + 1 AS left_over FROM lineitem")
def countdown_per_group(spark: SparkSession, d: str) -> DataFrame:
    return sq.countdown(_lines(spark, d), _O, _L, "left_over").select("l_orderkey", "l_linenumber", "left_over")


_RUNS = f"""WITH x AS (SELECT *, CASE WHEN l_returnflag IS DISTINCT FROM lag(l_returnflag) OVER {_LW} OR row_number() OVER {_LW} = 1 THEN 1 ELSE 0 END AS new FROM lineitem),
y AS (SELECT *, sum(new) OVER {_LW} AS run FROM x), r AS (SELECT l_orderkey, run, l_returnflag, count(*) AS length FROM y GROUP BY ALL)"""


@register("longest_identical_run", "W3", f"{_RUNS} SELECT l_orderkey, max(length) AS longest FROM r GROUP BY 1")
def longest_identical_run(spark: SparkSession, d: str) -> DataFrame:
    return sq.run_lengths(_lines(spark, d, "l_returnflag"), _O, _L, "l_returnflag").groupBy("l_orderkey").agg(F.max("length").alias("longest"))


@register("run_length_encode", "W10", f"{_RUNS} SELECT l_orderkey, string_agg(l_returnflag || CASE WHEN length > 1 THEN 'x' || length ELSE '' END, ' ' ORDER BY run) AS encoded FROM r GROUP BY 1")
def run_length_encode(spark: SparkSession, d: str) -> DataFrame:
    return sq.run_length_text(_lines(spark, d, "l_returnflag"), _O, _L, "l_returnflag")


@register("seen_before_fraction", "W4 A9", f"""WITH {_EV}, x AS (SELECT user_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) > 1 AS seen FROM ev)
SELECT user_id, round(count(CASE WHEN seen THEN 1 END) / greatest(count(*), 1), 6) AS share FROM x GROUP BY 1""")  # fmt: skip
def seen_before_fraction(spark: SparkSession, d: str) -> DataFrame:
    seen = sq.seen_before(_events(spark, d), _U, _T, "event_type")
    return seen.groupBy("user_id").agg(F.round(F.count_if("seen") / F.greatest(F.count("*"), F.lit(1)), 6).alias("share"))


@register("ngram_repeat_fraction", "W9 A9", f"""WITH {_EV}, g AS (SELECT user_id, event_type || '>' || lead(event_type, 1) OVER w || '>' || lead(event_type, 2) OVER w || '>' || lead(event_type, 3) OVER w AS g
FROM ev WINDOW w AS {_UW}) SELECT user_id, round(1 - count(DISTINCT g) / count(g), 6) AS repeated FROM g GROUP BY 1 HAVING count(g) > 0""")  # fmt: skip
def ngram_repeat_fraction(spark: SparkSession, d: str) -> DataFrame:
    w = sq.by(_U, _T)
    gram = F.concat_ws(">", "event_type", *[F.lead("event_type", i).over(w) for i in (1, 2, 3)])
    g = _events(spark, d).withColumn("g", F.when(F.lead("event_type", 3).over(w).isNotNull(), gram)).where("g is not null")
    return g.groupBy("user_id").agg(F.round(1 - F.count_distinct("g") / F.count("g"), 6).alias("repeated"))


@register("forward_fill_state", "W5 G3", f"WITH {_EV} SELECT event_id, user_id, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS state FROM ev")
def forward_fill_state(spark: SparkSession, d: str) -> DataFrame:
    return sq.forward_fill(_events(spark, d), _U, _T, F.when(F.col("event_type") == "view", F.col("value")), "state").select("event_id", "user_id", "state")


@register("gap_sessions", "W7", f"""WITH {_EV}, x AS (SELECT *, CASE WHEN t - lag(t) OVER {_UW} > 86400 THEN 1 ELSE 0 END AS new FROM ev), y AS (SELECT *, sum(new) OVER {_UW} AS session FROM x)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS events, min(t) AS first_t, max(t) AS last_t FROM y GROUP BY 1, 2""")  # fmt: skip
def gap_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = sq.gap_sessions(_events(spark, d), _U, _T, F.col("t"), F.col("t"), 86400)
    return s.groupBy("user_id", "session").agg(F.count("*").alias("events"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@register("flag_sessions", "W6 S8", f"""WITH {_EV}, x AS (SELECT *, CASE WHEN event_type = 'signup' AND row_number() OVER {_UW} > 1 THEN 1 ELSE 0 END AS new FROM ev), y AS (SELECT *, sum(new) OVER {_UW} AS session FROM x)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS events FROM y GROUP BY 1, 2""")  # fmt: skip
def flag_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = sq.flag_sessions(_events(spark, d), _U, _T, F.col("event_type") == "signup")
    return s.groupBy("user_id", "session").agg(F.count("*").alias("events"))


@register("run_budget", "A21 W6", f"""WITH {_EV}, x AS (SELECT *, CASE WHEN event_type = 'signup' AND row_number() OVER {_UW} > 1 THEN 1 ELSE 0 END AS new FROM ev), y AS (SELECT *, sum(new) OVER {_UW} AS session FROM x),
s AS (SELECT user_id, session, max(t) - min(t) AS span, max(value) AS top FROM y GROUP BY 1, 2) SELECT user_id, count(*) AS segments, round(sum(span) / 3600.0, 6) AS hours, max(top) AS top FROM s GROUP BY 1""")  # fmt: skip
def run_budget(spark: SparkSession, d: str) -> DataFrame:
    s = sq.flag_sessions(_events(spark, d), _U, _T, F.col("event_type") == "signup").groupBy("user_id", "session").agg((F.max("t") - F.min("t")).alias("span"), F.max("value").alias("top"))
    return s.groupBy("user_id").agg(F.count("*").alias("segments"), F.round(F.sum("span") / 3600.0, 6).alias("hours"), F.max("top").alias("top"))


@register("dense_renumber", "W8", f"""WITH x AS (SELECT l_orderkey, l_linenumber, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM lineitem WHERE l_returnflag <> 'N') SELECT l_orderkey, l_linenumber, n FROM x""")
def dense_renumber(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber")
    return _lines(spark, d, "l_returnflag").where("l_returnflag <> 'N'").select("l_orderkey", "l_linenumber", F.dense_rank().over(w).cast("long").alias("n"))


@register("early_vs_late_half", "W15", f"""WITH {_EV}, m AS (SELECT user_id, min(t) AS a, max(t) AS b FROM ev GROUP BY 1)
SELECT user_id, count(CASE WHEN 2 * (t - a) < b - a THEN 1 END) AS early, count(CASE WHEN 2 * (t - a) >= b - a THEN 1 END) AS late,
round(max(CASE WHEN 2 * (t - a) >= b - a THEN value END) - min(CASE WHEN 2 * (t - a) >= b - a THEN value END), 6) AS late_range FROM ev JOIN m USING (user_id) GROUP BY 1""")  # fmt: skip
def early_vs_late_half(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("user_id")
    e = _events(spark, d).withColumn("a", F.min("t").over(w)).withColumn("b", F.max("t").over(w)).withColumn("late", 2 * (F.col("t") - F.col("a")) >= F.col("b") - F.col("a"))
    late = F.when(F.col("late"), F.col("value"))
    return e.groupBy("user_id").agg(F.count_if(~F.col("late")).alias("early"), F.count_if("late").alias("late"), F.round(F.max(late) - F.min(late), 6).alias("late_range"))


@register("change_events", "W20", f"WITH x AS (SELECT l_orderkey, l_linenumber, l_linestatus, lag(l_linestatus) OVER {_LW} AS before FROM lineitem) SELECT l_orderkey, l_linenumber, before, l_linestatus AS status FROM x WHERE before <> l_linestatus")
def change_events(spark: SparkSession, d: str) -> DataFrame:
    x = _lines(spark, d, "l_linestatus").withColumn("before", F.lag("l_linestatus").over(sq.by(_O, _L)))
    return x.where("before <> l_linestatus").select("l_orderkey", "l_linenumber", "before", F.col("l_linestatus").alias("status"))


@register("overlap_count", "W19 W17", f"""WITH {_EV}, x AS (SELECT user_id, t + CAST(floor(value) AS BIGINT) * 600 AS stop, lead(t) OVER {_UW} AS nxt, t FROM ev)
SELECT user_id, count(CASE WHEN stop > nxt THEN 1 END) AS overlaps, CAST(sum(least(stop, coalesce(nxt, stop)) - t) AS BIGINT) AS clamped FROM x GROUP BY 1""")  # fmt: skip
def overlap_count(spark: SparkSession, d: str) -> DataFrame:
    x = _events(spark, d).withColumn("stop", F.col("t") + F.floor("value") * 600).withColumn("nxt", F.lead("t").over(sq.by(_U, _T)))
    return x.groupBy("user_id").agg(F.count_if(F.col("stop") > F.col("nxt")).alias("overlaps"), F.sum(F.least("stop", F.coalesce("nxt", "stop")) - F.col("t")).alias("clamped"))


@register("tiling_check", "W18", f"""WITH x AS (SELECT l_orderkey, l_linenumber, lead(l_linenumber) OVER {_LW} AS nxt FROM lineitem)
SELECT l_orderkey, count(CASE WHEN nxt IS NOT NULL AND nxt <> l_linenumber + 1 THEN 1 END) AS gaps FROM x GROUP BY 1""")  # fmt: skip
def tiling_check(spark: SparkSession, d: str) -> DataFrame:
    x = _lines(spark, d).withColumn("nxt", F.lead("l_linenumber").over(sq.by(_O, _L)))
    return x.groupBy("l_orderkey").agg(F.count_if(F.col("nxt").isNotNull() & (F.col("nxt") != F.col("l_linenumber") + 1)).alias("gaps"))


_VIEWS = "v AS (SELECT user_id, t, max(event_id) AS event_id FROM ev WHERE event_type = 'view' GROUP BY 1, 2)"


@register("asof_last_view_per_click", "J3 J2", f"""WITH {_EV}, {_VIEWS}, j AS (SELECT c.event_id, c.user_id, c.t, v.t AS last_t, v.event_id AS last_view FROM ev c ASOF LEFT JOIN v ON c.user_id = v.user_id AND c.t >= v.t WHERE c.event_type = 'click')
SELECT event_id, user_id, t, CASE WHEN t < last_t + 86400 THEN last_view END AS last_view FROM j""")  # fmt: skip
def asof_last_view_per_click(spark: SparkSession, d: str) -> DataFrame:
    ev = _events(spark, d)
    clicks, views = ev.where("event_type = 'click'").select("user_id", "t", "event_id"), ev.where("event_type = 'view'").select("user_id", "t", F.col("event_id").alias("view"))
    found = iv.asof_backward(clicks, views, _U, "t", ["view"])
    return found.select("event_id", "user_id", "t", F.when(F.col("t") < F.col("last_t") + 86400, F.col("last_view")).alias("last_view"))


@register("range_join_bucketed", "J4", f"""WITH {_EV} SELECT v.event_id AS span_id, count(*) AS inside FROM ev v JOIN ev c ON v.user_id = c.user_id AND c.t >= v.t AND c.t < v.t + 43200
WHERE v.event_type = 'view' AND c.event_type <> 'view' GROUP BY 1""")  # fmt: skip
def range_join_bucketed(spark: SparkSession, d: str) -> DataFrame:
    ev = _events(spark, d)
    spans = ev.where("event_type = 'view'").select("user_id", F.col("event_id").alias("span_id"), F.col("t").alias("a"), (F.col("t") + 43200).alias("b"))
    points = ev.where("event_type <> 'view'").select("user_id", "t")
    return iv.range_join(points, spans, _U, "t", "a", "b", 43200).groupBy("span_id").agg(F.count("*").alias("inside"))


@register("interval_split_equal_parts", "G7", """WITH x AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS n FROM lineitem), p AS (SELECT *, least(greatest(CAST(ceil(n / 12.0) AS BIGINT), 1), n) AS parts FROM x),
e AS (SELECT *, unnest(range(0, parts)) AS part FROM p)
SELECT l_orderkey, l_linenumber, part, parts, CAST(round_even(part * n / parts, 0) AS BIGINT) AS first, CAST(round_even((part + 1) * n / parts, 0) - round_even(part * n / parts, 0) AS BIGINT) AS units FROM e""")  # fmt: skip
def interval_split_equal_parts(spark: SparkSession, d: str) -> DataFrame:
    x = _lines(spark, d, "l_quantity").withColumn("n", F.col("l_quantity").cast("long")).withColumn("zero", F.lit(0).cast("long"))
    return iv.split_equal(x, "zero", "n", "n", 12.0).select("l_orderkey", "l_linenumber", "part", "parts", "first", "units")


@register("event_sweep_deltas", "G9 O1 K7", f"""WITH {_EV}, e AS (SELECT user_id, event_id, t AS "at", 1 AS "on" FROM ev WHERE event_type = 'view' UNION ALL SELECT user_id, event_id, t + 3600, 0 FROM ev WHERE event_type = 'view')
SELECT user_id, event_id, "at", "on", "at" - coalesce(lag("at") OVER w, 0) AS since, row_number() OVER w AS seq FROM e WINDOW w AS (PARTITION BY user_id ORDER BY "at", "on", event_id)""")  # fmt: skip
def event_sweep_deltas(spark: SparkSession, d: str) -> DataFrame:
    x = _events(spark, d).where("event_type = 'view'").select("user_id", "event_id", F.col("t").alias("a"), (F.col("t") + 3600).alias("b"))
    return iv.sweep(x, _U, "a", "b").select("user_id", "event_id", "at", "on", "since", "seq")


@register("normalize_segments", "G6", f"""WITH {_EV}, m AS (SELECT user_id, max(t) AS total FROM ev GROUP BY 1), one AS (SELECT user_id, t, arg_max(event_type, event_id) AS s FROM ev JOIN m USING (user_id) WHERE t < total GROUP BY 1, 2),
k AS (SELECT *, lag(s) OVER (PARTITION BY user_id ORDER BY t) AS b FROM one), kept AS (SELECT * FROM k WHERE b IS NULL OR b <> s)
SELECT user_id, t, s AS event_type, coalesce(lead(t) OVER (PARTITION BY user_id ORDER BY t), total) - t AS duration FROM kept JOIN m USING (user_id)""")  # fmt: skip
def normalize_segments(spark: SparkSession, d: str) -> DataFrame:
    ev = _events(spark, d).withColumn("total", F.max("t").over(W.partitionBy("user_id")))
    return iv.normalize(ev, _U, "t", "event_type", F.col("total"), "event_id")


@register("boundary_crossing_classes", "J19 A12 A13 G4", f"""WITH {_EV}, b AS (SELECT unnest(range(1, 5)) AS boundary), x AS (SELECT user_id, event_type, boundary, 1704067200 + boundary * 518400 AS cut, t FROM ev CROSS JOIN b),
s AS (SELECT user_id, event_type, boundary, count(CASE WHEN t < cut THEN 1 END) AS before, count(CASE WHEN t >= cut THEN 1 END) AS after, min(CASE WHEN t < cut THEN t END) >= any_value(cut) - 518400 AS near FROM x GROUP BY 1, 2, 3),
k AS (SELECT CASE WHEN near AND before < after AND (before <= 2 OR before * 2 < after) THEN 'pickup' WHEN after < before THEN 'tail' ELSE 'head_or_mid' END AS kind, least(before, after) <= 3 AND 3 * least(before, after) <= before + after AS repairable
FROM s WHERE before > 0 AND after > 0) SELECT kind, count(*) AS crossings, count(CASE WHEN repairable THEN 1 END) AS repairable FROM k GROUP BY 1""")  # fmt: skip
def boundary_crossing_classes(spark: SparkSession, d: str) -> DataFrame:
    x = _events(spark, d).withColumn("boundary", F.explode(F.sequence(F.lit(1), F.lit(4)))).withColumn("cut", F.lit(1704067200) + F.col("boundary") * 518400)
    early = F.col("t") < F.col("cut")
    s = x.groupBy("user_id", "event_type", "boundary").agg(F.count_if(early).alias("before"), F.count_if(~early).alias("after"), (F.min(F.when(early, F.col("t"))) >= F.max("cut") - 518400).alias("near"))
    s = s.where("before > 0 and after > 0")
    kind = F.when(F.expr("near AND before < after AND (before <= 2 OR before * 2 < after)"), "pickup").when(F.expr("after < before"), "tail").otherwise("head_or_mid")
    ok = F.expr("least(before, after) <= 3 AND 3 * least(before, after) <= before + after")
    return s.select(kind.alias("kind"), ok.alias("ok")).groupBy("kind").agg(F.count("*").alias("crossings"), F.count_if("ok").alias("repairable"))


@register("same_label_pairs", "J8", f"""{_RUNS} SELECT a.l_orderkey, a.l_returnflag AS label, a.run AS i, b.run AS j, a.length = b.length AS same_length FROM r a JOIN r b ON a.l_orderkey = b.l_orderkey AND a.l_returnflag = b.l_returnflag AND a.run < b.run""".replace("a.run AS i, b.run AS j", "CAST(a.run AS BIGINT) AS i, CAST(b.run AS BIGINT) AS j"))
def same_label_pairs(spark: SparkSession, d: str) -> DataFrame:
    r = sq.run_lengths(_lines(spark, d, "l_returnflag"), _O, _L, "l_returnflag")
    a, b = r.toDF("l_orderkey", "i", "label", "na"), r.toDF("l_orderkey", "j", "label", "nb")
    return a.join(b, ["l_orderkey", "label"]).where("i < j").select("l_orderkey", "label", "i", "j", (F.col("na") == F.col("nb")).alias("same_length"))


@register("cross_label_pairs", "J9", f"""{_RUNS} SELECT a.l_orderkey, count(*) AS pairs FROM r a JOIN r b ON a.l_orderkey = b.l_orderkey AND a.run < b.run AND a.l_returnflag <> b.l_returnflag
WHERE a.l_returnflag IN ('A', 'R') AND b.l_returnflag IN ('A', 'R') GROUP BY 1""")  # fmt: skip
def cross_label_pairs(spark: SparkSession, d: str) -> DataFrame:
    r = sq.run_lengths(_lines(spark, d, "l_returnflag"), _O, _L, "l_returnflag").where("l_returnflag IN ('A', 'R')")
    a, b = r.toDF("l_orderkey", "i", "la", "na"), r.toDF("l_orderkey", "j", "lb", "nb")
    return a.join(b, "l_orderkey").where("i < j AND la <> lb").groupBy("l_orderkey").agg(F.count("*").alias("pairs"))


@register("first_vs_later_overlap", "J10 U6", f"""WITH {_EV}, x AS (SELECT user_id, t // 604800 AS week, list_distinct(list(event_type)) AS types FROM ev GROUP BY 1, 2), f AS (SELECT user_id, min(week) AS first FROM x GROUP BY 1)
SELECT a.user_id, b.week, round(len(list_intersect(a.types, b.types)) / len(a.types), 6) AS kept FROM f JOIN x a ON a.user_id = f.user_id AND a.week = f.first JOIN x b ON b.user_id = a.user_id AND b.week > a.week""")  # fmt: skip
def first_vs_later_overlap(spark: SparkSession, d: str) -> DataFrame:
    x = _events(spark, d).groupBy("user_id", F.floor(F.col("t") / 604800).alias("week")).agg(F.collect_set("event_type").alias("types"))
    x = x.withColumn("base", F.first("types").over(W.partitionBy("user_id").orderBy("week"))).withColumn("n", F.row_number().over(W.partitionBy("user_id").orderBy("week")))
    return x.where("n > 1").select("user_id", "week", F.round(F.size(F.array_intersect("base", "types")) / F.size("base"), 6).alias("kept"))


@register("bar_signatures", "W16", """SELECT l_orderkey, array_to_string(list(l_quantity::BIGINT ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice), ',') AS signature FROM lineitem GROUP BY 1""")
def bar_signatures(spark: SparkSession, d: str) -> DataFrame:
    x = _lines(spark, d, "l_quantity").withColumn("q", F.col("l_quantity").cast("long").cast("string"))
    return x.groupBy("l_orderkey").agg(F.array_join(sq.ordered_list(_L, "q"), ",").alias("signature"))


@register("monotone_cleanup", "P6 W17", f"""WITH {_EV}, one AS (SELECT user_id, t, min_by(event_id, event_id) AS event_id, arg_min(value, event_id) AS value FROM ev GROUP BY 1, 2)
SELECT user_id, event_id, t, least(t + greatest(CAST(floor(value) AS BIGINT), 1) * 600, coalesce(lead(t) OVER (PARTITION BY user_id ORDER BY t), 9999999999)) AS stop FROM one""")  # fmt: skip
def monotone_cleanup(spark: SparkSession, d: str) -> DataFrame:
    one = _events(spark, d).groupBy("user_id", "t").agg(F.min(F.struct("event_id", "value")).alias("e"))
    w = W.partitionBy("user_id").orderBy("t")
    end = F.col("t") + F.greatest(F.floor("e.value"), F.lit(1)) * 600
    return one.select("user_id", F.col("e.event_id").alias("event_id"), "t", F.least(end, F.coalesce(F.lead("t").over(w), F.lit(9999999999))).alias("stop"))
