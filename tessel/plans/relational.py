"""Queries beyond the reference's own operators: joins of all kinds, grouping sets, frames, dates, JSON, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessel.plans.registry import register
from tessel.sources.tables import read
from tessel.streaming import events as st

_YEAR = "year(o_orderdate)"


@register("pricing_summary", "A11 [X]", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")  # fmt: skip
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02'")
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 4).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@register("join_chain", "J1 J13", """SELECT r_name, n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE o_orderstatus = 'F' GROUP BY 1, 2""")  # fmt: skip
def join_chain(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").where("o_orderstatus = 'F'").select("o_custkey", "o_totalprice")
    c, n, r = read(spark, d, "customer").select("c_custkey", "c_nationkey"), read(spark, d, "nation"), read(spark, d, "region")
    x = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return x.groupBy("r_name", "n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@register("semi_anti_joins", "S6 S7 F5", """SELECT 'with' AS kind, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'without', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def semi_anti_joins(spark: SparkSession, d: str) -> DataFrame:
    c, o = read(spark, d, "customer").select("c_custkey"), read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    side = lambda kind, how: c.join(o, "c_custkey", how).agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return side("with", "left_semi").unionByName(side("without", "left_anti"))


@register("outer_joins", "[X] full, right, null-safe", """WITH a AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_nationkey END AS k, count(*) AS n FROM supplier GROUP BY 1), b AS (SELECT CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_nationkey END AS k, count(*) AS m FROM customer GROUP BY 1)
SELECT 'full' AS kind, count(*) AS n, count(a.n) AS l, count(b.m) AS r FROM a FULL JOIN b ON a.k = b.k UNION ALL SELECT 'right', count(*), count(a.n), count(b.m) FROM a RIGHT JOIN b ON a.k = b.k
UNION ALL SELECT 'nullsafe', count(*), count(a.n), count(b.m) FROM a JOIN b ON a.k IS NOT DISTINCT FROM b.k""")  # fmt: skip
def outer_joins(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "supplier").groupBy(F.when(F.col("s_suppkey") % 3 != 0, F.col("s_nationkey")).alias("k")).agg(F.count("*").alias("n"))
    b = read(spark, d, "customer").groupBy(F.when(F.col("c_custkey") % 4 != 0, F.col("c_nationkey")).alias("j")).agg(F.count("*").alias("m"))
    line = lambda kind, on, how: a.join(b, on, how).agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.count("n").alias("l"), F.count("m").alias("r"))
    return line("full", F.col("k") == F.col("j"), "full").unionByName(line("right", F.col("k") == F.col("j"), "right")).unionByName(line("nullsafe", F.col("k").eqNullSafe(F.col("j")), "inner"))


@register("set_operations", "U1 U2 U4", """SELECT (SELECT count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)) AS both_sides, (SELECT count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)) AS only_left,
(SELECT count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)) AS either, (SELECT count(*) FROM (SELECT c_nationkey FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier)) AS only_left_all""")  # fmt: skip
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    a, b = read(spark, d, "customer").select("c_nationkey"), read(spark, d, "supplier").select("s_nationkey")
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(a.intersect(b), "both_sides").join(n(a.subtract(b), "only_left")).join(n(a.union(b).distinct(), "either")).join(n(a.exceptAll(b), "only_left_all"))


_SETS = "SELECT o_orderstatus AS status, o_orderpriority AS priority, CAST(grouping(o_orderstatus) * 2 + grouping(o_orderpriority) AS BIGINT) AS level, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY {}"


def _grouped(spark: SparkSession, d: str, sets: str) -> DataFrame:
    read(spark, d, "orders").select("o_orderstatus", "o_orderpriority", "o_totalprice").createOrReplaceTempView("tessel_orders")
    return spark.sql(f"SELECT o_orderstatus AS status, o_orderpriority AS priority, CAST(grouping_id(o_orderstatus, o_orderpriority) AS BIGINT) AS level, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM tessel_orders GROUP BY {sets}")


@register("rollup_sales", "[X] rollup", _SETS.format("ROLLUP (o_orderstatus, o_orderpriority)"))
def rollup_sales(spark: SparkSession, d: str) -> DataFrame:
    return _grouped(spark, d, "ROLLUP (o_orderstatus, o_orderpriority)")


@register("cube_orders", "[X] cube", _SETS.format("CUBE (o_orderstatus, o_orderpriority)"))
def cube_orders(spark: SparkSession, d: str) -> DataFrame:
    return _grouped(spark, d, "CUBE (o_orderstatus, o_orderpriority)")


@register("grouping_sets_orders", "[X] grouping sets", _SETS.format("GROUPING SETS ((o_orderstatus), (o_orderpriority), ())"))
def grouping_sets_orders(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(
        "SELECT o_orderstatus AS status, o_orderpriority AS priority, CAST(grouping_id() AS BIGINT) AS level, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {o} GROUP BY o_orderstatus, o_orderpriority GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
        o=read(spark, d, "orders"),
    )


@register("pivot_status", "A26 pivot", """SELECT year(o_orderdate) AS y, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS f, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS o, count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS p FROM orders GROUP BY 1""")
def pivot_status(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "orders").select(F.year("o_orderdate").cast("long").alias("y"), F.lower("o_orderstatus").alias("s"))
    return x.groupBy("y").pivot("s", ["f", "o", "p"]).count().fillna(0)


@register("approx_users", "[X] approximate", None)
def approx_users(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.01).alias("users"), F.percentile_approx("value", [0.5, 0.95], 10000).alias("quantiles"))


@register("range_frame_average", "[X] RANGE", "SELECT o_orderkey, count(*) OVER w AS near, CAST(round(100 * sum(o_totalprice) OVER w, 0) AS BIGINT) AS near_cents FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderkey RANGE BETWEEN 50 PRECEDING AND 50 FOLLOWING)")
def range_frame_average(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("o_orderstatus").orderBy("o_orderkey").rangeBetween(-50, 50)
    return read(spark, d, "orders").select("o_orderkey", F.count("*").over(w).alias("near"), F.round(100 * F.sum("o_totalprice").over(w), 0).cast("long").alias("near_cents"))


@register("ranking_functions", "[X] ntile percent_rank cume_dist nth_value", """SELECT s_suppkey, ntile(4) OVER w AS quarter, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd, rank() OVER w AS rk,
nth_value(s_suppkey, 2) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey)""")  # fmt: skip
def ranking_functions(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("s_nationkey").orderBy("s_acctbal", "s_suppkey")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return read(spark, d, "supplier").select(
        "s_suppkey", F.ntile(4).over(w).cast("long").alias("quarter"), F.round(F.percent_rank().over(w), 6).alias("pr"), F.round(F.cume_dist().over(w), 6).alias("cd"),
        F.rank().over(w).cast("long").alias("rk"), F.nth_value("s_suppkey", 2).over(whole).alias("second"),
    )


@register("top_per_group", "W11 [X]", "SELECT c_nationkey, c_custkey, rn FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn <= 3")
def top_per_group(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return read(spark, d, "customer").withColumn("rn", F.row_number().over(w).cast("long")).where("rn <= 3").select("c_nationkey", "c_custkey", "rn")


@register("date_functions", "[X] dates", """SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n, CAST(max(date_diff('day', DATE '1995-01-01', o_orderdate::DATE)) AS BIGINT) AS last_day, count(CASE WHEN dayofweek(o_orderdate) IN (0, 6) THEN 1 END) AS weekend FROM orders GROUP BY 1""")
def date_functions(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "orders").select(F.trunc("o_orderdate", "month").alias("month"), F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")).alias("day"), F.dayofweek("o_orderdate").isin(1, 7).alias("w"))
    return x.groupBy("month").agg(F.count("*").alias("n"), F.max("day").cast("long").alias("last_day"), F.count_if("w").alias("weekend"))


@register("json_props", "[X] JSON, S1", """WITH x AS (SELECT event_type, unnest(json_keys(props)) AS key FROM events) SELECT event_type, key, count(*) AS n FROM x GROUP BY 1, 2""")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "events").select("event_type", F.explode(F.json_object_keys("props")).alias("key"))
    return x.groupBy("event_type", "key").agg(F.count("*").alias("n"))


@register("tag_strip_links", "[X] HTML text", """SELECT page_id, CAST(len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS BIGINT) AS links, CAST(length(regexp_replace(html, '<[^>]*>', '', 'g')) AS BIGINT) AS plain FROM pages""")
def tag_strip_links(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).cast("long").alias("links"), F.length(F.regexp_replace("html", "<[^>]*>", "")).cast("long").alias("plain"))


@register("cosine_topk", "[X] vectors", """WITH q AS (SELECT vec_id AS qid, embedding AS q FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT qid, vec_id, list_cosine_similarity(q::DOUBLE[], embedding::DOUBLE[]) AS sim FROM q CROSS JOIN embeddings WHERE vec_id <> qid)
SELECT qid, vec_id, rk FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(sim, 9) DESC, vec_id) AS rk FROM s) WHERE rk <= 5""")  # fmt: skip
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """A stated query set against all vectors; each query's best are kept per partition before any shuffle."""
    x = read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, v: a + v * v))
    x = x.withColumn("n", norm(F.col("e")))
    q = x.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("e").alias("q"), F.col("n").alias("m"))
    dot = F.aggregate(F.zip_with("e", "q", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    s = x.join(q, F.col("vec_id") != F.col("qid")).withColumn("sim", F.round(dot / (F.col("n") * F.col("m")), 9))
    w = W.partitionBy("qid").orderBy(F.desc("sim"), "vec_id")
    return s.select("qid", "vec_id", "sim").withColumn("rk", F.row_number().over(w).cast("long")).where("rk <= 5").select("qid", "vec_id", "rk")


# ---- streams, run to their end over the stored events
@register("events_tumbling", "[X] tumbling windows", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark: SparkSession, d: str) -> DataFrame:
    s = st.tumbling(st.event_time(st.open_stream(spark, d, "events"), late="10 minutes"), ["event_type"], "value", "1 day")
    return st.run_to_end(s, "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@register("events_sliding", "[X] sliding windows", """WITH x AS (SELECT value, epoch(ts) AS t, unnest([0, 1]) AS k FROM events) SELECT make_timestamp(CAST((floor(t / 43200) - k) * 43200 * 1000000 AS BIGINT)) AS start, count(*) AS n, round(sum(value), 4) AS total FROM x GROUP BY 1""")
def events_sliding(spark: SparkSession, d: str) -> DataFrame:
    s = st.tumbling(st.event_time(st.open_stream(spark, d, "events"), late="10 minutes"), [], "value", "1 day", "12 hours")
    return st.run_to_end(s, "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@register("session_window_counts", "[X] sessions, W7", """WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 12 HOUR THEN 1 ELSE 0 END AS new FROM events), y AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x),
z AS (SELECT user_id, s, count(*) AS n FROM y GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, max(n) AS most FROM z GROUP BY 1""")  # fmt: skip
def session_window_counts(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return st.sessions(x, ["user_id"], "12 hours").groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("most"))


@register("stream_unique_keys", "[X] de-duplication", "SELECT user_id, event_type, 1 AS n FROM events GROUP BY 1, 2")
def stream_unique_keys(spark: SparkSession, d: str) -> DataFrame:
    s = st.unique(st.event_time(st.open_stream(spark, d, "events"), late="3650 days"), ["user_id", "event_type"])
    return st.run_to_end(s.select("user_id", "event_type"), "append").select("user_id", "event_type", F.lit(1).alias("n"))


@register("stream_running_state", "[X] state, F8", "SELECT user_id, count(*) AS n, round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END), 4) AS state FROM events GROUP BY 1")
def stream_running_state(spark: SparkSession, d: str) -> DataFrame:
    s = st.running_state(st.open_stream(spark, d, "events"), "user_id", lambda now, name, x: now + (x if name == "purchase" else 0.0), 0.0)
    out = st.run_to_end(s, "update")
    return out.groupBy("user_id").agg(F.max(F.struct("n", "state")).alias("m")).select("user_id", F.col("m.n").alias("n"), F.round("m.state", 4).alias("state"))
