"""Queries on evaluation statistics, rules, selection and training tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessel.functions import udfs
from tessel.operators import dedup, rules, select, stats, tasks
from tessel.operators import sequence as sq
from tessel.plans.registry import register
from tessel.sources.tables import read

_LONG = """long AS (SELECT 'quantity' AS metric, l_quantity AS value FROM lineitem UNION ALL SELECT 'price', l_extendedprice FROM lineitem UNION ALL SELECT 'discount', l_discount FROM lineitem),
o AS (SELECT metric, value, row_number() OVER (PARTITION BY metric ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY metric) AS n FROM long WHERE value IS NOT NULL AND NOT isnan(value))"""


@register("metric_summary_index_percentiles", "A1", f"""WITH {_LONG} SELECT metric, any_value(n) AS n, round(avg(value), 9) AS mean, max(CASE WHEN i = n // 2 THEN value END) AS median,
max(CASE WHEN i = CAST(floor(0.05 * (n - 1)) AS BIGINT) THEN value END) AS p05, max(CASE WHEN i = CAST(floor(0.95 * (n - 1)) AS BIGINT) THEN value END) AS p95 FROM o GROUP BY 1""")  # fmt: skip
def metric_summary_index_percentiles(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "lineitem")
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(c).alias("value")) for n, c in (("quantity", "l_quantity"), ("price", "l_extendedprice"), ("discount", "l_discount"))])).alias("p")
    return stats.summary(x.select(pairs).select("p.*")).withColumn("mean", F.round("mean", 9))


@register("validator_percentiles_by_source", "A2 A3 A17", """WITH o AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE n_chars IS NOT NULL)
SELECT source, any_value(n) AS n, max(CASE WHEN i = least(CAST(floor(0.5 * n) AS BIGINT), n - 1) THEN n_chars END) AS p50, max(CASE WHEN i = least(CAST(floor(0.99 * n) AS BIGINT), n - 1) THEN n_chars END) AS p99,
median(n_chars) AS true_median, CAST(sum(n_chars) AS BIGINT) AS total, round(count(CASE WHEN n_chars > 4096 THEN 1 END) / count(*), 6) AS over FROM o GROUP BY 1""")  # fmt: skip
def validator_percentiles_by_source(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").where("n_chars is not null")
    n = F.col("n")
    got = stats.ranked(docs, ["source"], "n_chars", {"p50": stats.count_rank(0.5), "p99": stats.count_rank(0.99), "a": F.floor((n - 1) / 2), "b": F.floor(n / 2)})
    more = docs.groupBy("source").agg(F.sum("n_chars").alias("total"), F.round(F.count_if(F.col("n_chars") > 4096) / F.count("*"), 6).alias("over"))
    return got.join(more, "source").select("source", "n", "p50", "p99", ((F.col("a") + F.col("b")) / 2).alias("true_median"), "total", "over")


@register("closed_domain_histogram", "A4", """WITH k AS (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM']) AS key), c AS (SELECT o_orderstatus AS status, o_orderpriority AS key, count(*) AS c FROM orders GROUP BY 1, 2),
t AS (SELECT status, sum(c) AS total FROM c SEMI JOIN k USING (key) GROUP BY 1), s AS (SELECT DISTINCT o_orderstatus AS status FROM orders)
SELECT s.status, k.key, round(CASE WHEN coalesce(total, 0) > 0 THEN coalesce(c, 0) / total ELSE 0 END, 6) AS share FROM s CROSS JOIN k LEFT JOIN t USING (status) LEFT JOIN c ON c.status = s.status AND c.key = k.key""")  # fmt: skip
def closed_domain_histogram(spark: SparkSession, d: str) -> DataFrame:
    domain = spark.createDataFrame([("1-URGENT",), ("2-HIGH",), ("3-MEDIUM",)], "key string")
    x = read(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), "o_orderpriority")
    return stats.histogram(x, ["status"], "o_orderpriority", domain).withColumn("share", F.round("share", 6))


@register("capped_length_histogram", "A16", """WITH x AS (SELECT len(list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) AS n FROM documents)
SELECT CAST(least(n // 16, 33) AS BIGINT) AS bin, count(*) AS docs, count(CASE WHEN n % 4 = 0 THEN 1 END) AS multiple_of_4, count(CASE WHEN n > 528 THEN 1 END) AS beyond FROM x GROUP BY 1""")  # fmt: skip
def capped_length_histogram(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "documents").select(F.size(dedup.words(F.col("text"))).cast("long").alias("n"))
    return x.groupBy(F.least(F.floor(F.col("n") / 16), F.lit(33)).cast("long").alias("bin")).agg(F.count("*").alias("docs"), F.count_if(F.col("n") % 4 == 0).alias("multiple_of_4"), F.count_if(F.col("n") > 528).alias("beyond"))


@register("js_divergence_event_type", "A5 A6", """WITH x AS (SELECT user_id % 2 AS side, event_type AS key, count(*) AS c FROM events GROUP BY 1, 2), s AS (SELECT side, key, c / sum(c) OVER (PARTITION BY side) AS share FROM x),
j AS (SELECT coalesce(a.share, 0) AS p, coalesce(b.share, 0) AS q FROM (SELECT * FROM s WHERE side = 0) a FULL JOIN (SELECT * FROM s WHERE side = 1) b USING (key))
SELECT round(0.5 * sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END) + 0.5 * sum(CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END), 6) AS js FROM j""")  # fmt: skip
def js_divergence_event_type(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("user_id") % 2 == 0).alias("a"), F.count_if(F.col("user_id") % 2 == 1).alias("b"))
    total = x.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    shares = x.join(F.broadcast(total)).select(F.when(F.col("ta") > 0, F.col("a") / F.col("ta")).otherwise(0.0).alias("p"), F.when(F.col("tb") > 0, F.col("b") / F.col("tb")).otherwise(0.0).alias("q"))
    return shares.agg(F.round(stats.js_divergence("p", "q"), 6).alias("js"))


@register("per_key_ratio_metrics", "A7 A8a", """SELECT l_suppkey, count(*) AS n, round(count(CASE WHEN l_returnflag = 'R' THEN 1 END) / greatest(count(*), 1), 6) AS returned, round(avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END), 8) AS discounted,
round(count(DISTINCT l_partkey) / count(*), 6) AS distinct_parts FROM lineitem GROUP BY 1""")  # fmt: skip
def per_key_ratio_metrics(spark: SparkSession, d: str) -> DataFrame:
    n = F.greatest(F.count("*"), F.lit(1))
    return read(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.count("*").alias("n"), F.round(F.count_if(F.col("l_returnflag") == "R") / n, 6).alias("returned"),
        F.round(F.avg((F.col("l_discount") > 0.05).cast("double")), 8).alias("discounted"), F.round(F.count_distinct("l_partkey") / n, 6).alias("distinct_parts"),
    )


@register("duration_weighted_ratio", "A8", "SELECT l_shipmode_key AS flag, round(part / whole, 6) AS share FROM (SELECT l_returnflag AS l_shipmode_key, sum(CASE WHEN l_tax > 0.04 THEN l_quantity ELSE 0 END) AS part, sum(l_quantity) AS whole FROM lineitem GROUP BY 1) WHERE whole > 0")
def duration_weighted_ratio(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.sum(F.when(F.col("l_tax") > 0.04, F.col("l_quantity")).otherwise(0)).alias("part"), F.sum("l_quantity").alias("whole"))
    return x.where("whole > 0").select("flag", F.round(F.col("part") / F.col("whole"), 6).alias("share"))


@register("error_map_merge", "A18", """WITH x AS (SELECT user_id, map_from_entries(list({'k': event_type, 'v': c})) AS m FROM (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY 1, 2) GROUP BY 1)
SELECT event_type AS error, count(*) AS total FROM events GROUP BY 1""")  # fmt: skip
def error_map_merge(spark: SparkSession, d: str) -> DataFrame:
    per = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("c"))
    maps = per.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "c"))).alias("errors"))
    return maps.select(F.explode("errors").alias("error", "c")).groupBy("error").agg(F.sum("c").alias("total"))


@register("weighted_category_loss", "A19 A20", """SELECT l_returnflag AS category, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS loss, round(sum(l_quantity) / any_value(t), 6) AS share
FROM lineitem, (SELECT sum(l_quantity) AS t FROM lineitem) GROUP BY 1""")  # fmt: skip
def weighted_category_loss(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("category")).agg(F.sum(F.col("l_extendedprice") * F.col("l_quantity")).alias("s"), F.sum("l_quantity").alias("q"))
    return x.select("category", F.round(F.col("s") / F.col("q"), 4).alias("loss"), F.round(F.col("q") / F.sum("q").over(W.partitionBy(F.lit(0))), 6).alias("share"))


@register("report_counts", "A10 A22 O5 S9 S10", """WITH x AS (SELECT CASE WHEN value > 150 THEN 'slow' WHEN event_type = 'error' THEN 'failed' ELSE 'done' END AS class, event_type, value FROM events)
SELECT class || '|' || event_type AS key, count(*) AS n, round(median(value), 6) AS median, round(max(value), 6) AS most FROM x GROUP BY 1 ORDER BY n DESC, key LIMIT 12""")  # fmt: skip
def report_counts(spark: SparkSession, d: str) -> DataFrame:
    kind = rules.first_reason({"slow": F.col("value") > 150, "failed": F.col("event_type") == "error", "done": F.lit(True)})
    x = read(spark, d, "events").select(F.concat_ws("|", kind, "event_type").alias("key"), "value")
    return x.groupBy("key").agg(F.count("*").alias("n"), F.round(F.percentile("value", 0.5), 6).alias("median"), F.round(F.max("value"), 6).alias("most")).orderBy(F.desc("n"), "key").limit(12)


_PAIR = "x AS (SELECT user_id, avg(CASE WHEN event_type = 'view' THEN value END) AS a, avg(CASE WHEN event_type = 'click' THEN value END) AS b FROM events GROUP BY 1)"


def _paired(spark: SparkSession, d: str) -> DataFrame:
    of = lambda kind: F.avg(F.when(F.col("event_type") == kind, F.col("value")))
    return read(spark, d, "events").groupBy("user_id").agg(of("view").alias("a"), of("click").alias("b"))


@register("paired_difference", "J12 A24", f"WITH {_PAIR} SELECT count(*) AS pairs, round(avg(b - a), 6) AS diff, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b FROM x WHERE a IS NOT NULL AND b IS NOT NULL")
def paired_difference(spark: SparkSession, d: str) -> DataFrame:
    x = _paired(spark, d).where("a is not null and b is not null")
    return x.agg(F.count("*").alias("pairs"), F.round(F.avg(F.col("b") - F.col("a")), 6).alias("diff"), F.round(F.avg("a"), 6).alias("mean_a"), F.round(F.avg("b"), 6).alias("mean_b"))


_BOOT = f"""{_PAIR}, v AS (SELECT b - a AS v, row_number() OVER (ORDER BY user_id) - 1 AS at, count(*) OVER () AS n FROM x WHERE a IS NOT NULL AND b IS NOT NULL),
dr AS (SELECT rep, CAST(concat('0x', substr(sha256(rep || ':' || v.at), 1, 8)) AS BIGINT) % n AS pick FROM v CROSS JOIN (SELECT unnest(range(0, 200)) AS rep)),
m AS (SELECT rep, avg(v.v) AS m FROM dr JOIN v ON v.at = dr.pick GROUP BY 1), o AS (SELECT m, row_number() OVER (ORDER BY m) - 1 AS i FROM m)"""


@register("paired_bootstrap_ci", "A23 A24", f"""WITH {_BOOT} SELECT (SELECT count(*) FROM v) AS n, round((SELECT avg(v) FROM v), 6) AS mean, round(max(CASE WHEN i = 5 THEN m END), 6) AS lo, round(max(CASE WHEN i = 195 THEN m END), 6) AS hi,
max(CASE WHEN i = 5 THEN m END) > 0 OR max(CASE WHEN i = 195 THEN m END) < 0 AS star FROM o""")  # fmt: skip
def paired_bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    x = _paired(spark, d).where("a is not null and b is not null").select(F.lit("all").alias("g"), "user_id", (F.col("b") - F.col("a")).alias("v"))
    got = stats.bootstrap(x, ["g"], "v", ["user_id"], 200)
    return got.select("n", F.round("mean", 6).alias("mean"), F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), ((F.col("lo") > 0) | (F.col("hi") < 0)).alias("star"))


@register("paired_bootstrap_ci_2000", "A23 A24", f"""WITH {_BOOT.replace("range(0, 200)", "range(0, 2000)")} SELECT (SELECT count(*) FROM v) AS n, round((SELECT avg(v) FROM v), 6) AS mean, round(max(CASE WHEN i = 50 THEN m END), 6) AS lo, round(max(CASE WHEN i = 1950 THEN m END), 6) AS hi,
max(CASE WHEN i = 50 THEN m END) > 0 OR max(CASE WHEN i = 1950 THEN m END) < 0 AS star FROM o""")  # fmt: skip
def paired_bootstrap_ci_2000(spark: SparkSession, d: str) -> DataFrame:
    x = _paired(spark, d).where("a is not null and b is not null").select(F.lit("all").alias("g"), "user_id", (F.col("b") - F.col("a")).alias("v"))
    got = stats.bootstrap(x, ["g"], "v", ["user_id"], 2000)
    return got.select("n", F.round("mean", 6).alias("mean"), F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), ((F.col("lo") > 0) | (F.col("hi") < 0)).alias("star"))


@register("failure_as_zero_means", "A25", """WITH x AS (SELECT user_id, avg(CASE WHEN event_type = 'purchase' THEN value END) AS rate, avg(CASE WHEN event_type = 'signup' THEN value END) AS other FROM events GROUP BY 1)
SELECT round(avg(coalesce(rate, 0)), 6) AS rate, round(avg(other), 6) AS other, count(rate) AS parsed FROM x""")  # fmt: skip
def failure_as_zero_means(spark: SparkSession, d: str) -> DataFrame:
    of = lambda kind: F.avg(F.when(F.col("event_type") == kind, F.col("value")))
    x = read(spark, d, "events").groupBy("user_id").agg(of("purchase").alias("rate"), of("signup").alias("other"))
    return x.agg(F.round(F.avg(F.coalesce("rate", F.lit(0.0))), 6).alias("rate"), F.round(F.avg("other"), 6).alias("other"), F.count("rate").alias("parsed"))


# ---- selection
_SAMPLES = "s AS (SELECT l_orderkey, l_linenumber AS seed, l_partkey, l_returnflag <> 'R' AS ok, round(l_discount, 3) AS a, round(l_tax, 3) AS b, l_quantity AS q, l_extendedprice AS p FROM lineitem)"


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("seed"), "l_partkey", (F.col("l_returnflag") != "R").alias("ok"), F.round("l_discount", 3).alias("a"), F.round("l_tax", 3).alias("b"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"))


def _best_sql(order: str) -> str:
    return f"WITH {_SAMPLES} SELECT l_orderkey, seed, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {order}, seed, l_partkey, p) AS rn FROM s) WHERE rn = 1"


_ALLOWED = frozenset({"ok", "a", "b", "q"})


def _best(spark: SparkSession, d: str, rule: list) -> DataFrame:
    one = F.struct("seed", "l_partkey", "p")
    return select.best_of_n(_samples(spark, d).withColumn("_seed", one), ["l_orderkey"], rule, "_seed").select("l_orderkey", "seed", "l_partkey")


@register("best_of_n_lex", "W11 A8a", _best_sql("ok DESC, a DESC, b DESC, q DESC"))
def best_of_n_lex(spark: SparkSession, d: str) -> DataFrame:
    return _best(spark, d, select.guarded(["ok", "a", "b", "q"], _ALLOWED))


@register("best_of_n_sum", "W11", _best_sql("CAST(round(1000 * (2.0 * CAST(ok AS INT) + 1.5 * a - 1.0 * b + 0.5 * q / 50), 3) AS DOUBLE) DESC"))
def best_of_n_sum(spark: SparkSession, d: str) -> DataFrame:
    return _best(spark, d, [F.round(1000 * (2.0 * F.col("ok").cast("int") + 1.5 * F.col("a") - 1.0 * F.col("b") + 0.5 * F.col("q") / 50), 3)])


@register("best_of_n_valid", "W11", _best_sql("ok DESC"))
def best_of_n_valid(spark: SparkSession, d: str) -> DataFrame:
    return _best(spark, d, select.guarded(["ok"], _ALLOWED))


@register("chosen_index_histogram", "A26", f"""WITH {_SAMPLES}, c AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY ok DESC, seed, l_partkey, p) AS rn FROM s), v AS (SELECT l_orderkey, bool_or(ok) AS ok FROM s GROUP BY 1)
SELECT seed, count(*) AS chosen, round(avg(CASE WHEN v.ok THEN 1.0 ELSE 0.0 END), 6) AS any_valid FROM c JOIN v USING (l_orderkey) WHERE rn = 1 GROUP BY 1""")  # fmt: skip
def chosen_index_histogram(spark: SparkSession, d: str) -> DataFrame:
    x = _samples(spark, d).groupBy("l_orderkey").agg(F.min(F.struct((~F.col("ok")).alias("bad"), "seed")).alias("m"), F.bool_or("ok").alias("any"))
    return x.groupBy(F.col("m.seed").alias("seed")).agg(F.count("*").alias("chosen"), F.round(F.avg(F.col("any").cast("double")), 6).alias("any_valid"))


@register("stride_sample", "W12", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) WHERE r % 7 = 0")
def stride_sample(spark: SparkSession, d: str) -> DataFrame:
    return select.ranked(read(spark, d, "orders").select("o_orderkey"), ["o_orderkey"]).where("rank % 7 = 0").select("o_orderkey")


@register("round_robin_shards", "W13", "SELECT shard, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) % 4 AS shard FROM orders) GROUP BY 1")
def round_robin_shards(spark: SparkSession, d: str) -> DataFrame:
    x = select.ranked(read(spark, d, "orders").select("o_orderkey"), ["o_orderkey"])
    return x.groupBy(F.pmod("rank", F.lit(4)).alias("shard")).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("total"))


@register("hash_order_sample", "O3 O2 K14", "SELECT doc_id FROM documents ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id LIMIT 25")
def hash_order_sample(spark: SparkSession, d: str) -> DataFrame:
    return select.hash_first(read(spark, d, "documents").select("doc_id"), "doc_id", 25)


@register("hash_fraction_sample", "U5 O2", "SELECT doc_id FROM documents WHERE substr(sha256(CAST(doc_id AS VARCHAR)), 1, 16) < '4000000000000000'")
def hash_fraction_sample(spark: SparkSession, d: str) -> DataFrame:
    return select.hash_fraction(read(spark, d, "documents").select("doc_id"), "doc_id", 0.25)


@register("greedy_category_pick", "O4 A30", """WITH a AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 1), b AS (SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT * FROM a) ORDER BY c_acctbal DESC, c_custkey LIMIT 1),
c AS (SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT * FROM a UNION ALL SELECT * FROM b) AND c_nationkey = 3 ORDER BY c_acctbal, c_custkey LIMIT 1)
SELECT 'builder' AS category, c_custkey FROM a UNION ALL SELECT 'rich', c_custkey FROM b UNION ALL SELECT 'third', c_custkey FROM c""")  # fmt: skip
def greedy_category_pick(spark: SparkSession, d: str) -> DataFrame:
    rich = F.col("c_acctbal").desc()
    return select.greedy(read(spark, d, "customer"), "c_custkey", [("builder", F.col("c_mktsegment") == "BUILDING", [rich]), ("rich", F.lit(True), [rich]), ("third", F.col("c_nationkey") == 3, [F.col("c_acctbal")])])


@register("ids_in_every_run", "J11 U1", "SELECT user_id FROM events GROUP BY 1 HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)")
def ids_in_every_run(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "events").select("user_id", "event_type")
    runs = x.agg(F.count_distinct("event_type").alias("runs"))
    return x.groupBy("user_id").agg(F.count_distinct("event_type").alias("n")).join(F.broadcast(runs), F.col("n") == F.col("runs")).select("user_id")


@register("wanted_vs_got_by_index", "J15 J14", """WITH w AS (SELECT o_custkey, o_orderpriority AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders WHERE year(o_orderdate) = 1995), g AS (SELECT o_custkey, o_orderpriority AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders WHERE year(o_orderdate) = 1996)
SELECT w.o_custkey, count(*) AS wanted, count(g.p) AS got, count(CASE WHEN g.p = w.p THEN 1 END) AS exact FROM w LEFT JOIN g USING (o_custkey, i) GROUP BY 1""")  # fmt: skip
def wanted_vs_got_by_index(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", F.year("o_orderdate").alias("y"))
    side = lambda y, name: o.where(F.col("y") == y).select("o_custkey", F.col("o_orderpriority").alias(name), F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).alias("i"))
    return side(1995, "p").join(side(1996, "q"), ["o_custkey", "i"], "left").groupBy("o_custkey").agg(F.count("*").alias("wanted"), F.count("q").alias("got"), F.count_if(F.col("p") == F.col("q")).alias("exact"))


@register("ring_donor", "J16", "WITH x AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS r, count(*) OVER () AS n FROM supplier) SELECT a.s_suppkey, b.s_suppkey AS donor FROM x a JOIN x b ON b.r = (a.r + 1) % a.n")
def ring_donor(spark: SparkSession, d: str) -> DataFrame:
    x = select.ranked(read(spark, d, "supplier").select("s_suppkey"), ["s_suppkey"], "r")
    n = x.count()
    return x.withColumn("to", F.pmod(F.col("r") + 1, F.lit(max(n, 1)))).join(x.select(F.col("s_suppkey").alias("donor"), F.col("r").alias("to")), "to").select("s_suppkey", "donor")


@register("latest_earlier_same_label", "J18", """WITH x AS (SELECT event_id, user_id, event_type, ts FROM events) SELECT event_id, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS earlier FROM x""")
def latest_earlier_same_label(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return read(spark, d, "events").select("event_id", F.lag("event_id").over(w).alias("earlier"))


# ---- rules
_RULES_SQL = {"has_text": "n_chars > 0", "not_short": "n_chars >= 200", "not_long": "n_chars <= 20000", "quality": "coalesce(quality, 1) = 1", "not_toxic": "coalesce(toxic, 0) = 0", "known_lang": "lang IN ('en', 'de', 'fr', 'es')"}
_RULED = "SELECT d.doc_id, " + ", ".join(f"coalesce({v}, false) AS {k}" for k, v in _RULES_SQL.items()) + " FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"


def _ruled(spark: SparkSession, d: str) -> tuple[DataFrame, rules.Rules]:
    docs = read(spark, d, "documents").select("doc_id", "n_chars", "lang").join(read(spark, d, "labels"), "doc_id", "left")
    return docs, {k: F.expr(v) for k, v in _RULES_SQL.items()}


@register("clean_subset_pass", "F1 F2 F7", "WITH r AS (" + _RULED + ") SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN NOT {k} THEN '{k}' END" for k in _RULES_SQL) + ") AS failed FROM r")
def clean_subset_pass(spark: SparkSession, d: str) -> DataFrame:
    docs, named = _ruled(spark, d)
    return docs.select("doc_id", F.array_join(rules.failed(named), ",").alias("failed"))


@register("rule_failure_counts", "F2 A11", "WITH r AS (" + _RULED + ") " + " UNION ALL ".join(f"SELECT '{k}' AS rule, count(CASE WHEN NOT {k} THEN 1 END) AS failures FROM r" for k in _RULES_SQL))
def rule_failure_counts(spark: SparkSession, d: str) -> DataFrame:
    docs, named = _ruled(spark, d)
    return rules.failure_counts(docs, named)


_REASON = "CASE WHEN l.doc_id IS NULL THEN 'not_labelled' WHEN d.n_chars < 200 THEN 'short' WHEN l.quality = 0 THEN 'low_quality' WHEN l.toxic = 1 THEN 'toxic' END"


@register("first_failed_reason", "F5 F6 P2", f"SELECT d.doc_id, {_REASON} AS reason FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE {_REASON} IS NOT NULL")
def first_failed_reason(spark: SparkSession, d: str) -> DataFrame:
    labels = read(spark, d, "labels").withColumn("known", F.lit(True))
    docs = read(spark, d, "documents").select("doc_id", "n_chars").join(labels, "doc_id", "left")
    bad = rules.quarantine(docs, {"not_labelled": F.col("known").isNull(), "short": F.col("n_chars") < 200, "low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1})[1]
    return bad.select("doc_id", "reason")


@register("exclusion_reason_counts", "F5 A10", f"SELECT coalesce({_REASON}, 'kept') || '|' || d.lang AS key, count(*) AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1")
def exclusion_reason_counts(spark: SparkSession, d: str) -> DataFrame:
    labels = read(spark, d, "labels").withColumn("known", F.lit(True))
    docs = read(spark, d, "documents").select("doc_id", "n_chars", "lang").join(labels, "doc_id", "left")
    reason = rules.first_reason({"not_labelled": F.col("known").isNull(), "short": F.col("n_chars") < 200, "low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1, "kept": F.lit(True)})
    return docs.groupBy(F.concat_ws("|", reason, "lang").alias("key")).agg(F.count("*").alias("n"))


@register("integrity_checks", "F3 U2 U3 F9", """SELECT (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders)) AS orphans, (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)) AS childless,
(SELECT bool_and(l_quantity > 0 AND l_discount BETWEEN 0 AND 1) FROM lineitem) AS in_range, (SELECT count(*) = count(DISTINCT o_orderkey) FROM orders) AS unique_keys""")  # fmt: skip
def integrity_checks(spark: SparkSession, d: str) -> DataFrame:
    li, o = read(spark, d, "lineitem"), read(spark, d, "orders")
    a = li.select(F.col("l_orderkey").alias("k")).join(o.select(F.col("o_orderkey").alias("k")), "k", "left_anti").agg(F.count_distinct("k").alias("orphans"))
    b = o.select(F.col("o_orderkey").alias("k")).join(li.select(F.col("l_orderkey").alias("k")), "k", "left_anti").agg(F.count_distinct("k").alias("childless"))
    c = li.agg(F.bool_and((F.col("l_quantity") > 0) & F.col("l_discount").between(0, 1)).alias("in_range"))
    e = o.agg((F.count("*") == F.count_distinct("o_orderkey")).alias("unique_keys"))
    return a.join(b).join(c).join(e)  # four rows of one


# ---- training tasks
@register("sft_examples", "P10 W1", """WITH x AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS r2, lead(text) OVER w AS t2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, turn, sha256(text) AS prompt, sha256(t2) AS completion FROM x WHERE role = 'user' AND r2 = 'assistant'""")  # fmt: skip
def sft_examples(spark: SparkSession, d: str) -> DataFrame:
    return tasks.turn_pairs(read(spark, d, "conversations")).select("conv_id", "turn", F.sha2("prompt", 256).alias("prompt"), F.sha2("completion", 256).alias("completion"))


@register("prompt_render", "P11 P13", """SELECT conv_id, sha256(string_agg('[' || role || ' ' || i || '/' || n || '] ' || text, chr(10) ORDER BY i)) AS digest, CAST(sum(length(text)) AS BIGINT) AS budget
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) GROUP BY 1""")  # fmt: skip
def prompt_render(spark: SparkSession, d: str) -> DataFrame:
    return tasks.render(read(spark, d, "conversations")).select("conv_id", F.sha2("prompt", 256).alias("digest"), "budget")


@register("masked_turn_task", "P15 G10", """WITH x AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations), c AS (SELECT conv_id, list(i ORDER BY i) AS cand FROM x WHERE 2 * i > n GROUP BY 1),
t AS (SELECT conv_id, cand[CAST(CAST(concat('0x', substr(sha256(CAST(conv_id AS VARCHAR)), 1, 8)) AS BIGINT) % len(cand) AS BIGINT) + 1] AS target FROM c)
SELECT conv_id, CAST(target AS BIGINT) AS target, sha256(string_agg(CASE WHEN i = target THEN '<gap>' ELSE text END, chr(10) ORDER BY i)) AS prompt, sha256(max(CASE WHEN i = target THEN text END)) AS completion FROM x JOIN t USING (conv_id) GROUP BY 1, 2""")  # fmt: skip
def masked_turn_task(spark: SparkSession, d: str) -> DataFrame:
    return tasks.masked_turns(read(spark, d, "conversations")).select("conv_id", "target", F.sha2("prompt", 256).alias("prompt"), F.sha2("completion", 256).alias("completion"))


@register("mixture_union", "U5", """WITH w AS (SELECT doc_id, 'whole' AS task FROM documents), i AS (SELECT doc_id, 'infill' AS task FROM documents WHERE substr(sha256(CAST(doc_id AS VARCHAR)), 1, 16) < '8000000000000000')
SELECT task, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM (SELECT * FROM w UNION ALL SELECT * FROM i) GROUP BY 1""")  # fmt: skip
def mixture_union(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id")
    both = docs.withColumn("task", F.lit("whole")).unionByName(select.hash_fraction(docs, "doc_id", 0.5).withColumn("task", F.lit("infill")))
    return both.groupBy("task").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@register("token_gate", "F4 G12", """WITH x AS (SELECT doc_id, len(list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) AS n FROM documents) SELECT doc_id, CAST(n AS BIGINT) AS tokens FROM x WHERE n + 1 > 1024""")
def token_gate(spark: SparkSession, d: str) -> DataFrame:
    return tasks.over_length(read(spark, d, "documents"), "doc_id", "text", 1024)


@register("update_plan", "§2.8 math", """WITH x AS (SELECT unnest([1, 2, 4, 8]) AS world), a AS (SELECT world, greatest(CAST(round_even(524288.0 / (16384 * world), 0) AS BIGINT), 1) AS grad_accum FROM x)
SELECT CAST(world AS BIGINT) AS world, grad_accum, grad_accum * world AS per_update, CAST(ceil(1528.0 / (grad_accum * world)) AS BIGINT) AS steps_per_epoch, CAST(ceil(ceil(1528.0 / (grad_accum * world)) * 2) AS BIGINT) AS total_steps FROM a""")  # fmt: skip
def update_plan(spark: SparkSession, d: str) -> DataFrame:
    return tasks.update_plan(spark.createDataFrame([(1,), (2,), (4,), (8,)], "world long"), 1528, 524288, 16384, 2)


@register("lr_schedule", "§2.8 math", """WITH x AS (SELECT unnest(range(0, 96)) AS step) SELECT step, round(CASE WHEN step < 2 THEN 1e-4 * (step + 1) / 2 ELSE 1e-4 * (0.1 + 0.9 * 0.5 * (1 + cos(pi() * least((step - 2) / 94.0, 1.0)))) END, 12) AS lr FROM x""")
def lr_schedule(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(96).select(F.col("id").alias("step"), F.round(tasks.learning_rate(F.col("id"), 96, 1e-4, 0.03, 0.1), 12).alias("lr"))


@register("length_bucket_packing", "G11", None)
def length_bucket_packing(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "lang", F.size(dedup.words(F.col("text"))).alias("length"))
    return tasks.pack(docs, "lang", "doc_id", "length", 16384).groupBy("lang", "batch").agg(F.count("*").alias("n"), F.max("length").alias("longest"))


# ---- sequence functions


@register("lcs_recall_precision", "LCS A7", None)
def lcs_recall_precision(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    x = read(spark, d, "conversations").withColumn("a", dedup.words(F.col("text"))).withColumn("b", F.lead("a").over(w)).where("b is not null")
    x = x.withColumn("lcs", udfs.lcs_length("a", "b"))
    return x.select("conv_id", "turn", "lcs", F.round(F.col("lcs") / F.greatest(F.size("b"), F.lit(1)), 6).alias("recall"), F.round(F.col("lcs") / F.greatest(F.size("a"), F.lit(1)), 6).alias("precision"))


@register("gzip_compressibility", "A28", None)
def gzip_compressibility(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "events").groupBy("user_id").agg(F.array_join(sq.ordered_list(["ts", "event_id"], "event_type"), " ").alias("s"))
    return x.select("user_id", udfs.gzip_ratio("s").alias("ratio"))
