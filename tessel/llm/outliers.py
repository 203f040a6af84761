"""Quality rules by robust multivariate outliers, in DataFrame functions only.

Each text gets counts of words, characters, symbols, repeated lines and words of repeated 3-word windows. Transformed to a
vector, these are compared with the minimum-covariance-determinant estimate of the text's language and source: the mean
and covariance of the ``SHARE`` of rows whose covariance (with the floors on its diagonal) has the least determinant. It is
sought from ``STARTS`` deterministic starts (medians with the floors as spreads, medians with the quartiles' spreads, mean and
covariance of all rows). Each takes ``FIRST`` concentration steps; the best ``BEST`` of each group then go on until the
determinant stands still, and the least one is taken. A row whose squared Mahalanobis distance passes ``CUTOFF`` is rejected.

All estimates are sums and histograms, pre-aggregated before any shuffle. Rows meet the groups' estimates by a broadcast of a
few numbers for each group while there are at most ``MOST_BROADCAST`` of them, else by a join whose skewed groups the
planner splits; so a source with most of all rows is no hot spot. Results do not depend on the order of rows. A group of
fewer than ``LEAST`` rows is judged by its language, a language of fewer by all rows. The closest share is cut at a bin of
the logarithm of the distance (0.5 % wide), so it may hold a few rows more than asked for.

Defined cases: a null or empty text has no words and fails the base rules; null language or source is a group of its own;
equal rows get equal results; other columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.sources.store import discard, stash

SHARE, LEAST = 0.75, 200
#: Starts of each group, steps that all of them take, starts that go on, and steps at most.
STARTS, FIRST, BEST, MOST_STEPS = 3, 2, 2, 100
#: Part by which a determinant must shrink for another step, and groups with starts that may be broadcast (200 bytes each).
STILL, MOST_BROADCAST = 1e-6, 200_000
#: Least standard deviation of each statistic: below it, differences are of no account (many texts have none at all). Among
#: rows that pass the base rules x2**2 reaches 1 and x3**2 0.5, so FLOOR**2 * CUTOFF must stay below these, or a statistic
#: could reject nothing by itself.
FLOOR = {"x0": 0.03, "x1": 0.03, "x2": 0.15, "x3": 0.15}
#: Squared distance beyond which a row is rejected: the 0.999 quantile of chi-square with four degrees of freedom.
CUTOFF = 18.467
#: Bins for each unit of a statistic, and for each unit of a distance's logarithm.
BINS, LOG_BINS = 500, 200
DIMS = list(FLOOR)
SPACE = " \t\n\x0b\f\r"


def statistics(text: Column | str = "text") -> list[tuple[str, Column]]:
    """Columns to add one after another, each by name; the last ones are the counts."""
    t = F.coalesce(F.col(text).cast("string") if isinstance(text, str) else text, F.lit(""))
    words = F.split(F.btrim(t, F.lit(SPACE)), "[\\x20\\x09-\\x0D]+")
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0)
    return [
        ("q_w", F.filter(words, lambda x: x != "")),
        ("q_l", lines),
        ("word_chars", F.length(F.translate(t, SPACE, "")).cast("long")),
        ("n_symbols", (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long")),
    ]


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (all long)."""
    df = docs
    for name, col in statistics(text_col):
        df = df.withColumn(name, col)
    df = df.withColumn("n_words", F.size("q_w").cast("long")).withColumn("n_lines", F.size("q_l").cast("long"))
    df = df.withColumn("n_dup_lines", (F.size("q_l") - F.size(F.array_distinct("q_l"))).cast("long"))
    # Windows as (hash, place), in the order of hashes: equal windows become neighbours.
    df = df.withColumn("q_g", F.expr("CASE WHEN n_words >= 3 THEN array_sort(transform(sequence(0, size(q_w) - 3), i -> struct(xxhash64(q_w[i], q_w[i + 1], q_w[i + 2]) AS h, i AS i))) END"))
    df = df.withColumn(
        "q_r",
        F.expr("""CASE WHEN n_words >= 3 THEN array_sort(array_compact(transform(q_g, (g, j) ->
            CASE WHEN g.h = get(q_g, j - 1).h OR g.h = get(q_g, j + 1).h THEN g.i END))) END"""),
    )
    covered = F.expr("CASE WHEN coalesce(size(q_r), 0) <= 0 THEN 0L ELSE 3L + aggregate(transform(q_r, (x, j) -> least(3, x - coalesce(get(q_r, j - 1), x))), 0L, (a, b) -> a + b) END")
    return df.withColumn("n_repeat_words", covered).drop("q_w", "q_l", "q_g", "q_r")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vector(df: DataFrame) -> DataFrame:
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    return df.withColumns({
        "x0": F.log(F.greatest(F.col("word_chars") / words, F.lit(0.1))),
        "x1": F.sqrt(F.col("n_symbols") / F.greatest("word_chars", F.lit(1))),
        "x2": F.sqrt(F.col("n_dup_lines") / lines),
        "x3": F.sqrt(F.col("n_repeat_words") / words),
    })


def _cholesky(df: DataFrame, keep: tuple[str, ...] = ("key", "start")) -> DataFrame:
    """From means m_i and covariances s_ij, the factor l_ij of the covariance with its floor, and its determinant."""
    for i in range(len(DIMS)):
        for j in range(i + 1):
            s = F.col(f"s_{i}{j}") + (FLOOR[DIMS[i]] ** 2 if i == j else 0.0)
            for k in range(j):
                s = s - F.col(f"l_{i}{k}") * F.col(f"l_{j}{k}")
            df = df.withColumn(f"l_{i}{j}", F.sqrt(F.greatest(s, F.lit(1e-12))) if i == j else s / F.col(f"l_{j}{j}"))
    root = F.col("l_00")
    for i in range(1, len(DIMS)):
        root = root * F.col(f"l_{i}{i}")
    return df.select(*keep, *[f"m_{i}" for i in range(len(DIMS))], *[f"l_{i}{j}" for i in range(len(DIMS)) for j in range(i + 1)], (root * root).alias("det"))


def _distance(df: DataFrame) -> DataFrame:
    """Squared Mahalanobis distance, by forward substitution."""
    for i in range(len(DIMS)):
        y = F.col(DIMS[i]) - F.col(f"m_{i}")
        for k in range(i):
            y = y - F.col(f"l_{i}{k}") * F.col(f"y_{k}")
        df = df.withColumn(f"y_{i}", y / F.col(f"l_{i}{i}"))
    return df.withColumn("d2", sum((F.col(f"y_{i}") * F.col(f"y_{i}") for i in range(1, len(DIMS))), F.col("y_0") * F.col("y_0")))


def _quantile_bins(counts: DataFrame, share: float) -> DataFrame:
    """The least bin of each key (and the other columns) up to which a share of its rows lies. counts: key.., bin, n."""
    keys = [c for c in counts.columns if c not in ("bin", "n")]
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys)
    run = counts.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
    return run.where(F.col("upto") >= F.col("all") * share).groupBy(*keys).agg(F.min("bin").alias("bin"))


def consistency(share: float) -> float:
    """What the covariance of the closest share of normal rows in four dimensions must be multiplied by."""
    cdf4 = lambda x: 1 - math.exp(-x / 2) * (1 + x / 2)
    lo, hi = 0.0, 100.0
    for _ in range(200):
        lo, hi = ((lo + hi) / 2, hi) if cdf4((lo + hi) / 2) < share else (lo, (lo + hi) / 2)
    return share / (1 - math.exp(-lo / 2) * (1 + lo / 2 + lo * lo / 8))


def _moments(rows: DataFrame, by: list[str]) -> DataFrame:
    """Means m_i and covariances s_ij of each group."""
    n = len(DIMS)
    sums = rows.groupBy(*by).agg(
        F.count("*").alias("n"), *[F.sum(x).alias(f"t_{i}") for i, x in enumerate(DIMS)],
        *[F.sum(F.col(DIMS[i]) * F.col(DIMS[j])).alias(f"u_{i}{j}") for i in range(n) for j in range(i + 1)],
    )
    at = sums.withColumns({f"m_{i}": F.col(f"t_{i}") / F.col("n") for i in range(n)})
    return at.withColumns({f"s_{i}{j}": F.col(f"u_{i}{j}") / F.col("n") - F.col(f"m_{i}") * F.col(f"m_{j}") for i in range(n) for j in range(i + 1)})


def _starts(rows: DataFrame) -> DataFrame:
    """The three starts of each group."""
    n = range(len(DIMS))
    long = rows.select("key", F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), F.floor(F.col(x) * BINS).cast("int").alias("bin")) for i, x in enumerate(DIMS)])).alias("v"))
    counts = stash(long.groupBy("key", "v.dim", "v.bin").agg(F.count("*").alias("n")), "bins")
    parts = [_quantile_bins(counts, q).select("key", "dim", F.lit(name).alias("name"), ((F.col("bin") + 0.5) / BINS).alias("x")) for q, name in ((0.25, "lo"), (0.5, "mid"), (0.75, "hi"))]
    pick = lambda name, i: F.max(F.when((F.col("dim") == i) & (F.col("name") == name), F.col("x")))
    at = parts[0].union(parts[1]).union(parts[2]).groupBy("key").agg(
        *[pick("mid", i).alias(f"m_{i}") for i in n], *[((pick("hi", i) - pick("lo", i)) / 1.349).alias(f"w_{i}") for i in n])
    none = {f"s_{i}{j}": F.lit(0.0) for i in n for j in range(i + 1)}
    wide = none | {f"s_{i}{i}": F.col(f"w_{i}") * F.col(f"w_{i}") for i in n}
    # The first start has spreads alike but for the floors, the second the quartiles', the third those of all rows.
    made = [_cholesky(at.withColumns(none).withColumn("start", F.lit(0))), _cholesky(at.withColumns(wide).withColumn("start", F.lit(1)))]
    out = stash(made[0].unionByName(made[1]).unionByName(_cholesky(_moments(rows, ["key"]).withColumn("start", F.lit(2)))), "start")
    discard(counts)
    return out


def _beside(rows: DataFrame, small: DataFrame, on: list[str], size: int, how: str = "inner") -> DataFrame:
    return rows.join(F.broadcast(small) if size <= MOST_BROADCAST else small, on, how)


def _step(rows: DataFrame, now: DataFrame) -> DataFrame:
    """One concentration step of each group and start: the closest share of rows gives the next mean and covariance."""
    size = now.count()
    log_bin = F.floor(F.log(F.col("d2") + 1e-9) * LOG_BINS).cast("int")
    near = _distance(_beside(rows, now, ["key"], size)).select("key", "start", log_bin.alias("bin"))
    edge = _quantile_bins(near.groupBy("key", "start", "bin").agg(F.count("*").alias("n")), SHARE).withColumnRenamed("bin", "edge")
    both = _beside(rows, now.join(edge, ["key", "start"]), ["key"], size)
    inside = _distance(both).where(log_bin <= F.col("edge"))
    scaled = {f"s_{i}{j}": F.col(f"s_{i}{j}") * consistency(SHARE) for i in range(len(DIMS)) for j in range(i + 1)}
    return _cholesky(_moments(inside, ["key", "start"]).withColumns(scaled))


def _least(estimates: DataFrame, n: int) -> DataFrame:
    """Of each group the n starts of least determinant."""
    from pyspark.sql import Window as W

    return estimates.withColumn("place", F.row_number().over(W.partitionBy("key").orderBy("det", "start"))).where(F.col("place") <= n).drop("place")


def determinants(rows: DataFrame) -> DataFrame:
    """(key, m_i, l_ij, det): the minimum-covariance-determinant estimate of each group of rows (key, x0 to x3)."""
    now = _starts(rows)
    for i in range(FIRST):
        old, now = now, stash(_step(rows, now) if i < FIRST - 1 else _least(_step(rows, now), BEST), "step")
        discard(old)
    done: list[DataFrame] = []
    written: list[DataFrame] = []
    for i in range(MOST_STEPS):
        before = now.select("key", "start", F.col("det").alias("was"))
        step = stash(_step(rows, now).join(before, ["key", "start"]), "step")
        discard(now)
        moves = F.col("det") < F.col("was") * (1 - STILL)
        still, now = (step.where(~moves), step.where(moves)) if i < MOST_STEPS - 1 else (step, step.where("false"))
        done.append(still.drop("was"))
        written.append(step)
        now = stash(now.drop("was"), "moving")
        if not now.take(1):
            break
    every = done[0]
    for x in done[1:]:
        every = every.unionByName(x)
    out = stash(_least(every, 1).drop("start"), "estimates")
    discard(now, *written)
    return out


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """One row for each row: id, counts, base_failed, distance (null where base rules fail) and kept."""
    name = lambda c: F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(c).cast("string")))
    source = docs.select(F.col(id_col).alias("rid"), F.col(text_col).cast("string").alias("txt"), name(lang_col).alias("lang"), name(source_col).alias("source"))
    counted = _vector(with_counts(source, "txt")).withColumn("base_failed", base_failed()).drop("txt")
    rows = stash(counted, "counted")
    fit = rows.where("NOT base_failed")
    of_lang, of_both = F.to_json(F.struct("lang")), F.to_json(F.struct("lang", "source"))
    each = fit.select(F.explode(F.array(F.lit("all"), of_lang, of_both)).alias("key"), *DIMS)
    now = determinants(each)
    sizes = each.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST)
    both, lang = sizes.select(F.col("key").alias("k2")), sizes.select(F.col("key").alias("k1"))
    groups = fit.select("lang", "source").distinct().withColumn("b", of_both).withColumn("a", of_lang)
    level = groups.join(both, F.col("b") == F.col("k2"), "left").join(lang, F.col("a") == F.col("k1"), "left").select("lang", "source", F.coalesce("k2", "k1", F.lit("all")).alias("key"))
    estimates = stash(level.join(now.drop("det"), "key"), "groups")
    judged = _distance(_beside(rows, estimates, ["lang", "source"], estimates.count(), "left"))
    discard(now)
    distance = F.when(~F.col("base_failed"), F.col("d2"))
    return judged.select(
        F.col("rid").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        distance.alias("distance"), (~F.col("base_failed") & (F.col("d2") <= cutoff)).alias("kept"),
    )
