"""URL filters: explicit rules first, then empirical-Bayes reputation of hosts.

Labelled outcomes of pages (good or not) are counted for each host and shrunk by beta-binomial priors: a suffix's rate
towards the rate of all, a registered domain's towards its suffix's, a host's towards its domain's. How strongly is
estimated at each level from the spread of rates around their parents' (method of moments). A host is blocked if even the
upper bound of its posterior rate lies below the level at which a good page's odds are a ``WORSE``-th of those of all pages,
so what is blocked is credibly worse than the rest, in crawls of many good pages as in those of few; a host without outcomes
has its domain's posterior mean.

Counts are pre-aggregated, so a host with a third of all pages is one row after the first stage. The hosts' table is
broadcast while its counted size allows, else joined by a shuffle whose skewed keys the planner splits.

Defined cases: a null url or one without ``://`` has an empty host and path, fits no rule and is judged by the rate of all;
null outcomes are not counted; equal rows count each and get equal results; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.sources.store import discard, stash

#: How many times worse than all pages' odds a blocked host's are at least; standard deviations from mean to bound.
WORSE, BOUND = 2.0, 1.96
#: Least and greatest strength of a prior, in pages.
WEAK, STRONG = 2.0, 500.0
#: Hosts (some 100 bytes each) that may be broadcast.
MOST_BROADCAST = 100_000

Rule = tuple[str, str, str]  # verdict, host, path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From behind the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def bare(host: Column) -> Column:
    """A host without user, port and closing dot."""
    return F.regexp_replace(host, r"\A.*@|:[0-9]*\z|\.\z", "")


def suffix_of(host: Column) -> Column:
    """The last label, or the last two where a country's label follows a common second one; an address is its own."""
    two = F.regexp_extract(host, r"((?:ac|co|com|edu|gov|net|org)\.[a-z]{2})\z", 1)
    one = F.regexp_extract(host, r"([^.]*)\z", 1)
    return F.when(_address(host), host).when((two != "") & (host != two), two).otherwise(one)


def _address(host: Column) -> Column:
    return host.rlike(r"\A[0-9.]+\z|\A\[")


def domain_of(host: Column, suffix: Column) -> Column:
    """The suffix and one label more, if there is one."""
    front = F.expr("left(bare, length(bare) - length(suffix))")
    label = F.regexp_extract(front, r"([^.]+)\.\z", 1)
    return F.when(_address(host) | (label == ""), host).otherwise(F.concat(label, F.lit("."), suffix))


def with_site(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host, path, bare, suffix, domain."""
    url = F.col(url_col)
    df = df.withColumn("host", host_of(url)).withColumn("path", path_of(url)).withColumn("bare", bare(F.col("host")))
    df = df.withColumn("suffix", suffix_of(F.col("bare")))
    return df.withColumn("domain", domain_of(F.col("bare"), F.col("suffix")))


def rule_columns(rules: list[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule, like ``net/``, and its verdict; null if none fits. Of equals the first in the list wins."""
    name = verdict = F.lit(None).cast("string")
    order = sorted(range(len(rules)), key=lambda i: (len(rules[i][1] + rules[i][2]), -i))
    for i in order:
        what, host, path = rules[i]
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name, verdict = F.when(fits, F.lit(host + path)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def _strength(children: DataFrame, rate: str) -> DataFrame:
    """One row: the prior's strength, from children's counts s of n around their parents' rates."""
    p, x = F.col(rate), F.col("s") / F.col("n")
    spread = p * (1 - p)
    got = children.where("n > 0").agg(F.sum(F.col("n") * (x - p) * (x - p) - spread).alias("over"), F.sum(spread * (F.col("n") - 1)).alias("room"))
    rho = F.when(F.coalesce("room", F.lit(0.0)) > 0, F.col("over") / F.col("room")).otherwise(0.0)
    rho = F.least(F.greatest(rho, F.lit(1 / (STRONG + 1))), F.lit(1 / (WEAK + 1)))
    return got.select(((1 - rho) / rho).alias("strength"))


def reputations(outcomes: DataFrame, hosts: DataFrame) -> DataFrame:
    """From outcomes (host, good 0/1) and all hosts (host, domain, suffix): host, rate, upper, and the rate of all (p_all).

    Each level's strength is one number, so these three are collected.
    """
    counts = outcomes.where("good is not null").groupBy("host").agg(F.sum("good").cast("double").alias("s"), F.count("*").cast("double").alias("n"))
    base = stash(hosts.join(counts, "host", "left").fillna(0.0, ["s", "n"]), "hosts")
    whole = base.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    p0 = ((whole["s"] or 0.0) + 1) / ((whole["n"] or 0.0) + 2)
    level, rate = base.withColumn("p_all", F.lit(p0)), "p_all"
    for unit in ("suffix", "domain"):
        up = level.groupBy(unit).agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.max(rate).alias(rate))
        k = _strength(up, rate).first()["strength"]
        shrunk = up.select(unit, ((k * F.col(rate) + F.col("s")) / (k + F.col("n"))).alias(f"p_{unit}"))
        level, rate = level.join(shrunk, unit), f"p_{unit}"
    k = _strength(level, rate).first()["strength"]
    a, b = k * F.col(rate) + F.col("s"), k * (1 - F.col(rate)) + F.col("n") - F.col("s")
    mean = a / (a + b)
    sd = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    out = stash(level.select("host", mean.alias("rate"), F.least(mean + BOUND * sd, F.lit(1.0)).alias("upper"), "p_all"), "reputations")
    discard(base)
    return out


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", worse: float = WORSE) -> DataFrame:
    """One row for each page: id, host, path, rule, verdict, rate and upper bound of its host.

    outcomes: (url, good) with good 1, 0 or null.
    """
    name, fixed = rule_columns(rules)
    sites = with_site(pages.select(F.col(id_col).alias("rid"), F.col(url_col).cast("string").alias("url")))
    known = with_site(outcomes.select(F.col("url").cast("string").alias("url"), F.col("good").cast("int").alias("good")))
    hosts = sites.select("host", "domain", "suffix").union(known.select("host", "domain", "suffix")).distinct()
    table = reputations(known.select("host", "good"), hosts)
    table = F.broadcast(table) if table.count() <= MOST_BROADCAST else table
    level = F.col("p_all") / (F.col("p_all") + worse * (1 - F.col("p_all")))
    by_rate = F.when(F.col("upper") < level, F.lit("block")).otherwise(F.lit("allow"))
    return sites.join(table, "host").select(F.col("rid").alias(id_col), "host", "path", name.alias("rule"), F.coalesce(fixed, by_rate).alias("verdict"), "rate", "upper")


def matched_outcomes(pages: DataFrame, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, good): a page's outcome is the quality label of the documents whose letters and digits its article has.

    Good if at least half of these labels are 1; pages that match no labelled document have no outcome and are left out.
    """
    letters = lambda c: F.regexp_replace(c, r"[^\p{L}\p{N}]+", "")
    digest = lambda c: F.sha2(letters(c), 256)
    marks = labels.where("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").alias("lid"), F.col("quality").alias("q"))
    texts = docs.select(F.col("doc_id").alias("did"), digest(F.coalesce("text", F.lit(""))).alias("digest"))
    good = texts.join(marks, F.col("did") == F.col("lid")).groupBy("digest").agg((2 * F.sum("q") >= F.count("*")).cast("int").alias("good"))
    article = F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<article\b[^>]*>(?:\s*<h1\b.*?</h1\s*>)?(.*?)</article\s*>", 1)
    plain = F.regexp_replace(article, r"(?s)<!--.*?-->|<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;|&#x27;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        plain = F.regexp_replace(plain, entity, char)
    found = pages.select("url", digest(plain).alias("digest")).where(F.col("digest") != F.sha2(F.lit(""), 256))
    return found.join(good, "digest").select("url", "good")
