"""The queries of this subpackage, one for each operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm import bpe, byte_cnn, decontaminate, html_extract, jaccard_join, outliers, shuffle_shards, substring, token_counts, url_filter
from tessel.llm.common import table
from tessel.llm.url_sql import url_sql


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), with_ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", decontaminate.contaminated().alias("contaminated"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens", "score")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


#: Verdict, host, path.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    outcomes = url_filter.matched_outcomes(pages, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return _judged(url_filter.judge(pages, outcomes, URL_RULES))


def _judged(verdicts: DataFrame) -> DataFrame:
    return verdicts.select("page_id", "host", "path", "rule", "verdict", F.round("rate", 6).alias("rate"), F.round("upper", 6).alias("upper"))


#: Made outcomes that differ by host: of pages of hosts for mobile readers one in five is good, of others six in seven.
MADE = "CASE WHEN {host} LIKE 'm.%' THEN CASE WHEN page_id % 5 = 0 THEN 1 ELSE 0 END WHEN page_id % 7 = 0 THEN 0 ELSE 1 END"


def url_filter_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The URL filter with made outcomes: in the test tables' own ones no host is bad, here the bound decides."""
    pages = table(spark, sf_dir, "pages")
    outcomes = url_filter.with_site(pages).select("url", F.expr(MADE.format(host="host")).alias("good"))
    return _judged(url_filter.judge(pages, outcomes, URL_RULES))


def op7_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = outliers.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_shuffle_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    slim = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    dealt = shuffle_shards.shuffle_shards(slim, shards=8)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return byte_cnn.classify(docs, byte_cnn.fit(docs, table(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.dedup_substrings(table(spark, sf_dir, "documents"), with_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extract": op1_html_extract,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_decontaminate": op3_decontaminate,
    "op4_token_counts": op4_token_counts,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_url_filter": op6_url_filter,
    "op7_outliers": op7_outliers,
    "op8_shuffle_shards": op8_shuffle_shards,
    "op9_byte_cnn": op9_byte_cnn,
    "op10_substring_dedup": op10_substring_dedup,
    "url_filter_case": url_filter_case,
}

#: DuckDB SQL where SQL can express the whole operator and stays fast on whole tables.
ORACLES: dict[str, str] = {
    "op6_url_filter": url_sql(URL_RULES),
    "url_filter_case": url_sql(URL_RULES, f"SELECT *, {MADE.format(host='host')} AS good FROM dom"),
}
