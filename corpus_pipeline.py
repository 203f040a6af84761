"""A pipeline over ``documents``: quality, near copies, repeated passages, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last give back the columns
of ``docs``. Stages call one operator each and join its decisions back on the id and the text, so a row that stands twice is
decided on once and stays twice.

Columns of ``docs`` beyond ``doc_id`` and ``text`` may have any names, a stage's own ones included, and come back as they are
(``n_chars`` is counted anew where a text is cut).

Decisions: rows whose quality score is below the classifier's threshold go; of each class of near copies the row with the
class's id stays (one of equal rows); repeated passages are cut out of texts, whose ``n_chars`` is counted anew, and a text
that nothing is left of stays as an empty one; contaminated rows go. The last stage gives each row's token count and
digests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm import bpe, byte_cnn, decontaminate, jaccard_join, substring
from tessel.llm.common import table
from tessel.session import ship
from tessel.sources.store import stash


def _packed(docs: DataFrame) -> DataFrame:
    """(rid, tk, row): id and a hash of the text, which tell rows apart, and the whole row in one column.

    So no column of ``docs``, whatever its name, meets a column of a stage.
    """
    whole = F.struct(*[docs[f"`{c}`"].alias(c) for c in docs.columns])
    return docs.select(docs["doc_id"].alias("rid"), F.xxhash64(docs["text"]).alias("tk"), whole.alias("row"))


def _unpacked(rows: DataFrame, names: list[str], new: dict[str, Column] | None = None) -> DataFrame:
    """The columns of ``row``, some of them replaced."""
    return rows.select(*[(new or {}).get(c, F.col("row").getField(c)).alias(c) for c in names])


def _identified(docs: DataFrame) -> DataFrame:
    """Ids that tell rows apart even if they share a ``doc_id`` (unless they are equal), and texts."""
    return docs.select(F.struct(docs["doc_id"].alias("doc_id"), F.xxhash64(docs["text"]).alias("tk")).alias("id"), docs["text"].alias("text"))


def _keep(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """(rid, tk, row) of ``docs`` whose ``id`` stands in ``decided``."""
    good = decided.select(F.col("id.doc_id").alias("gid"), F.col("id.tk").alias("gtk")).distinct()
    rows = _packed(docs)
    return rows.join(good, rows["rid"].eqNullSafe(good["gid"]) & (rows["tk"] == good["gtk"]), "left_semi")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the byte-level network does not reject. Scores depend on the text alone, so equal texts share them."""
    net = byte_cnn.fit(docs, table(spark, sf_dir, "labels"))
    scored = byte_cnn.classify(_identified(docs), net, id_col="id")
    return _unpacked(_keep(docs, scored.where("predicted = 1")), docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies: the one with the class's id, and one of rows that are equal in id and text.

    Of the latter it is the one whose other columns come first as JSON. They are pre-aggregated, so many of them are no hot spot.
    """
    ship(spark)
    joined = jaccard_join.jaccard_join(_identified(docs), id_col="id")
    kept = _keep(docs, joined.where(F.col("id").eqNullSafe(F.col("class_id"))))
    rest = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("doc_id", "text")]
    order = F.to_json(F.struct(*rest)) if rest else F.lit("")
    return _unpacked(kept.groupBy("rid", "tk").agg(F.min_by("row", order).alias("row")), docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand elsewhere too; texts that have none stay as they are, byte for byte."""
    ship(spark)
    cut = substring.dedup_substrings(_identified(docs), id_col="id").where("n_removed > 0")
    cut = cut.select(F.col("id.doc_id").alias("gid"), F.col("id.tk").alias("gtk"), "kept_text").dropDuplicates(["gid", "gtk"])
    rows = _packed(docs)
    joined = rows.join(cut, rows["rid"].eqNullSafe(cut["gid"]) & (rows["tk"] == cut["gtk"]), "left")
    changed = F.col("kept_text").isNotNull()
    new = {"text": F.when(changed, F.col("kept_text")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(changed, F.length("kept_text").cast(kind)).otherwise(F.col("row.n_chars"))
    return _unpacked(joined, docs.columns, new)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are not contaminated by the benchmark."""
    found = decontaminate.decontaminate(_identified(docs), table(spark, sf_dir, "benchmark"), id_col="id")
    return _unpacked(_keep(docs, found.where(~decontaminate.contaminated())), docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes."""
    ship(spark)
    return bpe.encode(docs.select(docs["doc_id"], docs["text"]), with_ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_copies),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("byte-level BPE", tokens),
]

#: Trained scores, hashed sketches and tokens are not SQL's to express; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's rows written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
