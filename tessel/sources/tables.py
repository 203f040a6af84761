"""Scans and sinks: Parquet tables, JSON lines, one JSON file for each entity, id lists, logs, reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessel.session import ship


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table; filters and column choices reach the scan."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines by an explicit schema; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def read_entities(spark: SparkSession, glob: str, schema: StructType | str) -> DataFrame:
    """One JSON file for each entity, with the file's path in ``file``."""
    return spark.read.schema(schema).option("multiLine", True).json(glob).withColumn("file", F.col("_metadata.file_path"))


def seeds_in_names(df: DataFrame, path: str = "file") -> DataFrame:
    """Adds ``name`` and ``seed`` from file names ``<name>_s<seed>.json``; other files are left out."""
    base = F.element_at(F.split(path, "/"), -1)
    pattern = r"^(.*)_s([0-9]+)\.json$"
    return df.where(base.rlike(pattern)).withColumn("name", F.regexp_extract(base, pattern, 1)).withColumn("seed", F.regexp_extract(base, pattern, 2).cast("int"))


def read_ids(spark: SparkSession, path: str, name: str = "id") -> DataFrame:
    """A plain list of ids, one on a line, as a filter set."""
    return spark.read.text(path).select(F.trim("value").alias(name)).where(F.col(name) != "").distinct()


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: file, value."""
    return spark.read.option("wholetext", True).text(path).withColumn("file", F.col("_metadata.file_path"))


def key_values(df: DataFrame, text: str, names: list[str]) -> DataFrame:
    """Integers from ``name=123`` in a text, null where absent; the first of each name."""
    for n in names:
        found = F.regexp_extract(text, rf"\b{n}=([0-9]+)", 1)
        df = df.withColumn(n, F.when(found != "", found.cast("long")))
    return df


def write_splits(df: DataFrame, path: str, split: str = "split", form: str = "parquet") -> None:
    """One folder for each split; refuses to write where something is."""
    df.write.mode("errorifexists").partitionBy(split).format(form).save(path)


def write_report(summary: DataFrame, path: str) -> None:
    """A small table as one JSON document on the driver's disk."""
    rows = [r.asDict(recursive=True) for r in summary.collect()]
    with open(path, "x", encoding="utf-8") as f:
        json.dump(rows, f, ensure_ascii=False, indent=1, default=str)


def markdown(summary: DataFrame) -> str:
    """A small table as Markdown."""
    cols = summary.columns
    lines = ["| " + " | ".join(cols) + " |", "|" + "---|" * len(cols)]
    lines += ["| " + " | ".join("" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v) for v in r) + " |" for r in summary.collect()]
    return "\n".join(lines)


def content_digest(df: DataFrame) -> str:
    """A digest of a table's rows that neither their order nor the files' layout changes.

    Row digests are summed in 32-bit parts, so nothing is sorted or gathered.
    """
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).alias(f"p{i}") for i in range(8)]
    got = df.agg(F.count("*").alias("n"), *parts).first()
    return f"{got['n']}-" + "".join(f"{int(got[f'p{i}'] or 0) % (1 << 32):08x}" for i in range(8))
