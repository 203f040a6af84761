"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; also makes the package importable for Python workers."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def same(a: Column, b: Column) -> Column:
    """Null-safe equality."""
    return a.eqNullSafe(b)


def rows_by(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just the id and the text, under fixed names, so no other column can clash."""
    return df.select(F.col(id_col).alias("rid"), F.col(text_col).cast("string").alias("txt"))


def text_key() -> Column:
    """With ``rid`` it tells rows apart that share an id but not a text; equal rows are interchangeable."""
    return F.xxhash64("txt")
