"""Tables cut out of a plan's lineage, in the folder that a cluster names for checkpoints.

Operators discard what they need no more before they return. What a returned DataFrame still reads stays until the
application ends, when the file system deletes it, or until ``clear`` is called once results are written.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; in local mode, where it may be unset, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir is unset: executors and driver need a folder that they share")
    own = getattr(spark.sparkContext, "_tessel_dir", None)
    if own is None:
        folder = tempfile.mkdtemp(prefix="tessel-shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        own = f"file://{folder}"
        spark.sparkContext._tessel_dir = own
    return own


def _at(spark: SparkSession, path: str):
    """The file system of a path, and the path, as the JVM has them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: its lineage is cut, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessel/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    files, at = _at(spark, path)
    files.deleteOnExit(at)
    _left(spark).add(path)
    out = spark.read.schema(schema).parquet(path)
    out._tessel_path = path
    return out


def _left(spark: SparkSession) -> set[str]:
    """Paths that ``stash`` wrote and nothing has deleted yet, of this application."""
    context = spark.sparkContext
    if not hasattr(context, "_tessel_left"):
        context._tessel_left = set()
    return context._tessel_left


def discard(*frames: DataFrame) -> None:
    """Delete what ``stash`` wrote; a frame that it did not write is left alone."""
    for df in frames:
        path = getattr(df, "_tessel_path", None)
        if path:
            _remove(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete all that ``stash`` wrote in this application: for long sessions, when no result is still to be computed."""
    for path in list(_left(spark)):
        _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    files, at = _at(spark, path)
    files.delete(at, True)
    files.cancelDeleteOnExit(at)
    _left(spark).discard(path)
