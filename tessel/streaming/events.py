"""Event-time streams: windows, sessions, de-duplication, joins and state; each also runs to its end over stored files.

Timestamps without zone cannot carry a watermark, so they are cast first. Results of a finished run go through
``foreachBatch`` to the shared folder and are read back, so a run may be stopped and taken up again from its checkpoint.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessel.session import ship
from tessel.sources.store import shared_dir


def open_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int = 1000) -> DataFrame:
    """A stored table as a stream of files."""
    ship(spark)
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/{name}.parquet*")


def run_to_end(stream: DataFrame, mode: str, checkpoint: str | None = None) -> DataFrame:
    """All output of a stream over the files that are there now. In ``complete`` mode the last batch stands for all."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/tessel/stream-{uuid.uuid4().hex}"
    schema = stream.schema

    def sink(batch: DataFrame, number: int) -> None:
        to = f"{base}/out" if mode == "complete" else f"{base}/out/b={number}"
        batch.write.mode("overwrite").parquet(to)  # a repeated batch replaces itself

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint or f"{base}/checkpoint").foreachBatch(sink).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{base}/out")


def event_time(df: DataFrame, column: str = "ts", late: str = "1 day") -> DataFrame:
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def tumbling(df: DataFrame, keys: list[str], value: str, size: str, slide: str | None = None, column: str = "ts") -> DataFrame:
    """(start, keys.., n, total) of tumbling or, with ``slide``, overlapping windows."""
    w = F.window(column, size, slide) if slide else F.window(column, size)
    return df.groupBy(w, *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(df: DataFrame, keys: list[str], gap: str, column: str = "ts") -> DataFrame:
    """(keys.., start, end, n) of windows that a pause of ``gap`` closes."""
    return df.groupBy(F.session_window(column, gap), *keys).agg(F.count("*").alias("n")).select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """First rows of their keys within the watermark."""
    return df.dropDuplicatesWithinWatermark(keys)


def running_state(df: DataFrame, key: str, step: Callable[[Any, str, float], Any], start: Any, column: str = "event_type", value: str = "value", order: str = "ts") -> DataFrame:
    """(key, n, state): a state of each key that each event moves on, in order of time within a batch."""
    kind = df.schema[key].dataType.simpleString()

    def move(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, now = state.get if state.exists else (0, start)
        rows = pd.concat(list(parts)).sort_values(order, kind="stable")  # one key's rows of one batch
        for name, x in zip(rows[column], rows[value], strict=True):
            n, now = n + 1, step(now, name, x)
        state.update((n, now))
        yield pd.DataFrame({key: [k[0]], "n": [n], "state": [now]})

    return df.groupBy(key).applyInPandasWithState(move, f"{key} {kind}, n long, state double", "n long, state double", "update", GroupStateTimeout.NoTimeout)
