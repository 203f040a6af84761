"""Training tasks: prompts, pairs, masked turns, length gates, packing, schedules."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessel.operators.dedup import words

_TURN = ["turn", "role", "text"]


def turn_pairs(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, prompt, completion): a user's turn and the assistant's right behind it."""
    w = W.partitionBy("conv_id").orderBy(*_TURN)
    x = conversations.withColumn("_r", F.lead("role").over(w)).withColumn("completion", F.lead("text").over(w))
    return x.where((F.col("role") == "user") & (F.col("_r") == "assistant")).select("conv_id", "turn", F.col("text").alias("prompt"), "completion")


def _numbered(conversations: DataFrame) -> DataFrame:
    w = W.partitionBy("conv_id")
    return conversations.withColumn("i", F.row_number().over(w.orderBy(*_TURN)).cast("long")).withColumn("n", F.count("*").over(w))


def render(conversations: DataFrame) -> DataFrame:
    """(conv_id, prompt, budget): all turns with ``[role i/n]`` in front, and their characters."""
    line = F.format_string("[%s %d/%d] %s", "role", "i", "n", "text")
    x = _numbered(conversations).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("i", line.alias("line")))).alias("l"), F.sum(F.length("text")).alias("budget"))
    return x.select("conv_id", F.array_join(F.transform("l", lambda v: v["line"]), "\n").alias("prompt"), "budget")


def masked_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, target, prompt, completion): one turn of the later half, chosen by the id's digest, becomes a gap."""
    later = F.filter("l", lambda v: 2 * v["i"] > F.size("l"))
    x = _numbered(conversations).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("i", "text"))).alias("l")).withColumn("c", later)
    pick = F.conv(F.substring(F.sha2(F.col("conv_id").cast("string"), 256), 1, 8), 16, 10).cast("long") % F.size("c")
    x = x.withColumn("target", F.get(F.col("c"), pick.cast("int"))["i"])
    prompt = F.array_join(F.transform("l", lambda v: F.when(v["i"] == F.col("target"), F.lit("<gap>")).otherwise(v["text"])), "\n")
    return x.select("conv_id", "target", prompt.alias("prompt"), F.get(F.col("l"), (F.col("target") - 1).cast("int"))["text"].alias("completion"))


def continuation_start(n: Column) -> Column:
    """First unit to be continued: min(max(ceil(2 n / 3), 1), n - 1)."""
    return F.least(F.greatest(F.ceil(2 * n / 3), F.lit(1)), n - 1)


def over_length(docs: DataFrame, id_col: str, text_col: str, most: int) -> DataFrame:
    """Rows whose words and one end mark exceed ``most``: (id, tokens)."""
    return docs.select(id_col, F.size(words(F.col(text_col))).cast("long").alias("tokens")).where(F.col("tokens") + 1 > most)


def update_plan(worlds: DataFrame, micro_batches: int, tokens_per_update: int, tokens_per_batch: int, epochs: float) -> DataFrame:
    """Steps for each number of workers; an update has the same budget of tokens for all."""
    accum = F.greatest(F.bround(F.lit(float(tokens_per_update)) / (tokens_per_batch * F.col("world")), 0).cast("long"), F.lit(1))
    x = worlds.withColumn("grad_accum", accum).withColumn("per_update", F.col("grad_accum") * F.col("world"))
    x = x.withColumn("steps_per_epoch", F.ceil(F.lit(float(micro_batches)) / F.col("per_update")))
    return x.withColumn("total_steps", F.ceil(F.col("steps_per_epoch") * F.lit(epochs)).cast("long"))


def learning_rate(step: Column, total: int, top: float, warmup: float, floor: float) -> Column:
    """Linear warm-up, then a cosine down to ``floor`` times the top."""
    warm = max(int(total * warmup), 1)
    progress = F.least((step - warm) / float(max(total - warm, 1)), F.lit(1.0))
    return F.when(step < warm, top * (step + 1) / warm).otherwise(top * (floor + (1 - floor) * 0.5 * (1 + F.cos(F.lit(math.pi) * progress))))


def pack(df: DataFrame, group: str, id_col: str, length: str, budget: int) -> DataFrame:
    """(group, id, length, batch): rows in order of length go into batches whose padded size stays within the budget.

    Greedy, so each step depends on the one before: each group is streamed in order through one task, which holds one row.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, batch, rows, longest = None, 0, 0, 0
        for part in parts:
            out = []
            for g, n in zip(part[group], part[length], strict=True):
                if g != now:
                    now, batch, rows, longest = g, 0, 0, 0
                if rows and max(longest, n) * (rows + 1) > budget:
                    batch, rows, longest = batch + 1, 0, 0
                rows, longest = rows + 1, max(longest, n)
                out.append(batch)
            yield part.assign(batch=out)

    sorted_ = df.select(group, id_col, length).repartition(group).sortWithinPartitions(group, length, id_col)
    return sorted_.mapInPandas(work, f"{group} {kinds[group]}, {id_col} {kinds[id_col]}, {length} {kinds[length]}, batch long")
