"""Leaks between splits of songs: exact lyrics, then lyric shingles, then melody shingles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.operators import dedup


def _windows(items: Column, n: int) -> Column:
    """Distinct hashes of n neighbouring items; none where there are fewer."""
    at = F.sequence(F.lit(1), F.greatest(F.size(items) - (n - 1), F.lit(1)))
    return F.when(F.size(items) >= n, F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.slice(items, i, n)))))


def _sung() -> Column:
    return F.flatten(F.transform(F.coalesce("notes", F.array()), lambda x: F.coalesce(x["lyric"], F.array().cast("array<string>"))))


def lyric_shingles(songs: DataFrame, n: int = 6) -> DataFrame:
    """(song_id, shingle): n neighbouring syllables, in the order of notes."""
    sung = songs.select("song_id", _sung().alias("_s"))
    return sung.select("song_id", F.explode(_windows(F.col("_s"), n)).alias("shingle"))


def melody_shingles(songs: DataFrame, n: int = 8) -> DataFrame:
    """(song_id, shingle): n neighbouring pairs of interval and onset step, so a transposed or shifted melody has the same."""
    step = lambda x, i: F.struct((F.get("notes", i + 1)["pitch"] - x["pitch"]).alias("interval"), (F.get("notes", i + 1)["onset"] - x["onset"]).alias("step"))
    heard = songs.select("song_id", F.transform(F.slice("notes", F.lit(1), F.greatest(F.size("notes") - 1, F.lit(0))), step).alias("_m"))
    return heard.select("song_id", F.explode(_windows(F.col("_m"), n)).alias("shingle"))


def resolve(songs: DataFrame, split_col: str, lyric_threshold: float, melody_threshold: float, max_df: int = 100) -> DataFrame:
    """(id, split, reason, match, score) of each held-out song that goes, as dedup.resolve_ranked."""
    base = songs.select(F.col("song_id").alias("id"), F.col(split_col).alias("split"), F.sha2(F.array_join(_sung(), ""), 256).alias("digest"))
    lyric, melody = (sh.withColumnRenamed("song_id", "id") for sh in (lyric_shingles(songs), melody_shingles(songs)))
    return dedup.resolve_ranked(base, "lyrics_exact", [("lyrics_near", lyric, lyric_threshold), ("melody_near", melody, melody_threshold)], max_df)
