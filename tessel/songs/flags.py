"""Flags of songs that look wrong, and the reasons that follow from them. They change no song."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.songs import model
from tessel.songs.theory import canonical_key, key_table, pitch_of

# Semitones above the root for each chord suffix.
TONES = {
    "": [0, 4, 7], "m": [0, 3, 7], "7": [0, 4, 7, 10], "maj7": [0, 4, 7, 11], "m7": [0, 3, 7, 10], "dim": [0, 3, 6], "aug": [0, 4, 8], "sus4": [0, 5, 7], "sus2": [0, 2, 7],
    "dim7": [0, 3, 6, 9], "m7b5": [0, 3, 6, 10], "6": [0, 4, 7, 9], "m6": [0, 3, 7, 9], "9": [0, 4, 7, 10, 2], "maj9": [0, 4, 7, 11, 2], "m9": [0, 3, 7, 10, 2], "mM7": [0, 3, 7, 11],
    "7sus4": [0, 5, 7, 10], "5": [0, 7],
}
ROOTS = [letter + sign for letter in "ABCDEFG" for sign in ("", "#", "b")]


def chord_table(spark) -> DataFrame:
    """(symbol, root, tones): pitch classes of the 21 roots' chords with each suffix, without basses."""
    rows = [(name + suffix, pitch_of(name), [(pitch_of(name) + t) % 12 for t in tones]) for name in ROOTS for suffix, tones in TONES.items()]
    return spark.createDataFrame(rows, "symbol string, root int, tones array<int>")


def _share(part, whole):
    """Part of a whole to four digits, null where there is no whole."""
    return F.round(F.try_divide(part, whole), 4)


def pathology_flags(songs: DataFrame) -> DataFrame:
    """One row for each song: its 17 flags and measures. Shares are null where nothing can be counted."""
    spark = songs.sparkSession
    tones = F.broadcast(chord_table(spark))  # 399 rows
    keys = F.broadcast(key_table(spark).select("key", "scale"))  # 24 rows
    scales = songs.select("song_id", canonical_key(F.col("key")).alias("key")).join(keys, "key", "left").select("song_id", "scale")
    named = lambda df, c: df.withColumn("symbol", F.split(c, "/")[0]).join(tones, "symbol", "left")
    heard = named(model.chord_at_notes(songs), F.col("chord")).join(scales, "song_id")
    took, inside = F.col("duration"), lambda items, x: F.when(F.array_contains(items, x), F.col("duration")).otherwise(0)
    words = F.coalesce(F.size("lyric"), F.lit(0))
    pitch = F.pmod("pitch", F.lit(12)).cast("int")
    of_notes = heard.groupBy("song_id").agg(
        F.count("*").alias("_count"), F.sum(words).alias("syllables"), F.count_if(words > 1).alias("_many"), F.count_if((words == 0) & ~F.col("melisma")).alias("_none"),
        (F.max("pitch") - F.min("pitch")).alias("pitch_range"), _share(F.sum(F.when(F.col("scale").isNotNull(), inside(F.col("scale"), pitch))), F.sum(took)).alias("melody_in_key_frac"),
        _share(F.sum(F.when(F.col("root").isNotNull(), inside(F.col("tones"), pitch))), F.sum(F.when(F.col("root").isNotNull(), took))).alias("chord_tone_frac"),
    )
    rooted = named(model.chords(songs), F.col("symbol")).where(F.col("root").isNotNull()).join(scales, "song_id").where(F.col("scale").isNotNull())
    of_chords = rooted.groupBy("song_id").agg(_share(F.sum(inside(F.col("scale"), F.col("root"))), F.sum(took)).alias("_chords"))
    many = lambda c, test: F.size(F.filter(c, test))
    beats, bars = F.aggregate("bar_beats", F.lit(0), lambda a, b: a + b), F.greatest(F.size("bar_beats"), F.lit(1))
    x = songs.join(of_notes, "song_id", "left").join(of_chords, "song_id", "left")
    notes = F.coalesce("_count", F.lit(0))
    return x.select(
        "song_id", many("sections", lambda s: s["num_bars"] <= 1).alias("tiny_sections"), many("sections", lambda s: s["num_bars"] > 32).alias("long_sections"), "tempo_bpm",
        ((F.col("tempo_bpm") >= 180) & (notes / F.greatest(beats, F.lit(1)) < 0.55)).alias("double_time_suspect"), (F.col("tempo_bpm") < 60).alias("half_time_suspect"),
        F.round(many("bar_beats", lambda b: b != F.col("meter_num")) / bars, 4).alias("irregular_bar_frac"), "melody_in_key_frac",
        F.when(notes > 0, F.col("_chords")).alias("chord_root_in_key_frac"), F.col("meta")["key_agreement"].alias("key_agreement"), F.round(notes / bars, 3).alias("notes_per_bar"),
        F.round(F.coalesce("_many", F.lit(0)) / F.greatest(notes, F.lit(1)), 4).alias("multi_syllable_note_frac"), F.round(F.coalesce("_none", F.lit(0)) / F.greatest(notes, F.lit(1)), 4).alias("wordless_note_frac"),
        F.coalesce("syllables", F.lit(0)).alias("syllables"), "chord_tone_frac", F.coalesce("pitch_range", F.lit(0)).alias("pitch_range"),
        F.size("sections").alias("sections"), F.size("bar_beats").alias("bars"),
    )


def pathology_reasons(flags: DataFrame) -> DataFrame:
    """(song_id, reasons): what is clearly wrong with each song, in fixed order."""
    tests = {
        "double_time_suspect": F.col("double_time_suspect"), "section_over_32_bars": F.col("long_sections") > 0, "irregular_bars_over_25pct": F.col("irregular_bar_frac") > 0.25,
        "melody_in_key_under_70pct": F.col("melody_in_key_frac") < 0.7, "aligner_cramming_over_10pct": F.col("multi_syllable_note_frac") > 0.1,
        "implausible_note_density": ~F.col("notes_per_bar").between(1.0, 9.0), "pitch_range_over_3_octaves": F.col("pitch_range") > 36,
    }
    return flags.select("song_id", F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in tests.items()])).alias("reasons"))
