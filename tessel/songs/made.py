"""Songs made from orders: each order is a song, and its line items are the notes. Whole numbers only, so SQL makes the same.

Notes are in the order of ``ORDER``. Every fifth bar has three beats, the others four; a song has two sections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.operators import sequence as sq
from tessel.songs.schemas import CHORD, LEAD_SHEET, NOTE, SECTION, TICKS_PER_BEAT
from tessel.sources.tables import read

ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
WORDS = ["山", "水", "云"]
KEYS = ["C major", "G major", "A minor", "E minor"]
SYMBOLS = ["C", "G", "Am", "F"]
#: Seconds of a beat in lead sheets.
BEAT = 0.5


def notes(spark: SparkSession, d: str) -> DataFrame:
    """(k, rn, onset, duration, pitch, n_words, word, melisma, line) of each line item."""
    key, order = ["l_orderkey"], ORDER
    x = read(spark, d, "lineitem").select("l_orderkey", *order).withColumn("kind", F.col("l_suppkey") % 5)
    x = x.withColumn("rn", F.row_number().over(sq.by(key, order)) - 1).withColumn("duration", 1 + F.col("l_partkey") % 8).withColumn("_step", F.col("duration") + F.col("l_suppkey") % 4)
    x = x.withColumn("onset", F.sum("_step").over(sq.by(key, ["rn"])) - F.col("duration"))
    x = x.withColumn("melisma", F.coalesce((F.col("kind") == 1) & (F.lag("kind").over(sq.by(key, ["rn"])) >= 2), F.lit(False)))
    n_words = F.when(F.col("kind") < 2, 0).when(F.col("kind") == 2, 2).otherwise(1)
    line = F.when(F.col("melisma") | (n_words > 0), F.floor((F.col("rn") - F.col("melisma").cast("int")) / 4))
    pitch = 55 + (F.col("l_partkey") * 7 + F.col("l_linenumber")) % 24
    return x.select(F.col("l_orderkey").alias("k"), "rn", "onset", "duration", pitch.alias("pitch"), n_words.alias("n_words"), (F.col("l_partkey") % 3).alias("word"), "melisma", line.alias("line"))


def _bar_start(bar: Column) -> Column:
    return 16 * bar - 4 * F.floor(bar / 5)


def _named(names: list[str], at: Column) -> Column:
    return F.get(F.array(*map(F.lit, names)), at.cast("int"))


def songs(spark: SparkSession, d: str) -> DataFrame:
    """Rows of ``SONG``; a song's id is its order's number as text."""
    words = F.when(F.col("n_words") > 0, F.slice(F.array(*[_named(WORDS, (F.col("word") + i) % 3) for i in range(2)]), F.lit(1), F.col("n_words")))
    one = F.struct("onset", "duration", "pitch", words.alias("lyric"), "melisma", "line")
    per = notes(spark, d).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("rn", one.alias("n")))).alias("_n"), F.max(F.col("onset") + F.col("duration")).alias("_last"))
    per = per.withColumn("_bars", F.ceil(F.col("_last") / 12) + 1).withColumn("_half", F.floor(F.col("_bars") / 2)).withColumn("_all", _bar_start(F.col("_bars")))
    bar = lambda b: F.when(b % 5 == 4, 3).otherwise(4)
    chord = lambda j: F.struct((12 * j).alias("onset"), F.least(F.lit(12), F.col("_all") - 12 * j).alias("duration"), _named(SYMBOLS, (F.col("k") + F.floor(j / 2)) % 4).alias("symbol"))
    section = lambda label, a, n: F.struct(F.lit(label).alias("label"), a.alias("start_bar"), n.alias("num_bars"))
    return per.select(
        F.col("k").cast("string").alias("song_id"), F.lit(4).alias("meter_num"), (60 + F.col("k") % 100).cast("int").alias("tempo_bpm"), _named(KEYS, F.col("k") % 4).alias("key"),
        F.transform(F.sequence(F.lit(0), F.col("_bars") - 1), bar).cast("array<int>").alias("bar_beats"),
        F.array(section("verse", F.lit(0), F.col("_half")), section("chorus", F.col("_half"), F.col("_bars") - F.col("_half"))).cast(f"array<{SECTION}>").alias("sections"),
        F.transform("_n", lambda x: x["n"]).cast(f"array<{NOTE}>").alias("notes"), F.transform(F.sequence(F.lit(0), F.ceil(F.col("_all") / 12) - 1), chord).cast(f"array<{CHORD}>").alias("chords"),
        F.lit("zh").alias("language"), F.create_map().cast("map<string,string>").alias("meta"),
    )


def lead_sheets(made: DataFrame) -> DataFrame:
    """Rows of ``LEAD_SHEET`` for made songs: ticks as seconds, each word a syllable, a note linked to the first of its words."""
    second = lambda ticks: ticks * (BEAT / TICKS_PER_BEAT)
    starts = F.transform(F.sequence(F.lit(0), F.size("bar_beats")), lambda b: _bar_start(b).cast("int"))
    x = made.withColumn("_b", starts).withColumn("_i", F.transform("notes", lambda n, i: F.struct(n.alias("n"), i.alias("i"))))
    name = lambda i, j: F.concat(F.lit("s"), i.cast("string"), F.lit("_"), F.lit(j).cast("string"))
    line = lambda n: F.concat(F.lit("l"), n["line"].cast("string"))
    beat = lambda b: F.struct((b * BEAT).alias("time_sec"), F.array_contains("_b", b * TICKS_PER_BEAT).alias("is_downbeat"))

    def syllables(x: Column) -> Column:
        n, begin, stop = x["n"], second(x["n"]["onset"]), second(x["n"]["onset"] + x["n"]["duration"])
        one = lambda t, j: F.struct(name(x["i"], j).alias("syllable_id"), t.alias("text"), t.alias("normalized_text"), begin.alias("start_sec"), stop.alias("end_sec"), line(n).alias("line_id"))
        return F.transform(F.coalesce(n["lyric"], F.array().cast("array<string>")), one)

    def link(x: Column) -> Column:
        unit = F.when(x["n"]["melisma"], name(x["i"] - 1, 0)).when(F.size(x["n"]["lyric"]) > 0, name(x["i"], 0))
        return F.struct(x["i"].cast("string").alias("note_id"), unit.alias("lyric_unit_id"), x["n"]["melisma"].alias("is_lyric_continuation"))

    times = lambda n: [second(v).alias(c) for v, *cs in ((n["onset"], "onset_sec", "onset_grid_time_sec"), (n["onset"] + n["duration"], "offset_sec", "offset_grid_time_sec")) for c in cs]
    note = lambda x: F.struct(x["i"].cast("string").alias("note_id"), *times(x["n"]), x["n"]["pitch"].alias("pitch_midi"))
    chord = lambda c: F.struct(
        c["symbol"].alias("symbol"), F.substring(c["symbol"], 1, 1).alias("root"), F.when(c["symbol"].endswith("m"), "min").otherwise("maj").alias("quality"), F.lit(None).cast("string").alias("bass"), second(c["onset"]).alias("start_sec")
    )
    numbers = F.array_sort(F.array_distinct(F.filter(F.transform("notes", lambda n: n["line"]), lambda v: v.isNotNull())))
    out = x.select(
        "song_id", F.struct(F.lit("4/4").alias("meter"), F.col("tempo_bpm").cast("double").alias("tempo_bpm"), "key", "language", F.lit(None).cast("string").alias("key_agreement")).alias("global"),
        F.transform(F.sequence(F.lit(0), (F.element_at("_b", -1) / TICKS_PER_BEAT).cast("int")), beat).alias("beats"),
        F.transform("sections", lambda s: F.struct(F.when(s["label"] == "chorus", "Hook").otherwise("Vers").alias("label"), second(F.get("_b", s["start_bar"])).alias("start_sec"))).alias("sections"),
        F.flatten(F.transform("_i", syllables)).alias("syllables"),
        F.transform(numbers, lambda v: F.struct(F.concat(F.lit("l"), v.cast("string")).alias("line_id"), F.lit("").alias("text"), F.lit("").alias("normalized_text"))).alias("lines"),
        F.transform("_i", note).alias("melody_notes"), F.struct(F.filter(F.transform("_i", link), lambda v: v["lyric_unit_id"].isNotNull()).alias("items")).alias("note_lyric_alignment"),
        F.transform("chords", chord).alias("recognized_chords"),
    )
    return out.to(out.sparkSession.createDataFrame([], LEAD_SHEET).schema)
