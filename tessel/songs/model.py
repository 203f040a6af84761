"""Songs taken apart into rows: bars, sections, notes in sections, chords at notes, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessel.operators import intervals as iv
from tessel.operators import sequence as sq
from tessel.songs.schemas import TICKS_PER_BEAT

S = ["song_id"]


def total_ticks() -> Column:
    return F.aggregate("bar_beats", F.lit(0), lambda a, b: a + b) * TICKS_PER_BEAT


def bar_starts() -> Column:
    """First tick of each bar and, last, the song's end: sums of all bars before."""
    grown = F.aggregate("bar_beats", F.array(F.lit(0)), lambda a, b: F.concat(a, F.array(F.element_at(a, -1) + b * TICKS_PER_BEAT)))
    return grown


def bars(songs: DataFrame) -> DataFrame:
    """(song_id, bar, beats, start, end)."""
    x = songs.select("song_id", F.posexplode("bar_beats").alias("bar", "beats")).withColumn("_t", F.col("beats") * TICKS_PER_BEAT)
    x = sq.prefix_sum(x, S, ["bar"], "_t", "start").withColumn("end", F.col("start") + F.col("_t"))
    return x.select("song_id", "bar", "beats", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))


def sections(songs: DataFrame) -> DataFrame:
    """(song_id, section, label, start_bar, num_bars, start, end) with ticks."""
    x = songs.select("song_id", bar_starts().alias("_b"), F.posexplode("sections").alias("section", "s"))
    last = F.least(F.col("s.start_bar") + F.col("s.num_bars"), F.size("_b") - 1)
    return x.select("song_id", "section", "s.*", F.get("_b", F.col("s.start_bar")).alias("start"), F.get("_b", last).alias("end"))


def notes(songs: DataFrame) -> DataFrame:
    """(song_id, note, onset, duration, pitch, lyric, melisma, line, offset)."""
    x = songs.select("song_id", F.posexplode("notes").alias("note", "n")).select("song_id", "note", "n.*")
    return x.withColumn("offset", F.col("onset") + F.col("duration"))


def chords(songs: DataFrame) -> DataFrame:
    x = songs.select("song_id", F.posexplode("chords").alias("chord", "c")).select("song_id", "chord", "c.*")
    return x.withColumn("offset", F.col("onset") + F.col("duration"))


def notes_in_sections(songs: DataFrame) -> DataFrame:
    """Each note with the section that holds its onset."""
    at = sections(songs).select("song_id", "section", "label", F.col("start").alias("a"), F.col("end").alias("b"))
    return iv.range_join(notes(songs), at, S, "onset", "a", "b", 64 * TICKS_PER_BEAT).drop("a", "b")


def chord_at_notes(songs: DataFrame) -> DataFrame:
    """Each note with the chord that sounds at its onset, null if none does."""
    c = chords(songs).select("song_id", "onset", F.col("offset").alias("stop"), "symbol")
    found = iv.asof_backward(notes(songs), c, S, "onset", ["stop", "symbol"], prefix="chord_")
    return found.withColumn("chord", F.when(F.col("onset") < F.col("chord_stop"), F.col("chord_symbol"))).drop("chord_onset", "chord_stop", "chord_symbol")


def normalized_chords(songs: DataFrame) -> DataFrame:
    """(song_id, onset, symbol, duration): see ``intervals.normalize``."""
    x = songs.select("song_id", total_ticks().alias("_all"), F.posexplode("chords").alias("_i", "c")).select("song_id", "_all", "_i", "c.onset", "c.symbol")
    return iv.normalize(x, S, "onset", "symbol", F.col("_all"), "_i")


def note_events(songs: DataFrame, pulses: int = 480) -> DataFrame:
    """Note on and off events in time order with delta times, in MIDI ticks; offs come first at one time."""
    scale = pulses // TICKS_PER_BEAT
    x = notes(songs).select("song_id", "note", "pitch", (F.col("onset") * scale).alias("a"), (F.col("offset") * scale).alias("b"))
    return iv.sweep(x, S, "a", "b")


def paired_notes(events: DataFrame, pulses: int = 480) -> DataFrame:
    """Notes from events: each on with the next off of its pitch."""
    w = W.partitionBy("song_id", "pitch").orderBy("at", "on", "seq")
    scale = pulses // TICKS_PER_BEAT
    x = events.withColumn("_off", F.lead("at").over(w)).withColumn("_kind", F.lead("on").over(w)).where((F.col("on") == 1) & (F.col("_kind") == 0))
    return x.select("song_id", (F.col("at") / scale).cast("int").alias("onset"), ((F.col("_off") - F.col("at")) / scale).cast("int").alias("duration"), "pitch")


def click_events(songs: DataFrame) -> DataFrame:
    """(song_id, tick, downbeat): one click on each beat."""
    x = bars(songs).select("song_id", "start", F.explode(F.sequence(F.lit(0), F.col("beats") - 1)).alias("beat"))
    return x.select("song_id", (F.col("start") + F.col("beat") * TICKS_PER_BEAT).alias("tick"), (F.col("beat") == 0).alias("downbeat"))


def segments(songs: DataFrame, most_seconds: float) -> DataFrame:
    """Sections cut at bars into the fewest near-equal parts that fit the seconds: label, part, parts, first bar, bars, times."""
    second = 60.0 / F.greatest(F.col("tempo_bpm"), F.lit(1)) / TICKS_PER_BEAT
    x = sections(songs).join(songs.select("song_id", second.alias("_s"), bar_starts().alias("_b")), "song_id")
    x = x.withColumn("_n", F.col("num_bars").cast("long")).withColumn("_first", F.col("start_bar").cast("long")).withColumn("_span", (F.col("end") - F.col("start")) * F.col("_s"))
    cut = iv.split_equal(x, "_first", "_n", "_span", most_seconds)
    tick = lambda bar: F.get("_b", bar.cast("int")) * F.col("_s")
    return cut.select("song_id", "section", "label", "part", "parts", F.col("first").alias("start_bar"), F.col("units").alias("num_bars"), tick(F.col("first")).alias("start_s"), tick(F.col("first") + F.col("units")).alias("end_s"))


def pieces_at_bars(songs: DataFrame) -> DataFrame:
    """Notes cut at barlines: (song_id, note, bar, onset, duration, tie) with tie start, continue, stop or none."""
    n = notes(songs).select("song_id", "note", F.col("onset").alias("x"), F.col("offset").alias("y"))
    b = bars(songs).select("song_id", "bar", "start", "end")
    met = n.join(b, "song_id").where((F.col("x") < F.col("end")) & (F.col("y") > F.col("start")))  # a song's own notes and bars
    onset, stop = F.greatest("x", "start"), F.least("y", "end")
    tie = F.when((onset == F.col("x")) & (stop == F.col("y")), "none").when(onset == F.col("x"), "start").when(stop == F.col("y"), "stop").otherwise("continue")
    return met.select("song_id", "note", "bar", onset.alias("onset"), (stop - onset).alias("duration"), tie.alias("tie"))


def separate_syllables(songs: DataFrame, least: int = 2) -> DataFrame:
    """Notes with several syllables become several notes (each of ``least`` ticks or more); the last takes what is left.

    A note over a section's start stays whole. Gives notes as rows, numbered anew.
    """
    edges = songs.select("song_id", bar_starts().alias("_b"), "sections").select("song_id", F.transform("sections", lambda s: F.get(F.col("_b"), s["start_bar"])).alias("edges"))
    x = notes(songs).join(edges, "song_id")
    crosses = F.exists("edges", lambda e: (F.col("onset") < e) & (e < F.col("offset")))
    k = F.coalesce(F.size("lyric"), F.lit(0))
    parts = F.when((k < 2) | crosses, 1).otherwise(F.least(k, F.greatest(F.lit(1), F.floor(F.col("duration") / least))))
    x = x.withColumn("parts", parts.cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    base = F.floor(F.col("duration") / F.col("parts")).cast("int")
    last = F.col("part") == F.col("parts") - 1
    own = F.when(F.col("parts") == 1, F.col("lyric")).when(last, F.slice("lyric", F.col("part") + 1, F.size("lyric"))).otherwise(F.slice("lyric", F.col("part") + 1, 1))
    out = x.select(
        "song_id", "note", "part", (F.col("onset") + base * F.col("part")).alias("onset"), F.when(last, F.col("duration") - base * F.col("part")).otherwise(base).alias("duration"),
        "pitch", own.alias("lyric"), F.when(F.col("parts") > 1, False).otherwise(F.col("melisma")).alias("melisma"), "line",
    )
    w = W.partitionBy("song_id").orderBy("note", "part")
    return out.withColumn("note", (F.row_number().over(w) - 1).cast("int")).drop("part")


def melody_metrics(songs: DataFrame) -> DataFrame:
    """One row for each song: counts and shares of notes, intervals and lyrics."""
    step = F.lead("pitch").over(sq.by(S, ["onset", "note"])) - F.col("pitch")
    x = notes(songs).withColumn("step", step).withColumn("sung", F.coalesce(F.size("lyric"), F.lit(0)))
    n = F.greatest(F.count("*"), F.lit(1))
    got = x.groupBy("song_id").agg(
        F.count("*").alias("num_notes"), (F.max("pitch") - F.min("pitch")).alias("pitch_range"), F.avg("pitch").alias("pitch_mean"), F.avg(F.abs("step")).alias("mean_abs_interval"),
        (F.count_if(F.abs("step") > 12) / F.greatest(F.count("step"), F.lit(1))).alias("large_leap_frac"), (F.avg("duration") / TICKS_PER_BEAT).alias("mean_duration_beats"),
        (F.count_if(F.pmod("onset", F.lit(2)) == 1) / n).alias("offbeat_16th_frac"), F.sum("sung").alias("syllables_sung"),
        (F.count("*") / F.greatest(F.sum("sung"), F.lit(1))).alias("notes_per_syllable"), (F.count_if("melisma") / n).alias("melisma_note_frac"),
        (F.count_if((F.col("sung") == 0) & ~F.col("melisma")) / n).alias("wordless_note_frac"), (F.count_if(F.col("sung") > 1) / n).alias("multi_syllable_note_frac"),
    )
    return got.join(songs.select("song_id", F.size("bar_beats").alias("num_bars")), "song_id").withColumn("notes_per_bar", F.col("num_notes") / F.greatest("num_bars", F.lit(1)))


def renderable_problems(songs: DataFrame) -> DataFrame:
    """(song_id, problems): reasons why a song cannot be sung; none for a good one."""
    w = sq.by(S, ["onset", "note"])
    x = notes(songs).withColumn("_next", F.lead("onset").over(w))
    per = x.groupBy("song_id").agg(
        F.count_if(F.size("lyric") > 0).alias("sung"), F.count_if(F.col("_next") == F.col("onset")).alias("stacked"), F.count_if((F.col("_next") > F.col("onset")) & (F.col("offset") > F.col("_next"))).alias("overlaps"), F.count_if(F.col("duration") <= 0).alias("empty")
    )
    all_ = songs.select("song_id", F.size("sections").alias("_sections")).join(per, "song_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)) if isinstance(c, str) else c
    return all_.select("song_id", F.array_compact(F.array(
        F.when(zero("sung") == 0, "no lyrics"), F.when(zero("stacked") > 0, F.format_string("%d stacked onsets", "stacked")), F.when(zero("overlaps") > 0, F.format_string("%d overlaps", "overlaps")),
        F.when(zero("empty") > 0, F.format_string("%d notes without length", "empty")), F.when(F.col("_sections") == 0, "no sections"),
    )).alias("problems"))
