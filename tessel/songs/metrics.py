"""Metrics of songs, one row each: tonality, repetition, intervals, conformance to a plan, lyrics, counts of bars left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessel.functions import udfs
from tessel.operators import sequence as sq
from tessel.songs import model
from tessel.songs.theory import canonical_key, key_table

S = ["song_id"]


def share(condition: Column, of: Column | None = None) -> Column:
    """Aggregate: rows that meet a condition over all (or over ``of``), 0 of none."""
    return F.count_if(condition) / F.greatest(F.count("*") if of is None else of, F.lit(1))


def tonality(songs: DataFrame) -> DataFrame:
    """melody_in_key_frac (by duration) and chord_root_in_key_frac; null without a key."""
    keys = F.broadcast(key_table(songs.sparkSession).select("key", "scale"))  # 24 rows
    named = songs.select("song_id", canonical_key(F.col("key")).alias("key")).join(keys, "key", "left").select("song_id", "scale")
    inside = F.array_contains("scale", F.pmod("pitch", F.lit(12)))
    melody = model.notes(songs).join(named, "song_id").groupBy("song_id").agg(F.sum(F.when(inside, F.col("duration")).otherwise(F.when(inside.isNotNull(), 0))).alias("a"), F.sum("duration").alias("b"))
    pitch = F.create_map(*[F.lit(x) for pair in {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}.items() for x in pair])
    sign = F.regexp_extract("symbol", "^[A-G]([#b]?)", 1)
    root = F.pmod(pitch[F.regexp_extract("symbol", "^([A-G])", 1)] + F.when(sign == "#", 1).when(sign == "b", -1).otherwise(0), F.lit(12))
    chord = model.chords(songs).where(F.col("symbol").rlike("^[A-G]")).withColumn("root", root).join(named, "song_id")
    chord = chord.groupBy("song_id").agg(F.avg(F.array_contains("scale", F.col("root")).cast("double")).alias("chord_root_in_key_frac"))
    return melody.join(chord, "song_id", "full").select("song_id", F.try_divide("a", "b").alias("melody_in_key_frac"), "chord_root_in_key_frac")


def bar_signatures(songs: DataFrame) -> DataFrame:
    """(song_id, bar, signature): onsets in the bar, durations and pitches of the notes that begin there, in order."""
    b = model.bars(songs).select("song_id", "bar", F.col("start").alias("a"), F.col("end").alias("z"))
    x = model.notes(songs).join(b, "song_id").where((F.col("onset") >= F.col("a")) & (F.col("onset") < F.col("z")))
    item = F.struct((F.col("onset") - F.col("a")).alias("at"), "duration", "pitch")
    return x.groupBy("song_id", "bar").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("signature"))


def repetition(songs: DataFrame) -> DataFrame:
    """Shares of bars that are distinct, seen before, or equal to the bar before; the longest run of equal bars; 4-grams."""
    sig = bar_signatures(songs)
    w = sq.by(S, ["bar"])
    x = sq.seen_before(sig, S, ["bar"], "signature").withColumn("same", F.coalesce((F.lag("signature").over(w) == F.col("signature")) & (F.lag("bar").over(w) == F.col("bar") - 1), F.lit(False)))
    runs = x.withColumn("run", F.sum((~F.col("same")).cast("int")).over(w)).groupBy("song_id", "run").agg(F.count("*").alias("n")).groupBy("song_id").agg(F.max("n").alias("max_identical_consecutive_bars"))
    base = x.groupBy("song_id").agg(
        (F.count_distinct("signature") / F.greatest(F.count("*"), F.lit(1))).alias("distinct_bar_frac"), share(F.col("seen")).alias("repeated_bar_frac"), share(F.col("same")).alias("consecutive_repeat_bar_frac")
    )
    wn = sq.by(S, ["onset", "note"])
    gram = F.array(*[F.lead("pitch", i).over(wn) for i in range(4)])
    g = model.notes(songs).withColumn("g", gram).where(F.get("g", F.lit(3)).isNotNull()).groupBy("song_id").agg((1 - F.count_distinct("g") / F.count("*")).alias("pitch_4gram_repeat_frac"))
    return base.join(runs, "song_id").join(g, "song_id", "left")


def intervals(songs: DataFrame) -> DataFrame:
    """Shares of melodic steps: repeats, steps (1-2), skips (3-4), leaps (5-12), large ones; durations and offbeats."""
    d = F.abs(F.lead("pitch").over(sq.by(S, ["onset", "note"])) - F.col("pitch"))
    x, n = model.notes(songs).withColumn("d", d), F.count("d")
    return x.groupBy("song_id").agg(
        share(F.col("d") == 0, n).alias("int_repeat_frac"), share(F.col("d").between(1, 2), n).alias("int_step_frac"), share(F.col("d").between(3, 4), n).alias("int_skip_frac"),
        share(F.col("d").between(5, 12), n).alias("int_leap_frac"), share(F.col("d") > 12, n).alias("int_large_frac"), share(F.col("duration") == 1).alias("dur_16th_frac"),
        share(F.col("duration") == 2).alias("dur_8th_frac"), share(F.pmod("onset", F.lit(4)) == 2).alias("offbeat_8th_frac"),
    )


def conformance(songs: DataFrame, wanted: DataFrame) -> DataFrame:
    """How far songs keep to the songs they were asked to follow (same ids)."""
    plan = lambda df: F.transform("sections", lambda s: F.concat_ws(":", s["label"], s["num_bars"].cast("string")))
    field = lambda name: F.transform("sections", lambda s: s[name].cast("string"))
    parts = lambda df, p: df.select("song_id", *[c.alias(p + n) for n, c in {"plan": plan(df), "labels": field("label"), "lens": field("num_bars"), "bars": F.col("bar_beats"), "tempo": F.col("tempo_bpm"), "key": F.col("key"), "meter": F.col("meter_num")}.items()])
    x = parts(songs, "g_").join(parts(wanted, "w_"), "song_id")
    equal = lambda a, b: F.size(F.filter(F.zip_with(a, b, lambda p, q: p.eqNullSafe(q)), lambda v: v))
    num = lambda c: c.cast("double")
    return x.select(
        "song_id", num(F.col("g_plan") == F.col("w_plan")).alias("section_plan_exact"), num(F.col("g_labels") == F.col("w_labels")).alias("section_label_seq_match"),
        num(F.size("g_plan") == F.size("w_plan")).alias("section_count_match"), num(F.col("g_lens") == F.col("w_lens")).alias("section_bars_seq_match"),
        (equal("g_plan", "w_plan") / F.greatest(F.size("w_plan"), F.lit(1))).alias("section_bars_exact_frac"), num(F.size("g_bars") == F.size("w_bars")).alias("bar_count_match"),
        (equal("g_bars", "w_bars") / F.greatest(F.size("w_bars"), F.lit(1))).alias("bar_beats_match_frac"), num(F.col("g_tempo") == F.col("w_tempo")).alias("tempo_match"),
        num(F.col("g_key").eqNullSafe(F.col("w_key"))).alias("key_match"), num(F.col("g_meter") == F.col("w_meter")).alias("meter_match"),
        num(F.size("g_plan") < F.size("w_plan")).alias("fewer_sections_than_requested"), num(F.size("g_plan") > F.size("w_plan")).alias("more_sections_than_requested"),
        (F.size("g_bars") / F.greatest(F.size("w_bars"), F.lit(1))).alias("total_bars_ratio"), num(F.abs(F.size("g_bars") - F.size("w_bars"))).alias("abs_total_bar_error"),
    )


def syllables(songs: DataFrame) -> DataFrame:
    """(song_id, sung): all syllables in order."""
    each = F.transform(F.array_sort("notes", lambda a, b: a["onset"] - b["onset"]), lambda n: F.coalesce(n["lyric"], F.array().cast("array<string>")))
    return songs.select("song_id", F.flatten(each).alias("sung"))


def lyrics(songs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Recall and precision of syllables by their longest common subsequence."""
    x = syllables(songs).join(syllables(wanted).select("song_id", F.col("sung").alias("asked")), "song_id").withColumn("hit", udfs.lcs_length("asked", "sung"))
    recall, precision = F.col("hit") / F.greatest(F.size("asked"), F.lit(1)), F.col("hit") / F.greatest(F.size("sung"), F.lit(1))
    return x.select("song_id", recall.alias("lyric_recall"), precision.alias("lyric_precision"), (F.col("asked") == F.col("sung")).cast("double").alias("lyric_exact"), (1 - recall).alias("lyric_missing_frac"), (1 - precision).alias("lyric_extra_frac"))


def bars_left(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Of texts with marks of bars left: bars with a mark, marks that tell what follows, sections that end on one."""
    lines = texts.select("song_id", F.posexplode(F.split(text_col, "\n")).alias("line", "t"))
    lines = lines.withColumn("section", F.sum(F.col("t").startswith("P:").cast("int")).over(W.partitionBy("song_id").orderBy("line").rowsBetween(W.unboundedPreceding, 0)))
    music = lines.where(~F.col("t").rlike("^[A-Za-z]:|^%|^\\s*$") & (F.col("section") > 0))
    bars = music.select("song_id", "section", "line", F.posexplode(F.split(F.regexp_replace("t", "\\|\\s*$", ""), "\\|")).alias("i", "b"))
    w = W.partitionBy("song_id", "section")
    n = F.count("*").over(w) - F.row_number().over(w.orderBy("line", "i")) + 1
    mark = F.regexp_extract("b", "\\[r:([0-9]+)\\]", 1)
    x = bars.withColumn("left", n).withColumn("mark", F.when(mark != "", mark.cast("long")))
    return x.groupBy("song_id").agg(
        share(F.col("mark").isNotNull()).alias("counter_present_frac"), share(F.col("mark") == F.col("left"), F.count("mark")).alias("counter_self_consistent_frac"),
        (F.count_if((F.col("left") == 1) & (F.col("mark") == 1)) / F.greatest(F.count_if(F.col("left") == 1), F.lit(1))).alias("sections_ending_on_counter_1"),
    )


def reflowed(lines: list[list[str]], donor: list[str]) -> list[list[str]]:
    """A donor's syllables on lines of another song, in proportion to their lengths."""
    total = sum(map(len, lines))
    edges = [0]
    for x in lines:
        edges.append(edges[-1] + len(x))
    cuts = [round(e * len(donor) / total) if total else 0 for e in edges]
    return [donor[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
