"""Requests and prompts: lyric lines of each section, syllable budgets, marks of lines that go on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessel.operators import sequence as sq
from tessel.songs import model

CJK = "\\u3400-\\u9fff\\uf900-\\ufaff"
#: Mark of a lyric line that another section begins or ends.
GOES_ON = "…"


def syllables(text: Column) -> Column:
    """Single ideographs, and runs of anything else but white space."""
    return F.regexp_extract_all(text, F.lit(f"[{CJK}]|[^\\s{CJK}]+"), 0)


def joined(items: Column) -> Column:
    """Syllables as text: spaces, but not between two ideographs."""
    spaced = F.array_join(items, " ")
    # A space between ideographs goes; looking around keeps the neighbours for the next match.
    return F.regexp_replace(spaced, f"(?<=[{CJK}]) (?=[{CJK}])", "")


def lines(songs: DataFrame) -> DataFrame:
    """(song_id, section, part, line, text, n): runs of one lyric line in a section, in order."""
    sung = model.notes_in_sections(songs).where(F.size("lyric") > 0)
    keys = ["song_id", "section"]
    parts = sq.runs(sung, keys, ["onset", "note"], "line", "part")
    each = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("onset", "note", "lyric"))), lambda x: x["lyric"]))
    got = parts.groupBy(*keys, "part", "line").agg(each.alias("_s"))
    return got.select(*keys, "part", "line", joined(F.col("_s")).alias("text"), F.size("_s").alias("n"))


def marked_lines(songs: DataFrame) -> DataFrame:
    """Lines with ``before`` and ``after``: whether they go on from, or into, the next section that has lyrics."""
    w = W.partitionBy("song_id").orderBy("section", "part")
    x = lines(songs)
    other = lambda f, c: f(c).over(w)
    crosses = lambda f: (other(f, "section") != F.col("section")) & (other(f, "line") == F.col("line"))
    return x.withColumn("before", F.coalesce(crosses(F.lag), F.lit(False))).withColumn("after", F.coalesce(crosses(F.lead), F.lit(False)))


def beats_text(songs: DataFrame) -> DataFrame:
    """(song_id, section, beats): run lengths of bars, empty where all have the nominal number of beats."""
    at = model.sections(songs).select("song_id", "section", F.explode(F.sequence(F.col("start_bar"), F.col("start_bar") + F.col("num_bars") - 1)).alias("bar"))
    x = at.join(model.bars(songs).select("song_id", "bar", "beats"), ["song_id", "bar"]).join(songs.select("song_id", "meter_num"), "song_id")
    odd = x.groupBy("song_id", "section").agg(F.bool_and(F.col("beats") == F.col("meter_num")).alias("plain"))
    text = sq.run_length_text(x, ["song_id", "section"], ["bar"], "beats", "runs")
    return odd.join(text, ["song_id", "section"]).select("song_id", "section", F.when(F.col("plain"), "").otherwise(F.concat(F.lit(" | beats "), "runs")).alias("beats"))


def prompts(songs: DataFrame, header: str, closing: str, version: int = 1) -> DataFrame:
    """(song_id, prompt). Version 2 numbers sections; version 3 adds syllable budgets and marks of lines that go on."""
    text = F.col("text")
    if version == 3:
        text = F.concat(F.when(F.col("before"), GOES_ON).otherwise(""), text, F.when(F.col("after"), GOES_ON).otherwise(""))
    of_lines = marked_lines(songs).groupBy("song_id", "section").agg(F.array_sort(F.collect_list(F.struct("part", text.alias("t")))).alias("_l"), F.sum("n").alias("budget"))
    secs = model.sections(songs).join(beats_text(songs), ["song_id", "section"], "left").join(of_lines, ["song_id", "section"], "left")
    count = F.count("*").over(W.partitionBy("song_id"))
    head = F.concat(F.lit("P:"), "label", F.lit(" | "), F.col("num_bars").cast("string"), F.lit(" bars"), F.coalesce("beats", F.lit("")))
    if version >= 2:
        head = F.concat(head, F.lit(" | section "), (F.col("section") + 1).cast("string"), F.lit("/"), count.cast("string"))
    if version == 3:
        n = F.coalesce("budget", F.lit(0))
        head = F.concat(head, F.lit(" | "), n.cast("string"), F.when(n == 1, " syllable").otherwise(" syllables"))
    body = F.array_join(F.concat(F.array(head), F.transform(F.coalesce("_l", F.array().cast("array<struct<part:bigint,t:string>>")), lambda x: x["t"])), "\n")
    per = secs.withColumn("_body", body).groupBy("song_id").agg(F.array_sort(F.collect_list(F.struct("section", "_body"))).alias("_b"))
    top = F.array_compact(F.array(
        F.lit(header), F.concat(F.lit("Language: "), "language"), F.concat(F.lit("Meter: "), F.col("meter_num").cast("string"), F.lit("/4")),
        F.concat(F.lit("Tempo: "), F.col("tempo_bpm").cast("string"), F.lit(" BPM")), F.concat(F.lit("Key: "), F.col("key")), F.lit("Structure:"),
    ))
    whole = F.concat(F.array_join(F.concat(top, F.transform("_b", lambda x: x["_body"])), "\n"), F.lit("\n\n" + closing))
    return songs.join(per, "song_id").select("song_id", whole.alias("prompt"))
