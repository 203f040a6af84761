"""Queries on songs made from orders (``songs.made``): model, metrics, notation, lead sheets, cleaning, sung notes, prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.plans.registry import register
from tessel.songs import flags, lead_sheet, made, metrics, model, notation, prompts, sequential

# The made songs in SQL: n0, n1 and n have the notes, g the songs, b the bars, s the sections, c the chords.
_NOTES = f"""n0 AS (SELECT l_orderkey AS k, l_suppkey % 5 AS kind, 1 + l_partkey % 8 AS duration, l_suppkey % 4 AS gap, 55 + (l_partkey * 7 + l_linenumber) % 24 AS pitch,
    l_partkey % 3 AS word, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(made.ORDER)}) - 1 AS rn FROM lineitem),
n1 AS (SELECT *, CAST(sum(duration + gap) OVER (PARTITION BY k ORDER BY rn) - duration AS BIGINT) AS onset,
    coalesce(kind = 1 AND lag(kind) OVER (PARTITION BY k ORDER BY rn) >= 2, false) AS melisma, CASE WHEN kind < 2 THEN 0 WHEN kind = 2 THEN 2 ELSE 1 END AS words FROM n0),
n AS (SELECT k, CAST(k AS VARCHAR) AS song_id, rn AS note, onset, duration, onset + duration AS stop, pitch, melisma, words, word,
    CASE WHEN melisma OR words > 0 THEN (rn - CAST(melisma AS INT)) // 4 END AS line,
    CASE WHEN words > 0 THEN array_to_string((['{"', '".join(made.WORDS * 2)}'])[word + 1 : word + words], ' ') END AS lyric FROM n1)"""
_SONGS = f"""{_NOTES},
g AS (SELECT *, bars // 2 AS half, 16 * bars - 4 * (bars // 5) AS total, 60.0 / (60 + k % 100) / 4 AS tick FROM (SELECT k, song_id, CAST(ceil(max(stop) / 12.0) AS BIGINT) + 1 AS bars FROM n GROUP BY ALL)),
b AS (SELECT song_id, bar, CASE WHEN bar % 5 = 4 THEN 3 ELSE 4 END AS beats, 16 * bar - 4 * (bar // 5) AS a, 16 * (bar + 1) - 4 * ((bar + 1) // 5) AS z FROM (SELECT song_id, unnest(range(bars)) AS bar FROM g)),
s AS (SELECT song_id, 0 AS section, 'verse' AS label, 0 AS first, half AS bars, 0 AS a, 16 * half - 4 * (half // 5) AS z FROM g
    UNION ALL SELECT song_id, 1, 'chorus', half, bars - half, 16 * half - 4 * (half // 5), total FROM g),
c AS (SELECT song_id, chord, 12 * chord AS a, least(12 * chord + 12, total) AS z, (['{"', '".join(made.SYMBOLS)}'])[(k + chord // 2) % 4 + 1] AS symbol
    FROM (SELECT *, unnest(range((total + 11) // 12)) AS chord FROM g))"""
_ONE_BY_ONE = "song_id, onset, duration, pitch, lyric, melisma"


def _rows(songs: DataFrame) -> DataFrame:
    """A song's notes as rows, with the lyric as text."""
    return model.notes(songs).select("song_id", "onset", "duration", "pitch", F.array_join("lyric", " ").alias("lyric"), "melisma")


@register("song_bars", "W2", f"WITH {_SONGS} SELECT song_id, bar, beats, a AS start_tick, z AS end_tick FROM b")
def song_bars(spark: SparkSession, d: str) -> DataFrame:
    return model.bars(made.songs(spark, d)).withColumnsRenamed({"start": "start_tick", "end": "end_tick"})


@register("song_clicks", "K8", f"WITH {_SONGS} SELECT song_id, a + 4 * beat AS tick, beat = 0 AS downbeat FROM (SELECT song_id, a, unnest(range(beats)) AS beat FROM b)")
def song_clicks(spark: SparkSession, d: str) -> DataFrame:
    return model.click_events(made.songs(spark, d))


@register("song_notes_in_sections", "J4", f"WITH {_SONGS} SELECT song_id, note, section, label FROM n JOIN s USING (song_id) WHERE onset >= a AND onset < z")
def song_notes_in_sections(spark: SparkSession, d: str) -> DataFrame:
    return model.notes_in_sections(made.songs(spark, d)).select("song_id", "note", "section", "label")


@register("song_chord_at_notes", "J3", f"WITH {_SONGS} SELECT n.song_id, note, symbol AS chord FROM n LEFT JOIN c ON c.song_id = n.song_id AND onset >= a AND onset < z")
def song_chord_at_notes(spark: SparkSession, d: str) -> DataFrame:
    return model.chord_at_notes(made.songs(spark, d)).select("song_id", "note", "chord")


@register("song_normalized_chords", "G6", f"""WITH {_SONGS}, kept AS (SELECT song_id, a, symbol, total FROM (SELECT c.*, total, lag(symbol) OVER (PARTITION BY song_id ORDER BY a) AS old FROM c JOIN g USING (song_id))
    WHERE old IS NULL OR old <> symbol) SELECT song_id, a AS onset, symbol, coalesce(lead(a) OVER (PARTITION BY song_id ORDER BY a), total) - a AS duration FROM kept""")
def song_normalized_chords(spark: SparkSession, d: str) -> DataFrame:
    return model.normalized_chords(made.songs(spark, d))


@register("song_events_and_back", "G9, K7", f"WITH {_SONGS} SELECT song_id, onset, duration, pitch FROM n")
def song_events_and_back(spark: SparkSession, d: str) -> DataFrame:
    return model.paired_notes(model.note_events(made.songs(spark, d)))


@register("song_event_deltas", "G9", f"""WITH {_SONGS}, e AS (SELECT song_id, note, 120 * stop AS tick, 0 AS is_on FROM n UNION ALL SELECT song_id, note, 120 * onset, 1 FROM n)
    SELECT song_id, note, tick, is_on, tick - lag(tick, 1, 0) OVER (PARTITION BY song_id ORDER BY tick, is_on, note) AS since FROM e""")
def song_event_deltas(spark: SparkSession, d: str) -> DataFrame:
    return model.note_events(made.songs(spark, d)).select("song_id", "note", F.col("at").alias("tick"), F.col("on").alias("is_on"), "since")


@register("song_pieces_at_bars", "K10", f"""WITH {_SONGS} SELECT song_id, note, bar, greatest(onset, a) AS onset, least(stop, z) - greatest(onset, a) AS duration,
    CASE WHEN onset >= a AND stop <= z THEN 'none' WHEN onset >= a THEN 'start' WHEN stop <= z THEN 'stop' ELSE 'continue' END AS tie FROM n JOIN b USING (song_id) WHERE onset < z AND stop > a""")
def song_pieces_at_bars(spark: SparkSession, d: str) -> DataFrame:
    return model.pieces_at_bars(made.songs(spark, d))


@register("song_separate_syllables", "P18", f"""WITH {_SONGS},
p AS (SELECT n.*, CASE WHEN words < 2 OR (onset < s.a AND s.a < stop) OR duration < 4 THEN 1 ELSE 2 END AS parts FROM n JOIN s ON s.song_id = n.song_id AND section = 1)
    SELECT song_id, onset + part * (duration // parts) AS onset, CASE WHEN part = parts - 1 THEN duration - part * (duration // parts) ELSE duration // parts END AS duration, pitch,
    CASE WHEN parts = 1 THEN lyric ELSE split_part(lyric, ' ', CAST(part AS INT) + 1) END AS lyric, parts = 1 AND melisma AS melisma FROM (SELECT *, unnest(range(parts)) AS part FROM p)""")
def song_separate_syllables(spark: SparkSession, d: str) -> DataFrame:
    return model.separate_syllables(made.songs(spark, d)).select("song_id", "onset", "duration", "pitch", F.array_join("lyric", " ").alias("lyric"), "melisma")


@register("song_melody_metrics", "A7, A9", f"""WITH {_SONGS}, m AS (SELECT *, abs(lead(pitch) OVER (PARTITION BY song_id ORDER BY onset, note) - pitch) AS step FROM n)
    SELECT song_id, count(*) AS num_notes, max(pitch) - min(pitch) AS pitch_range, round(avg(pitch), 6) AS pitch_mean, round(avg(step), 6) AS mean_abs_interval,
    round(count(*) FILTER (WHERE step > 12) / greatest(count(step), 1), 6) AS large_leap_frac, round(avg(duration) / 4, 6) AS mean_duration_beats, round(count_if(onset % 2 = 1) / count(*), 6) AS offbeat_16th_frac,
    CAST(sum(words) AS BIGINT) AS syllables_sung, round(count(*) / greatest(sum(words), 1), 6) AS notes_per_syllable, round(count_if(melisma) / count(*), 6) AS melisma_note_frac,
    round(count_if(words = 0 AND NOT melisma) / count(*), 6) AS wordless_note_frac, round(count_if(words > 1) / count(*), 6) AS multi_syllable_note_frac,
    any_value(bars) AS num_bars, round(count(*) / any_value(bars), 6) AS notes_per_bar FROM m JOIN g USING (song_id) GROUP BY song_id""")
def song_melody_metrics(spark: SparkSession, d: str) -> DataFrame:
    x = model.melody_metrics(made.songs(spark, d))
    return x.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in x.dtypes])


@register("song_intervals", "A7, W1", f"""WITH {_SONGS}, m AS (SELECT *, abs(lead(pitch) OVER (PARTITION BY song_id ORDER BY onset, note) - pitch) AS d FROM n)
    SELECT song_id, {", ".join(f"round(count(*) FILTER (WHERE d BETWEEN {a} AND {b}) / greatest(count(d), 1), 6) AS int_{name}_frac" for name, a, b in [("repeat", 0, 0), ("step", 1, 2), ("skip", 3, 4), ("leap", 5, 12), ("large", 13, 99)])},
    round(count_if(duration = 1) / count(*), 6) AS dur_16th_frac, round(count_if(duration = 2) / count(*), 6) AS dur_8th_frac, round(count_if(onset % 4 = 2) / count(*), 6) AS offbeat_8th_frac FROM m GROUP BY song_id""")
def song_intervals(spark: SparkSession, d: str) -> DataFrame:
    x = metrics.intervals(made.songs(spark, d))
    return x.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in x.dtypes])


@register("song_tonality", "A8, A8a", f"""WITH {_SONGS}, scale(i, inside) AS (VALUES (0, [0, 2, 4, 5, 7, 9, 11]), (1, [7, 9, 11, 0, 2, 4, 6]), (2, [9, 11, 0, 2, 4, 5, 7, 8]), (3, [4, 6, 7, 9, 11, 0, 2, 3])),
melody AS (SELECT song_id, round(sum(CASE WHEN list_contains(inside, pitch % 12) THEN duration ELSE 0 END) / sum(duration), 6) AS melody_in_key_frac FROM n JOIN scale ON i = k % 4 GROUP BY song_id),
root AS (SELECT song_id, round(avg(CASE WHEN list_contains(inside, CASE symbol WHEN 'C' THEN 0 WHEN 'G' THEN 7 WHEN 'Am' THEN 9 ELSE 5 END) THEN 1.0 ELSE 0 END), 6) AS chord_root_in_key_frac
    FROM c JOIN g USING (song_id) JOIN scale ON i = k % 4 GROUP BY song_id) SELECT song_id, melody_in_key_frac, chord_root_in_key_frac FROM melody JOIN root USING (song_id)""")
def song_tonality(spark: SparkSession, d: str) -> DataFrame:
    return metrics.tonality(made.songs(spark, d)).select("song_id", *[F.round(c, 6).alias(c) for c in ("melody_in_key_frac", "chord_root_in_key_frac")])


_FLAGS = f"""{_SONGS}, scale(i, inside) AS (VALUES (0, [0, 2, 4, 5, 7, 9, 11]), (1, [7, 9, 11, 0, 2, 4, 6]), (2, [9, 11, 0, 2, 4, 5, 7, 8]), (3, [4, 6, 7, 9, 11, 0, 2, 3])),
tone(symbol, root, tones) AS (VALUES ('C', 0, [0, 4, 7]), ('G', 7, [7, 11, 2]), ('Am', 9, [9, 0, 4]), ('F', 5, [5, 9, 0])),
m AS (SELECT n.song_id, count(*) AS notes, CAST(sum(words) AS BIGINT) AS syllables, round(count_if(words > 1) / count(*), 4) AS multi, round(count_if(words = 0 AND NOT melisma) / count(*), 4) AS wordless,
    max(pitch) - min(pitch) AS pitch_range, round(sum(CASE WHEN list_contains(inside, pitch % 12) THEN duration ELSE 0 END) / sum(duration), 4) AS in_key,
    round(sum(CASE WHEN list_contains(tones, pitch % 12) THEN duration ELSE 0 END) / sum(duration), 4) AS in_chord
    FROM n JOIN scale ON i = k % 4 JOIN c ON c.song_id = n.song_id AND onset >= a AND onset < z JOIN tone USING (symbol) GROUP BY n.song_id),
h AS (SELECT c.song_id, round(sum(CASE WHEN list_contains(inside, root) THEN z - a ELSE 0 END) / sum(z - a), 4) AS roots FROM c JOIN g USING (song_id) JOIN scale ON i = k % 4 JOIN tone USING (symbol) GROUP BY c.song_id),
flags AS (SELECT song_id, CAST(half <= 1 AS INT) + CAST(bars - half <= 1 AS INT) AS tiny_sections, CAST(half > 32 AS INT) + CAST(bars - half > 32 AS INT) AS long_sections, 60 + k % 100 AS tempo_bpm,
    false AS double_time_suspect, false AS half_time_suspect, round((bars // 5) / bars, 4) AS irregular_bar_frac, in_key AS melody_in_key_frac, roots AS chord_root_in_key_frac, CAST(NULL AS VARCHAR) AS key_agreement,
    round(notes / bars, 3) AS notes_per_bar, multi AS multi_syllable_note_frac, wordless AS wordless_note_frac, syllables, in_chord AS chord_tone_frac, pitch_range, 2 AS sections, bars FROM g JOIN m USING (song_id) JOIN h USING (song_id))"""


@register("song_pathology_flags", "G5", f"WITH {_FLAGS} SELECT * FROM flags")
def song_pathology_flags(spark: SparkSession, d: str) -> DataFrame:
    return flags.pathology_flags(made.songs(spark, d))


@register("song_pathology_reasons", "F1", f"""WITH {_FLAGS} SELECT song_id, concat_ws(';', CASE WHEN long_sections > 0 THEN 'section_over_32_bars' END, CASE WHEN irregular_bar_frac > 0.25 THEN 'irregular_bars_over_25pct' END,
    CASE WHEN melody_in_key_frac < 0.7 THEN 'melody_in_key_under_70pct' END, CASE WHEN multi_syllable_note_frac > 0.1 THEN 'aligner_cramming_over_10pct' END,
    CASE WHEN notes_per_bar < 1 OR notes_per_bar > 9 THEN 'implausible_note_density' END, CASE WHEN pitch_range > 36 THEN 'pitch_range_over_3_octaves' END) AS reasons FROM flags""")
def song_pathology_reasons(spark: SparkSession, d: str) -> DataFrame:
    return flags.pathology_reasons(flags.pathology_flags(made.songs(spark, d))).select("song_id", F.array_join("reasons", ";").alias("reasons"))


@register("song_problems", "F7", f"WITH {_SONGS} SELECT song_id, CASE WHEN count_if(words > 0) = 0 THEN 'no lyrics' ELSE '' END AS problems FROM n GROUP BY song_id")
def song_problems(spark: SparkSession, d: str) -> DataFrame:
    return model.renderable_problems(made.songs(spark, d)).select("song_id", F.array_join("problems", "; ").alias("problems"))


@register("song_text_round_trip", "P19, P20", f"WITH {_SONGS} SELECT {_ONE_BY_ONE} FROM n")
def song_text_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The notes that are read from the songs' texts, with section headers and counts of bars left."""
    return _rows(notation.parsed(notation.texts(made.songs(spark, d), countdown=True)))


@register("song_text_sections", "P19, P20", f"WITH {_SONGS} SELECT song_id, section, label, first AS start_bar, bars AS num_bars, true AS strict_ok FROM s")
def song_text_sections(spark: SparkSession, d: str) -> DataFrame:
    x = notation.parsed(notation.texts(made.songs(spark, d)))
    return x.select("song_id", "strict_ok", F.posexplode("sections").alias("section", "s")).select("song_id", "section", "s.label", "s.start_bar", "s.num_bars", "strict_ok")


@register("song_bars_left", "A29, W14", f"WITH {_SONGS} SELECT song_id, 1.0::DOUBLE AS counter_present_frac, 1.0::DOUBLE AS counter_self_consistent_frac, 1.0::DOUBLE AS sections_ending_on_counter_1 FROM g")
def song_bars_left(spark: SparkSession, d: str) -> DataFrame:
    return metrics.bars_left(notation.texts(made.songs(spark, d), countdown=True))


@register("lead_sheet_notes", "G1, P1, P3, P4, P5, P6, P7, P8, P9", f"WITH {_SONGS} SELECT {_ONE_BY_ONE} FROM n")
def lead_sheet_notes(spark: SparkSession, d: str) -> DataFrame:
    """The notes that conversion finds in lead sheets written from the songs."""
    return _rows(lead_sheet.songs(made.lead_sheets(made.songs(spark, d))))


@register("lead_sheet_plan", "P2, P3, P4, P5", f"""WITH {_SONGS}, per AS (SELECT song_id, string_agg(beats, ' ' ORDER BY bar) AS bar_beats FROM b GROUP BY song_id),
plan AS (SELECT song_id, string_agg(label || ':' || first || '+' || bars, ' ' ORDER BY section) AS sections FROM s GROUP BY song_id)
    SELECT song_id, bar_beats, sections, (['{"', '".join(made.KEYS)}'])[k % 4 + 1] AS song_key, 60 + k % 100 AS tempo_bpm, CAST(NULL AS VARCHAR) AS reason FROM g JOIN per USING (song_id) JOIN plan USING (song_id)""")
def lead_sheet_plan(spark: SparkSession, d: str) -> DataFrame:
    x = lead_sheet.songs(made.lead_sheets(made.songs(spark, d)))
    plan = F.transform("sections", lambda s: F.concat(s["label"], F.lit(":"), s["start_bar"].cast("string"), F.lit("+"), s["num_bars"].cast("string")))
    return x.select("song_id", F.array_join(F.col("bar_beats").cast("array<string>"), " ").alias("bar_beats"), F.array_join(plan, " ").alias("sections"), F.col("key").alias("song_key"), "tempo_bpm", "reason")


@register("song_lyric_lines", "G3, P10, P13", f"""WITH {_SONGS} SELECT song_id, section, line, string_agg(replace(lyric, ' ', ''), '' ORDER BY note) AS text, CAST(sum(words) AS BIGINT) AS syllables
    FROM n JOIN s USING (song_id) WHERE onset >= a AND onset < z AND words > 0 GROUP BY song_id, section, line""")
def song_lyric_lines(spark: SparkSession, d: str) -> DataFrame:
    return prompts.lines(made.songs(spark, d)).select("song_id", "section", "line", "text", F.col("n").alias("syllables"))


@register("song_continued_lines", "P12", f"""WITH {_SONGS}, l AS (SELECT DISTINCT song_id, section, line FROM n JOIN s USING (song_id) WHERE onset >= a AND onset < z AND words > 0)
    SELECT song_id, section, line, section = 1 AND EXISTS (FROM l o WHERE o.song_id = l.song_id AND o.section = 0 AND o.line = l.line) AS before,
    section = 0 AND EXISTS (FROM l o WHERE o.song_id = l.song_id AND o.section = 1 AND o.line = l.line) AS after FROM l""")
def song_continued_lines(spark: SparkSession, d: str) -> DataFrame:
    return prompts.marked_lines(made.songs(spark, d)).select("song_id", "section", "line", "before", "after")


@register("song_prompts", "P11")
def song_prompts(spark: SparkSession, d: str) -> DataFrame:
    return prompts.prompts(made.songs(spark, d), "Write a song.", "Song:", 3)


@register("song_clean_boundaries", "G2, G2a, G4")
def song_clean_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """Each start depends on the one settled before, which SQL has no form for."""
    return sequential.cleaned(made.songs(spark, d)).select("song_id", F.explode("decisions").alias("x")).select("song_id", "x.*")


@register("song_sung_notes", "G8")
def song_sung_notes(spark: SparkSession, d: str) -> DataFrame:
    return sequential.sung(made.songs(spark, d)).select("song_id", F.explode("sung").alias("x")).select("song_id", "x.*")
