from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessel.songs import lead_sheet, model, prompts, theory
from tessel.songs.schemas import LEAD_SHEET, SONG


def song(song_id="s", bars=(4, 4), sections=(("verse", 0, 2),), notes=(), chords=((0, 32, "G"),), key="G major", tempo=92, meter=4):
    n = [(*x[:3], x[3] if len(x) > 3 else None, x[4] if len(x) > 4 else False, x[5] if len(x) > 5 else None) for x in notes]
    return (song_id, meter, tempo, key, list(bars), list(sections), n, list(chords), "zh", {})


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def make(spark):
    return lambda *songs: spark.createDataFrame(list(songs), SONG)


def test_bars_sections_and_clicks(make):
    s = make(song(bars=(4, 3, 4), sections=(("verse", 0, 2), ("chorus", 2, 1))))
    assert rows(model.bars(s)) == [("s", 0, 4, 0, 16), ("s", 1, 3, 16, 28), ("s", 2, 4, 28, 44)]
    assert [(r.label, r.start, r.end) for r in model.sections(s).orderBy("section").collect()] == [("verse", 0, 28), ("chorus", 28, 44)]
    clicks = model.click_events(s).collect()
    assert len(clicks) == 11 and sum(r.downbeat for r in clicks) == 3


def test_notes_meet_sections_and_chords_half_open(make):
    s = make(song(sections=(("verse", 0, 1), ("chorus", 1, 1)), notes=((0, 16, 60), (16, 4, 62), (31, 1, 64)), chords=((0, 16, "G"), (20, 12, "C"))))
    assert [(r.note, r.label) for r in model.notes_in_sections(s).orderBy("note").collect()] == [(0, "verse"), (1, "chorus"), (2, "chorus")]
    assert [(r.note, r.chord) for r in model.chord_at_notes(s).orderBy("note").collect()] == [(0, "G"), (1, None), (2, "C")]


def test_chords_tile_the_song(make):
    s = make(song(chords=((0, 1, "G"), (0, 1, "C"), (8, 1, "C"), (16, 1, "D"), (40, 1, "E"))))
    assert rows(model.normalized_chords(s)) == [("s", 0, "C", 16), ("s", 16, "D", 16)]


def test_events_and_back(make):
    notes = ((0, 4, 60), (4, 4, 60), (8, 2, 62), (9, 3, 64))
    s = make(song(notes=notes))
    assert [(r[1], r[2], r[3]) for r in rows(model.paired_notes(model.note_events(s)))] == sorted(notes)


def test_segments(make):
    s = make(song(bars=(4,) * 23, sections=(("verse", 0, 23),), tempo=60))  # 92 s
    got = model.segments(s, 30.0).orderBy("part").collect()
    assert [r.num_bars for r in got] == [6, 6, 5, 6] and got[-1].end_s == 92.0
    two = model.segments(make(song(bars=(4,) * 8, sections=(("verse", 0, 3), ("chorus", 3, 5)), tempo=80)), 30.0).orderBy("section").collect()
    assert [r.start_s for r in two] == [0.0, 9.0] and two[-1].end_s == 24.0


def test_notes_cut_at_barlines(make):
    got = model.pieces_at_bars(make(song(bars=(4, 4, 4), notes=((8, 28, 60), (0, 8, 62))))).orderBy("note", "bar").collect()
    assert [(r.bar, r.onset, r.duration, r.tie) for r in got] == [(0, 8, 8, "start"), (1, 16, 16, "continue"), (2, 32, 4, "stop"), (0, 0, 8, "none")]


def test_syllables_are_separated(make):
    s = make(song(notes=((0, 8, 60, ["a", "b", "c"]),)), song("t", notes=((0, 2, 60, ["a", "b", "c"]),)), song("u", notes=((8, 20, 60, ["a", "b"]),), sections=(("verse", 0, 1), ("chorus", 1, 1))), song("v", notes=((0, 5, 60, ["a", "b", "c"]),)))
    got = model.separate_syllables(s).orderBy("song_id", "note").collect()
    assert [(r.song_id, r.onset, r.duration, r.lyric) for r in got] == [
        ("s", 0, 2, ["a"]), ("s", 2, 2, ["b"]), ("s", 4, 4, ["c"]), ("t", 0, 2, ["a", "b", "c"]), ("u", 8, 20, ["a", "b"]), ("v", 0, 2, ["a"]), ("v", 2, 3, ["b", "c"]),
    ]


def test_metrics_and_problems(make):
    s = make(song(notes=((0, 4, 60, ["a"]), (4, 4, 62, None, True), (8, 4, 80), (13, 2, 64, ["b", "c"]))), song("bad", notes=((0, 4, 60), (0, 4, 61), (4, 8, 62), (8, 4, 60))))
    m = {r.song_id: r for r in model.melody_metrics(s).collect()}["s"]
    assert (m.num_notes, m.pitch_range, m.syllables_sung, m.melisma_note_frac, m.wordless_note_frac, m.multi_syllable_note_frac, m.large_leap_frac) == (4, 20, 3, 0.25, 0.25, 0.25, 2 / 3)
    got = {r.song_id: r.problems for r in model.renderable_problems(s).collect()}
    assert got == {"s": [], "bad": ["no lyrics", "1 stacked onsets", "1 overlaps"]}


def test_prompts(make):
    notes = ((0, 4, 60, ["走"], False, 0), (16, 4, 60, ["吧", "la"], False, 0), (20, 4, 60, ["x"], False, 0), (24, 4, 62, ["y"], False, 0), (48, 4, 62, ["z", "w"], False, 1))
    s = make(song(bars=(4, 4, 4, 3), sections=(("intro", 0, 1), ("verse", 1, 1), ("instrumental", 2, 1), ("chorus", 3, 1)), notes=notes))
    one = prompts.prompts(s, "H", "END").first().prompt
    assert one == "H\nLanguage: zh\nMeter: 4/4\nTempo: 92 BPM\nKey: G major\nStructure:\nP:intro | 1 bars\n走\nP:verse | 1 bars\n吧 la x y\nP:instrumental | 1 bars\nP:chorus | 1 bars | beats 3\nz w\n\nEND"
    three = prompts.prompts(s, "H", "END", 3).first().prompt
    assert "P:intro | 1 bars | section 1/4 | 1 syllable\n走…" in three and "4 syllables\n…吧 la x y\n" in three and "P:instrumental | 1 bars | section 3/4 | 0 syllables\n" in three
    two = prompts.prompts(s, "H", "END", 2).first().prompt
    assert three.replace("…", "").replace(" | 1 syllable", "").replace(" | 4 syllables", "").replace(" | 0 syllables", "").replace(" | 2 syllables", "") == two


def test_syllables_split_and_join(spark):
    x = spark.createDataFrame([("走吧 la 你好x",)], "t string").select(prompts.syllables(F.col("t")).alias("s"))
    assert x.first().s == ["走", "吧", "la", "你", "好", "x"]
    assert x.select(prompts.joined(F.col("s")).alias("j")).first().j == "走吧 la 你好 x"


def test_keys(spark):
    names = ["C# major", "Ab minor", "B major", "Bm", "Ebmin", "g# m", "H", None, "F"]
    got = [r.k for r in spark.createDataFrame([(n,) for n in names], "n string").select(theory.canonical_key(F.col("n")).alias("k")).collect()]
    assert got == ["Db major", "G# minor", "B major", "B minor", "Eb minor", "G# minor", None, None, "F major"] == [theory.preferred_key(n) for n in names]
    assert {k: f for k, _, _, f, _ in theory.key_rows()}["Db major"] == -5 and theory.fifths("E", "minor") == 1
    assert theory.spell(65, theory.fifths("F#", "major")) == ("E", 1, 4) and theory.spell(60, 0) == ("C", 0, 4) and theory.spell(70, theory.fifths("F", "major")) == ("B", -1, 4)
    for fifths in range(-6, 7):
        for midi in range(52, 85):
            letter, alter, octave = theory.spell(midi, fifths)
            assert 12 * (octave + 1) + theory.NATURAL[letter] + alter == midi and abs(alter) <= 1


def test_bars_are_cut_anew():
    stats = Counter()
    assert lead_sheet.rebar([0, 3, 5, 6, 9, 13, 18, 21, 22], {0, 18}, 3, stats) == [0, 3, 6, 9, 12, 15, 18, 21, 22]
    assert lead_sheet.rebar([0, 3, 10, 14], {0}, 4, stats) == [0, 4, 8, 10, 14]
    assert stats == {"irregular_runs_regularized": 2, "irregular_runs_packed_with_remainder": 1}
    assert lead_sheet.rebar([0, 3, 10, 14], {0, 3}, 4, Counter()) == lead_sheet.rebar([0, 3, 10, 14], {3}, 4, Counter()) == [0, 3, 10, 14]


def test_lead_sheet(spark):
    beat = lambda i: 1.0 + 0.5 * i
    note = lambda i, a, b, p: {"note_id": f"n{i}", "onset_sec": beat(a), "offset_sec": beat(b), "pitch_midi": p}
    syl = lambda i, t, a, b, line: {"syllable_id": f"s{i}", "text": t, "normalized_text": t, "start_sec": beat(a), "end_sec": beat(b), "line_id": line}
    sheet = {
        "song_id": "x", "global": {"meter": "4/4", "tempo_bpm": 120.0, "key": "C# major", "language": "zh"}, "beats": [{"time_sec": beat(i), "is_downbeat": i % 4 == 0} for i in range(17)],
        "sections": [{"label": "inst", "start_sec": beat(0)}, {"label": "Verse", "start_sec": beat(4)}],
        "syllables": [syl(0, "我", 4, 5, "l0"), syl(1, "走", 5, 6, "l0"), syl(2, "吧", 20, 21, "l0")], "lines": [{"line_id": "l0", "text": "我走吧"}],
        "melody_notes": [note(0, 4, 5, 60), note(1, 5, 5.75, 62), note(2, 5.5, 6, 64), note(3, 8, 8, 65)],
        "note_lyric_alignment": {"items": [{"note_id": "n0", "lyric_unit_id": "s0"}, {"note_id": "n1", "lyric_unit_id": "s1"}]},
        "recognized_chords": [{"symbol": "C#:maj", "root": "C#", "quality": "maj", "start_sec": beat(0)}, {"symbol": "x", "root": "F#", "quality": "min7", "bass": "b7", "start_sec": beat(8)}],
    }
    bad = {**sheet, "song_id": "bad", "global": {"meter": "6/8"}}
    import json

    df = spark.createDataFrame([(json.dumps(sheet),), (json.dumps(bad),)], "j string").select(F.from_json("j", LEAD_SHEET).alias("s")).select("s.*")
    got = {r.song_id: r for r in lead_sheet.songs(df).collect()}
    s = got["x"]
    assert s.key == "Db major" and s.bar_beats == [4, 4, 4, 4] and [(x.label, x.start_bar) for x in s.sections] == [("instrumental", 0), ("verse", 1)]
    assert [(n.onset, n.duration, n.lyric, n.melisma) for n in s.notes] == [(16, 4, ["我"], False), (20, 2, ["走", "吧"], False), (22, 2, None, True), (32, 1, None, False)]
    assert [(c.onset, c.symbol) for c in s.chords] == [(0, "Db"), (32, "Gbm7/E")]
    assert s.stats["melisma_inherited"] == 1 and s.stats["unmatched_syllable_joined"] == 1 and s.reason is None
    assert "unsupported meter" in got["bad"].reason
