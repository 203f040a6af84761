import pytest

from tessel.songs import metrics as M
from tessel.songs import notation
from tessel.songs.schemas import SONG


def song(name="s", notes=(), bars=(4, 4, 2), sections=(("verse", 0, 3),), key="G major", chords=((0, 40, "G"),), tempo=92):
    return (name, 4, tempo, key, list(bars), list(sections), [(*n[:3], n[3] if len(n) > 3 else None, False, None) for n in notes], list(chords), "zh", {})


@pytest.fixture(scope="module")
def make(spark):
    return lambda *s: spark.createDataFrame(list(s), SONG)


def only(df):
    return df.first().asDict()


def test_tonality(make):
    got = only(M.tonality(make(song(notes=((0, 6, 67), (6, 2, 65)), chords=((0, 8, "G"), (8, 8, "F#m"), (16, 8, "Bb"), (24, 8, "N.C."))))))
    assert got["melody_in_key_frac"] == 0.75 and got["chord_root_in_key_frac"] == pytest.approx(2 / 3)
    assert only(M.tonality(make(song(notes=((0, 6, 67),), key=None))))["melody_in_key_frac"] is None


def test_repetition(make):
    bar = lambda b, p: [(16 * b + i, 1, p + i) for i in range(4)]
    got = only(M.repetition(make(song(notes=[*bar(0, 60), *bar(1, 60), *bar(2, 70), *bar(3, 60)], bars=(4,) * 4, sections=(("a", 0, 4),)))))
    assert (got["distinct_bar_frac"], got["repeated_bar_frac"], got["consecutive_repeat_bar_frac"], got["max_identical_consecutive_bars"]) == (0.5, 0.5, 0.25, 2)


def test_intervals(make):
    got = only(M.intervals(make(song(notes=((0, 1, 60), (2, 2, 60), (4, 4, 62), (8, 4, 66), (12, 4, 74), (16, 4, 94))))))
    assert [got[f"int_{k}_frac"] for k in ("repeat", "step", "skip", "leap", "large")] == [0.2] * 5


def test_a_song_conforms_to_itself(make):
    s = make(song(notes=((0, 4, 60, ["a"]), (4, 4, 62, ["b"]))))
    got = only(M.conformance(s, s))
    assert all(got[k] == (0 if k.startswith(("fewer", "more", "abs")) else 1) for k in got if k != "song_id")
    other = make(song(bars=(4, 4), sections=(("verse", 0, 1), ("chorus", 1, 1)), tempo=90, key=None))
    got = only(M.conformance(other, s))
    assert got["section_plan_exact"] == got["tempo_match"] == got["key_match"] == 0 and got["more_sections_than_requested"] == 1 and got["bar_beats_match_frac"] == pytest.approx(2 / 3)


def test_lyrics(make):
    asked = make(song(notes=((0, 2, 60, ["a"]), (2, 2, 60, ["b"]), (4, 2, 60, ["c", "d"]))))
    sung = make(song(notes=((4, 2, 60, ["d"]), (0, 2, 60, ["a"]), (2, 2, 60, ["x", "c"]))))
    got = only(M.lyrics(sung, asked))
    assert got["lyric_recall"] == 0.75 and got["lyric_precision"] == 0.75 and got["lyric_exact"] == 0


def test_bars_left(spark, make):
    texts = notation.texts(make(song(notes=((0, 4, 60),), bars=(4,) * 5, sections=(("a", 0, 2), ("b", 2, 3)))), countdown=True, per_line=2)
    got = only(M.bars_left(texts))
    assert got["counter_present_frac"] == got["counter_self_consistent_frac"] == got["sections_ending_on_counter_1"] == 1
    row = texts.first()
    bad = spark.createDataFrame([(row.song_id, row.text.replace("[r:3]", "[r:9]").replace("[r:1]", ""))], "song_id string, text string")
    got = only(M.bars_left(bad))
    assert got["counter_present_frac"] == 0.6 and got["counter_self_consistent_frac"] == pytest.approx(2 / 3) and got["sections_ending_on_counter_1"] == 0


def test_reflow():
    assert M.reflowed([["a"] * 4, ["b"] * 2], list("xyz")) == [["x", "y"], ["z"]] and M.reflowed([[], []], ["x"]) == [[], []]
