"""Flags of songs, on hand-made songs."""

import pytest

from tessel.songs import flags
from tessel.songs.schemas import SONG


def song(name, notes=(), tempo=100, bars=(4, 4), sections=(("verse", 0, 2),), key="D major", chords=((0, 32, "D"),), meta=None):
    return (name, 4, tempo, key, list(bars), list(sections), [(*n[:3], n[3] if len(n) > 3 else None, False, None) for n in notes], list(chords), "zh", meta or {})


@pytest.fixture(scope="module")
def got(spark):
    songs = [
        song("fine", [(0, 8, 62, ["a"]), (8, 4, 64, ["b"]), (12, 4, 65, ["c"])], chords=((0, 16, "Bm7/A"), (16, 16, "N.C.")), meta={"key_agreement": "both"}),
        song("fast", [(0, 4, 62, ["a", "b"]), (16, 4, 101)], tempo=180),
        song("none", [], tempo=59, key=None, chords=()),
        song("odd", [(0, 4, 61)], bars=(3, 4, *[4] * 33), sections=(("verse", 0, 1), ("chorus", 1, 34))),
    ]
    df = spark.createDataFrame(songs, SONG)
    return {r.song_id: r for r in flags.pathology_flags(df).collect()}, {r.song_id: r.reasons for r in flags.pathology_reasons(flags.pathology_flags(df)).collect()}


def test_flags(got):
    fine = got[0]["fine"]
    assert (fine.melody_in_key_frac, fine.chord_root_in_key_frac, fine.chord_tone_frac, fine.key_agreement, fine.syllables) == (0.75, 1.0, 0.5, "both", 3)
    assert (fine.notes_per_bar, fine.pitch_range, fine.sections, fine.bars, fine.half_time_suspect) == (1.5, 3, 1, 2, False)
    none = got[0]["none"]
    assert none.half_time_suspect and (none.melody_in_key_frac, none.chord_root_in_key_frac, none.chord_tone_frac, none.pitch_range, none.syllables) == (None, None, None, 0, 0)
    odd = got[0]["odd"]
    assert (odd.tiny_sections, odd.long_sections, odd.irregular_bar_frac) == (1, 1, round(1 / 35, 4)) and odd.wordless_note_frac == 1.0


def test_reasons(got):
    assert got[1] == {
        "fine": [],
        "fast": ["double_time_suspect", "melody_in_key_under_70pct", "aligner_cramming_over_10pct", "pitch_range_over_3_octaves"],
        "none": ["implausible_note_density"],
        "odd": ["section_over_32_bars", "implausible_note_density"],
    }
