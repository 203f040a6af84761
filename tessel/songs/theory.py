"""Keys as small tables, so that functions of keys are joins or literal maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Pitch classes of note names, preferred tonics of each pitch class, letters in order of fifths.
NATURAL = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}
MAJOR_TONICS = ["C", "Db", "D", "Eb", "E", "F", "F#", "G", "Ab", "A", "Bb", "B"]
MINOR_TONICS = ["C", "C#", "D", "Eb", "E", "F", "F#", "G", "G#", "A", "Bb", "B"]
FIFTHS = "FCGDAEB"
SCALE_STEPS = {"major": [0, 2, 4, 5, 7, 9, 11], "minor": [0, 2, 3, 5, 7, 8, 10, 11]}

# What a key's mode may be called behind its tonic.
MODES = {"": "major", "major": "major", "maj": "major", "minor": "minor", "min": "minor", "m": "minor"}
SPACES = " \t\n\x0b\f\r"


def pitch_of(name: str) -> int:
    """Pitch class of a name like ``F#``."""
    return (NATURAL[name[0]] + name.count("#") - name.count("b")) % 12


def fifths(tonic: str, mode: str) -> int:
    """Sharps (positive) or flats of a signature; letters a fifth apart differ by one, an accidental by seven."""
    place = FIFTHS.index(tonic[0]) - 1 + 7 * (tonic.count("#") - tonic.count("b"))
    return place - 3 if mode == "minor" else place


def key_rows() -> list[tuple]:
    """(key, tonic pitch class, mode, fifths, pitch classes of the scale) for the 24 preferred keys."""
    out = []
    for mode, tonics in (("major", MAJOR_TONICS), ("minor", MINOR_TONICS)):
        out += [(f"{t} {mode}", pc, mode, fifths(t, mode), sorted((pc + s) % 12 for s in SCALE_STEPS[mode])) for pc, t in enumerate(tonics)]
    return out


def key_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(key_rows(), "key string, tonic int, mode string, fifths int, scale array<int>")


def preferred_key(name: str | None) -> str | None:
    """Preferred spelling of a key's name, such as ``Db major`` for ``C# major``; null if it is none.

    A name is a letter, a sign perhaps, and one of the words for a mode.
    """
    text = (name or "").strip()
    letter, rest = text[:1].upper(), text[1:]
    shift = {"#": 1, "b": -1}.get(rest[:1], 0)
    mode = MODES.get(rest[abs(shift) :].strip())
    if letter not in NATURAL or mode is None:
        return None
    tonics = MINOR_TONICS if mode == "minor" else MAJOR_TONICS
    return f"{tonics[(NATURAL[letter] + shift) % 12]} {mode}"


def canonical_key(key: Column) -> Column:
    """``preferred_key`` of a column."""
    text = F.btrim(key, F.lit(SPACES))
    letter, second = F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1)
    shift = F.when(second == "#", 1).when(second == "b", -1).otherwise(0)
    table = lambda d: F.create_map(*[F.lit(x) for pair in d.items() for x in pair])
    rest = F.btrim(F.when(shift == 0, F.substr(text, F.lit(2))).otherwise(F.substr(text, F.lit(3))), F.lit(SPACES))
    mode, base = F.element_at(table(MODES), rest), F.element_at(table(NATURAL), letter)
    pc = F.pmod(base + shift, F.lit(12))
    tonics = lambda names: F.get(F.array(*map(F.lit, names)), pc)
    return F.concat(F.when(mode == "minor", tonics(MINOR_TONICS)).otherwise(tonics(MAJOR_TONICS)), F.lit(" "), mode)


def spell(midi: int, key_fifths: int) -> tuple[str, int, int]:
    """(letter, alteration, octave) of a pitch: of the names with one accidental at most, the nearest on the line of fifths."""
    near = [p for p in range(-8, 13) if (7 * p) % 12 == midi % 12]
    place = min(near, key=lambda p: abs(p - key_fifths - 0.5)) + 1
    letter, alter = FIFTHS[place % 7], place // 7
    return letter, alter, (midi - alter - NATURAL[letter]) // 12 - 1
