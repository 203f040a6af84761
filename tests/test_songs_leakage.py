"""Cases of FIXTURES A4."""

from pyspark.sql import functions as F

from tessel.songs import leakage
from tessel.songs.schemas import SONG


def song(name, words, pitches, onset=0):
    notes = [(onset + 2 * i + i % 3, 2, p, [w] if w else None, False, None) for i, (w, p) in enumerate(zip(words, pitches))]
    return (name, 4, 92, "G major", [4] * 8, [("verse", 0, 8)], notes, [(0, 128, "G")], "zh", {})


def test_leaks_of_songs_by_rank(spark):
    words = lambda a: [f"{a}{i}" for i in range(20)]
    tune = lambda k: [60 + (i * i * k + i) % 11 for i in range(20)]
    table = [
        ("train", song("t1", words("a"), tune(1))), ("train", song("t2", words("b"), tune(2))),
        ("test", song("e1", words("a"), tune(3))),  # equal lyrics
        ("test", song("e2", words("b")[:15] + words("c")[:5], tune(4))),  # most of the lyrics
        ("test", song("e3", words("d"), [p + 5 for p in tune(1)], 16)),  # new lyrics, the melody transposed and later
        ("test", song("e4", words("e"), tune(5))),
        ("test", song("e5", [None] * 20, tune(6))),
        ("validation", song("v1", words("e"), tune(7))),  # equal to a test song's lyrics
        ("validation", song("v2", words("f"), [p - 3 for p in tune(5)])),
        ("validation", song("v3", [None] * 20, tune(8))),  # no lyrics are no exact copy of none
        ("validation", song("v4", ["x"], [60])),
    ]
    split = F.create_map(*[F.lit(x) for s, r in table for x in (r[0], s)])
    songs = spark.createDataFrame([r for _, r in table], SONG).withColumn("split", split[F.col("song_id")])
    want = [
        ("e1", "lyrics_exact_duplicate_of_train", "t1"), ("e2", "lyrics_near_duplicate_of_train", "t2"), ("e3", "melody_near_duplicate_of_train", "t1"),
        ("v1", "lyrics_exact_duplicate_of_test", "e4"), ("v2", "melody_near_duplicate_of_test", "e4"),
    ]
    for n in (1, 3):
        got = leakage.resolve(songs.repartition(n), "split", 0.3, 0.3).collect()
        assert sorted((r.id, r.reason, r.match) for r in got) == want
        assert {r.id: r.score for r in got}["e3"] == 1.0
