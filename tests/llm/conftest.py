import random

import pytest

WORDS = "the of and to in it was for on are as with his they at be this from have or by one had not but what all were when we there can an your".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", "s", "ed", "ing"]) for _ in range(n))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, rid string, tk string, score string, shard_ string, kept string"


def make_rows() -> list[tuple]:
    """Copies, near copies, shared passages, nulls, empty and very long texts, repeated rows and ids, clashing names."""
    rng = random.Random(4)
    long = prose(rng, 6000)
    base = [prose(rng, rng.randint(60, 200)) for _ in range(12)]
    passage = prose(rng, 60)
    texts: list[tuple] = []
    for i, t in enumerate(base):
        texts.append((i, t))
        words = t.split()
        words[len(words) // 2] = "changed"
        texts.append((100 + i, " ".join(words)))
        texts.append((200 + i, f"{prose(rng, 30)} {passage} {prose(rng, 20)}"))
    texts += [(300, base[0]), (301, base[0]), (302, base[0]), (303, long), (304, long + " end"), (305, "one two three"), (306, "one two three"), (307, "one  two\tthree")]
    texts += [(310, None), (311, ""), (312, " \n\t "), (313, "é ü 中文 😀 ßß 中文 é"), (None, base[1]), (None, None), (314, "a b c d e f g " * 40)]
    texts += [(5, base[5]), (5, base[5]), (5, "the same id with another text of some words in it")]
    return [(i, t, "en" if (i or 0) % 3 else None, f"s{(i or 0) % 2}", None if t is None else len(t), "x", "y", "z", "s", "q", "k") for i, t in texts]


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
