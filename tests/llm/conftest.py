import random

import pytest

EXTRA = ["shard", "digest", "key", "score", "kinds", "row", "bucket", "slot", "window", "n", "gid"]


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from ``(doc_id, text)`` rows, with extra columns whose names clash
    with the operators' own."""
    def make(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)
        return spark.createDataFrame([(i, t, *(list(more) + [None] * 3)[:3], *["x"] * len(EXTRA)) for i, t, *more in rows], schema)
    return make


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in any column, empty, blank, very long, equal and repeated rows."""
    rng = random.Random(5)
    long = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(40_000))
    return [(1, "The cat sat on the mat and looked at the dog.", "en", "a"), (2, None, None, None), (3, "", "en", None),
            (4, " \n\t ", None, "b"), (5, "THE CAT SAT ON THE MAT and looked at the dog.", "en", None), (6, long, "en", "a"),
            (7, "12345 !!! ***", None, None), (7, "12345 !!! ***", None, None), (None, "a text without an id", "en", "a"),
            (None, None, None, None), (9, "Der Hund läuft über die Straße — ß 猫 🐈", "de", "a"), (-3, "x", "en", "a")]


@pytest.fixture(scope="session")
def random_rows():
    """A few hundred texts; a third of the rows are copies of one text."""
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(1, 7))) for _ in range(400)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 120)))) for i in range(400)]
    return rows + [(1000 + i, "one hot text that very many rows repeat word for word") for i in range(200)]
