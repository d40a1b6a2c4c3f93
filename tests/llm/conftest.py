import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """(id, text) pairs as a table with columns whose names clash with those that operators use inside."""

    def make(pairs, **extra):
        rows = [(i, t, "en", f"src{(i or 0) % 3}", len(t or ""), "x", 1, "y", [1.0]) for i, t in pairs]
        return spark.createDataFrame(rows, DOCS + ", key string, tag int, label string, v array<double>")

    return make


@pytest.fixture(scope="session")
def awkward():
    """Nulls, empty and blank texts, ties, repeated rows and a long text."""
    rng = random.Random(9)
    words = ["w%d" % rng.randrange(400) for _ in range(60_000)]
    long = " ".join(words)
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One"), (None, "no id here at all, but text"), (None, None), (6, "a b c d e f"), (6, "a b c d e f"), (7, long), (8, long), (9, "é 日本 😀 ñ")]
