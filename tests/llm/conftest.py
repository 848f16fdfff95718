"""Fixtures with the awkward rows that every corpus operator must take."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BIG = 2**60 + 1


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from (doc_id, text) pairs, with a further column whose name operators use inside."""

    def build(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 7) for i, t in rows], SCHEMA + ", spans string, n long")

    return build


@pytest.fixture(scope="session")
def prose():
    """A maker of random text from a small invented vocabulary."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(400)]

    def text(n, seed):
        r = random.Random(seed)
        return " ".join(r.choice(vocabulary) for _ in range(n))

    return text


@pytest.fixture(scope="session")
def awkward(prose):
    """Null, empty and blank texts, null and huge ids, a repeated row, equal texts, a very long text."""
    long = prose(60_000, 1)
    return [(1, None), (2, ""), (3, " \n\t "), (None, "a null id here"), (BIG, prose(80, 2)), (4, prose(80, 2)), (4, prose(80, 2)), (5, long), (6, "é" * 5000)]
