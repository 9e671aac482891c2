import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, size int, component_id string"


@pytest.fixture
def docs_of(spark):
    """Documents from ``(doc_id, text)`` pairs, with extra columns whose names clash with the operators' own."""

    def make(pairs):
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, 7, "x") for i, t in pairs], DOCS)

    return make


@pytest.fixture
def rnd():
    return random.Random(11)


@pytest.fixture
def prose(rnd):
    """A maker of invented texts."""
    heads = ["the", "of", "tion", "ing", "and", "re", "st", "er", "an", "th"]

    def make(n):
        return " ".join("".join(rnd.choice(heads) for _ in range(rnd.randint(1, 4))) for _ in range(n))

    return make
