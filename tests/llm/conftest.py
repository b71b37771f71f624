import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def prose():
    """A generator of texts from an invented vocabulary, seeded."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(4000)]

    def make(n, rng=rng):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def edge_rows():
    """Null, empty, white-space and very long texts, ties, null keys."""
    return [
        (900, None, None, None, None),
        (901, "", "en", "s1", 0),
        (902, " \t\n\x0b ", "en", "s1", 4),
        (903, "one", None, "s2", 3),
        (904, "one", "en", None, 3),
        (905, "é ß  x \U0001f600 İ", "fr", "s2", 9),
        (906, "word " * 60_000, "de", "s1", 300_000),
        (906, "word " * 60_000, "de", "s1", 300_000),
        (None, "a text without an id that has some words", "en", "s1", 40),
    ]
