"""Rows that every corpus operator must take: nulls, ties, repeats, extra columns."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, cls long"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls, an empty and a long text, repeated rows and names that could clash."""
    rng = random.Random(5)
    long_text = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "Straße", "é"]) + str(rng.randrange(50)) for _ in range(30_000))
    a = "one two three four five six seven eight nine ten eleven twelve\n\nshort line"
    rows = [
        (None, a, None, None, None, "x", 1),
        (1, None, "en", "s", 0, None, None),
        (2, "", "en", "s", 0, "", 2),
        (3, a, "en", "s", 5, "w", 3),
        (3, a, "en", "s", 5, "w", 3),
        (4, a.upper() + "\nmore words in this one line here", "en", None, 5, "w", 3),
        (5, long_text, "de", "t", 9, "w", 3),
        (6, " \t\n    x\x1cy\x85 it's <|endoftext|> \U0001f600́\r\n\n end ", "de", "t", 9, "w", 3),
        (7, None, None, "t", None, "w", None),
        (-7, "one two three four five six seven eight nine ten eleven changed", "en", "s", 5, "w", 3),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
