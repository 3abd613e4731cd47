from __future__ import annotations

import random

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows and columns with clashing names."""
    r = random.Random(1)
    words = ["alpha", "Beta", "gamma,", "delta", "ünï", "eps.", "zeta"]
    long = " ".join(r.choice(words) + str(i % 97) for i in range(60_000))
    rows = [
        (1, None, None, None),
        (2, "", "en", "a"),
        (3, " \t\n ", "en", "a"),
        (4, "one two", "en", "a"),
        (5, "one  two", None, "a"),
        (6, "one\ttwo", "en", None),
        (7, long, "de", "b"),
        (8, long + " end", "de", "b"),
        (9, "a b c d e f g h i j k l m n o p", "en", "b"),
        (10, "A b c d e f g h i j k l m n o p", "en", "b"),
        (10, "A b c d e f g h i j k l m n o p", "en", "b"),
        (None, "a b c d e f g h i j k l m n o p", "en", "b"),
        (12, "x" * 300_000, "en", "c"),
        (13, "12 34 !!", "en", "c"),
    ]
    wide = [(*row, len(row[1] or ""), 1, 2, "k") for row in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, n_chars long, keep_id int, size int, key string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
