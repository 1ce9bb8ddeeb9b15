from __future__ import annotations

import pytest

AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a"),
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "b"),
    (4, " \t\n\x0b ", None, "b"),
    (None, "A text without an id, with some words in it for good measure here", "fr", "c"),
    (5, "é ü ñ 漢字 🙂 one two three four five six seven", "de", "c"),
    (6, "word " * 30000, "en", "d"),
    (7, "x" * 50000, "en", "d"),
    (8, "a b c", "es", "d"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns with clashing names."""
    return spark.createDataFrame(
        [r + (i, "k", 1.5, 7) for i, r in enumerate(AWKWARD)],
        "doc_id long, text string, lang string, source string, row long, key string, score double, node int",
    )


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
