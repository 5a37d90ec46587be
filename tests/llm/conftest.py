from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, key string, ids string, __text string, __id long, kept boolean"


def documents(spark, rows):
    """Documents with further columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), 1, "k", "x", "y", 7, False) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def odd_rows():
    long = " ".join(f"word{i}" for i in range(30_000))
    return [
        (1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (4, "one", "a"), (5, long, "b"), (5, long, "b"), (6, "x" * 50_000, "b"),
        (None, "a text without an id, password=hunter2hunter2 and more words here", "a"), (7, "é中😀 \x1c ﬁ  two  blanks ", "a"), (8, "one", None),
        (9, "\n".join(["the same line"] * 50), "c"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return documents(spark, odd_rows)


@pytest.fixture(scope="session")
def empty(spark):
    return documents(spark, [])
