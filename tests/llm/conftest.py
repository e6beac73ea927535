from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in each column, empty and white texts, repeated rows, a very long text, clashing names."""
    long = " ".join(f"w{i % 5000}" for i in range(60000))
    phrase = " ".join(f"p{i}" for i in range(30))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n ", "en", "a", 3), (4, long, "en", "b", len(long)), (5, phrase, "en", None, 9), (6, f"Vor {phrase} nach", None, "b", 9),
            (7, "Same words here again.", "en", "a", 9), (7, "Same words here again.", "en", "a", 9), (8, "Same words here again.", "fr", "c", 9), (None, "a text without an id", "en", "c", 9), (9, "x", "en", "c", 1)]
    return spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, key string, size int")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(2, 1, 0), (4, 0, 1), (7, 1, None), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
