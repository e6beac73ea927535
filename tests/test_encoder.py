"""The learnt encoder against a dense decomposition of a small matrix."""

from __future__ import annotations

import random

import numpy as np
import pytest

from textlathe.operators import encoder as E
from textlathe.operators.search import encode_texts

TOPICS = [[f"{t}w{i}" for i in range(30)] for t in "abcdef"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    made = [" ".join(rng.choices(TOPICS[i % 6], k=20) + rng.choices(TOPICS[(i + 1) % 6], k=3)) for i in range(300)]
    return [*made, "", None, "Únîcode Straße 12 漢字", made[0]]


@pytest.fixture(scope="module")
def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(5)


def dense(texts, idf):
    row, col, value = E.weighted(*E.term_counts(texts), idf)
    a = np.zeros((len(texts), E.COLUMNS))
    a[row, col] = value
    return a


def test_close_to_the_best_decomposition(spark, rows, texts):
    dim = 12
    model = E.fit_encoder(rows, "text", dim, passes=3)
    a = dense(texts, model.idf)
    df = np.count_nonzero(a, axis=0)
    assert np.allclose(model.idf, np.log((1 + len(texts)) / (1 + df)) + 1)
    assert np.allclose(model.directions.T @ model.directions, np.eye(dim), atol=1e-8)
    s = np.linalg.svd(a, compute_uv=False)
    assert np.allclose(model.strengths[:6], s[:6], rtol=1e-3) and np.all(model.strengths <= s[:dim] + 1e-9)
    left = np.linalg.norm(a - a @ model.directions @ model.directions.T)
    assert left <= 1.02 * np.sqrt((s[dim:] ** 2).sum())


def test_texts_of_a_topic_are_near(rows, texts):
    found = {r["vector_id"]: np.array(r["embedding"]) for r in encode_texts(rows, "id", "text", E.fit_encoder(rows, "text", 12)).collect()}
    assert set(found) == {i for i, t in enumerate(texts) if t is not None} and all(len(v) == 12 for v in found.values())
    assert np.allclose(found[0], found[303]) and not found[300].any()
    near = np.mean([found[i] @ found[i + 6] for i in range(120)])
    assert near > 0.8 and np.mean([found[i] @ found[i + 3] for i in range(120)]) < 0.3


def test_sums_in_a_tree(spark, rows, monkeypatch):
    monkeypatch.setattr(E, "FAN", 2)
    right = np.random.default_rng(2).normal(size=(E.COLUMNS, 5))
    texts = [r["text"] for r in rows.collect()]
    columns, counts = E.term_counts(texts)
    stored = spark.createDataFrame([(c.tolist(), n.tolist()) for c, n in zip(columns, counts)], "columns array<int>, counts array<float>").repartition(7)
    idf = np.ones(E.COLUMNS)
    a = dense(texts, idf)
    assert np.allclose(E.product(stored, idf, right), a.T @ (a @ right), atol=1e-6)


def test_no_terms(spark):
    rows = spark.createDataFrame([(1, None), (2, "..."), (3, "")], "id long, text string")
    model = E.fit_encoder(rows, "text", 4)
    assert not model(["x", "..."]).any() and E.fit_encoder(rows.limit(0), "text", 4)(["x"]).shape == (1, 4)
