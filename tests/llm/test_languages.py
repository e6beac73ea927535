"""The byte network: its parts by loops, its gradients by differences, its languages by held-out accuracy."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from textlathe.llm import languages as L


def tiny(rng: np.random.Generator, names: int = 3) -> L.LanguageModel:
    mask = L.filter_mask()
    f = mask.shape[1]
    return L.LanguageModel([f"l{i}" for i in range(names)], *(rng.normal(0, s, size).astype(np.float64) * m for s, size, m in ((0.5, (256, L.DIM), 1), (0.3, mask.shape, mask), (0.1, f, 1), (0.3, (f, names), 1), (0.1, names, 1))))


def test_responses_by_loops():
    rng = np.random.default_rng(0)
    model, windows = tiny(rng), rng.integers(0, 256, (3, L.WINDOW), np.uint8)
    got = model.probabilities(windows)
    for w, p in zip(windows, got):
        best = []
        for f, width in enumerate(np.repeat(L.WIDTHS, L.FILTERS)):
            weights = model.filters[:, f].reshape(L.REACH, L.DIM)
            best.append(max(sum(model.vectors[w[at + j]] @ weights[j] for j in range(width)) for at in range(L.PLACES)))
        z = np.maximum(np.array(best) + model.offsets, 0) @ model.softmax + model.bias
        assert np.allclose(p, np.exp(z) / np.exp(z).sum(), atol=1e-5)


def test_gradients_by_differences():
    rng = np.random.default_rng(1)
    model, windows, y = tiny(rng), rng.integers(97, 105, (6, L.WINDOW), np.uint8), np.array([0, 1, 2, 0, 1, 2])
    mask = L.filter_mask()
    _, grads = L.gradients(model, windows, y, mask)
    for part, grad in zip((model.vectors, model.filters, model.offsets, model.softmax, model.bias), grads):
        flat = part.reshape(-1)
        for i in rng.choice(np.flatnonzero(np.abs(grad.reshape(-1)) > 1e-6), 5):
            kept, ends = flat[i], []
            for step in (1e-6, -1e-6):
                flat[i] = kept + step
                ends.append(L.gradients(model, windows, y, mask)[0])
            flat[i] = kept
            assert np.isclose((ends[0] - ends[1]) / 2e-6, grad.reshape(-1)[i], rtol=1e-3, atol=1e-6)


@pytest.mark.parametrize("sizes", [[0], [1, 0, 5], [L.PLACES - 1, L.PLACES, L.PLACES + 1], [1000, 3, 5000]])
def test_windows_hold_every_run_of_bytes(sizes):
    rng = np.random.default_rng(2)
    texts = [L.text_bytes("".join(chr(97 + c) for c in rng.integers(0, 26, n))) for n in sizes]
    windows, owner = L.cut_windows(texts)
    assert sorted(set(owner.tolist())) == list(range(len(texts)))
    for i, text in enumerate(texts):
        runs = {bytes(w[at : at + L.REACH]) for w in windows[owner == i] for at in range(L.PLACES)}
        assert {text[at : at + L.REACH] for at in range(len(text) - L.REACH + 1)} <= runs


def test_scores_do_not_depend_on_batches():
    model = tiny(np.random.default_rng(3))
    texts = ["a" * 10, "häß " * 900, "x", "the words " * 2000]
    names, scores = model.predict(texts)
    for group in (1, 300, 4096):
        other = model.predict(texts, group)
        assert other[0] == names and np.allclose(other[1], scores)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found = L.languages(docs).toPandas()
    assert len(found) == docs.count() and found["score"].between(0, 1).all()
    assert all((zlib.crc32(str(i).encode()) % 4 == 2) == h for i, h in zip(found["doc_id"], found["held_out"]))
    held = found[found["held_out"]].merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert len(held) > 1000 and (held["lang"] == held["lang_pred"]).mean() >= 0.99


def test_held_out_languages_are_not_learnt(spark, documents):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    changed = documents.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    one, two = ({r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.languages(d).collect()} for d in (documents, changed))
    assert one == two


def test_odd_rows(spark, odd, documents):
    extra = spark.createDataFrame([(30, "12 34 -- !!", "en", "a", 9, "k", 1), (31, "漢字かな", "en", "a", 4, "k", 1), (32, "Ωmega", None, None, None, None, None)], odd.schema)
    rows = odd.unionByName(extra).unionByName(documents.limit(150).select("*", F.lit("k").alias("key"), F.lit(1).alias("size")))
    found = L.languages(rows).collect()
    assert len(found) == rows.count() and all(0 <= r["score"] <= 1 for r in found)
    unknown = [r for r in found if r["lang_pred"] == L.UNKNOWN]
    assert {1, 2, 3, 30} <= {r["doc_id"] for r in unknown} and all(r["score"] == 0 for r in unknown)
    assert all(r["lang_pred"] != L.UNKNOWN for r in found if r["doc_id"] in (4, 5, 6, 31, 32) and r["doc_id"] not in {x["doc_id"] for x in unknown})
    assert [r["held_out"] for r in found if r["doc_id"] is None] == [False]
    assert L.languages(rows.limit(0)).count() == 0


def test_without_languages_or_with_one(spark, odd):
    none = L.languages(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in none} == {(L.UNKNOWN, 0.0)}
    one = L.languages(odd.withColumn("lang", F.lit("q"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in one} == {(L.UNKNOWN, 0.0), ("q", 1.0)}


def test_short_texts_and_capitals(spark):
    """A network of three languages of made words tells short texts, capitals, and texts between marks."""
    rng = np.random.default_rng(4)
    parts = {"aa": ["sch", "ung", "ei"], "bb": ["tion", "eau", "que"], "cc": ["ción", "ñue", "os"]}
    made = lambda k, n: " ".join("".join(rng.choice(parts[k], 3)) for _ in range(n))
    rows = [(i, made(k, 30), k) for i in range(240) for k in [list(parts)[i % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit_languages(docs)
    for k in parts:
        for text in (made(k, 2), made(k, 9).upper(), "### 123 $$$ " + made(k, 4) + " </div>", made(k, 20_000)):
            assert model.predict([text])[0] == [k]
