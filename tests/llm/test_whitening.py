"""Whitening against eigenvectors of the covariance matrix, and exact numbers against whole-number arithmetic."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from textlathe.llm import whitening as W


def by_brute_force(vectors: list[list[float]], k: int = 16) -> dict:
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    exact = [[n * c - s for c, s in zip(row, sums)] for row in fit]
    centred = np.array(exact, float) / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1][:, :k]
    off = np.array([[n * c - s for c, s in zip(row, sums)] for row in x], float) / n
    return {"n": n, "deviation": [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x], "whitened": off @ u / np.sqrt(e[:k]), "explained": e[:k] / e.sum()}


def compare(found: list, ids: list, expected: dict) -> None:
    k = len(expected["explained"])
    rows = {(r["vec_id"], r["component"]): r for r in found}
    assert len(found) == len(ids) * k and {r["n"] for r in found} == {expected["n"]}
    got = np.array([[rows[i, c + 1]["whitened"] for c in range(k)] for i in ids])
    sign = np.sign((got * expected["whitened"]).sum(axis=0))
    assert np.allclose(got, expected["whitened"] * sign, atol=1e-7)
    assert [rows[i, 1]["deviation"] for i in ids] == expected["deviation"]
    assert np.allclose([rows[ids[0], c + 1]["explained"] for c in range(k)], expected["explained"], rtol=1e-9)
    assert len({r["identity_error"] for r in found}) == 1 and found[0]["identity_error"] < 1e-9


def test_against_eigenvectors(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = table.collect()
    compare(W.whiten(table).collect(), [r["vec_id"] for r in rows], by_brute_force([r["embedding"] for r in rows]))


@pytest.mark.parametrize("d", [1, 2, 5, 17])
def test_spread_of_many_sizes(spark, d):
    """Deviations from 2**0 to 2**-16 and a mean far from zero; copies count once."""
    rng = np.random.default_rng(d)
    v = (rng.normal(0, 1, (400, d)) * 2.0 ** np.arange(12, 12 - d, -1) + 777).tolist()
    v += v[:5] * 40
    table = spark.createDataFrame([(i, x, "k") for i, x in enumerate(v)], "vec_id long, embedding array<double>, whitened string").repartition(7)
    compare(W.whiten(table).collect(), list(range(len(v))), by_brute_force(v))


def test_jacobi_keeps_small_deviations_exact():
    """A graded matrix whose covariance matrix would lose its small values: columns of known lengths, turned."""
    rng = np.random.default_rng(3)
    q, turn = np.linalg.qr(rng.normal(size=(40, 12)))[0], np.linalg.qr(rng.normal(size=(12, 12)))[0]
    lengths = 10.0 ** -np.arange(12)
    found, v = W.jacobi(q * lengths)
    assert np.allclose(found, lengths, rtol=1e-12) and np.allclose(v.T @ v, np.eye(12), atol=1e-13)
    found, v = W.jacobi((q * lengths) @ turn.T)
    assert np.allclose(found[:8], lengths[:8], rtol=1e-6) and np.allclose(np.abs((turn.T @ v)[np.arange(6), np.arange(6)]), 1, atol=1e-6)


def test_triangles_in_a_tree(spark, monkeypatch):
    """Two triangles a task; the product of the last one with itself is that of all rows."""
    monkeypatch.setattr(W, "STACK_BYTES", 1)
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(330, 4))
    blocks = [(i, rows[at : at + 7].tobytes()) for i, at in enumerate(range(0, 330, 7))]
    r = W.tree_reduced(spark.createDataFrame([(i, bytearray(b)) for i, b in blocks], "part long, rows binary"), W.triangle, 4)
    assert r.shape == (4, 4) and np.allclose(r.T @ r, rows.T @ rows)


@pytest.mark.parametrize("d", [1, 2, 3, 8, 9])
def test_rounds_have_every_pair_once(d):
    pairs = [(int(a), int(b)) for p, q in W.rounds_of_pairs(d) for a, b in zip(p, q)]
    assert sorted(pairs) == [(a, b) for a in range(d) for b in range(a + 1, d)]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i), float(i * i % 7), 1.0]) for i in range(20)]
    bad = [(90, None), (91, []), (92, [1.0, None, 2.0]), (93, [nan, 0.0, 1.0]), (94, [inf, 0.0, 1.0]), (95, [1.0]), (96, [-inf, 1.0, 1.0])]
    rows = spark.createDataFrame([*good, *bad, good[0], (None, [1.0, 1.0, 1.0])], "vec_id long, embedding array<double>")
    found = W.whiten(rows).collect()
    assert sorted({r["vec_id"] for r in found if r["vec_id"] is not None}) == list(range(20)) and len(found) == 22 * 3
    third = [r for r in found if r["component"] == 3]
    assert all(r["whitened"] is None and r["explained"] == 0 for r in third)  # the third dimension never changes
    assert found[0]["n"] == 20 and found[0]["identity_error"] < 1e-12  # (1, 1, 1) is the vector of 1
    assert W.whiten(rows.limit(0)).count() == 0 and W.whiten(rows.where("vec_id > 89")).count() == 1
    same = W.whiten(rows.where("vec_id = 3")).collect()
    assert {(r["n"], r["deviation"], r["whitened"], r["identity_error"]) for r in same} == {(1, 0, None, None)}


def test_numbers_beyond_a_long(spark):
    """Exact where it fits a long, null beyond; entries that are too great for a long do no harm."""
    near = [(i, [float(2.0**29 * (i % 2)), float(i)]) for i in range(4)]
    found = {r["vec_id"]: r["deviation"] for r in W.whiten(spark.createDataFrame(near, "vec_id long, embedding array<double>")).collect()}
    expected = by_brute_force([v for _, v in near], 2)["deviation"]
    assert found == {i: e if e < 2**63 else None for (i, _), e in zip(near, expected)} and None in found.values()
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [5.0, 2.0])], "vec_id long, embedding array<double>")
    assert W.whiten(huge).count() == 6


def test_small_numbers_beside_large_ones_are_exact():
    """The way by whole numbers of Python gives what the way by longs gives."""
    rng = np.random.default_rng(8)
    x = rng.integers(-(2**20), 2**20, (50, 3)) + 1_000_000
    model = W.Whitening(3_000_000_000, [int(s) for s in x.sum(axis=0) * 60_000_000], np.ones(3), np.eye(3), 3)
    exact = [sum((model.n * int(c) - s) ** 2 for c, s in zip(row, model.sums)) for row in x]
    assert model.deviation(x) == [e if e < 2**63 else None for e in exact]
    close = np.array([model.base, [b + 1 for b in model.base]])
    exact = [sum((model.n * int(c) - s) ** 2 for c, s in zip(row, model.sums)) for row in close]
    assert model.deviation(close) == [e if e < 2**63 else None for e in exact]
