"""The stored index of vectors against brute force: exact with bounds, and its recall without."""

from __future__ import annotations

import numpy as np
import pytest

from textlathe.operators import vectors as V


def made(n, d, clusters, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, d))
    return (centres[rng.integers(0, clusters, n)] + rng.normal(size=(n, d)) * 0.5) * rng.lognormal(size=(n, 1))


def truth(v, q, k):
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    score = np.float32(unit).astype(float) @ (q / np.linalg.norm(q))
    return sorted(range(len(v)), key=lambda i: (-round(score[i], 6), i))[:k], score


@pytest.fixture(scope="module")
def indexed(spark):
    v = made(4000, 24, 40)
    v[1000:3000] = v[1000]  # a third of all are one vector
    v[7] = 0
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(9999, None)], "id long, v array<float>").repartition(6)
    return v, V.build_vector_index(table, "id", "v", cells=60)


def test_every_vector_is_in_one_cell(indexed):
    v, index = indexed
    assert sorted(r["id"] for r in index.rows().select("id").collect()) == list(range(len(v))) and index.cells["n"].sum() == len(v)


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_search(indexed, seed):
    v, index = indexed
    q = made(1, 24, 1, seed)[0]
    expected, score = truth(v, q, 12)
    found = V.index_search(index, q.tolist(), 12, exact=True).collect()
    assert np.allclose([r["score"] for r in found], score[expected], atol=1e-5)
    assert len({r["id"] for r in found}) == 12 and np.allclose([score[r["id"]] for r in found], [r["score"] for r in found], atol=1e-5)


def test_equal_vectors_are_told_apart_by_id(indexed):
    v, index = indexed
    for exact in (True, False):
        assert [r["id"] for r in V.index_search(index, v[1000].tolist(), 5, exact=exact).collect()] == list(range(1000, 1005))


def test_recall_and_rows_read(spark):
    """Recall of 0.9 at least, and a smaller share of all rows in the probed cells of a larger table."""
    shares = []
    for n in (1000, 8000):
        v = made(n, 16, 50, 4)
        index = V.build_vector_index(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<float>"), "id", "v")
        got = want = read = 0
        for i in range(0, n, n // 8):
            expected, _ = truth(v, v[i], 10)
            got += len(set(expected) & {r["id"] for r in V.index_search(index, v[i].tolist(), 10).collect()})
            want += 10
            q = v[i] / np.linalg.norm(v[i])
            near = np.argsort(-(np.stack(index.cells["centroid"]) @ q))[: index.probes]
            read += index.cells["n"].to_numpy()[near].sum()
        assert got >= 0.9 * want
        shares.append(read / 8 / n)
    assert shares[1] < shares[0] < 0.5


def test_plan_reads_probed_folders_and_bytes_only(indexed):
    _, index = indexed
    plan = index.rows().where("cell IN (1, 2)").select("id", "code", "step")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan and "embedding" not in plan.split("ReadSchema")[1]


def test_few_rows_and_none(spark):
    empty = V.build_vector_index(spark.createDataFrame([], "id string, v array<float>"), "id", "v")
    assert V.index_search(empty, [1.0, 2.0]).count() == 0 and V.index_search(empty, [1.0], exact=True).count() == 0
    one = V.build_vector_index(spark.createDataFrame([("a", [0.0, 2.0]), ("b", [0.0, 0.0])], "id string, v array<float>"), "id", "v")
    for exact in (True, False):
        assert [(r["id"], r["score"]) for r in V.index_search(one, [1.0, 1.0], 5, exact=exact, probes=9).collect()] == [("a", pytest.approx(0.5**0.5)), ("b", 0.0)]
    assert V.index_search(V.open_vector_index(spark, one.path), [0.0, 1.0], 1).first()["id"] == "a"
