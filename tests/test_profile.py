"""Quantiles by rank selection against sorted values."""

from __future__ import annotations

import numpy as np
import pytest

from textlathe.operators import profile as P

SHARES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


@pytest.mark.parametrize("kind", ["normal", "log", "hot", "whole", "wide"])
def test_quantiles(spark, monkeypatch, kind):
    monkeypatch.setattr(P, "FETCHED", 20)
    monkeypatch.setattr(P, "RANGES", 16)
    rng = np.random.default_rng(1)
    v = {"normal": rng.normal(size=3000), "log": 10.0 ** rng.uniform(-12, 12, 2000), "hot": np.concatenate([np.full(2000, 5.0), rng.normal(5, 1e-9, 500)]), "whole": rng.integers(-5, 5, 900).astype(float), "wide": np.array([-1e308, 1e308, 0.0, 1.0])}[kind]
    rows = spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),)], "v double").repartition(4)
    assert np.allclose(P.exact_quantiles(rows, "v", SHARES), np.quantile(v, SHARES), rtol=1e-12)


def test_few_values(spark):
    rows = spark.createDataFrame([(None,), (3,)], "v int")
    assert P.exact_quantiles(rows, "v", SHARES) == [3.0] * len(SHARES) and P.exact_quantiles(rows.limit(0), "v", [0.5]) == [None]
    for in_one in (0, 100):
        assert tuple(P.describe(rows, "v", in_one).first()) == (1, 3.0, None, 3, 3.0, 3.0, 3.0, 3)
