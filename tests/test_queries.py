"""Every registered query of the library against its SQL in DuckDB."""

from __future__ import annotations

import pytest

from tests.compare import both, connect
from textlathe import plans


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_same_rows_as_sql(spark, sf_dir, con, name):
    ours, theirs = both(plans.QUERIES[name](spark, sf_dir), con, plans.ORACLES[name])
    assert ours == theirs


def test_encoder_gives_unit_vectors(spark, sf_dir):
    rows = plans.QUERIES["encode_documents"](spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(abs(sum(x * x for x in r["embedding"]) - 1) < 1e-4 or not any(r["embedding"]) for r in rows)


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
