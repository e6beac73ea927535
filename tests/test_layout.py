"""Lookups in clustered tables: the rows of a plain filter, from few of the stored rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from textlathe.sources import layout as L
from textlathe.sources.tables import scratch_path

N = 40_000


@pytest.fixture(scope="module")
def table(spark):
    """A third of the rows have one key; articles are arrays, some null, some empty, some with nulls."""
    k = F.col("id")
    rows = spark.range(N).select(
        F.when(k % 3 == 0, F.lit("hot")).when(k % 1000 != 7, F.concat(F.lit("d"), F.pmod(F.xxhash64("id"), F.lit(5000)).cast("string"))).alias("doc_id"),
        F.when(k % 11 == 0, None).when(k % 7 == 0, F.array().cast("array<string>")).otherwise(F.array((k % 4001).cast("string"), F.when(k % 2 == 0, F.lit("all")))).alias("articles"),
        F.when(k % 5 > 0, (k % 3000).cast("int")).alias("year"), F.lit("x").alias("value"), F.lit(1).alias("key"), k.alias("n"),
    )
    return rows, L.write_clustered(rows, scratch_path(spark, "clustered"), "doc_id", ["articles", "year"], group_bytes=16_384)


def scanned(df):
    """How many rows the scan gave out, once the rows have been taken."""
    got = df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return got, sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def numbers(df):
    return sorted(r["n"] for r in df.collect())


def test_all_rows_are_stored(table):
    rows, stored = table
    assert numbers(stored.rows()) == list(range(N)) and stored.rows().columns == rows.columns


@pytest.mark.parametrize("values", [["d17", "d18", None], ["hot"], ["none"], []])
def test_by_key(table, values):
    rows, stored = table
    assert numbers(stored.find("doc_id", values)) == numbers(rows.where(F.col("doc_id").isin([v for v in values if v])))


@pytest.mark.parametrize("most", [L.MOST_KEYS, 3])
@pytest.mark.parametrize("sent", [L.MOST_SENT, 0])
@pytest.mark.parametrize(("column", "values"), [("articles", ["12", "3999"]), ("articles", ["all"]), ("year", [2001]), ("year", [99_999])])
def test_by_other_columns(table, monkeypatch, column, values, most, sent):
    if not sent and most > 3:
        pytest.skip("what is sent matters beyond the filter only")
    monkeypatch.setattr(L, "MOST_KEYS", most)
    monkeypatch.setattr(L, "MOST_SENT", sent)
    rows, stored = table
    test = F.arrays_overlap("articles", F.array(*map(F.lit, values))) if column == "articles" else F.col("year").isin(values)
    assert numbers(stored.find(column, values)) == numbers(rows.where(test & F.col("doc_id").isNotNull()))


def test_a_lookup_reads_few_rows(table):
    _, stored = table
    got, read = scanned(stored.find("doc_id", ["d17"]))
    assert got and read < N / 20
    # the value is in rows of the hot key too, which are not clustered by it: the narrow table is
    narrow = stored.spark.read.parquet(f"{stored.path}/by-articles").where("value = '12'").select("key")
    got, read = scanned(narrow)
    assert got and read < N / 20


def test_odd_tables(spark):
    empty = L.write_clustered(spark.createDataFrame([], "id string, a array<string>"), scratch_path(spark, "clustered"), "id", ["a"])
    assert empty.find("id", ["x"]).count() == 0 and empty.find("a", ["x"]).count() == 0
    with pytest.raises(ValueError, match="not written"):
        empty.find("b", ["x"])
