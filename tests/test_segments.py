"""Chunking on literal documents, and invariants on random ones."""

from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st

import pytest
from pyspark.sql import functions as F

from textlathe.operators import profile as P
from textlathe.operators import segment as S

LONG_A, LONG_B = "Điều 1. " + "a" * 32, "Điều 2. " + "b" * 1472
CASES = {
    "articles of two parts": ("Phần mở đầu\nĐiều 1. Ban hành quy định.\nĐiều 2. Hiệu lực.\nQUY ĐỊNH:\nĐiều 1. Chức năng của Sở.", [(0, "1,2", "Phần mở đầu\nĐiều 1. Ban hành quy định.\nĐiều 2. Hiệu lực."), (1, "1", "QUY ĐỊNH:\nĐiều 1. Chức năng của Sở.")], None),
    "one article": ("Điều 5. Nội dung", [(0, None, "Điều 5. Nội dung")], [(0, "5", "Điều 5. Nội dung")]),
    "inside a line": ("Theo Điều 3. Điều 4: x", [(0, None, "Theo Điều 3. Điều 4: x")], [(0, "3,4", "Theo\nĐiều 3.\nĐiều 4: x")]),
    "numbered clause": ("Điều 3.4 abc", [(0, None, "Điều 3.4 abc")], [(0, "3", "Điều 3.4 abc")]),
    "notice only": ("(Xem file đính kèm)", [], []),
    "too long to join": (f"{LONG_A}\n{LONG_B}", [(0, "1", LONG_A), (0, "2", LONG_B)], [(0, "1,2", f"{LONG_A}\n{LONG_B}")]),
    "empty": ("", [], []),
    "null": (None, [], []),
}


def chunked(spark, text, version):
    rows = spark.createDataFrame([(72, text)], "id long, text string")
    return S.chunk_documents(rows, version=version).orderBy("chunk_index").collect()


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("version", [1, 2])
def test_literal_documents(spark, name, version):
    text, second, first = CASES[name]
    if version == 1 and first is None:
        pytest.skip("same marks, other joins")
    found = chunked(spark, text, version)
    assert [(r["part_index"], r["articles"], r["text"]) for r in found] == (first if version == 1 else second)
    assert [r["chunk_id"] for r in found] == [f"72_{i}" for i in range(len(found))]


@pytest.mark.parametrize(("version", "lengths"), [(2, [1500, 1500, 400, 200]), (1, [1500, 1500, 601])])
def test_last_window_repeats_the_overlap(spark, version, lengths):
    assert [len(r["text"]) for r in chunked(spark, "x" * 3000, version)] == lengths


def test_chunks_are_bounded_and_lose_nothing(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice(["a", "bb ccc", "\n", "\n\n", "Điều 1. x", "\n1. ", "\nĐiều 2a. ", " ", "dài" * 30]) for _ in range(rng.randrange(121)))) for i in range(200)]
    for version in (1, 2):
        found = spark.createDataFrame(rows, "id int, t string").select("id", S.chunk_array(F.col("t"), 100, 20, 10, version).alias("c")).collect()
        for text, pieces in zip((t for _, t in rows), (r["c"] for r in sorted(found))):
            assert all(p["text"] for p in pieces) and (version == 1 or all(len(p["text"]) <= 100 for p in pieces))
            assert set("".join(p["text"] for p in pieces)) >= {c for c in text if not c.isspace()}
            assert version == 1 or sum(len("".join(p["text"].split())) for p in pieces) >= len("".join(text.split()))


def test_oversize_chunks_fail(spark):
    rows = spark.createDataFrame([("1_0", "x" * 1501)], "chunk_id string, text string")
    with pytest.raises(Exception, match="chunk too long: 1_0"):
        P.require_bounded(rows).collect()


def test_integrity_sees_gaps_and_repeats(spark):
    rows = spark.createDataFrame([("a", 0, "a_0"), ("a", 2, "a_2"), ("b", 0, "b_0"), ("b", 1, "b_0")], "doc_id string, chunk_index long, chunk_id string")
    found = {r["doc_id"]: (r["contiguous"], r["unique_ids"]) for r in P.chunk_integrity(rows).collect()}
    assert found == {"a": (False, True), "b": (True, False)}


def plain_windows(text, size, overlap, marks):
    """By the words of the rule, character by character."""
    out, start = [], 0
    while start < len(text):
        stop = min(start + size, len(text))
        if stop < len(text):
            found = [[i for i in range(start + 1, stop) if text[i] == m] for m in marks]
            stop = next((f[-1] for f in found if f), stop)
        out.append(text[start:stop].strip())
        start = stop - overlap if stop - overlap > start else stop
    return [x for x in out if x]


@settings(max_examples=300, deadline=None)
@given(st.text("ab \n", max_size=200), st.integers(2, 30), st.integers(0, 12), st.sampled_from([1, 2]))
def test_windows_by_the_rule(text, size, overlap, version):
    assert S.windows(text, size, overlap, version) == plain_windows(text, size, overlap, " " if version == 1 else "\n ")


def test_a_text_that_fits_is_stripped(spark):
    rows = spark.createDataFrame([(1, "  a b \n"), (2, " "), (3, ""), (4, None)], "id int, t string")
    got = {r["id"]: r["w"] for r in rows.select("id", S.window_array(F.col("t")).alias("w")).collect()}
    assert got == {1: ["a b"], 2: [""], 3: [], 4: None}


def test_enforced_chunks_follow_their_sql(spark, tmp_path):
    from tests.compare import both
    from textlathe import plans

    import duckdb

    texts = ["", None, " \n ", "a b", "x" * 1501, " " + "word " * 400 + "　", ("abc def " + " ") * 300, " " * 1600, " " * 1600]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("enforce_max", "word_windows", "word_windows_v1"):
        ours, theirs = both(plans.QUERIES[name](spark, str(tmp_path)), con, plans.ORACLES[name])
        assert ours == theirs, name


def test_enforced_chunks_are_numbered_without_empty_ones(spark):
    rows = spark.createDataFrame([("d", i, 0, [], t) for i, t in enumerate(["", "a", " ", "x" * 12])], "doc_id string, chunk_index long, part_index long, articles array<string>, text string")
    found = S.enforce_max(rows, 10, 2).orderBy("chunk_index").collect()
    assert [(r["chunk_id"], r["text"]) for r in found] == [("d_0", "a"), ("d_1", " "), ("d_2", "x" * 10), ("d_3", "x" * 4), ("d_4", "xx")]
