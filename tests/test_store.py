"""Merging into a stored graph: the same tables from any loads, and nothing written where nothing changes."""

from __future__ import annotations

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from textlathe.operators import graph as G
from textlathe.operators.store import GraphStore
from textlathe.operators.stored import picked
from textlathe.sources.tables import scratch_path

REL = "doc_id string, other_doc_id string, relationship string, at int"


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    docs = [(rng.randrange(30), rng.choice(["A", "B", None]), rng.choice(["x", "y"]), i) for i in range(60)]
    rels = [(str(rng.randrange(34)), str(rng.randrange(34)), rng.choice(["sửa đổi bởi", "Sửa đổi  bởi", "căn cứ", "5-LOW"]), i) for i in range(150)]
    chunks = [(f"{rng.randrange(20)}_c{rng.randrange(3)}", None, None, None, rng.choice([None, "1,2", "3"]), f"t{i}", i) for i in range(60)]
    return (spark.createDataFrame(docs, "id long, title string, nganh string, at int"), spark.createDataFrame(rels, REL), spark.createDataFrame(chunks, "chunk_id string, doc_id string, chunk_index long, part_index long, articles string, text string, at int"))


def contents(store):
    rows = {"documents": store.documents.rows(), "edges": store.edges.rows(), "chunks": store.chunks.rows(), "steps": store.steps.rows(), "part_of": store.part_of(), "waiting": store.waiting.rows()}
    return {name: sorted(map(repr, df.collect())) for name, df in rows.items()}


def files(store):
    return {f: os.path.getmtime(f) for f in glob.glob(store.path.removeprefix("file:") + "/**/*.parquet", recursive=True)}


@pytest.mark.parametrize(("order", "seeds"), [("at", (0, 1)), (None, (0,))])
def test_loads_in_any_split(spark, tables, order, seeds):
    whole = GraphStore(spark, scratch_path(spark, "graph"), 4)
    whole.load(*tables, order=order)
    expected = contents(whole)
    for seed in seeds:
        split = GraphStore(spark, scratch_path(spark, "graph"), 4)
        parts = [[t.where(F.pmod(F.xxhash64(F.lit(seed), *t.columns), F.lit(2)) == k) for t in tables] for k in range(2)]
        metadata, rels, chunks = zip(*parts)
        if seed:
            split.load(metadata[0], rels[0], chunks[0], order=order)
            split.load(metadata[1], rels[1], chunks[1], order=order)
        else:  # edges first: all of them wait
            split.load(relationships=rels[1], order=order)
            split.load(relationships=rels[0], chunks=chunks[1], order=order)
            split.load(metadata=metadata[1], order=order)
            split.load(metadata=metadata[0], chunks=chunks[0], order=order)
        assert contents(split) == expected
    before = files(whole)
    assert set(whole.load(*tables, order=order).values()) == {0}
    assert files(whole) == before and contents(whole) == expected


def test_same_as_one_build(spark, tables):
    store = GraphStore(spark, scratch_path(spark, "graph"), 4)
    store.load(*tables, order="at")
    graph = G.build_graph(*tables, order="at", indexes=False)
    for name in ("documents", "edges", "chunks"):
        theirs = graph[name]
        assert sorted(map(repr, getattr(store, name).rows().select(theirs.columns).collect())) == sorted(map(repr, theirs.collect()))
    assert sorted(store.part_of().collect()) == sorted(graph["part_of"].collect())


def test_only_touched_folders_are_rewritten(spark, tables):
    store = GraphStore(spark, scratch_path(spark, "graph"), 16)
    store.load(*tables, order="at")
    before = files(store)
    done = store.load(metadata=spark.createDataFrame([(7, "new", "z", 1000)], "id long, title string, nganh string, at int"), order="at")
    after = files(store)
    gone, new = {os.path.dirname(f) for f in before if f not in after}, {os.path.dirname(f) for f in after if f not in before}
    assert done["documents"] == 1 and len(gone | new) == 1 and "documents" in next(iter(new))
    assert [r["title"] for r in store.documents.picked(["7"]).collect()] == ["new"]
    assert store.load(metadata=spark.createDataFrame([(7, "old", "z", 1)], "id long, title string, nganh string, at int"), order="at")["documents"] == 0


def test_lookups(spark, tables, monkeypatch):
    from textlathe.operators import stored as S

    store = GraphStore(spark, scratch_path(spark, "graph"), 8)
    store.load(*tables, order="at")
    rows = store.steps.rows().collect()
    for keys in (["3"], ["3", "4", "none"], [], ["1", None]):
        expected = sorted(r for r in rows if r["a"] in keys)
        assert sorted(store.steps.picked(keys).collect()) == expected
        assert sorted(picked(store.steps, "a", [k for k in keys if k]).collect()) == sorted(picked(store.steps.rows(), "a", [k for k in keys if k]).collect()) == expected
        for most in (1000, 0):
            monkeypatch.setattr(S, "NAMED_KEYS", most)
            assert sorted(store.steps.picked(spark.createDataFrame([(k,) for k in keys], "k string")).collect()) == expected
    plan = store.steps.picked(["3"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(a,3)" in plan


def test_empty_and_odd_loads(spark, tables):
    store = GraphStore(spark, scratch_path(spark, "graph"), 4)
    assert store.documents.rows().count() == 0 and store.documents.picked(["1"]).count() == 0
    assert set(store.load(*(t.limit(0) for t in tables)).values()) == {0}
    rows = spark.createDataFrame([(None, "x"), ("1", None)], "id string, title string")
    rels = spark.createDataFrame([(None, "1", "r", 0), ("1", None, "r", 0), ("1", "1", None, 0), ("1", "2", "***", 0)], REL)
    store.load(rows, rels)
    assert [(r["id"], r["title"]) for r in store.documents.rows().collect()] == [("1", None)]
    assert [tuple(r)[:3] for r in store.edges.rows().collect()] == [("1", "RELATED_TO", "1")]
    assert [tuple(r)[:3] for r in store.waiting.rows().collect()] == [("1", "RELATED_TO", "2")]


def test_the_graph_of_the_test_tables_stores_no_texts(spark, sf_dir):
    from textlathe.plans import stores

    assert stores.graph(spark, sf_dir).chunks.rows().isEmpty()


def test_rows_are_moved_once(spark, tables, monkeypatch):
    """First rows go through no scratch table, relations of several loads are settled at once, and those of a repeated
    load are not kept again, settled or not."""
    from textlathe.operators import store as L
    from textlathe.operators import stored as S

    written = []
    for module in (L, S):
        monkeypatch.setattr(module, "scratch_table", lambda df, name, write=module.scratch_table: written.append(name) or write(df, name))
    metadata, rels, chunks = tables
    store = GraphStore(spark, scratch_path(spark, "graph"), 4)
    store.load(metadata.where("id % 2 = 0"), rels, chunks, order="at")
    assert written == []
    store.load(metadata.where("id % 2 = 1"), order="at")
    assert store.load(metadata.where("id % 2 = 0"), rels.orderBy(F.desc("at")), order="at") == {"documents": 0, "relations": 0}
    assert written.count("settled") == 0
    whole = GraphStore(spark, scratch_path(spark, "graph"), 4)
    whole.load(*tables, order="at")
    assert contents(store) == contents(whole)
    assert store.load(relationships=rels, order="at") == {"relations": 0} and store.load(relationships=rels.limit(3), order="at") == {"relations": 1}
    before = {f for f in files(store) if "/noted/" not in f}
    assert contents(store) == contents(whole) and set(files(store)) == before


def test_many_new_rows_come_beside_the_stored_ones(spark):
    rows = lambda *parts: spark.createDataFrame([(i, title, "z", at) for ids, title, at in parts for i in ids], "id long, title string, nganh string, at int")
    store = GraphStore(spark, scratch_path(spark, "graph"), 1)
    store.load(rows((range(20), "a", 0)), order="at")
    first = set(files(store))
    assert store.load(rows((range(20), "a", 0), (range(20, 40), "b", 0)), order="at")["documents"] == 1
    assert first < set(files(store))  # nothing was rewritten
    second = set(files(store))
    store.load(rows((range(1), "c", 1), (range(40, 80), "d", 0)), order="at")  # a row is replaced: the folder is rewritten
    assert not second & set(files(store))
    third = set(files(store))
    store.load(rows((range(100, 101), "e", 0)), order="at")  # one row is no file of its own
    assert not third & set(files(store))
    assert sorted((int(r["id"]), r["title"]) for r in store.documents.rows().collect()) == [(0, "c"), *((i, "a") for i in range(1, 20)), *((i, "b") for i in range(20, 40)), *((i, "d") for i in range(40, 80)), (100, "e")]


def test_names_of_loads_tell_rows_apart(spark):
    from textlathe.operators.store import digest

    schema = "src string, dst string"
    names = [digest(spark.createDataFrame(rows, schema))[1] for rows in ([("a", None)], [(None, "a")], [("a", None)] * 2, [("a", ""), ("b", "c")], [("b", ""), ("a", "c")])]
    assert len(set(names)) == 5
    assert digest(spark.createDataFrame([("a", "b"), ("c", None)], schema)) == digest(spark.createDataFrame([("c", None), ("a", "b")], schema).repartition(2))


def test_a_settling_that_broke_off_is_repeated(spark, tables, monkeypatch):
    store, whole = (GraphStore(spark, scratch_path(spark, "graph"), 4) for _ in range(2))
    whole.load(*tables, order="at")
    metadata, rels, chunks = tables
    store.load(metadata.where("id % 2 = 0"), rels.where("at % 2 = 0"), chunks, order="at")
    assert store.waiting.rows().count()
    store.load(metadata, rels, order="at")
    for broken in (store._steps, store._waiting):
        with monkeypatch.context() as m:
            m.setattr(type(store._edges), "merge", lambda self, rows, merge=type(store._edges).merge, path=broken.path: merge(self, rows) if self.path != path else 1 / 0)
            with pytest.raises(ZeroDivisionError):
                store.settle()
    assert contents(store) == contents(whole)


def test_searches_look_up_documents_and_relations(spark, sf_dir, monkeypatch):
    """No graph is stored for a search, and nothing is joined for few keys."""
    from textlathe import plans
    from textlathe.plans import stores

    monkeypatch.setattr(stores, "GraphStore", None)
    assert all(plans.QUERIES[name](spark, sf_dir).count() == 5 for name in ("search_by_keyword", "hybrid_retrieve"))
    rows, keys = spark.range(100).select(F.col("id").cast("string").alias("k")), spark.createDataFrame([("3",), (None,), ("3",), ("200",)], "k string")
    few = picked(rows, "k", keys)
    assert [r["k"] for r in few.collect()] == ["3"] and "Join" not in few._jdf.queryExecution().executedPlan().toString()
    assert picked(rows, "k", rows.unionByName(spark.range(2000).selectExpr("cast(id AS string) AS k"))).count() == 100
