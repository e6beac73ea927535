"""The graph on five documents, and the checks of its tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from textlathe.operators import graph as G


@pytest.fixture(scope="module")
def graph(spark):
    metadata = spark.createDataFrame([(i, t) for i, t in enumerate("ABCDE", 1)], "id long, title string")
    rels = spark.createDataFrame([(1, "2", "sửa đổi bởi"), (1, "2", "sửa đổi bởi"), (2, "3", "hết hiệu lực bởi"), (4, "9", "căn cứ"), (3, "3", "x")], "doc_id long, other_doc_id string, relationship string")
    return G.build_graph(metadata, rels, content=spark.createDataFrame([(1, "một"), (None, "không"), (7, "bảy")], "id long, text string"))


def test_edges(graph):
    assert sorted((r["src"], r["rel_type"], r["dst"]) for r in graph["edges"].collect()) == [("1", "SUA_OI_BOI", "2"), ("2", "HET_HIEU_LUC_BOI", "3"), ("3", "X", "3")]


def test_chunks_of_content(graph):
    assert sorted(r["chunk_id"] for r in graph["chunks"].collect()) == ["1_c0", "7_c0"]
    assert [tuple(r) for r in graph["part_of"].collect()] == [("1_c0", "1")]


@pytest.mark.parametrize(("doc", "expected"), [(1, [[("SUA_OI_BOI", "2", "B")]]), (5, [[(None, None, None)]]), (99, [])])
def test_legal_status(graph, doc, expected):
    found = G.legal_status(graph["documents"], graph["edges"], doc).collect()
    assert [[tuple(x) for x in r["quan_he"]] for r in found] == expected


def test_incoming(graph):
    assert [tuple(r) for r in G.incoming_relations(graph["documents"], graph["edges"], 2).collect()] == [("SUA_OI_BOI", "1", "A")]


@pytest.mark.parametrize(("a", "b", "path", "titles"), [(1, 3, [["1", "2", "3"]], [["A", "B", "C"]]), (3, 1, [["3", "2", "1"]], [["C", "B", "A"]]), (1, 4, [], []), (2, 2, [["2"]], [["B"]]), (1, 99, [], [])])
def test_shortest_path(graph, a, b, path, titles):
    found = G.shortest_path(graph["documents"], G.steps_of(graph["edges"]), a, b).collect()
    assert [r["path"] for r in found] == path and [r["titles"] for r in found] == titles


@pytest.mark.parametrize("hops", [1, 2, 3, 4])
def test_paths_of_a_random_graph(spark, hops):
    """Against a search of all paths: the fewest hops, and of these the first ids; the bound on hops holds."""
    rng = random.Random(hops)
    pairs = {(rng.randrange(14), rng.randrange(14)) for _ in range(16)}
    docs = spark.createDataFrame([(str(i), f"t{i}") for i in range(14)], "id string, title string")
    edges = spark.createDataFrame([(str(a), str(b), f"R{(a + b) % 3}") for a, b in pairs], "src string, dst string, rel_type string")
    near = {str(i): {str(b) for a, b in pairs if a == i} | {str(a) for a, b in pairs if b == i} for i in range(14)}
    paths = [["0"]]
    for _ in range(hops):
        if any(p[-1] == "9" for p in paths):
            break
        paths = [[*p, n] for p in paths for n in near[p[-1]] if n not in p]
    expected = min((p for p in paths if p[-1] == "9"), default=None)
    assert [r["path"] for r in G.shortest_path(docs, G.steps_of(edges), 0, 9, hops).collect()] == ([expected] if expected else [])


def test_inputs_without_chunks_warn(spark, graph):
    with pytest.warns(UserWarning, match="no chunks"):
        bare = G.build_graph(graph["documents"], spark.createDataFrame([], "doc_id string, other_doc_id string, relationship string"), indexes=False)
    assert set(bare) == {"documents", "edges"}
    assert {(r["term"], r["id"]) for r in graph["title_terms"].collect()} == {(t.lower(), str(i)) for i, t in enumerate("ABCDE", 1)}
    assert {r["term"] for r in graph["chunk_terms"].collect()} == {"một", "bảy"}


def test_last_row_by_a_column_or_by_value(spark):
    rows = spark.createDataFrame([(1, "x", 1), (1, "b", 3), (1, "c", 2)], "id long, title string, at int")
    rels = spark.createDataFrame([(1, 1, "a b", 1), (1, 1, "A B", 2)], "doc_id long, other_doc_id long, relationship string, at int")
    for order, title, label in ((None, "x", "a b"), ("at", "b", "A B")):
        got = G.build_graph(rows, rels, content=rows.select("id", F.lit("x").alias("text")), order=order, indexes=False)
        assert got["documents"].first()["title"] == title and got["edges"].first()["raw_label"] == label


def test_parts_and_articles(spark):
    rows = spark.createDataFrame([("d_0", "d", 0, 0, ["2"], "x"), ("d_1", "d", 1, 0, ["10", "1a"], "y")], "chunk_id string, doc_id string, chunk_index long, part_index long, articles array<string>, text string")
    assert [tuple(r) for r in G.document_parts(rows, "d").collect()] == [(0, 2, ["10", "1a", "2"])]


def test_index_that_cannot_be_found_fails(spark):
    rows = spark.createDataFrame([("72_0", "72", None, "0", None, "x")], "chunk_id string, doc_id string, chunk_index string, part_index string, articles string, text string")
    with pytest.raises(Exception, match="no chunk_index"):
        G.normalize_chunks(rows).collect()
    assert G.normalize_chunks(rows, plain_suffix=True).first()["chunk_index"] == 0


def test_chunk_rows(spark):
    rows = spark.createDataFrame([("72_c0", None, None, None, "12,13a"), ("72_0", None, "5", "1", None), ("9_c12", "9", None, "2", " 1 ,, 2 ")], "chunk_id string, doc_id string, chunk_index string, part_index string, articles string").withColumn("text", F.lit("x"))
    got = [tuple(r)[:5] for r in G.normalize_chunks(rows).collect()]
    assert got == [("72_c0", "72", 0, 0, ["12", "13a"]), ("72_0", "72_0", 5, 1, []), ("9_c12", "9", 12, 2, ["1", "2"])]


def test_inputs_are_checked(spark, graph):
    with pytest.raises(ValueError):
        G.build_graph(graph["documents"], graph["edges"], chunks=graph["chunks"], content=graph["chunks"])
    with pytest.raises(ValueError, match="part_index"):
        G.require_columns(graph["chunks"].drop("part_index"), G.CHUNK_COLUMNS)


def test_last_row_of_an_id_sets_all_properties(spark):
    rows = spark.createDataFrame([(1.0, "a", 0), (1.0, None, 1), (None, "c", 2)], "id double, title string, at long")
    assert [(r["id"], r["title"]) for r in G.upsert_nodes(rows, "id", "at").collect()] == [("1", None)]


@pytest.mark.parametrize("frontier", [100_000, 0])
def test_paths_of_many_pairs(spark, monkeypatch, frontier):
    """Each pair as if it were asked alone, with a broadcast frontier and with salted steps."""
    monkeypatch.setattr(G, "FRONTIER", frontier)
    monkeypatch.setattr(G, "SALTS", 3)
    rng = random.Random(7)
    pairs = {(rng.randrange(12), rng.randrange(12)) for _ in range(14)} | {(0, i) for i in range(12)}  # 0 is a hub
    docs = spark.createDataFrame([(str(i), f"t{i}") for i in range(14)], "id string, title string")
    steps = G.steps_of(spark.createDataFrame([(str(a), str(b), f"R{(a + b) % 3}") for a, b in pairs], "src string, dst string, rel_type string"))
    asked = [(1, 2), (3, 9), (3, 4), (0, 5), (5, 5), (12, 1), (1, 12), (13, 13), (77, 1), (1, 77), (11, 10), (1, 2)]
    got = {(r["a"], r["b"]): (r["hops"], r["path"], r["titles"]) for r in G.shortest_paths(docs, steps, spark.createDataFrame(asked, "a long, b long"), 3).collect()}
    near = {str(i): {str(b) for a, b in pairs if a == i} | {str(a) for a, b in pairs if b == i} for i in range(14)}

    def alone(a, b):
        paths = [[a]] if a in near else []
        for _ in range(4):
            hit = [p for p in paths if p[-1] == b]
            if hit:
                return min(hit)
            paths = [[*p, n] for p in paths for n in near[p[-1]] if n not in p]

    expected = {(str(a), str(b)): p for a, b in asked if (p := alone(str(a), str(b)))}
    assert got == {k: (len(p) - 1, p, [f"t{i}" for i in p]) for k, p in expected.items()}


def test_a_path_is_searched_to_half_its_length_from_each_end(spark, monkeypatch):
    """Twenty ways out of each end and of each node there: four hops from one end would reach 20 + 400 nodes and more."""
    sizes, stored = [], G.scratch_table

    def watched(df, name):
        out = stored(df, name)
        if name in ("paths-rim", "paths-level"):
            sizes.append(out.count())
        return out

    monkeypatch.setattr(G, "scratch_table", watched)
    tree = [(end, f"{end}{i}") for end in "ab" for i in range(20)] + [(f"{end}{i}", f"{end}{i}_{j}") for end in "ab" for i in range(20) for j in range(20)]
    edges = [*tree, ("a0", "m"), ("b0", "m")]
    docs = spark.createDataFrame([(n, n) for n in sorted({x for e in edges for x in e})], "id string, title string")
    steps = G.steps_of(spark.createDataFrame([(x, y, "R") for x, y in edges], "src string, dst string, rel_type string"))
    found = G.shortest_paths(docs, steps, spark.createDataFrame([("a", "b"), ("a", "a0_1"), ("b", "nowhere")], "a string, b string"))
    assert sorted((r["a"], r["b"], r["path"]) for r in found.collect()) == [("a", "a0_1", ["a", "a0", "a0_1"]), ("a", "b", ["a", "a0", "m", "b0", "b"])]
    assert max(sizes) < 450


def test_only_nodes_with_very_many_steps_are_salted(spark, monkeypatch):
    monkeypatch.setattr(G, "HEAVY", 3)
    monkeypatch.setattr(G, "SALTS", 3)
    steps = spark.createDataFrame([("h", str(i)) for i in range(9)] + [("x", "1"), ("y", "2")], "at string, to string")
    level = spark.createDataFrame([("h", 1), ("h", 2), ("x", 3), ("z", 4)], "at string, n int")
    got = sorted((r["at"], r["to"], r["n"]) for r in G.with_steps(steps, level, 0).collect())
    assert got == sorted([("h", str(i), n) for i in range(9) for n in (1, 2)] + [("x", "1", 3)])
