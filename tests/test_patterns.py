"""Chains of relations against a search of all edge sequences."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from textlathe.operators import patterns as P
from textlathe.operators.patterns import Hop, chain_matches

EDGES = "src string, rel_type string, dst string"


def searched(docs, edges, hops, begin, ends, closed):
    """All matches, edge by edge."""
    edges = {e for e in edges if None not in e and e[0] in docs and e[2] in docs}
    out = []

    def go(hop, n, at, nodes, path, kinds, used):
        if n >= max(1, hops[hop].low) and (ends[hop] is None or at in ends[hop]):
            done = [*nodes, at]
            if hop + 1 == len(hops):
                if not closed or at == path[0]:
                    out.append((tuple(done), tuple(path), tuple(kinds)))
            else:
                walk(hop + 1, 0, at, done, path, kinds, used)
        if n < hops[hop].high:
            walk(hop, n, at, nodes, path, kinds, used)

    def walk(hop, n, at, nodes, path, kinds, used):
        h = hops[hop]
        for e in edges - used:
            if h.rel_types and e[1] not in h.rel_types:
                continue
            to = set()
            if h.direction != "in" and e[0] == at:
                to.add(e[2])
            if h.direction != "out" and e[2] == at:
                to.add(e[0])
            for t in to:
                go(hop, n + 1, t, nodes, [*path, t], [*kinds, e[1]], used | {e})

    for b in begin:
        walk(0, 0, b, [b], [b], [], frozenset())
    return sorted(out)


CASES = {
    "one": ([Hop()], {}),
    "types": ([Hop(("A",)), Hop(("B", "C"), "in")], {}),
    "both ways, no edge twice": ([Hop(direction="any"), Hop(direction="any")], {}),
    "runs": ([Hop(("A", "B"), "any", 1, 2), Hop((), "out", 1, 2)], {"start": [0, 1, 2]}),
    "cycles": ([Hop(), Hop(), Hop()], {"closed": True}),
    "loops": ([Hop(direction="any", low=1, high=2)], {"closed": True}),
    "conditions": ([Hop(), Hop(("A", "C"), "any")], {"start": [1, 3, 5], "ends": [[2, 3, 4], None]}),
    "nothing ends there": ([Hop(), Hop()], {"ends": [None, []]}),
}


@pytest.mark.parametrize("frontier", [P.FRONTIER, 0])
@pytest.mark.parametrize("case", CASES)
def test_chains_of_a_random_graph(spark, monkeypatch, case, frontier):
    if not frontier and case not in ("runs", "cycles"):
        pytest.skip("salted joins are tried with two of the cases")
    monkeypatch.setattr(P, "FRONTIER", frontier)
    rng = random.Random(case)
    edges = [(str(rng.randrange(8)), rng.choice("ABC"), str(rng.randrange(8))) for _ in range(22)]
    edges += [edges[0], ("3", "A", "3"), ("99", "A", "1"), ("1", "A", "99"), (None, "A", "1"), ("1", None, "2")]
    hops, how = CASES[case]
    docs = {str(i) for i in range(8)}
    ends = [None if e is None else {str(i) for i in e} for e in how.get("ends", [None] * len(hops))]
    asked = [h if e is None else Hop(h.rel_types, h.direction, h.low, h.high, F.col("id").isin(*e) if e else F.lit(False)) for h, e in zip(hops, ends)]
    begin = [str(i) for i in how.get("start", range(8))]
    rows = spark.createDataFrame([(i, "t") for i in docs] + [(None, "t")], "id string, title string")
    # of several columns with the names that matches have
    clash = spark.createDataFrame(edges, EDGES).withColumns({"at": F.lit(1), "to": F.lit(2), "path": F.lit("x"), "used": F.lit(3)})
    got = chain_matches(rows, clash, asked, start=F.col("id").isin(*begin), closed=how.get("closed", False))
    assert sorted((tuple(r["nodes"]), tuple(r["path"]), tuple(r["rel_types"])) for r in got.collect()) == searched(docs, edges, hops, begin, ends, how.get("closed", False))


def test_chains_of_empty_tables(spark):
    docs, edges = spark.createDataFrame([("1",)], "id string"), spark.createDataFrame([("1", "A", "1")], EDGES)
    assert chain_matches(docs.limit(0), edges, [Hop()]).count() == 0
    assert chain_matches(docs, edges.limit(0), [Hop()]).count() == 0
    assert [tuple(r) for r in chain_matches(docs, edges, [Hop()], start_ids=[" 1 ", "7"]).collect()] == [(["1", "1"], ["1", "1"], ["A"])]
    with pytest.raises(ValueError, match="no such hop"):
        Hop(low=0)
    with pytest.raises(ValueError, match="one hop"):
        chain_matches(docs, edges, [])


def test_ids_beyond_the_frontier_do_not_go_through_the_driver(spark, monkeypatch):
    monkeypatch.setattr(P, "FRONTIER", 0)
    plans, stored = [], P.scratch_table

    def watched(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return stored(df, name)

    monkeypatch.setattr(P, "scratch_table", watched)
    docs = spark.createDataFrame([(str(i),) for i in range(9)], "id string")
    edges = spark.createDataFrame([(str(i), "A", str((i + 1) % 9)) for i in range(9)], EDGES)
    assert chain_matches(docs, edges, [Hop(), Hop()]).count() == 9
    kept = [plan for name, plan in plans if name in ("chain-forth", "chain-back")]
    assert kept and not any("BroadcastHashJoin" in plan for plan in kept)


@pytest.mark.parametrize("name", ["relation_cycles", "expired_basis"])
def test_queries_on_all_relations_store_no_texts_and_steps(spark, sf_dir, monkeypatch, name):
    from tests.compare import both, connect
    from textlathe import plans

    monkeypatch.setattr(plans.graphs.stores, "graph", None)
    ours, theirs = both(plans.QUERIES[name](spark, sf_dir), connect(sf_dir), plans.ORACLES[name])
    assert ours == theirs
