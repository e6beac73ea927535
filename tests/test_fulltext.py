"""The stored full-text index against a search by loops over small texts."""

from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from textlathe.operators import fulltext as T

WORDS = "an ant bat bats batter cat cast coat đê điều".split()
N = 120


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(0)
    weights = [2.0**-i for i in range(len(WORDS))]
    texts = {i: " ".join(rng.choices(WORDS, weights, k=rng.randrange(0, 12))).capitalize() + rng.choice([".", "!", " - x", ""]) for i in range(N)}
    return texts | {500: None, 501: "", 502: "...", 503: "ant " * 3000, 504: "to be or not to be", 505: "be to or to not be"}


@pytest.fixture(scope="module")
def index(spark, corpus):
    rows = spark.createDataFrame(list(corpus.items()), "id long, text string").repartition(5)
    return T.build_index(rows, "id", "text", block=8, buckets=5, spelling=True)


def split(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def by_loops(corpus: dict, q: T.Query) -> dict[int, float]:
    terms = {i: split(t) for i, t in corpus.items()}
    mean = sum(map(len, terms.values())) / len(terms)
    df = {w: sum(w in t for t in terms.values()) for w in {w for t in terms.values() for w in t}}
    idf = lambda w: math.log(1 + (len(terms) - df.get(w, 0) + 0.5) / (df.get(w, 0) + 0.5))
    score = lambda tf, n: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))

    def leaf(q: T.Leaf) -> dict[int, float]:
        out = {}
        for i, t in terms.items():
            if q.kind == "prefix":
                if any(w.startswith(q.text) for w in t):
                    out[i] = 1.0
            elif q.kind == "fuzzy":
                near = {w: edits(w, q.text) for w in set(t)}
                found = {w: e for w, e in near.items() if e <= q.edits}
                if found:
                    out[i] = sum(idf(w) * (1 - e / len(q.text)) * score(t.count(w), len(t)) for w, e in found.items())
            else:
                asked = q.text.split()
                n = sum(t[at : at + len(asked)] == asked for at in range(len(t)))
                if n:
                    out[i] = sum(map(idf, asked)) * score(n, len(t))
        return out

    def run(q: T.Query) -> dict[int, float]:
        if isinstance(q, T.Leaf):
            return leaf(q)
        must, should, without = ([run(p) for p in parts] for parts in (q.must, q.should, q.must_not))
        hits = set.intersection(*map(set, must)) if must else {i for s in should for i in s}
        hits -= {i for s in without for i in s}
        return {i: sum(s.get(i, 0) for s in must + should) for i in hits}

    return run(q)


QUERIES = [
    T.word("an"), T.word("nothing"), T.phrase("an ant"), T.phrase("to be or not to be"), T.phrase("ant ant ant"), T.prefix("ba"), T.prefix("zz"), T.fuzzy("cat", 1), T.fuzzy("batr", 2), T.fuzzy("bat", 0),
    T.word("ant") & T.word("bat"), T.word("ant") | T.word("coat"), T.word("an") & ~T.word("bat"), (T.phrase("an ant") | T.word("đê")) & ~T.prefix("ca"), T.Clauses(must=(T.word("an"),), should=(T.word("ant"), T.word("cast")), must_not=(T.phrase("bat an"),)),
    (T.word("an") & T.word("ant")) | (T.word("bats") & T.fuzzy("cost", 1)), T.Clauses(),
]


@pytest.mark.parametrize("few", [False, True])
@pytest.mark.parametrize("q", QUERIES, ids=range(len(QUERIES)))
def test_queries(index, corpus, monkeypatch, q, few):
    """All shards at once, and the best ones first: the same hits and scores."""
    monkeypatch.setattr(T, "FEW_SHARDS", 1000 if few else 0)
    monkeypatch.setattr(T, "FIRST_SHARDS", 2)
    expected = sorted(((-round(s, 6), i) for i, s in by_loops(corpus, q).items()))
    for k in (5,) if few else (5, 1000):
        assert [(-round(r["score"], 6), r["id"]) for r in T.search(index, q, k).collect()] == expected[:k]


def test_bounds_hold_and_skip_shards(index, corpus):
    """No text scores more than the bound of its shard, and the bounds of a rare word leave shards out."""
    for q in QUERIES[:-1]:
        leaves = list(dict.fromkeys(T.leaves_of(q)))
        asked = T.asked_terms(index, leaves)
        if not asked.named:
            continue
        bound = {r["shard"]: r["bound"] for r in T.bounds(index, q, asked).collect()}
        shard = {r["id"]: r["shard"] for r in index.table("postings").select("shard", F.explode("id").alias("id")).distinct().collect()}
        assert all(s <= bound[shard[i]] * (1 + 1e-9) for i, s in by_loops(corpus, q).items())
    rare = T.asked_terms(index, [T.phrase("to be or not to be")])
    assert T.bounds(index, T.phrase("to be or not to be"), rare).count() <= 2 < index.n_shards


def test_words_that_stand_for_many_are_joined(index, corpus, monkeypatch):
    monkeypatch.setattr(T, "NAMED_TERMS", 1)
    for q in (T.prefix("ba"), T.word("an") & T.prefix("b"), T.fuzzy("bat", 2)):
        expected = sorted(((-round(s, 6), i) for i, s in by_loops(corpus, q).items()))
        assert [(-round(r["score"], 6), r["id"]) for r in T.search(index, q, 1000).collect()] == expected


def test_search_lines(spark):
    w, p = T.word, T.phrase
    any_of = lambda *parts: T.Clauses(should=parts)
    cases = {
        "The Ing": any_of(w("the"), w("ing")), '"To be" or': any_of(p("to be"), w("or")), "+a -b c": T.Clauses((w("a"),), (w("c"),), (w("b"),)), "a AND b": T.Clauses((w("a"), w("b"))), "a OR b": any_of(w("a"), w("b")),
        "a NOT b": T.Clauses((), (w("a"),), (w("b"),)), "hợp đồ*": any_of(w("hợp"), T.prefix("đồ")), "cat~1 dog~": any_of(any_of(T.fuzzy("cat", 1)), any_of(T.fuzzy("dog", 2))), "12/2020": any_of(any_of(w("12"), w("2020"))),
        "x x X": any_of(w("x")), "": T.Clauses(), "?? ** \"\"": T.Clauses(), '"open': any_of(p("open")), '-"a b" c': T.Clauses((), (w("c"),), (p("a b"),)),
    }
    for line, q in cases.items():
        assert T.keywords(spark, line) == q, line


def test_no_meaning(index):
    with pytest.raises(ValueError):
        T.word("a") | ~T.word("b")
    with pytest.raises(ValueError):
        T.fuzzy("a", 3)
    assert T.search(index, ~T.word("an")).count() == 0 and T.search(index, "-an").count() == 0 and T.search(index, "").count() == 0


def test_reopened(spark, index, corpus):
    expected = sorted(((-round(s, 6), i) for i, s in by_loops(corpus, T.word("an")).items()))[:5]
    assert [(-round(r["score"], 6), r["id"]) for r in T.search(T.open_index(spark, index.path), "an", 5).collect()] == expected


def test_plan_reads_folders_of_terms_only(index):
    plan = T.scores(index, T.word("coat"), T.asked_terms(index, [T.word("coat")]))._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert f"PartitionFilters: [isnotnull(bucket" in scan and f"= {T.folder('coat', 5)})]" in scan and "EqualTo(term,coat)" in scan and "positions" not in scan


def test_empty_table(spark):
    index = T.build_index(spark.createDataFrame([], "id string, text string"), "id", "text")
    assert index.n_docs == 0 and T.search(index, "a").count() == 0 and T.search(index, "a*").count() == 0


def test_places_of_terms(spark, corpus):
    rows = spark.createDataFrame(list(corpus.items()), "id long, text string")
    for most in (1, 50, 1 << 21):
        got: dict = {}
        for r in T.places(rows, "id", "text", most).collect():
            got.setdefault(r["id"], []).append((r["term"], r["n_terms"], r["positions"], r["first"]))
        assert set(got) == set(corpus)
        for i, found in got.items():
            terms = split(corpus[i])
            expected = {t: [at for at, x in enumerate(terms) if x == t] for t in terms} or {None: []}
            assert {t: p for t, _, p, _ in found} == expected and {n for _, n, _, _ in found} == {len(terms)}
            assert len(found) == len(expected) and sum(f for *_, f in found) == 1


@pytest.mark.parametrize(("most", "files"), [(1_000_000, 8), (100, 40)])
def test_files_do_not_grow_with_folders_times_tasks(spark, monkeypatch, most, files):
    """800 postings in 8 folders: one file a folder, or one for some hundred postings."""
    monkeypatch.setattr(T, "PART_ROWS", most)
    rows = spark.createDataFrame([(i, " ".join(f"w{(i + j) % 40}" for j in range(4))) for i in range(400)], "id long, text string")
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    for k, v in zip(old, ("false", "32")):
        spark.conf.set(k, v)
    try:
        index = T.build_index(rows, "id", "text", block=4, buckets=8)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    stored = index.table("postings")
    assert len(stored.inputFiles()) <= files and stored.agg(F.sum(F.size("id"))).first()[0] == 1600
    assert [r["id"] for r in T.search(index, "w7", 3).collect()] == [4, 5, 6]


def test_build_writes_nothing_beside_the_index(spark, corpus, tmp_path):
    from textlathe.sources import tables

    before = list(tables.SCRATCH)
    T.build_index(spark.createDataFrame(list(corpus.items()), "id long, text string"), "id", "text", f"{tmp_path}/index", block=8)
    assert tables.SCRATCH == before and sorted(p.name for p in tmp_path.glob("index/*")) == ["postings", "stats", "terms"]


def test_shards_of_many_terms_are_cut(spark, corpus, monkeypatch):
    """Texts that share an id stay together, and no shard has two blocks of a term, so bounds hold."""
    twice = [*corpus.items(), *[(i, corpus[i]) for i in range(0, N, 3)]]
    rows = spark.createDataFrame(twice, "id long, text string")
    whole, cut = (T.build_index(rows, "id", "text", block=50, buckets=3, most=most) for most in (1 << 21, 10))
    blocks = {name: index.table("postings").collect() for name, index in (("whole", whole), ("cut", cut))}
    hits = {name: sorted((r["term"], i, tf, n, p) for r in found for i, tf, n, p in zip(r["id"], r["tf"], r["n_terms"], r["positions"])) for name, found in blocks.items()}
    terms = [(i, split(t)) for i, t in twice]
    assert hits["whole"] == hits["cut"] == sorted((w, i, t.count(w), len(t), [at for at, x in enumerate(t) if x == w]) for i, t in terms for w in set(t))
    for found in blocks.values():
        assert len({(r["term"], r["shard"]) for r in found}) == len(found)
        assert len({(i, r["shard"]) for r in found for i in r["id"]}) == len({i for i, t in terms if t})
        top = lambda r: max(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / whole.mean)) for tf, n in zip(r["tf"], r["n_terms"]))
        assert all(abs(r["top"] - top(r)) < 1e-12 and r["id"] == sorted(r["id"]) for r in found)
    assert len({r["shard"] for r in blocks["cut"]}) > len({r["shard"] for r in blocks["whole"]})
    monkeypatch.setattr(T, "FEW_SHARDS", 0)
    monkeypatch.setattr(T, "FIRST_SHARDS", 1)
    for q in (T.word("an"), T.phrase("an ant"), T.prefix("ba") & T.word("cat")):
        assert [tuple(r) for r in T.search(cut, q, 1000).collect()] == [tuple(r) for r in T.search(whole, q, 1000).collect()]


def test_pages_of_long_texts_give_their_blocks_back():
    import pyarrow as pa

    for n in (70, 70_000):
        texts = [["a", "b"] * (n // 2) + ["c"], [], ["b", "é"]]
        got = {}
        for row in T.shard_pages(4, pa.array(["x", "y", "z"]), pa.array(texts, pa.list_(pa.string())), 3).to_pylist():
            assert row["wide"] == (n > 1 << 16)
            got |= {(r["bucket"], r["term"]): r for r in T.page_blocks(row, pa.string(), 2.0).to_pylist()}
        assert set(got) == {(T.folder(t, 3), t) for t in "abcé"} and {r["shard"] for r in got.values()} == {4}
        b = got[T.folder("b", 3), "b"]
        assert (b["id"], b["tf"], b["n_terms"], b["positions"]) == (["x", "z"], [n // 2, 1], [n + 1, 2], [list(range(1, n, 2)), [0]])
