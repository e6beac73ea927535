"""Main text of pages, the two classifiers by held-out accuracy, and the pipeline stage by stage."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from textlathe.llm import html_text as X
from textlathe.llm import quality as Q
from textlathe.llm import toxicity as T
from textlathe.llm.folds import fold
from textlathe.llm.subwords import BUCKETS, STOPS, bag, grams

import corpus_pipeline
from tests.llm.test_exact import components_by_brute_force, contaminated_by_brute_force, removed_by_brute_force

PARAGRAPHS = ["The first paragraph of the article has a fair number of words & signs in it.", "Here a second one follows, with more words than any menu would ever have.", "Short end."]
PAGE = f"""<!doctype html><html><head><title>T</title><style>p {{ color: red }}</style><script>var x = "<p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a><li><a href=/a>About</a></ul></nav>
<div class="cookie-notice">We use cookies.</div>
<article><h1>A headline</h1><p>{PARAGRAPHS[0].replace("&", "&amp;")}<p>{PARAGRAPHS[1]}</p><div class="advert">Buy now!</div><!-- hidden --><p>Short&#32;
   end.</p><form><input value=x>Sign up <button>Go</button></form></article>
<aside>Related things to read</aside><section class="comments"><p>A reader said something quite long about the article above, and went on and on.</p></section>
<footer>Copyright</footer></body></html>"""


def test_main_text_of_a_page():
    assert X.main_text(PAGE) == "\n".join(["A headline", *PARAGRAPHS])


@pytest.mark.parametrize("html", [None, "", "   ", "<p></p>", "<script>x</script>", "<", "<!-- a", "&", "<p>x", "<div><div><p>a</div>b", "<![CDATA[x]]>", "<p>" * 500, "a" * 100000, "<a href='"])
def test_main_text_of_broken_pages(html):
    assert isinstance(X.main_text(html), str)


def test_main_text_keeps_rows(spark):
    rows = spark.createDataFrame([(1, "u", PAGE, "k"), (1, "u", PAGE, "k"), (2, None, None, "k"), (None, "v", "<p>só</p>", None)], "page_id long, url string, html string, text string")
    got = sorted((tuple(r) for r in X.extract_text(rows).collect()), key=repr)
    whole = "\n".join(["A headline", *PARAGRAPHS])
    assert got == sorted([(1, "u", whole, len(whole)), (1, "u", whole, len(whole)), (2, None, "", 0), (None, "v", "só", 2)], key=repr)
    assert X.extract_text(rows.limit(0)).count() == 0


def auc(score: np.ndarray, y: np.ndarray) -> float:
    order = score.argsort(kind="stable").argsort() + 1
    n = y.sum()
    return (order[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


@pytest.mark.parametrize(("run", "label", "folds", "held", "least"), [(T.toxicity, "toxic", 5, 0, 0.9), (Q.quality, "quality", 3, 1, 0.9)])
def test_held_out_accuracy(spark, run, label, folds, held, least):
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    found = run(docs, labels).toPandas()
    assert len(found) == docs.count() and found["score"].between(0, 1).all()
    assert ((found["score"] >= 0.5) == (found["predicted"] == 1)).all()
    assert all((zlib.crc32(str(i).encode()) % folds == held) == h for i, h in zip(found["doc_id"], found["held_out"]))
    both = found[found["held_out"]].merge(labels.toPandas(), on="doc_id")
    assert len(both) > 50 and auc(both["score"].to_numpy(), both[label].to_numpy()) >= least


@pytest.mark.parametrize(("run", "fit"), [(T.toxicity, T.fit_toxicity), (Q.quality, Q.fit_quality)])
def test_classifiers_on_odd_rows(odd, labels, run, fit):
    for marks in (labels, labels.limit(0)):
        found = run(odd, marks).collect()
        assert len(found) == odd.count() and all(0 <= r["score"] <= 1 for r in found)
        assert [r["held_out"] for r in found if r["doc_id"] is None] == [False]
    assert run(odd.limit(0), labels).count() == 0


@pytest.mark.parametrize(("run", "label", "folds", "held"), [(T.toxicity, "toxic", 5, 0), (Q.quality, "quality", 3, 1)])
def test_held_out_labels_are_not_learnt(spark, documents, sf_dir, run, label, folds, held):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    flipped = labels.withColumn(label, F.when(fold(F.col("doc_id"), folds) == held, 1 - F.col(label)).otherwise(F.col(label)))
    one, two = ({r["doc_id"]: r["score"] for r in run(documents, x).collect()} for x in (labels, flipped))
    assert one == two


def test_labels_of_the_other_class_are_not_learnt(spark, documents, sf_dir):
    """Positive-unlabelled learning: without the rows labelled 0 the model is the same."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    one, two = ({r["doc_id"]: r["score"] for r in Q.quality(documents, x).collect()} for x in (labels, labels.where("quality = 1")))
    assert one == two


def test_risk_and_its_gradient():
    """By loops over texts, and by differences."""
    rng = np.random.default_rng(4)
    xp, xu, w, prior = rng.normal(1, 1, (7, 3)), rng.normal(0, 1, (9, 3)), rng.normal(size=3), 0.3
    loss = lambda z, y: np.log(1 + np.exp(-y * z))
    up, down, pull, push = Q.risk(w, xp, xu, prior)
    assert np.isclose(up, prior * sum(loss(x @ w, 1) for x in xp) / 7)
    assert np.isclose(down, sum(loss(x @ w, -1) for x in xu) / 9 - prior * sum(loss(x @ w, -1) for x in xp) / 7)
    for i in range(3):
        step = np.eye(3)[i] * 1e-6
        above, below = (Q.risk(w + d, xp, xu, prior)[:2] for d in (step, -step))
        assert np.allclose([(a - b) / 2e-6 for a, b in zip(above, below)], [pull[i], push[i]], atol=1e-6)


def test_steps_follow_the_non_negative_risk():
    """With a prior far too high the second part falls below zero; the minimum found keeps it near zero all the same."""
    rng = np.random.default_rng(5)
    p, u = (np.column_stack([x, np.ones(len(x))]) for x in (rng.normal(2, 1, (300, 1)), np.concatenate([rng.normal(2, 1, (100, 1)), rng.normal(-2, 1, (200, 1))])))
    w = Q.minimised(p, u, 1 / 3, steps=400, batch=1000, rate=0.05, decay=0.0, seed=0)
    right = np.concatenate([u[:100] @ w > 0, u[100:] @ w < 0])
    assert right.mean() > 0.93
    over = Q.minimised(p, u, 0.9, steps=400, batch=1000, rate=0.05, decay=0.0, seed=0)
    assert Q.risk(over, p, u, 0.9)[1] > -0.1


@pytest.mark.parametrize("share", [0.1, 0.5, 0.85])
def test_share_of_positives_is_estimated(share):
    rng = np.random.default_rng(6)
    p = rng.normal(2, 1, 1000)
    u = np.concatenate([rng.normal(2, 1, int(2000 * share)), rng.normal(-2, 1, 2000 - int(2000 * share))])
    assert abs(Q.mixture_share(p, u) - share) < 0.08


def test_scores_of_quality_by_hand():
    """The score of a text is that of its features and of the mean weights of its n-grams."""
    rng = random.Random(9)
    good = [" ".join(rng.choice("sea wind boat rope".split()) for _ in range(rng.randrange(5, 60))) + "." for _ in range(60)]
    bad = ["|".join(rng.choice("xq zz 00 #".split()) for _ in range(rng.randrange(5, 60))) for _ in range(60)]
    model = Q.train(good[:30], good[30:] + bad, 0.33, steps=200)
    texts = [good[3], bad[5], "", "sea zz", None]
    wanted = []
    for t in texts:
        made = ((Q.expand(Q.features(t)[None])[0] - model.mean) / model.spread).clip(-8, 8) @ model.weights
        _, col, value = bag([t])
        wanted.append(1 / (1 + np.exp(-(made + value @ model.gram_weights[col] + model.bias))))
    assert np.allclose(model.score(texts), wanted, atol=1e-5)
    assert min(model.score(good[30:])) > max(model.score(bad))


def plain_bag(text: str) -> dict[int, float]:
    """Of one text, by loops: the mean over its words of the mean over a word's n-grams, by bucket."""
    marks = [" " if ord(c) <= 32 or c in STOPS else c for c in text.lower()]
    words = [w for w in "".join(marks).split(" ") if w]
    per_word = []
    for word in words:
        buckets, _, _, _ = grams(f"{word}\n")
        if len(buckets):
            per_word.append([(int(b), 1 / len(buckets)) for b in buckets])
    out: dict[int, float] = {}
    for found in per_word:
        for b, v in found:
            out[b] = out.get(b, 0) + v / len(per_word)
    return out


def test_forward_pass_of_toxicity():
    """Scores are the softmax of the mean of the texts' subword vectors, told word by word and n-gram by n-gram."""
    texts = ["You are awful, AWFUL!", "a b c", "", "Fähre über das Meer", "x" * 40, "one\ttwo\nthree"]
    weights = np.random.default_rng(3).normal(size=BUCKETS).astype(np.float32)
    model = T.ToxicityModel(weights, (1.5, -0.2), (0.3, 0.1))
    for text, score in zip(texts, model.score(texts)):
        mean = sum(weights[b] * v for b, v in plain_bag(text).items())
        size = np.log1p(len(text)) / 10
        assert np.isclose(score, 1 / (1 + np.exp(-((1.5 - 0.2 * size) * mean + 0.3 + 0.1 * size))), atol=1e-5)


def test_misspellings_share_vectors():
    rng = random.Random(2)
    calm = "the boat came home with the wind and the sea was calm today".split()
    made = [(" ".join(rng.choice(calm) for _ in range(20)) + (" dreadful idiotic" if i % 2 else ""), i % 2) for i in range(300)]
    model = T.train([t for t, _ in made], np.array([y for _, y in made]), 1.0)
    clean, bad = model.score(["the boat came home with the wind", "the boat came home dreadfull idiotik wind"])
    assert clean < 0.5 < bad


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "simhash", "substrings", "decontamination", "mixing"]
    kept = {n: None for n in names}
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, sf_dir).cache()
        kept[name] = (before, after)
        before = after
    good = {r["doc_id"] for r in Q.quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("predicted = 1").collect()}
    assert {i for i, _ in texts(kept["quality"][1])} == good
    first = {i for i, _, c in components_by_brute_force(texts(kept["simhash"][0])) if i == c}
    assert {i for i, _ in texts(kept["simhash"][1])} == first
    expected = removed_by_brute_force(texts(kept["substrings"][0]))
    was = dict(texts(kept["substrings"][0]))
    for i, text in texts(kept["substrings"][1]):
        assert len(text.split()) == expected[i][0] - expected[i][1] and (expected[i][1] or text == was[i])
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {r[0] for r in contaminated_by_brute_force(texts(kept["decontamination"][0]), items) if not r[5]}
    assert {i for i, _ in texts(kept["decontamination"][1])} == clean
    assert kept["mixing"][1].count() == len(clean)
    assert all(kept[n][1].columns == docs.columns for n in names[:-1])
    for _, after in kept.values():
        after.unpersist()


def test_pipeline_on_odd_rows(spark, odd, labels, tmp_path):
    """Each stage on nulls in any column, empty and very long texts, repeated rows and more columns, against plain
    versions; and all stages on empty tables."""
    items = [(1, "p3 P4 p5"), (None, None), (2, "")]
    for name, table in (("documents", odd), ("labels", labels), ("benchmark", spark.createDataFrame(items, "item_id long, text string"))):
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    stages = dict(corpus_pipeline.STAGES)
    everything = sorted(texts(odd), key=repr)
    good = {(r["doc_id"], r["text"]) for r in Q.quality(odd, labels).where("predicted = 1").join(odd, "doc_id").collect()}
    kept = stages["quality"](spark, odd, str(tmp_path))
    assert {t for t in texts(kept) if t[0] is not None} == good and kept.columns == odd.columns

    unique = set(everything)
    groups = {k: c for k, _, c in components_by_brute_force([((-1 if k is None else k) * 2 + (t is None), t) for k, t in unique])}
    kept = texts(stages["simhash"](spark, odd, str(tmp_path)))
    assert len(kept) == len(set(kept)) == len(set(groups.values()))

    expected = removed_by_brute_force({(-1 if k is None else k, t) for k, t in everything})
    kept = stages["substrings"](spark, odd, str(tmp_path))
    assert sorted((r["doc_id"] or -1, len((r["text"] or "").split())) for r in kept.collect()) == sorted((-1 if k is None else k, expected[-1 if k is None else k][0] - expected[-1 if k is None else k][1]) for k, _ in everything)

    clean = sorted((t for t, r in ((t, contaminated_by_brute_force([t], items)[0]) for t in everything) if not r[5]), key=repr)
    assert sorted(texts(stages["decontamination"](spark, odd, str(tmp_path))), key=repr) == clean and len(clean) < len(everything)
    mixed = stages["mixing"](spark, odd, str(tmp_path)).collect()
    assert len(mixed) == len(everything) and all(0 <= r["taken"] <= 3 * r["size"] for r in mixed)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    for stage in stages.values():
        assert stage(spark, odd.limit(0), str(tmp_path)).count() == 0


def test_pipeline_decides_by_row(spark, odd, tmp_path):
    """Rows without an id are judged as well; of rows that share an id, each by its own text; one row of a group stays."""
    phrase = " ".join(f"q{i}" for i in range(20))
    other, third = (" ".join(f"{c}{i}" for i in range(40)) for c in "xy")
    spark.createDataFrame([(1, phrase)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(None, f"a {phrase}"), (None, other), (3, phrase), (3, third), (4, None)], "doc_id long, text string")
    assert sorted(texts(corpus_pipeline.decontamination_stage(spark, docs, str(tmp_path))), key=repr) == [(3, third), (4, None), (None, other)]

    rows = [(None, other, "a"), (None, other, "b"), (None, third, "a"), (3, phrase, "b"), (3, phrase, "a"), (3, phrase, None), (3, f"alone {third} {other}", "a"), (8, phrase, "a"), (5, third, "c"), (5, third, "c"), (9, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = sorted((tuple(r) for r in corpus_pipeline.simhash_stage(spark, docs, str(tmp_path)).collect()), key=repr)
    assert got == sorted([(None, other, "a"), (3, phrase, None), (3, f"alone {third} {other}", "a"), (5, third, "c"), (9, None, None)], key=repr)
    assert [r["doc_id"] for r in corpus_pipeline.simhash_stage(spark, odd.where("doc_id = 7 or doc_id = 8"), str(tmp_path)).collect()] == [7]
