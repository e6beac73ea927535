"""Operators with one right answer, against plain versions."""

from __future__ import annotations

import hashlib
import os
import random
import re
from collections import defaultdict
from functools import cache
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from textlathe.llm import common as C
from textlathe.llm import decontamination as D
from textlathe.llm import licences as L
from textlathe.llm import mixing as M
from textlathe.llm import neighbours as N
from textlathe.llm import simhash as H
from textlathe.llm import substrings as R
from textlathe.llm import token_counts as K

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def shared_passages(seed: int, n: int = 60) -> list[tuple[int, str]]:
    """Documents that share passages of many lengths, some within one document."""
    rng = random.Random(seed)
    passages = [" ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(5, 60))) for _ in range(8)]
    return [(i, " ".join(rng.choice(passages) if rng.random() < 0.5 else " ".join(f"u{rng.randrange(4000)}" for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(0, 8)))) for i in range(n)]


def removed_by_brute_force(rows, size=20):
    seen, out = set(), {}
    for key, text in sorted(rows):
        words = WORD.findall(text or "")
        gone = set()
        for at in range(len(words) - size + 1):
            window = tuple(words[at : at + size])
            if window in seen:
                gone.update(range(at, at + size))
            seen.add(window)
        kept = [w for i, w in enumerate(words) if i not in gone]
        out[key] = (len(words), len(gone), sha(" ".join(kept)))
    return out


@pytest.mark.parametrize(("seed", "setting"), [(1, {}), (2, {}), (3, {"BLOCK_CHARS": 300}), (5, {"SAMPLE": 1, "LEAST_SHARED": 0})])
def test_repeats_on_made_texts(spark, monkeypatch, seed, setting):
    """Also with texts in many pieces, and with all 10-grams taken for very frequent ones."""
    for name, value in setting.items():
        monkeypatch.setattr(R, name, value)
    if "SAMPLE" in setting:
        monkeypatch.setattr(R, "shared_grams", lambda docs, size, share, plain=R.shared_grams: plain(docs, size, 0.0))
    rows = shared_passages(seed)
    got = R.repeat_digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == removed_by_brute_force(rows)


def test_repeats_of_odd_rows(spark, odd):
    """Nulls in any column, empty, white and very long texts, repeated rows, more columns; and an empty table."""
    clash = odd.withColumn("bucket", F.lit(1)).withColumn("words", F.lit("x")).withColumn("print", F.lit(0))
    rows = [(-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in odd.collect()]
    expected = removed_by_brute_force(set(rows))
    got = R.remove_repeats(clash).select("doc.*", "n_words", "n_removed").collect()
    assert len(got) == len(rows) and all((r["n_words"], r["n_removed"]) == expected[-1 if r["doc_id"] is None else r["doc_id"]][:2] for r in got)
    assert set(clash.columns) <= set(got[0].asDict())
    assert R.repeat_digests(odd.limit(0)).count() == 0


def test_pieces_of_a_text(monkeypatch):
    monkeypatch.setattr(R, "BLOCK_CHARS", 40)
    rng = random.Random(8)
    for overlap in (0, 3, 19):
        text = b" \n "[: rng.randrange(4)] + b" ".join(b"w" * rng.choice([1, 3, 90]) + str(i).encode() for i in range(300)) + b"\t "[: rng.randrange(3)]
        words, seen = text.split(), []
        for base, piece in R.pieces(text, overlap):
            own = piece.split()
            assert own == words[base : base + len(own)]
            seen += [(base + i, tuple(own[i : i + overlap + 1])) for i in range(len(own) - overlap)]
        assert seen == [(i, tuple(words[i : i + overlap + 1])) for i in range(len(words) - overlap)]


def test_choices_in_a_text_of_many_words():
    """A text of more than 2**24 words: each window chooses the first of the least 10-grams in it."""
    n = (1 << 24) + 5000
    block = R.Block.__new__(R.Block)
    block.words, block.doc = R.mixed(np.arange(n, dtype=np.uint64) % np.uint64(1 << 22)), np.zeros(n, np.int8)
    at, place, grams = block.chosen(20)
    for i in [0, 5, (1 << 24) - 30, *range((1 << 24) - 3, len(at), 499), len(at) - 1]:
        assert place[i] == i + int(np.argmin(grams[i : i + 11]))


def test_equal_hashes_are_no_equal_words(spark, monkeypatch):
    """Where all 10-grams have one hash, words alone tell which windows are equal."""
    monkeypatch.setattr(R, "mixed", lambda x: np.zeros_like(x))
    words = [f"w{i}" for i in range(60)]
    block = R.Block(np.array([1]), np.array([0]), np.array([0]), [" ".join(words).encode()])
    _, place, grams = block.chosen(20)
    assert len(set(grams.tolist())) == 1
    texts = [b" ".join(w.encode() for w in words[i : i + 20]) for i in (0, 30, 0)]
    row = R.packed(0, hashes=np.zeros(3, np.uint64), keys=np.array([1, 1, 2]), prints=np.zeros(3, np.int64), places=np.array([0, 30, 7]) * R.RUN + 1, words=b"\n".join(texts))
    import pyarrow as pa

    found = R.meet_passages(pa.Table.from_batches([R.sent([row])]), 20, 1, [])
    assert R.column(found, "keys", np.int64).tolist() == [2] and R.column(found, "places", np.int64).tolist() == [7 * R.RUN + 1]


def test_repeats_on_documents(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    assert {r[0]: tuple(r)[1:] for r in R.repeat_digests(documents).collect()} == removed_by_brute_force(rows)


@pytest.mark.parametrize("block_chars", [R.BLOCK_CHARS, 600])
def test_repeats_of_rows_without_an_id_of_their_own(spark, monkeypatch, block_chars):
    """Different texts under a null or shared id are documents of their own, equal ones are one; with small blocks, rows
    of one document are also dealt over buckets."""
    monkeypatch.setattr(R, "BLOCK_CHARS", block_chars)
    rows = [(None if i % 3 == 0 else i % 5, text) for i, text in shared_passages(4, 40)]
    same = " ".join(f"s{i}" for i in range(30))
    rows += [(None, f"{same} one"), (None, f"{same} two"), (7, f"{same} three"), (7, f"{same} four"), (None, None)] + [(None, f"again {same}")] * 9
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    prints = {(r[0], r[1]): r[2] for r in docs.select("doc_id", "text", F.xxhash64("text")).collect()}
    keyed = {((-1 if k is None else k, prints[k, t]), t) for k, t in rows}
    expected = removed_by_brute_force(keyed)
    got = sorted((tuple(r) for r in R.repeat_digests(docs).collect()), key=repr)
    assert got == sorted(((k, *expected[-1 if k is None else k, prints[k, t]]) for k, t in rows), key=repr)
    kept = [r["kept"] for r in R.remove_repeats(docs).collect() if same in r["kept"]]
    assert len(set(kept)) == 1


def test_repeats_within_a_reference(spark):
    known = " ".join(f"k{i}" for i in range(50))
    docs = spark.createDataFrame([(1, f"a b {known} c"), (2, " ".join(known.split()[:19])), (3, None)], "doc_id long, text string")
    reference = spark.createDataFrame([(f"x {known} y",), (None,)], "text string")
    assert [(r["kept"], r["n_removed"]) for r in R.remove_known(docs, reference).orderBy("doc_id").collect()] == [("a b c", 50), (" ".join(known.split()[:19]), 0), ("", 0)]
    with pytest.raises(ValueError):
        R.remove_known(docs, reference, shard_words=1, max_shards=1)


def test_automaton_matches_brute_force():
    rng = random.Random(3)
    sequences = [[rng.choice("abc").encode() for _ in range(rng.randrange(1, 30))] for _ in range(5)]
    automaton = R.SuffixAutomaton()
    for s in sequences:
        automaton.add(s)
    text = [rng.choice("abcd").encode() for _ in range(200)]
    within = lambda part: any(part == s[i : i + len(part)] for s in sequences for i in range(len(s)))
    for end, n in enumerate(automaton.matches(text), 1):
        assert n == max(k for k in range(end + 1) if k == 0 or within(text[end - k : end]))


def contaminated_by_brute_force(docs, items, size=13):
    where = defaultdict(set)
    for item, text in items:
        words = TERM.findall((text or "").translate(ASCII_LOWER))
        for at in range(max(1, len(words) - size + 1) if words else 0):
            where[tuple(words[at : at + size])].add(item)
    lengths = {len(w) for w in where}
    out = []
    for key, text in docs:
        words = TERM.findall((text or "").translate(ASCII_LOWER))
        hit, found = set(), set()
        for n in lengths:
            for at in range(len(words) - n + 1):
                if (window := tuple(words[at : at + n])) in where:
                    hit.update(range(at, at + n))
                    found |= where[window]
        names = sorted(str(i) for i in found if i is not None)
        out.append((key, len(words), len(hit), len(names), sha(",".join(names)), bool(hit) and 20 * len(hit) >= len(words)))
    return sorted(out, key=repr)


def test_contamination_of_documents(spark, documents, sf_dir):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    docs = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    items = [tuple(r) for r in benchmark.select("item_id", "text").collect()]
    expected = contaminated_by_brute_force(docs, items)
    assert any(r[5] for r in expected)
    assert sorted((tuple(r) for r in D.contamination(documents, benchmark).collect()), key=repr) == expected


def test_contamination_of_odd_texts(spark, odd):
    items = [(1, "p3 P4 p5"), (2, " ".join(f"p{i}" for i in range(20))), (3, ""), (4, None), (None, "without an id"), (5, "x"), (5, "w1 w2 w3 w4"), (6, "same same")]
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = D.contamination(odd, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == contaminated_by_brute_force(docs, items)
    empty = spark.createDataFrame([], "item_id long, text string")
    assert not any(r["contaminated"] for r in D.contamination(odd, empty).collect())
    assert D.contamination(odd.limit(0), empty).count() == 0


@pytest.mark.parametrize("stretch", [1024, 7])
def test_contamination_of_long_texts_with_hits_throughout(spark, monkeypatch, stretch):
    """Items longer than a stretch, hits across its ends, a text that is one item over and over, and a cut-off beginning."""
    monkeypatch.setattr(D, "STRETCH", stretch)
    rng = random.Random(stretch)
    long_item = [f"q{rng.randrange(40)}" for _ in range(1300)]
    short_item = [f"s{i}" for i in range(15)]
    docs = [(1, " ".join(long_item[600:] + ["x"] * 500 + long_item + ["y"] * 3 + long_item[:700])), (2, " ".join(short_item * 1500)), (3, " ".join(short_item[2:] + ["z"] * 1000 + short_item[:-1])), (4, " ".join(short_item)), (4, "other"), (2, " ".join(short_item * 1500))]
    items = [(7, " ".join(long_item)), (8, " ".join(short_item)), (9, "z z")]
    got = D.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == contaminated_by_brute_force(docs, items)


def test_contamination_with_clashing_columns(spark, odd):
    clash = odd.withColumns({c: F.lit(i) for i, c in enumerate(["term", "pos", "words", "n", "item", "at", "shift", "hit"])})
    items = spark.createDataFrame([(1, "p3 P4 p5"), (2, " ".join(f"p{i}" for i in range(20)))], "item_id long, text string").withColumns({"doc_id": F.lit(1), "n": F.lit(2), "term": F.lit("x")})
    got = D.contamination(clash, items).collect()
    assert sorted((tuple(r) for r in got), key=repr) == contaminated_by_brute_force([(r["doc_id"], r["text"]) for r in odd.collect()], [(1, "p3 P4 p5"), (2, " ".join(f"p{i}" for i in range(20)))])


def test_contamination_without_broadcasts(spark, documents, sf_dir, monkeypatch):
    """The same rows where all terms and matches are too many to be broadcast."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    plain = sorted((tuple(r) for r in D.contamination(documents, benchmark).collect()), key=repr)
    monkeypatch.setattr(D, "small", lambda df: df)
    assert sorted((tuple(r) for r in D.contamination(documents, benchmark).collect()), key=repr) == plain


def near_by_brute_force(docs, items, size, slack):
    split = lambda t: TERM.findall((t or "").translate(ASCII_LOWER))
    texts = [(k, split(t)) for k, t in docs]
    counts = defaultdict(int)
    for _, text in texts:
        for w in text:
            counts[w] += 1
    out = set()
    for item, text in items:
        found = split(text)
        length = min(size, len(found))
        for at in range(len(found) - length + 1 if found else 0):
            window = range(at, at + length)
            if not all(counts[found[p]] for p in window):
                continue
            low, *high = sorted(sorted(window, key=lambda p: (counts[found[p]], p))[:2])
            for key, doc in texts:
                for x, w in enumerate(doc):
                    if w == found[low]:
                        ends = range(len(doc)) if high else [x]
                        out |= {(key, item, at, x, y) for y in ends if not high or (doc[y] == found[high[0]] and x < y and abs((y - x) - (high[0] - low)) <= slack)}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_proximity_by_brute_force(spark, seed):
    """With frequent terms, repeats between the two, and windows that share anchors."""
    rng = random.Random(seed)
    make = lambda n, k: " ".join(rng.choice("abcdefgh"[:k]) for _ in range(n))
    docs = [(i, make(rng.randrange(0, 40), 8)) for i in range(12)] + [(90, "alpha x y z alpha beta"), (91, None)]
    items = [(i, make(rng.randrange(0, 9), 6)) for i in range(6)] + [(90, "alpha c d e f beta"), (91, "alpha x beta")]
    docs += [(92, "c d e f x")]
    index = D.build_index(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), size=5)
    got = {(r["doc_id"], r["item_id"], r["at"], r["first"], r["second"]) for r in D.proximity_matches(index, slack=3).collect()}
    assert got == near_by_brute_force(docs, items, 5, 3)


def test_items_near_by_brute_force(spark, odd):
    """How many items are near each row, among odd texts, rows without ids and items that share their rarest terms."""
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()] + [(70, "alpha x y z beta a b"), (71, "beta alpha"), (None, "alpha x y z beta")]
    items = [(1, "p3 P4 p5"), (2, " ".join(f"p{i}" for i in range(20))), (3, ""), (4, None), (5, "x"), (6, "alpha x y z beta"), (7, "w alpha x y z q beta x"), (8, "alpha beta")]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    got = D.contamination(rows, spark.createDataFrame([*items, (None, "alpha beta")], "item_id long, text string"), size=5, slack=2)
    near = defaultdict(set)
    for at in range(len(docs)):
        near[at] = set()
    for at, item, *_ in near_by_brute_force([(i, t) for i, (_, t) in enumerate(docs)], items, 5, 2):
        near[at].add(item)
    assert sorted((repr(r["doc_id"]), r["n_words"], r["n_near"]) for r in got.collect()) == sorted((repr(docs[at][0]), len(TERM.findall((docs[at][1] or "").translate(ASCII_LOWER))), len(found)) for at, found in near.items())
    assert all(r["n_near"] >= r["n_items"] for r in got.collect())
    empty = D.contamination(rows, spark.createDataFrame([], "item_id long, text string"), slack=3)
    assert {r["n_near"] for r in empty.collect()} == {0}


def fingerprint_by_brute_force(text):
    words = WORD.findall((text or "").translate(ASCII_LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_brute_force(rows):
    prints = [(key, fingerprint_by_brute_force(text)) for key, text in rows]
    ids = [r[0] for r in prints]
    codes = np.array([p for _, p in prints], np.uint64)
    label = list(range(len(ids)))
    linked = [np.flatnonzero(np.bitwise_count(codes ^ c) <= 3) for c in codes]
    group, seen = {}, set()
    for start in range(len(ids)):
        if start in seen:
            continue
        todo, members = [start], []
        while todo:
            i = todo.pop()
            if i not in seen:
                seen.add(i)
                members.append(i)
                todo += linked[i].tolist()
        known = [ids[i] for i in members if ids[i] is not None]
        group |= {i: min(known) if known else None for i in members}
    return sorted(((ids[i], f"{prints[i][1]:016x}", group[i]) for i in label), key=repr)


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_simhash(request, which):
    docs = request.getfixturevalue(which)
    assert H.near_duplicates(docs.limit(0)).count() == 0
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted((tuple(r) for r in H.near_duplicates(docs).collect()), key=repr) == components_by_brute_force(rows)


@pytest.mark.parametrize("dense", [False, True])
def test_links_among_fingerprints(spark, monkeypatch, dense):
    """Chains of fingerprints; with short lists declared long, so that the finer lists are used too."""
    monkeypatch.setattr(H, "LONG_LIST", 3 if dense else 2048)
    rng = random.Random(5)
    codes = set()
    for _ in range(40):
        code = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):
            codes.add(code)
            for _ in range(rng.randrange(1, 5)):
                code ^= 1 << rng.randrange(64)
    codes = sorted(codes)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    found = {r["node"]: r["root"] for r in H.components(H.link_edges(spark.createDataFrame([(c,) for c in signed], "fp long"))).collect()}
    expected = {}
    for i, c in enumerate(codes):
        expected.setdefault(i, i)
    parent = list(range(len(codes)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    ours, theirs = defaultdict(set), defaultdict(set)
    for i, s in enumerate(signed):
        ours[found.get(s, s)].add(s)
        theirs[root(i)].add(s)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_finer_lists_hold_every_pair():
    """Of pairs of at most 3 differing bits, each shares the bits of one list on every level, and the last level bounds
    a list by the bits that are left."""
    rng = random.Random(7)
    first, levels = H.list_masks()
    unsigned = lambda mask: mask & (1 << 64) - 1
    assert all(64 - unsigned(mask).bit_count() == free for masks, free in ((first.values(), 40), ((m for _, _, m in levels[0]), 24), ((m for _, _, m in levels[1]), 12)) for mask in masks)
    for _ in range(300):
        differing = sum({1 << rng.randrange(64) for _ in range(3)})
        for number, mask in first.items():
            if not differing & unsigned(mask):
                finer = [n for of, n, m in levels[0] if of == number and not differing & unsigned(m)]
                assert finer and all(any(of == n and not differing & unsigned(m) for of, _, m in levels[1]) for n in finer)
        assert any(not differing & unsigned(mask) for mask in first.values())


@pytest.mark.parametrize("descending", [False, True])
def test_a_long_chain_takes_few_rounds(spark, monkeypatch, descending):
    rounds = []
    plain = H.written
    monkeypatch.setattr(H, "written", lambda df, name: rounds.append(name) or plain(df, name))
    n = 10_000
    edges = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    edges = edges.selectExpr(f"{n} - a AS a", f"{n} - b AS b") if descending else edges
    roots = H.components(edges).select("node", "root").collect()
    assert len(roots) == n and len({r["root"] for r in roots}) == 1
    assert rounds.count("components-moves") <= 20


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_token_counts(request, which):
    from tokenizers import Tokenizer

    docs = request.getfixturevalue(which)
    path = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    count = lambda t: len(model.encode(t or "", add_special_tokens=False))
    expected = sorted(((r["doc_id"], len((r["text"] or "").encode()), count(r["text"]), count(r["text"]) > 512) for r in docs.collect()), key=repr)
    for piece_chars in (1 << 15, 50):
        assert sorted((tuple(r) for r in K.count_tokens(docs, path, piece_chars=piece_chars).collect()), key=repr) == expected


def test_token_counts_at_boundaries(spark):
    texts = ["a  b <|endoftext|> c", "<|endoftext|>" * 5 + " x", "tab\tand\n new  lines   x", "don't 123 4é ñ 日本 語", " lead", "trail ", "日本語の文章。改行なしで続く、とても長い文", "var a=b1+c2;if(x){y('it''s')}", "one\ntwo\tthree\n\nfour", "e\u0301a\u00a0b\u2003c 1½x", "<|endof<|endoftext|>text|>"]
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    docs = spark.createDataFrame(list(enumerate(t * 40 for t in texts)), "doc_id long, text string")
    for size in (1, 3, 17):
        got = {r["doc_id"]: r["n_tokens"] for r in K.count_tokens(docs, path, piece_chars=size).collect()}
        assert got == {i: len(model.encode(t * 40, add_special_tokens=False)) for i, t in enumerate(texts)}
    assert K.count_tokens(docs.limit(0), path).count() == 0
    model_path = public_tokenizers.path("piece_bpe_32k.model")
    assert all(r["n_tokens"] > 0 for r in K.count_tokens(docs, model_path).collect())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "Bc", "é", "日本", " ", "  ", "\n", "\t", "'s", "'", "12", "½", "_", "-", "。", "\u0301", "\u00a0", "<|endoftext|>", "<|endof", "😀"]), max_size=60).map("".join), st.integers(1, 9))
def test_pieces_have_the_tokens_of_the_text(text, size):
    counter, may_cut, whole = loaded_counter()
    found = list(K.pieces(text, size, whole))
    assert may_cut and "".join(found) == text
    assert sum(counter(found)) == sum(counter([text]))


@cache
def loaded_counter():
    return K.load_counter(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("text", ["日本語の文章。" * 50_000, "var a=b1+c2;" * 30_000, "word\tnext\n" * 30_000])
def test_long_texts_without_spaces_are_cut(text):
    _, _, whole = loaded_counter()
    assert max(map(len, K.pieces(text, 1 << 15, whole))) < (1 << 15) + 100


def targets_by_brute_force(sizes, most=3):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    open_, target, left = set(order), {}, float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if most * sizes[s] <= left * weight[s] / total]
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = float(most * sizes[s])
        left -= sum(target[s] for s in over)
        open_ -= set(over)
    return target


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_mix(request, which):
    docs = request.getfixturevalue(which)
    rows = [(r["doc_id"], r["source"], len(WORD.findall(r["text"] or ""))) for r in docs.collect()]
    sizes = defaultdict(int)
    for _, s, n in rows:
        sizes[s] += n
    target = targets_by_brute_force(dict(sizes))
    got = M.mix_sources(docs).collect()
    assert sorted(((r["doc_id"], r["size"]) for r in got), key=repr) == sorted(((k, n) for k, _, n in rows), key=repr)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    taken, by_id = defaultdict(int), defaultdict(list)
    for k, s, n in rows:
        by_id[k, n].append(s)
    for r in got:
        source = by_id[r["doc_id"], r["size"]].pop(0)
        assert r["source_size"] == sizes[source] and abs(r["target"] - target[source]) < 1e-6 * max(1, target[source])
        taken[source] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, M.mix_sources(docs.repartition(7)).collect()), key=repr)
    assert M.mix_sources(docs.limit(0)).count() == 0


def made_vectors(kind: str, n: int, width: int) -> np.ndarray:
    rng = np.random.default_rng(11)
    if kind == "clustered":
        return rng.normal(size=(20, width))[rng.integers(0, 20, n)] + rng.normal(size=(n, width))
    x = rng.normal(size=(n, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "mixed lengths":
        x *= rng.lognormal(0, 0.7, (n, 1))
    if kind == "one long":
        x[3] *= 10
    return x


@pytest.mark.parametrize(("kind", "n", "width"), [("table", 0, 0), ("plain", 4000, 64), ("clustered", 4000, 768), ("plain", 1500, 768), ("mixed lengths", 4000, 64), ("one long", 4000, 64)])
def test_neighbours_reach_recall_and_are_exact(spark, sf_dir, kind, n, width):
    """Doubles are kept; scores are exact; the recall over all queries is at least 0.9."""
    if kind == "table":
        rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    else:
        rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(made_vectors(kind, n, width))], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in N.nearest(rows, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    data = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in rows.collect()}
    ids = np.array(list(data))
    all_vectors = np.stack(list(data.values()))
    hits = 0
    for q, found in got.items():
        scores = all_vectors @ data[q]
        exact = [i for i in ids[np.lexsort((ids, -scores))[:21]].tolist() if i != q][:20]
        hits += len(set(exact) & {i for i, _ in found})
        assert len(found) == 20 and [i for i, _ in found] == [i for i, s in sorted(found, key=lambda x: (-x[1], x[0]))]
        assert all(abs(s - float(data[i] @ data[q])) < 1e-12 * max(1, abs(s)) for i, s in found)
    assert set(got) == {i for i in data if i % 20 == 0} and hits >= 0.9 * 20 * len(got)


def test_share_of_scored_vectors_falls(spark):
    """The cells of a query hold a smaller share of all vectors, the more there are, at the same recall."""
    shares = []
    for n in (2_000, 20_000):
        x = made_vectors("plain", n, 64)
        plan = N.Plan(64, 8, (N.Band(0, n, 1.0, False, N.hash_widths(n, 64, 32), 0),), N.signs(8, 3, 64, 5))
        scores = x[:64] @ x.T
        scores[np.arange(64), np.arange(64)] = -9
        truth = [(x[q], x[i], 0) for q in range(64) for i in np.argsort(-scores[q])[:20]]
        shares.append(N.scored_share(plan, N.enough_probes(truth, plan, 0.9, 1024)))
    assert shares[1] < 0.7 * shares[0]


def test_probes_come_in_order_of_what_they_miss():
    rng = np.random.default_rng(2)
    plan = N.Plan(8, 1, (N.Band(0, 9999, 1.0, False, (8, 4), 0),), N.signs(1, 2, 8, 5))
    v = rng.normal(size=(5, 8))
    got = plan.probes_of(v, plan.bands[0], 0, 40)
    x = plan.padded(v, plan.bands[0], False)
    short = [(r.max(axis=1, keepdims=True) - r) ** 2 for r in (N.axes(x, plan.diagonals[0, h], w) for h, w in enumerate((8, 4)))]
    every = (short[0][:, :, None] + short[1][:, None, :]).reshape(5, -1)
    assert (np.sort(every, axis=1)[:, :40] == np.take_along_axis(every, got, 1)).all()
    assert (got[:, 0] == plan.cells_of(v, plan.bands[0])[:, 0]).all()


def test_rows_that_share_an_id_have_their_own_vectors(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (5, [1.0, 0.0]), (5, [0.0, 1.0]), (7, [0.17, 0.0]), (7, [0.17, 0.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in N.nearest(rows, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 5, 1.0), (0, 2, 7, 0.17), (0, 3, 5, 0.0)]
    both = [tuple(r) for r in N.nearest(rows, F.col("vec_id") == 5).orderBy("rank", F.desc("score"), "vec_id").collect()]
    assert both == [(5, 1, 0, 1.0), (5, 1, 0, 0.0), (5, 2, 7, 0.17), (5, 2, 5, 0.0), (5, 3, 5, 0.0), (5, 3, 7, 0.0)]


def test_queries_with_too_few_candidates_ask_all(spark, monkeypatch):
    """With one probe only, many queries find fewer than k; they get k all the same, and so does the plain comparison."""
    monkeypatch.setattr(N, "enough_probes", lambda *_: 1)
    x = made_vectors("plain", 600, 16)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for exact in (False, True):
        got = N.nearest(rows, F.col("vec_id") % 20 == 0, tables=2, exact=exact).groupBy("query_id").count().collect()
        assert {r["count"] for r in got} == {20} and len(got) == 30


def test_neighbours_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0]), (40, [-1.0, 0.5]), (None, [1.0, 1.0]), (60, [1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x"))
    got = [tuple(r) for r in N.nearest(frame, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [
        (0, 1, 1, 1.0), (0, 2, 20, 1.0), (0, 3, 2, 0.0), (0, 4, 40, -1.0), (20, 1, 0, 1.0), (20, 2, 1, 1.0), (20, 3, 2, 0.0), (20, 4, 40, -1.0),
        (40, 1, 2, 1.0), (40, 2, 0, -1.0), (40, 3, 1, -1.0), (40, 4, 20, -1.0),
    ]
    assert N.nearest(frame.limit(0), F.lit(True)).count() == 0


def licences_by_brute_force(texts):
    """Of each `(id, text)`, the best `(not a file, -score, licence)` over all templates and all windows around their two
    rarest words."""
    split = lambda t: [w for w in re.split(D.BETWEEN, (t or "").lower()) if w]
    df = defaultdict(int)
    for _, t in texts:
        for w in set(split(t)):
            df[w] += 1
    idf = lambda w: np.log((1 + len(texts)) / (1 + df[w])) + 1

    def vector(found):
        counts = defaultdict(float)
        for w in found:
            counts[w] += idf(w)
        return counts, np.sqrt(sum(x * x for x in counts.values()))

    rows = [(kind, name, split(t)) for _, kind, name, t in L.template_rows()]
    out = {}
    for key, text in texts:
        found = split(text)
        for kind, name, template in rows:
            u, m = vector(template)
            order = sorted(range(len(template)), key=lambda i: (-idf(template[i]), i))
            two = [order[0], next((i for i in order if template[i] != template[order[0]]), order[0])]
            for start in {p - i for i in two for p, w in enumerate(found) if w == template[i]}:
                window = found[max(0, start) : max(0, start + len(template))]
                if not window:
                    continue
                v, n = vector(window)
                score = round(sum(v[w] * u[w] for w in v if w in u) / (n * m), 9)
                if kind == L.NAME:
                    before, after = found[max(0, start - L.BEFORE) : max(0, start)], found[start + len(template) : start + len(template) + 1]
                    if start < 0 or sorted(window) != sorted(template) or L.SAID.isdisjoint([*before, found[start]]) or not L.DENIED.isdisjoint(before) or not L.NOT_NEXT.isdisjoint(after):
                        continue
                if score >= L.MIN_SCORE:
                    file = kind in (L.WHOLE, L.OPENING) and start <= L.MARGIN and (kind == L.OPENING or len(found) - len(template) <= L.MARGIN)
                    out[key, text] = min(out.get((key, text), (True, 0.0, "~")), (not file, -score, name))
    return out


def wrapped(text: str, width: int = 60, mark: str = " * ") -> str:
    import textwrap

    return "\n".join(mark + line for line in textwrap.wrap(text, width))


def licence_docs() -> list[tuple[int | None, str | None]]:
    names = {name: text for name, text in L.NOTICES}
    whole, openings = dict(L.WHOLE_TEXTS), dict(L.OPENINGS)
    code = "def main ( ) return value of the function and print it to the screen " * 12
    docs = [(i, f"/*\n{wrapped(names[n])}\n */\n{code}") for i, n in enumerate(["GPL-3.0", "GPL-2.0", "AGPL-3.0", "BSD-3-Clause", "ISC", "MIT", "MPL-2.0"])]
    docs += [(20, f"/*\n{wrapped(names['Apache-2.0'])}\n */\n{code}"), (21, f"MIT License\n\nCopyright (c) 2024 Somebody\n\n{wrapped(whole['MIT'], 80, '')}"), (22, f"Copyright 2020 A B\nAll rights reserved.\n{wrapped(whole['BSD-2-Clause'], 70, '')}"), (23, wrapped(openings["GPL-3.0"], 70, "    ") + " 0. Definitions. " + code), (24, f"{code} {whole['MIT']} {code}")]
    return docs + [(30, "Intro line.\nReleased under the MIT License.\nMore"), (31, "Nothing here under the sun."), (32, None), (33, ""), (34, "licensed UNDER cc by-nc 4.0. And so on"), (34, "again other text"), (None, "Licensed under CC BY 4.0."), (35, "the mit license"), (36, "Preheat the oven, then serve with a license to eat.")]


def test_licences_by_brute_force(spark):
    texts = licence_docs()
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    prints = {r[2]: (r[0], r[1]) for r in docs.select("doc_id", "text", F.xxhash64("text")).collect()}
    expected = licences_by_brute_force(texts)
    got = {prints[r["text_hash"]]: (not r["is_licence_file"], -r["score"], r["licence"]) for r in L.licence_matches(docs, L.templates(spark)).collect()}
    assert got.keys() == expected.keys()
    assert all(got[k][0] == expected[k][0] and got[k][2] == expected[k][2] and abs(got[k][1] - expected[k][1]) < 1e-8 for k in got)
    by_id = {k[0]: v for k, v in got.items()}
    assert [by_id[i][2] for i in (0, 1, 2, 3, 4, 5, 6, 20, 30, 34, None)] == ["GPL-3.0", "GPL-2.0", "AGPL-3.0", "BSD-3-Clause", "ISC", "MIT", "MPL-2.0", "Apache-2.0", "MIT", "CC-BY-NC-4.0", "CC-BY-4.0"]
    assert {k: v[2] for k, v in by_id.items() if not v[0]} == {21: "MIT", 22: "BSD-2-Clause", 23: "GPL-3.0"}
    assert not {31, 32, 33, 36} & set(by_id)


def test_each_licence_by_its_names_and_no_other(spark):
    """Each licence's usual notices and identifiers give it, whatever the verb; denied and bare names give none."""
    rows, expected = [], {}
    spelt = [*L.NAMES, *((i, i) for i in L.IDENTIFIERS if "-" in i)]
    for licence, name in spelt:
        for form in ("Licensed under the {}.", "This project is made available under the terms of the {}, see the file.", "# License: {}", "Code (c) 2020 A. Distributed\n * under the\n * {}", "It is not licensed under the {}.", "We looked at {} texts."):
            expected[len(rows)] = None if "not" in form or ("looked" in form and name != "The Unlicense" and not name.startswith("License ")) else licence
            if "looked" in form and (name == "The Unlicense" or name.startswith("License ")):
                continue
            rows.append((len(rows), form.format(name)))
    for licence in L.IDENTIFIERS:
        expected[len(rows)] = licence
        rows.append((len(rows), f"// SPDX-License-Identifier: {licence}\nint main() {{}}"))
    for text in ("// SPDX-License-Identifier: MIT-0", "under CC BY-XY 4.0", "the GNU Lesser Public Licence 3", "licensed under the MIT"):
        expected[len(rows)] = None
        rows.append((len(rows), text))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["licence"], r["score"]) for r in L.licence_matches(docs, L.templates(spark)).collect()}
    wrong = [(text, expected[i], got.get(i)) for i, text in rows if (got.get(i) or (None,))[0] != expected[i]]
    assert not wrong and {s for _, s in got.values()} == {1.0}


def test_scan_gives_licences_to_the_files_below(spark):
    """Only texts that are licence files give theirs; a notice, a recipe and a poem give and get none elsewhere."""
    texts = dict((k, t) for k, t in licence_docs() if k is not None)
    rows = [(1, "a/LICENSE", texts[21]), (2, "a/src/x.py", texts[36]), (3, "a/src/gpl.c", texts[0]), (4, "a/src/deep/LICENSE", texts[23]), (5, "a/src/deep/y.py", None), (6, "b/poem.txt", texts[31]), (7, "b/header.py", texts[30]), (8, "aa/z.py", "")]
    docs = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumns({"licence": F.lit("x"), "score": F.lit(1), "term": F.lit("y")})
    got = {r["doc_id"]: (r["licence"], r["origin"], r["from_path"]) for r in L.scan_licences(docs, path_col="path").collect()}
    assert got == {
        1: ("MIT", "own", "a/LICENSE"), 2: ("MIT", "inherited", "a/LICENSE"), 3: ("GPL-3.0", "own", "a/src/gpl.c"), 4: ("GPL-3.0", "own", "a/src/deep/LICENSE"),
        5: ("GPL-3.0", "inherited", "a/src/deep/LICENSE"), 6: (None, "none", None), 7: ("MIT", "own", "b/header.py"), 8: (None, "none", None),
    }


def test_licence_of_the_nearest_directory(spark):
    rows = [("LICENSE", "MIT", 1.0, True), ("a/LICENSE", "GPL-3.0", 0.9, True), ("a/COPYING", "BSD-3-Clause", 0.9, True), ("a/b/x.py", None, None, False), ("a/own.py", "MIT", 0.8, False), ("c/d/e.py", None, None, False)]
    files = spark.createDataFrame(rows, "path string, licence string, score double, is_licence_file boolean")
    got = {r["path"]: (r["licence"], r["origin"], r["from_path"]) for r in L.inherited(files).collect()}
    assert got["a/b/x.py"] == ("BSD-3-Clause", "inherited", "a/COPYING")
    assert got["a/own.py"] == ("MIT", "own", "a/own.py") and got["c/d/e.py"] == ("MIT", "inherited", "LICENSE")
    alone = files.where("path = 'a/b/x.py'")
    assert [tuple(r) for r in L.inherited(alone).collect()] == [("a/b/x.py", None, None, "none", None)]


def test_licences_of_odd_documents(odd):
    got = L.scan_licences(odd).collect()
    assert len(got) == odd.count() and {r["origin"] for r in got} == {"none"}
    assert L.scan_licences(odd.limit(0)).count() == 0


def test_scratch_tables(spark):
    """They are dropped when asked for; a cluster session without a shared folder gets an error."""
    path = C.written(spark.range(3), "scratch-test").inputFiles()[0]
    assert C.drop_scratch(spark) >= 1 and not os.path.exists(path.removeprefix("file://"))
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="yarn"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        C.scratch_root(session)
