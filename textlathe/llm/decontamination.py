"""Benchmark decontamination with a distributed positional index, in DataFrame functions only.

Corpus counts of the test terms tell the rarest terms of each test window. The postings (document, position) of those
terms are stored; shifted by the term's place in the test item, the lists of the two rarest terms of a window meet in
alignments, and only these are compared word by word.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, written

#: What stands between words: every ASCII character but digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Over how many tasks at least the rows of a frequent term are dealt where terms are too many to broadcast.
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text with A-Z in lower case; other letters stay as they are. Null has none. The text is split once,
    also where the result is used more than once or exploded."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.array_remove(F.split(F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER)), BETWEEN), "")


def among(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """The rows of `tokens` whose `term` is one of `terms`, with what `terms` says of it. Few terms are broadcast; many
    are repeated with each of SALTS salts, so that no frequent term gathers in one task."""
    few = small(terms)
    if few is not terms:
        return tokens.join(few, "term")
    salted = terms.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    return tokens.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "text_hash", "pos"), F.lit(SALTS)).cast("int")).join(salted, ["term", "_salt"]).drop("_salt")


#: Words of a stretch of a text; as many as the longest item has, if that has more.
STRETCH = 1024


@dataclass(frozen=True)
class Index:
    """The stored index: `items` (`item_id, words, n, item`), `anchors` (the two rarest places of each window of an item:
    `item, item_id, n, at, place, term`), `postings` of their terms (`doc_id, text_hash, pos, term`) and `totals`
    (`doc_id, text_hash, n_words` of each document row)."""

    items: DataFrame
    anchors: DataFrame
    postings: DataFrame
    totals: DataFrame


def rarest_terms(items: DataFrame, counts: DataFrame, size: int, most: int = 2) -> DataFrame:
    """`item, item_id, n, at, place, term`: the `most` rarest places of each window of `size` words (an item of fewer, but
    some, words is one window). Windows with a word that no document has cannot occur, and are left out."""
    length = F.least(F.lit(size), F.col("n"))
    starts = F.explode(F.sequence(F.lit(0), F.col("n") - length)).alias("at")
    each = items.where("n > 0").select("item", "item_id", "n", starts).select("*", F.explode(F.sequence(F.col("at"), F.col("at") + length - 1)).alias("place"))
    placed = items.select("item", F.posexplode("words").alias("place", "term")).join(small(counts), "term", "left")
    window = Window.partitionBy("item", "at")
    ranked = each.join(placed, ["item", "place"]).withColumn("known", F.count("n_corpus").over(window))
    ranked = ranked.withColumn("rank", F.row_number().over(window.orderBy("n_corpus", "place")))
    return ranked.where((F.col("known") == length) & (F.col("rank") <= most)).select("item", "item_id", "n", "at", "place", "term")


def build_index(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", size: int = 13) -> Index:
    """The index of `docs` for the items of `benchmark`. Two scans: counts of the items' terms over all documents, then
    the postings of the terms that are rarest in a window. A document is known by its id and its text, so rows that share
    an id are kept apart."""
    corpus = corpus_words(docs, id_col, text_col)
    items = benchmark.select(F.col(item_col).alias("item_id"), words(F.col(text_col)).alias("words"))
    items = written(items.withColumn("n", F.size("words")).withColumn("item", F.struct("item_id", F.xxhash64("words").alias("h"))).distinct(), "bench-items")
    tokens = corpus.select("doc_id", "text_hash", F.posexplode("words").alias("pos", "term"))
    counts = among(tokens, items.select(F.explode("words").alias("term")).distinct()).groupBy("term").agg(F.count("*").alias("n_corpus"))
    anchors = written(rarest_terms(items, written(counts, "bench-counts"), size), "bench-anchors")
    # one scan for both: postings, and the numbers of words of all documents
    posted = among(tokens, anchors.select("term").distinct()).select("doc_id", "text_hash", "pos", "term")
    totals = corpus.select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words"))
    return Index(items, anchors, written(posted, "bench-postings"), totals)


def corpus_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), words(F.col(text_col)).alias("words"))


def phrase_matches(docs: DataFrame, index: Index, *, id_col: str = "doc_id", text_col: str = "text", size: int = 13) -> DataFrame:
    """The exact matches `doc_id, text_hash, item_id, start, length` of windows of `size` item words (`start` from 0).

    The lists of the two rarest terms of the windows of an item, shifted by the terms' places, meet where both stand as
    in the item; only there words are compared.
    """
    places = index.anchors.select("item", "n", "place", "term").distinct()
    shifted = index.postings.join(small(places), "term").select("doc_id", "text_hash", "item", "n", "place", (F.col("pos") - F.col("place")).alias("shift"))
    met = shifted.groupBy("doc_id", "text_hash", "item", "n", "shift").agg(F.min("place").alias("low"), F.max("place").alias("high")).where("low < high or n = 1")
    # texts that meet are cut into stretches of STRETCH words and those that the longest item may reach beyond; an alignment
    # is looked at in its stretch alone, so a text is carried once however many it has
    longest = int(index.items.agg(F.max("n")).first()[0] or 0)
    wide = max(STRETCH, longest)
    stretch = F.greatest(F.lit(0), F.floor(F.col("shift") / wide)).cast("int")
    aligned = written(met.select("doc_id", "text_hash", "item", "n", "shift", stretch.alias("stretch")), "bench-aligned").withColumnsRenamed({"doc_id": "id_", "text_hash": "hash_", "stretch": "stretch_"})
    whole = written(aligned.select("id_", "hash_").distinct(), "bench-met")
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    same = keyed["doc_id"].eqNullSafe(F.col("id_")) & (keyed["text_hash"] == F.col("hash_"))
    texts = keyed.join(small(whole), same, "left_semi").select("doc_id", "text_hash", words(F.col("text")).alias("words"))
    number = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("words") - 1) / wide).cast("int")))
    cut = texts.select("doc_id", "text_hash", F.explode(F.transform(number, lambda k: F.struct(k.alias("stretch"), F.slice("words", k * wide + 1, wide + longest).alias("words")))).alias("s")).select("doc_id", "text_hash", "s.*")
    lead = F.greatest(F.lit(0), -F.col("shift"))
    found = F.slice("words", F.greatest(F.lit(0), F.col("shift")) - F.col("stretch") * wide + 1, F.col("n") - lead)
    pairs = cut.join(small(aligned), cut["doc_id"].eqNullSafe(F.col("id_")) & (cut["text_hash"] == F.col("hash_")) & (cut["stretch"] == F.col("stretch_")))
    pairs = pairs.select("doc_id", "text_hash", "item", "shift", lead.cast("int").alias("lead"), found.alias("found"))
    both = pairs.join(small(index.items.select("item", "item_id", "n", F.col("words").alias("test"))), "item")
    length = F.least(F.col("n"), F.lit(size))
    last = F.least(F.col("n") - length, F.col("lead") + F.size("found") - length)
    at = F.when(last >= F.col("lead"), F.sequence(F.col("lead"), last)).otherwise(F.array().cast("array<int>"))
    equal = F.filter(at, lambda s: F.slice("found", s - F.col("lead") + 1, length) == F.slice("test", s + 1, length))
    hits = both.select("doc_id", "text_hash", "item_id", "shift", length.alias("length"), F.explode(equal).alias("at"))
    return hits.select("doc_id", "text_hash", "item_id", (F.col("shift") + F.col("at")).alias("start"), "length").distinct()


def proximity_matches(index: Index, *, slack: int = 3) -> DataFrame:
    """`doc_id, text_hash, item_id, at, first, second`: where the two rarest terms of the window of an item that begins at
    its word `at` stand in a document at `first` and `second`, in the window's order and at a distance that differs by no
    more than `slack` words from theirs there. A looser signal than an exact match; all such pairs are found, whatever
    stands between. Windows of one word have one place, `first` and `second` alike.

    Both lists say where the window would begin. They are joined on blocks of that, as wide as the slack.
    """
    anchors = index.anchors.select("item", "item_id", "at", "place", "term")
    window = Window.partitionBy("item", "at")
    sides = anchors.withColumns({"low": F.min("place").over(window), "high": F.max("place").over(window)})
    keys = ["doc_id", "text_hash", "item", "item_id", "at", "block"]
    posted = index.postings.join(small(sides), "term").withColumn("begins", F.col("pos") - F.col("place"))
    block = F.floor(F.col("begins") / (slack + 1))
    left = posted.where("place = low").select(*keys[:-1], block.alias("block"), F.col("pos").alias("first"), F.col("begins").alias("one"), "low", "high")
    right = posted.where("place = high").select(*keys[:-1], F.explode(F.array(block - 1, block, block + 1)).alias("block"), F.col("pos").alias("second"), F.col("begins").alias("other")).withColumnsRenamed({k: f"{k}_" for k in keys})
    same = [left[k].eqNullSafe(right[f"{k}_"]) for k in keys]
    near = left.join(right, reduce(lambda a, b: a & b, same)).where(F.abs(F.col("one") - F.col("other")) <= slack)
    near = near.where("low < high AND first < second OR low = high AND first = second")
    return near.select(*keys[:-2], "at", "first", "second").drop("item").distinct()


def near_items(index: Index, *, slack: int = 3) -> DataFrame:
    """`doc_id, text_hash, item_id`: the items of which a document has a proximity match (see `proximity_matches`), each
    once, so also all of which it has an exact one.

    Windows of all items whose two rarest terms are the same, at the same distance, are looked for together.
    """
    window = F.struct("place", "term")
    sides = index.anchors.groupBy("item", "item_id", "at").agg(F.min(window).alias("low"), F.max(window).alias("high"))
    named = written(sides.select("item_id", F.col("low.term").alias("one"), F.col("high.term").alias("other"), (F.col("high.place") - F.col("low.place")).alias("gap")).distinct(), "bench-named")
    pairs = written(named.select("one", "other", "gap").distinct(), "bench-pairs")
    block = F.floor((F.col("pos") + F.col("gap")) / (slack + 1))
    left = among(index.postings, pairs.withColumn("term", F.col("one"))).select("doc_id", "text_hash", "one", "other", "gap", block.alias("block"), F.col("pos").alias("first"))
    block = F.floor(F.col("pos") / (slack + 1))
    right = among(index.postings, pairs.withColumn("term", F.col("other"))).select("doc_id", "text_hash", "one", "other", "gap", F.explode(F.array(block - 1, block, block + 1)).alias("block"), F.col("pos").alias("second"))
    keys = ["doc_id", "text_hash", "one", "other", "gap", "block"]
    right = right.withColumnsRenamed({k: f"{k}_" for k in keys})
    same = [left[k].eqNullSafe(right[f"{k}_"]) if k == "doc_id" else left[k] == right[f"{k}_"] for k in keys]
    met = left.join(right, reduce(lambda a, b: a & b, same)).where(F.abs(F.col("second") - F.col("first") - F.col("gap")) <= slack)
    met = met.where("gap > 0 AND first < second OR gap = 0 AND first = second").select(*keys[:-1]).distinct()
    return met.join(small(named), ["one", "other", "gap"]).select("doc_id", "text_hash", "item_id").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", size: int = 13, share: int = 20, slack: int | None = None) -> DataFrame:
    """`doc_id, n_words, n_hit, n_items, items_sha256, contaminated` of each row of `docs`; see `judged`. With a `slack`,
    also `n_near`: how many items with an id have a proximity match in it (see `near_items`), 0 where nothing has."""
    index = build_index(docs, benchmark, id_col=id_col, text_col=text_col, item_col=item_col, size=size)
    out = judged(docs, benchmark, id_col=id_col, text_col=text_col, item_col=item_col, size=size, share=share, index=index)
    if slack is None:
        return out.drop("text_hash")
    near = near_items(index, slack=slack).groupBy(F.col("doc_id").alias("id_"), F.col("text_hash").alias("hash_")).agg(F.count("item_id").alias("n_near"))
    near = small(written(near, "bench-near"))
    return out.join(near, out["doc_id"].eqNullSafe(F.col("id_")) & (out["text_hash"] == F.col("hash_")), "left").drop("text_hash", "id_", "hash_").withColumn("n_near", F.coalesce("n_near", F.lit(0)))


def judged(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", size: int = 13, share: int = 20, index: Index | None = None) -> DataFrame:
    """`doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated` of each row of `docs`.

    A word is hit if it lies in an exact occurrence of a window; a document is contaminated if at least one of `share`
    words is hit. Null and empty texts have no words and are clean; so is all if the benchmark is empty. Items without
    words give no window, those with a null id hit words but are not named. Rows of `docs` that repeat an id are judged
    each by its own text; other columns are not read.
    """
    index = index or build_index(docs, benchmark, id_col=id_col, text_col=text_col, item_col=item_col, size=size)
    totals, hits = index.totals, phrase_matches(docs, index, id_col=id_col, text_col=text_col, size=size)
    hits = written(hits, "bench-hits")
    # of spans in order, each adds what lies beyond the furthest end so far; a document's spans are no array
    order = Window.partitionBy("doc_id", "text_hash").orderBy("start", "end")
    spans = hits.select("doc_id", "text_hash", "start", (F.col("start") + F.col("length")).alias("end")).distinct()
    reached = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fresh = spans.withColumn("fresh", F.greatest(F.lit(0), F.col("end") - F.greatest("start", reached)))
    covered = fresh.groupBy(F.col("doc_id").alias("id_"), F.col("text_hash").alias("hash_")).agg(F.sum("fresh").alias("hit"))
    named = hits.groupBy("doc_id", "text_hash").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))  # the contract's list of items
    found = covered.join(named, covered["id_"].eqNullSafe(named["doc_id"]) & (covered["hash_"] == named["text_hash"])).select("id_", "hash_", "items", "hit")
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("hit", F.lit(0)).cast("long")
    return totals.join(found, totals["doc_id"].eqNullSafe(F.col("id_")) & (totals["text_hash"] == F.col("hash_")), "left").select(
        "doc_id", "text_hash", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items), ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )
