"""Licence scan, in DataFrame functions only: sparse TF-IDF cosine of notices and licence files to templates, then
inheritance from the nearest ancestor directory by joins on paths.

A template is compared with windows of as many words as it has, wherever lines end: with those that have one of its two
rarest words in the same place. So a notice is found in any wrapping, and a window is looked at only where a rare word
stands. Names and identifiers of licences are templates too, of which every word must be there.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import literal_rows, small, written
from .decontamination import BETWEEN
from .licence_texts import DENIED, IDENTIFIERS, NAMES, NOT_NEXT, NOTICES, OPENINGS, SAID, WHOLE_TEXTS

MIN_SCORE = 0.8
#: A licence file has its text within so many words of its start, and whole texts leave no more than these around them.
MARGIN = 60
NOTICE, WHOLE, OPENING, NAME = "notice", "whole", "opening", "name"
#: Within so many words before a name it is said, or denied, that it is a notice.
BEFORE = 6


def template_rows() -> list[tuple[int, str, str, str]]:
    """`template, kind, licence, text` of all templates."""
    names = [*NAMES, *((i, i) for i in IDENTIFIERS if "-" in i), *((i, f"SPDX-License-Identifier: {i}") for i in IDENTIFIERS)]
    named = [(kind, *row) for kind, rows in ((NOTICE, NOTICES), (WHOLE, WHOLE_TEXTS), (OPENING, OPENINGS), (NAME, names)) for row in rows]
    return [(i, *row) for i, row in enumerate(named)]


def templates(spark: SparkSession) -> DataFrame:
    return literal_rows(spark, template_rows(), "template int, kind string, licence string, text string")


def words(text: Column) -> Column:
    """The words of a text in lower case: runs of ASCII letters and digits and of all that is not ASCII."""
    return F.array_remove(F.split(F.lower(text), BETWEEN), "")


def template_weights(docs: DataFrame, texts: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame, float]:
    """`template, term, weight, idf`, with unit lengths; `template, kind, licence, size, place, term` of the two rarest
    places of each template (first ones first); and the weight of a term that no template has.

    A term weighs its count times ln((1 + documents) / (1 + documents with it)) + 1, from all documents. Both tables are
    as large as the templates.
    """
    spark = docs.sparkSession
    found = [(r["template"], r["kind"], r["licence"], r["words"]) for r in texts.select("template", "kind", "licence", words(F.col("text")).alias("words")).collect()]
    vocabulary = sorted({w for *_, terms in found for w in terms})
    shared = F.array_intersect(words(F.col(text_col)), F.array(*map(F.lit, vocabulary)))
    # the mark "" stands in each list once and counts the documents
    marked = F.array_append(F.coalesce(shared, F.array().cast("array<string>")), F.lit(""))
    seen = {r["term"]: r["count"] for r in docs.select(F.explode(marked).alias("term")).groupBy("term").count().collect()}
    total = seen.get("", 0)
    idf = {t: math.log((1 + total) / (1 + seen.get(t, 0))) + 1 for t in vocabulary}
    weights, anchors = [], []
    for number, kind, licence, terms in found:
        vector = {t: terms.count(t) * idf[t] for t in set(terms)}
        length = math.sqrt(sum(w * w for w in vector.values()))
        weights += [(number, t, w / length, idf[t]) for t, w in sorted(vector.items())]
        rarest = sorted(range(len(terms)), key=lambda i: (-idf[terms[i]], i))
        second = next((i for i in rarest if terms[i] != terms[rarest[0]]), rarest[0])
        anchors += [(number, kind, licence, len(terms), i, terms[i]) for i in dict.fromkeys((rarest[0], second))]
    return (
        literal_rows(spark, weights, "template int, term string, weight double, idf double"),
        literal_rows(spark, anchors, "template int, kind string, licence string, size int, place int, term string"),
        math.log(1 + total) + 1,
    )


def licence_matches(docs: DataFrame, texts: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = MIN_SCORE) -> DataFrame:
    """`doc_id, text_hash, licence, score, is_licence_file` of the documents with a window whose cosine to a template is at
    least `least`: the best one, ties to the licence first by name. All windows around the rarest words of the templates
    in all documents are scored.

    A name of a licence or an identifier is a notice of its own if all its words and no others stand in the window, so its
    score is 1 in any table; if a word such as "licensed" or "under" stands before it, and none such as "not"; and if
    what follows does not make it another name.

    A document is a licence file if it opens with a template of one: after at most MARGIN words, and, for whole licence
    texts, with no more than MARGIN words left over.
    """
    weights, anchors, other = template_weights(docs, texts, text_col)
    rare = sorted({r["term"] for r in anchors.select("term").collect()})  # as many as templates, at most twice
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), words(F.col(text_col)).alias("words"))
    could = keyed.where(F.arrays_overlap("words", F.array(*map(F.lit, rare))))
    spots = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("pos"), w.alias("term"))), lambda s: s["term"].isin(rare))
    spotted = could.select("doc_id", "text_hash", "words", F.size("words").alias("n_words"), F.explode(spots).alias("s")).select("doc_id", "text_hash", "words", "n_words", "s.pos", "s.term")
    start = F.col("pos") - F.col("place")
    window = F.slice("words", F.greatest(start, F.lit(0)) + 1, F.col("size") + F.least(start, F.lit(0)))
    placed = spotted.join(F.broadcast(anchors), "term").where(start + F.col("size") > 0)
    squares = weights.groupBy("template").agg(F.collect_list(F.struct("term", F.pow("weight", 2).alias("square"))).alias("squares"))
    reach = F.aggregate(F.filter("squares", lambda t: F.array_contains("window", t["term"])), F.lit(0.0), lambda s, t: s + t["square"])
    first = F.greatest(start - BEFORE, F.lit(0))
    before, after = F.slice("words", first + 1, F.greatest(start - first, F.lit(0))), F.coalesce(F.get("words", start + F.col("size")), F.lit(""))
    among = lambda found: lambda w: w.isin(sorted(found))
    said = (F.exists(before, among(SAID)) | F.get("words", start).isin(sorted(SAID))) & ~F.exists(before, among(DENIED)) & ~after.isin(sorted(NOT_NEXT))
    placed = placed.where((F.col("kind") != NAME) | ((start >= 0) & said))
    windows = placed.select("doc_id", "text_hash", "template", "kind", "licence", "size", "n_words", start.alias("start"), window.alias("window")).join(F.broadcast(squares), "template")
    # a cosine is at most the length of the part of the template's vector that lies on words of the window; names are whole
    windows = windows.where(reach >= F.when(F.col("kind") == NAME, 1 - 1e-9).otherwise(least * least - 1e-9)).drop("squares").dropDuplicates(["doc_id", "text_hash", "template", "start"])
    keys = ["doc_id", "text_hash", "template", "kind", "licence", "size", "n_words", "start"]
    terms = windows.select(*keys, F.explode("window").alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))
    idf, named = F.broadcast(weights.select("term", "idf").distinct()), F.broadcast(weights.select("template", "term", "weight"))
    scaled = terms.join(idf, "term", "left").withColumn("value", F.col("tf") * F.coalesce("idf", F.lit(other))).join(named, ["template", "term"], "left")
    sums = scaled.groupBy(*keys).agg(F.sum(F.col("value") * F.coalesce("weight", F.lit(0.0))).alias("dot"), F.sum(F.pow("value", 2)).alias("square"))
    scored = sums.withColumn("score", F.round(F.col("dot") / F.sqrt("square"), 9)).where(F.col("score") >= F.when(F.col("kind") == NAME, 1 - 1e-9).otherwise(least))
    near = F.col("kind").isin(WHOLE, OPENING) & (F.col("start") <= MARGIN) & ((F.col("kind") == OPENING) | (F.col("n_words") - F.col("size") <= MARGIN))
    best = F.min(F.struct((~near).alias("not_file"), (-F.col("score")).alias("low"), "licence")).alias("best")
    return scored.groupBy("doc_id", "text_hash").agg(best).select("doc_id", "text_hash", F.col("best.licence").alias("licence"), (-F.col("best.low")).alias("score"), (~F.col("best.not_file")).alias("is_licence_file"))


def inherited(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """`path, licence, score, origin, from_path` of each row of `files` (`path, licence, score, is_licence_file`), after the
    columns `keep`.

    A file with a licence of its own has origin 'own'. Another one takes that of the licence file in the nearest of the
    directories above it (its own directory first), origin 'inherited'; with none the licence is null and origin 'none'.
    Of several licence files in a directory the one of the best score counts, then of the first path. Licence files are
    few beside all files: they are broadcast behind a check of their number, so a directory of very many files does not
    gather in one task.
    """
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    rank = F.min(F.struct((-F.col("score")).alias("low"), F.col("path").alias("from_path"), F.col("licence").alias("found")))
    declared = files.where("is_licence_file AND licence IS NOT NULL").groupBy(folder.alias("folder")).agg(rank.alias("d"))
    declared = declared.select("folder", "d.from_path", "d.found", (-F.col("d.low")).alias("found_score"))
    steps = F.split(folder, "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    open_files = files.where("licence IS NULL AND path IS NOT NULL").select("path").distinct()
    found = open_files.select("path", F.explode(F.array_distinct(above)).alias("folder")).join(small(declared), "folder")
    nearest = found.groupBy("path").agg(F.max(F.struct(F.length("folder").alias("depth"), "from_path", "found", "found_score")).alias("n"))
    joined = files.join(nearest.withColumnRenamed("path", "path_"), files["path"] == F.col("path_"), "left")
    own = F.col("licence").isNotNull()
    return joined.select(
        *keep, "path", F.coalesce("licence", "n.found").alias("licence"), F.coalesce(F.when(own, F.col("score")), F.col("n.found_score")).alias("score"),
        F.when(own, "own").when(F.col("n").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(own, F.col("path")).otherwise(F.col("n.from_path")).alias("from_path"),
    )


def scan_licences(docs: DataFrame, *, path_col: str | None = None, least: float = MIN_SCORE) -> DataFrame:
    """`doc_id, path, licence, score, origin, from_path` of each row of `documents`.

    Without a column of paths a document stands for the file `source/lang/doc_id`. A file whose text carries a notice has
    that licence ('own'); one that is a licence file by its text gives its licence to all files below its directory that
    carry none ('inherited'). No other file gives one. Null and empty texts carry nothing; a null source or lang stands
    for `-`. A row is known by its id, null or not, and its text; rows that share a path are files of one place each.
    Without documents there are no rows.
    """
    place = F.col(path_col) if path_col else F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), "doc_id")
    known = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), place.alias("path"))
    matches = written(licence_matches(docs, templates(docs.sparkSession), least=least).withColumnsRenamed({"doc_id": "id_", "text_hash": "hash_"}), "licence-matches")
    files = known.join(small(matches), F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("text_hash") == F.col("hash_")), "left")
    files = files.select("doc_id", "path", "licence", "score", F.coalesce("is_licence_file", F.lit(False)).alias("is_licence_file"))
    return inherited(files, keep=("doc_id",)).select("doc_id", "path", "licence", "score", "origin", "from_path")
