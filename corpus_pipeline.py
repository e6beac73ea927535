"""A corpus pipeline of five stages over `documents`: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlathe.llm.common import table, written
from textlathe.llm.decontamination import judged
from textlathe.llm.mixing import mix_sources
from textlathe.llm.quality import keep_good
from textlathe.llm.simhash import copies
from textlathe.llm.substrings import remove_repeats


def matched(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """`docs` joined with `doc_id, text_hash` of `rows`; a row is known by its id, null or not, and its text."""
    rows = rows.select(F.col("doc_id").alias("id_"), F.col("text_hash").alias("hash_"))
    return docs.join(rows, docs["doc_id"].eqNullSafe(F.col("id_")) & (F.xxhash64(docs["text"]) == F.col("hash_")), how)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go, each row by its own text, null and empty ones too; repeated rows go
    or stay together. Labels of the documents' ids are only learnt from."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays: that of the smallest id (rows without an id come last), of these
    that of the smallest text hash, of rows equal in both the least by all columns. What goes is written, so that Spark
    knows its size when it chooses how to join."""
    more = written(copies(docs), "pipeline-copies")
    alone = matched(docs, more, "left_anti").select(docs.columns)
    repeated = matched(docs, more.where("first"), "left_semi").select(F.xxhash64("text").alias("hash_"), F.struct(*docs.columns).alias("row"))
    return alone.unionByName(repeated.groupBy("row.doc_id", "hash_").agg(F.min("row").alias("row")).select("row.*"))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of 20 words and more that occur before go; texts that lose nothing, null and empty ones too, stay as they are.
    Rows that repeat an id and a text lose nothing to each other. All rows stay."""
    done = remove_repeats(docs)
    cut = F.col("n_removed") > 0
    changed = {"text": F.when(cut, F.col("kept")).otherwise(F.col("doc.text")), "n_chars": F.when(cut, F.char_length("kept").cast("long")).otherwise(F.col("doc.n_chars"))}
    return done.select(*[changed.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go, with or without an id; of rows that share an id, those whose own text is contaminated.
    Null and empty texts are clean, and without benchmark items all are."""
    gone = judged(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id", "text_hash").distinct()
    return matched(docs, written(gone, "pipeline-contaminated"), "left_anti").select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes: none of null and empty texts; null sources are one source."""
    return mix_sources(docs)


STAGES = [("quality", quality_stage), ("simhash", simhash_stage), ("substrings", substring_stage), ("decontamination", decontamination_stage), ("mixing", mixing_stage)]

#: The stages learn, hash and compare in ways that SQL cannot express; tests compare each with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
