"""Labelled rows for the classifiers: which rows may be learnt from, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def labelled(labels: DataFrame, label: str, folds: int, held_out: int) -> DataFrame:
    """`doc_id, y` of the rows outside the held-out fold; of repeated ids the largest label, without null labels."""
    rows = labels.where(F.col(label).isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
    return rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))


def first_by_hash(rows: DataFrame, n: int, seed: int = 17) -> DataFrame:
    """At most `n` rows, those with the least hashes of their ids: the same for the same ids."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col("doc_id")), "doc_id").limit(n)


def texts_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """`chosen` (bounded, so broadcast) with the texts of `docs`; text is not moved for any other row."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
