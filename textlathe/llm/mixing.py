"""Mixing sources to target weights: hash-random keys, a range sort within each source, distributed prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, small, written

#: A range of hash keys has about so many documents.
RANGE_ROWS = 4096
#: The hash keys are cut to 52 bits, so that a range is found exactly in double arithmetic.
KEY_BITS = 52


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """`source, source_size, n_docs, target` from `source, size` rows.

    Sources by code point, null last, take the weights in turn. The targets share the total by weight; one stops at
    `most` times its source's size and the excess goes to the others by weight. Sources are stopped in order of
    `most * size / weight`, so one pass of prefix sums over that order finds all that stop. One row per source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights)).cast("int") + 1).cast("double")
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    share = F.when(F.col("open_weight") > 0, F.col("left") / F.col("open_weight")).otherwise(0.0)
    return (
        by_source.withColumn("weight", weight)
        .withColumn("stop", (most * F.col("source_size")).cast("double"))
        .withColumn("ratio", F.col("stop") / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(Window.partitionBy()).cast("double") - F.coalesce(F.sum("stop").over(before), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(rest))
        .withColumn("stops", F.col("ratio") <= share)
        # the level of the first source that does not stop; sources before it all stop
        .withColumn("level", F.first(F.when(~F.col("stops"), share), ignorenulls=True).over(Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("target", F.when(F.col("stops"), F.col("stop")).otherwise(F.col("level") * F.col("weight")))
        .select("source", "source_size", "n_docs", "target")
    )


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 42) -> DataFrame:
    """`doc_id, size, source_size, target, taken` of each row.

    A source takes `round(target)` words: whole epochs of all its documents, then its documents in the order of a
    random key (a hash of id and text) until the budget is exactly reached, so that at most one document per source is taken
    in part. No document is taken more than `most` times. Keys are uniform, so ranges of keys have about equal rows
    however large a source is: sums per range are added up first, and only then the rows of each range.

    A null or empty text has size 0 and is never taken; null sources form one source. Rows that repeat an id or have
    none are told apart by their texts, and those that repeat both share a key; an empty table gives no rows. Other columns are not read.
    """
    key = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), 64 - KEY_BITS)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), key.alias("key"))
    base = written(base, "mix-sizes")
    targets = small(written(source_targets(base, weights, most), "mix-targets"))
    per_range = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / RANGE_ROWS)).cast("long")
    ranged = (
        base.join(targets.withColumn("ranges", per_range), base["source"].eqNullSafe(targets["source"]))
        .drop(targets["source"])
        .withColumn("part", F.floor(F.col("key") / F.lit(float(2**KEY_BITS)) * F.col("ranges")).cast("long"))
    )
    sums = ranged.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    starts = sums.select(
        "source", "part",
        F.coalesce(F.sum("part_size").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start"),
    )
    starts = small(written(starts, "mix-starts"))  # one row for RANGE_ROWS rows
    placed = ranged.join(starts, ranged["source"].eqNullSafe(starts["source"]) & (ranged["part"] == starts["part"])).drop(starts["source"]).drop(starts["part"])
    upto = Window.partitionBy("source", "part").orderBy("key", "doc_id", F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("part_start") + F.coalesce(F.sum("size").over(upto), F.lit(0))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0)
    return (
        placed.withColumn("start", start)
        .withColumn("budget", F.round("target").cast("long"))
        .withColumn("epochs", epochs.cast("long"))
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
        .withColumn("taken", F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start"))))
        .select("doc_id", "size", "source_size", "target", "taken")
    )
