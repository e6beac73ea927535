"""Counts, profiles, duplicates and deduplication of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import write_checked

#: Ranges that a pass of rank selection divides a span into, and how many values of the last one are fetched at most.
RANGES, FETCHED = 1024, 10_000


def value_counts(df: DataFrame, col: str, top: int | None = None) -> DataFrame:
    """Rows of each value that is not null, most first, ties by value."""
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")
    return counts.limit(top) if top else counts


def null_profile(df: DataFrame) -> DataFrame:
    """`column_name, n_null, pct_null` of each column, in one pass."""
    sums = df.agg(F.count("*").alias("_rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"c{i}") for i, c in enumerate(df.columns)])
    each = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("n_null")) for i, c in enumerate(df.columns)])
    share = F.when(F.col("_rows") > 0, F.round(100.0 * F.col("n_null") / F.col("_rows"), 6))
    return sums.select("_rows", F.inline(each)).select("column_name", "n_null", share.alias("pct_null"))


def values_at(df: DataFrame, col: str, ranks: list[int]) -> dict[int, float]:
    """The values of some ranks (from 0) among all values that are numbers, by rank selection: a pass counts the values of
    equal ranges around each wanted one with the least and greatest of them, and the next pass divides the range that
    holds it. Passes end where a range has one value, or so few that they are fetched. Only counts reach the driver."""
    values = df.select(F.col(col).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    least, most = values.agg(F.min("v"), F.max("v")).first()
    found: dict[int, float] = {}
    wanted = {rank: (least, most, 0) for rank in ranks}  # the range that holds a rank, and how many values lie below it
    while wanted:
        spans = sorted(set(wanted.values()))
        share = lambda lo, hi: (F.col("v") / RANGES - lo / RANGES) / (hi / RANGES - lo / RANGES) if hi > lo else F.lit(0.0)
        place = F.lit(None).cast("int")
        for i, (lo, hi, _) in enumerate(spans):
            at = F.least(F.floor(share(lo, hi) * RANGES), F.lit(RANGES - 1)).cast("int")
            place = F.when((F.col("v") >= lo) & (F.col("v") <= hi), i * RANGES + at).otherwise(place)
        counted = values.select("v", place.alias("place")).where("place IS NOT NULL").groupBy("place").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        bins = sorted(counted.collect())  # at most RANGES rows a span
        narrowed = {}
        for rank, span in wanted.items():
            below, i = span[2], spans.index(span)
            for r in bins:
                if r["place"] // RANGES == i:
                    if rank < below + r["n"]:
                        narrowed[rank] = (r["lo"], r["hi"], below), r["n"]
                        break
                    below += r["n"]
        wanted = {}
        for rank, ((lo, hi, below), n) in narrowed.items():
            if lo == hi:
                found[rank] = lo
            elif n <= FETCHED:
                found[rank] = sorted(r["v"] for r in values.where(F.col("v").between(lo, hi)).collect())[rank - below]
            else:
                wanted[rank] = lo, hi, below
    return found


def exact_quantiles(df: DataFrame, col: str, shares: list[float]) -> list[float | None]:
    """The quantiles of a column, between two values in proportion; None for a column without numbers."""
    n = df.select(F.col(col).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)").count()
    places = [share * (n - 1) for share in shares]
    at = values_at(df, col, sorted({rank for p in places for rank in (int(p), min(int(p) + 1, n - 1))})) if n else {}
    return [at[int(p)] + (at[min(int(p) + 1, n - 1)] - at[int(p)]) * (p - int(p)) for p in places] if n else [None] * len(shares)


def describe(df: DataFrame, col: str, in_one: int = 1_000_000) -> DataFrame:
    """Count, mean, sample deviation, least, exact quartiles and greatest of a column. Up to about `in_one` distinct
    values are counted at one place; quartiles of more are found by rank selection."""
    q = [F.percentile(col, F.lit(p)).alias(name) for p, name in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))]
    if df.select(F.approx_count_distinct(col)).first()[0] > in_one:
        q = [F.lit(x).cast("double").alias(name) for x, name in zip(exact_quantiles(df, col, [0.25, 0.5, 0.75]), ("p25", "p50", "p75"))]
    return df.agg(F.count(col).alias("n"), F.round(F.avg(col), 6).alias("mean"), F.round(F.stddev_samp(col), 6).alias("std"), F.min(col).alias("least"), *q, F.max(col).alias("most"))


def digests(df: DataFrame, keys: tuple[str, ...] | list[str]) -> list[Column]:
    """What rows are compared and shuffled by: of text columns the SHA-256, so that no text leaves the scan."""
    return [F.sha2(F.col(k).cast("binary"), 256) if df.schema[k].dataType.simpleString() == "string" else F.col(k) for k in keys]


def duplicate_count(df: DataFrame, *keys: str) -> DataFrame:
    """How many rows repeat an earlier one."""
    return df.groupBy(*digests(df, keys)).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("n_duplicates"))


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), *keys)


def keep_first(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """The first row of each key in `order`; of a group, each task passes on only its own first row."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*digests(df, keys)).orderBy(*order))).where("_nth = 1").drop("_nth")


def duplicate_flags(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """`df` with `is_duplicate`: whether an earlier row in `order`, which no two rows share, has the same key.

    The firsts of all keys are one aggregate, so a key that many rows have meets nowhere; rows are joined to the first of
    their key by digest and place.
    """
    named = [d.alias(f"_k{i}") for i, d in enumerate(digests(df, keys))]
    place = F.struct(*order)
    firsts = df.select(*named, place.alias("_at")).groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(F.min("_at").alias("_at"))
    return df.withColumn("_at", place).join(firsts.select("_at", F.lit(True).alias("_first")), "_at", "left").withColumn("is_duplicate", F.col("_first").isNull()).drop("_at", "_first")


def length_report(chunks: DataFrame, size: int = 1500) -> DataFrame:
    """Lengths of chunks, and how many are over `size` and over 10,000."""
    n = F.length("text").cast("long")
    return chunks.agg(
        F.count("*").alias("n_chunks"), F.min(n).alias("least"), F.max(n).alias("most"), F.round(F.avg(n), 6).alias("mean"),
        F.count_if(n > size).alias("n_over"), F.count_if(n > 10000).alias("n_far_over"),
    )


def write_chunks(chunks: DataFrame, path: str, size: int = 1500) -> tuple[DataFrame, DataFrame, dict]:
    """Writes chunks; gives those that fit, those that are too long or lack an id or a text (kept apart), and the numbers of
    `length_report`, all from one pass over the chunks."""
    n = F.length("text").cast("long")
    rules = {"long": n <= size, "id": F.col("chunk_id").isNotNull() & F.col("doc_id").isNotNull(), "text": F.col("text").isNotNull()}
    measures = {"least": F.min(n), "most": F.max(n), "mean": F.round(F.avg(n), 6), "n_over": F.count_if(n > size), "n_far_over": F.count_if(n > 10000)}
    return write_checked(chunks, path, rules, measures)


def require_bounded(chunks: DataFrame, size: int = 1500) -> DataFrame:
    """`chunks`; reading it fails if one is longer than `size`."""
    fail = F.raise_error(F.concat(F.lit("chunk too long: "), F.col("chunk_id")))
    return chunks.withColumn("text", F.when(F.length("text") <= size, F.col("text")).otherwise(fail))


def chunk_integrity(chunks: DataFrame) -> DataFrame:
    """Of each document, whether its chunk indexes are 0 to n - 1 and its chunk ids differ."""
    index = F.col("chunk_index")
    per = chunks.groupBy("doc_id").agg(F.count("*").alias("n"), F.min(index).alias("lo"), F.max(index).alias("hi"), F.count_distinct(index).alias("n_index"), F.count_distinct("chunk_id").alias("n_id"))
    return per.select("doc_id", "n", ((F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1) & (F.col("n_index") == F.col("n"))).alias("contiguous"), (F.col("n_id") == F.col("n")).alias("unique_ids"))


def table_profile(df: DataFrame) -> DataFrame:
    """Number of rows and columns, and the names and types of the columns."""
    types = " ".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema)
    return df.agg(F.count("*").alias("n_rows"), F.lit(len(df.columns)).cast("bigint").alias("n_columns"), F.lit(types).alias("columns"))
