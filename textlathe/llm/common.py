"""What the training-data operators share: table access, scratch tables on shared storage, word splitting."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word definition of the contracts: space and U+0009 to U+000D.
SPACES = r"[\x20\x09-\x0D]+"
#: Tables of up to this many rows are broadcast (some tens of bytes each); larger ones are joined by shuffles.
BROADCAST_ROWS = 200_000
#: Paths of the scratch tables that `written` has made and `drop_scratch` has not removed.
SCRATCH: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster. Where the session names none, a temporary folder in local mode (tests); an error
    on a cluster, whose executors could not read it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="textlathe-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def written(df: DataFrame, name: str) -> DataFrame:
    """`df`, written as a table in the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    SCRATCH.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> int:
    """Removes all scratch tables so far and tells how many; for when the results that read them have been written."""
    n = len(SCRATCH)
    while SCRATCH:
        path = spark._jvm.org.apache.hadoop.fs.Path(SCRATCH.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as a literal of the plan: no Python worker makes them."""
    names = [field.split(" ")[0] for field in schema.split(", ")]
    text = json.dumps([dict(zip(names, row)) for row in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema.replace(' ', ': ').replace(',: ', ', ')}>>")))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df`, with a broadcast hint if it has no more than `rows` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_words(text: Column) -> Column:
    """How many words of `[^\\x20\\x09-\\x0D]+` a text has; 0 for null."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACES)
    n = F.size(parts)
    empty_first = F.element_at(parts, 1) == ""
    empty_last = (n > 1) & (F.element_at(parts, -1) == "")
    return (n - empty_first.cast("int") - empty_last.cast("int")).cast("long")
