"""Reading and writing tables: Parquet, and CSV with a byte order mark; scratch tables on shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOM = "\ufeff"
#: The scratch paths that have been given out and not been removed.
SCRATCH: list[str] = []


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the session names. Where it names none: a temporary folder in local mode (tests), an error
    on a cluster, whose executors could not read that."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="textlathe-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which `drop_scratch` removes."""
    SCRATCH.append(f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}")
    return SCRATCH[-1]


def exists(spark: SparkSession, path: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """`df` as a scratch table, for what is read more than once."""
    return write_parquet(df, scratch_path(df.sparkSession, name))


def drop_scratch(spark: SparkSession) -> int:
    """Removes the scratch paths so far and tells how many; for when the results that read them have been written."""
    n = len(SCRATCH)
    while SCRATCH:
        path = spark._jvm.org.apache.hadoop.fs.Path(SCRATCH.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def spread(df: DataFrame) -> DataFrame:
    """`df`, dealt to all cores if it lies in fewer files than there are cores: before work on texts that takes longer
    than moving them. A table of many files is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: list[str] | None = None) -> DataFrame:
    """Writes `df` and reads it back, so that what follows does not compute it again."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_checked(df: DataFrame, path: str, rules: dict[str, Column], measures: dict[str, Column]) -> tuple[DataFrame, DataFrame, dict]:
    """Writes `df` once and returns the rows that keep all rules, the others with `broken` (the names of the rules they
    break; one that is null is broken), and the `measures` (aggregates over all rows, and `n_<rule>`, how many rows break
    each), which the write itself observes: `df` is not computed a second time for its checks."""
    broken = F.filter(F.array(*[F.when(F.coalesce(keeps, F.lit(False)), F.lit(None).cast("string")).otherwise(F.lit(name)) for name, keeps in rules.items()]), lambda x: x.isNotNull())
    seen = Observation()
    marked = df.withColumn("broken", broken)
    counts = [F.count_if(F.array_contains("broken", name)).alias(f"n_{name}") for name in rules]
    observed = marked.observe(seen, F.count("*").alias("n_rows"), *[m.alias(name) for name, m in measures.items()], *counts)
    observed.withColumn("kept", F.size("broken") == 0).write.partitionBy("kept").parquet(path)
    schema = T.StructType([*marked.schema, T.StructField("kept", T.BooleanType())])
    stored = df.sparkSession.read.schema(schema).parquet(path)
    return stored.where("kept").select(df.columns), stored.where("NOT kept").drop("kept"), seen.get


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV files with a header, each of which starts with a byte order mark, as spreadsheets expect of UTF-8."""
    first, *rest = df.columns
    df.toDF(BOM + first, *rest).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Reads what `write_csv` wrote; columns go by place, so the mark in the header does no harm."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("escape", '"').option("multiLine", True).csv(path)
