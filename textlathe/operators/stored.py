"""Tables in folders by a hash of their key: a merge rewrites only the folders with rows that it changes, and a lookup
reads only those of its keys."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import scratch_table

#: Up to this many keys are named in a plan; more are joined.
NAMED_KEYS = 1000
#: Into how many parts the rows of a folder are dealt for writing; of new rows, how many times as many the folders may have
#: that get them as further files, if none replaces a row.
DEALS, ADDED = 32, 8


def bucket_of(key: Column, buckets: int) -> Column:
    return (F.crc32(key.cast("binary")) % buckets).cast("int")


@dataclass(frozen=True)
class StoredTable:
    """Rows with a unique `key` (its first column deals them to folders). Of rows with one key the one that is greatest by
    the other columns in their order counts, or the least: so a table does not depend on how its rows were loaded."""

    spark: SparkSession = field(repr=False)
    path: str
    schema: T.StructType
    key: tuple[str, ...]
    buckets: int
    least: bool = False

    def files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def folders(self, path: str | None = None) -> list[int]:
        """The numbers of the folders that are there."""
        top = self.spark._jvm.org.apache.hadoop.fs.Path(path or self.path)
        names = [f.getPath().getName() for f in self.files().listStatus(top)] if self.files().exists(top) else []
        return sorted(int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket="))

    def stored(self) -> DataFrame:
        """All rows with their `bucket`."""
        schema = T.StructType([*self.schema, T.StructField("bucket", T.IntegerType())])
        return self.spark.read.schema(schema).parquet(self.path) if self.folders() else self.spark.createDataFrame([], schema)

    def rows(self) -> DataFrame:
        return self.stored().drop("bucket")

    def picked(self, keys: Iterable[str] | DataFrame) -> DataFrame:
        """The rows of some values of the first key column. Few are named in the plan, so that only their folders and row
        groups are read; a table of keys (its first column) is joined."""
        if isinstance(keys, DataFrame):
            few = keys.limit(NAMED_KEYS + 1).collect()
            if len(few) > NAMED_KEYS:
                return self.rows().join(keys.toDF(self.key[0]).distinct(), self.key[0], "left_semi")
            keys = [r[0] for r in few]
        keys = sorted({k for k in keys if k is not None})
        folders = sorted({zlib.crc32(k.encode()) % self.buckets for k in keys})
        return self.stored().where(F.col("bucket").isin(folders) & F.col(self.key[0]).isin(keys)).drop("bucket")

    def value(self, prefix: str = "") -> Column:
        return F.struct(*[F.col(prefix + f.name) for f in self.schema if f.name not in self.key])

    def picked_value(self, value: Column | str) -> Column:
        return F.min(value) if self.least else F.max(value)

    def merge(self, rows: DataFrame) -> int:
        """Puts rows in, and tells how many folders were rewritten: those with rows that are new or better than the stored
        ones of their keys. Loading rows again changes nothing. A load that breaks off can be repeated; folders are
        swapped one by one, each as a whole. Rows with a null in their key are left out. The first rows of a table are
        shuffled once; later `rows` are read twice, first for the folders they go to."""
        key = list(self.key)
        typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]
        rows = rows.dropna(subset=key).select(*typed).withColumn("bucket", bucket_of(F.col(key[0]), self.buckets))
        if not self.folders():
            return len(self.put(rows, unique=False))
        held = self.stored().where(F.col("bucket").isin([r[0] for r in rows.select("bucket").distinct().collect()]))  # at most all folders
        no = F.lit(None).cast(T.StructType([f for f in self.schema if f.name not in key]))
        both = rows.select("bucket", *key, self.value().alias("new"), no.alias("old")).unionByName(held.select("bucket", *key, no.alias("new"), self.value().alias("old")))
        met = both.groupBy("bucket", *key).agg(self.picked_value("new").alias("new"), self.picked_value("old").alias("old"))
        better = F.col("new") < F.col("old") if self.least else F.col("new") > F.col("old")
        news = met.where(F.col("new").isNotNull() & (F.col("old").isNull() | better))
        news = scratch_table(news.select("bucket", *key, "new.*", F.col("old").isNotNull().alias("replaces")), "merge-news")
        touched = {r["bucket"]: r for r in news.groupBy("bucket").agg(F.count("*").alias("n"), F.max("replaces").alias("replaces")).collect()}
        if not touched:
            return 0
        kept = self.stored().where(F.col("bucket").isin(list(touched)))
        if any(r["replaces"] for r in touched.values()):
            kept = kept.join(news.where("replaces").select(*key), key, "left_anti")
        elif kept.count() <= ADDED * sum(r["n"] for r in touched.values()):
            return len(self.put(news, add=True))
        return len(self.put(kept.unionByName(news.drop("replaces"))))

    def put(self, rows: DataFrame, unique: bool = True, add: bool = False) -> list[int]:
        """Writes whole folders, or with `add` further files of folders, and names them. Rows are dealt to tasks by their
        full key, so that one value of its first column may have most rows; in the same shuffle one row is left of each
        key that is not `unique`. Folders are written aside, so `rows` may read those that they take the place of."""
        names, key = self.schema.names, list(self.key)
        dealt = rows.withColumn("deal", F.pmod(F.xxhash64(*key), F.lit(DEALS)).cast("int")).repartition("bucket", "deal")
        if not unique:
            dealt = dealt.groupBy("bucket", "deal", *key).agg(self.picked_value(self.value()).alias("v")).select("bucket", *key, "v.*")
        aside = f"{self.path}/_next-{uuid.uuid4().hex}"
        dealt.select(*names, "bucket").sortWithinPartitions("bucket", *key).write.partitionBy("bucket").parquet(aside)
        fs, path = self.files(), self.spark._jvm.org.apache.hadoop.fs.Path
        written = self.folders(aside)
        for bucket in written:
            source, target = path(f"{aside}/bucket={bucket}"), path(f"{self.path}/bucket={bucket}")
            if add and fs.exists(target):
                moves = [(f.getPath(), path(target, f.getPath().getName())) for f in fs.listStatus(source)]
            else:
                fs.delete(target, True)
                moves = [(source, target)]
            if not all(fs.rename(*move) for move in moves):
                raise OSError(f"{source} cannot be moved to {target}")
        fs.delete(path(aside), True)
        return written

    def remove(self, keys: DataFrame) -> None:
        """Takes rows out by their full keys, which are read twice."""
        key = list(self.key)
        gone = keys.select(*key).withColumn("bucket", bucket_of(F.col(key[0]), self.buckets))
        touched = [r[0] for r in gone.select("bucket").distinct().collect()]  # at most all folders
        held = self.put(self.stored().where(F.col("bucket").isin(touched)).join(gone.select(*key), key, "left_anti")) if touched else []
        for bucket in set(touched) - set(held):
            self.files().delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/bucket={bucket}"), True)


#: A table of either kind.
Rows = DataFrame | StoredTable


def picked(table: Rows, key: str, values: Iterable[str] | DataFrame) -> DataFrame:
    """Some rows of a table by key: of a few values, or of a table of them, which are named if they are few, so that nothing
    is shuffled for them."""
    if isinstance(table, StoredTable):
        return table.picked(values)
    if isinstance(values, DataFrame):
        few = values.limit(NAMED_KEYS + 1).collect()
        if len(few) > NAMED_KEYS:
            return table.join(values.toDF(key).distinct(), key, "left_semi")
        values = [r[0] for r in few]
    return table.where(F.col(key).isin(sorted({v for v in values if v is not None})))


def all_rows(table: Rows) -> DataFrame:
    return table.rows() if isinstance(table, StoredTable) else table
