"""Tables laid out for lookups: clustered by key, with a narrow clustered table for each other column that is asked."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import exists

#: Bytes of a row group: what a lookup reads at least of a column whose pages have no narrower bounds.
GROUP_BYTES = 8 << 20
#: So many keys of a lookup are put into the filter of the scan; more are joined, by a broadcast up to MOST_SENT.
MOST_KEYS, MOST_SENT = 1000, 200_000


@dataclass(frozen=True)
class ClusteredTable:
    """A stored table and the column it is clustered by. `find` reads the row groups that can hold what is asked."""

    spark: SparkSession
    path: str
    key: str

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def find(self, column: str, values: Sequence[object]) -> DataFrame:
        """The rows that have one of some values in a column: the key, or one that the table was written with. Of an
        array, one of the elements. A null is no value, so a row with a null there is not found, nor is one with a null
        key by another column."""
        values = sorted({v for v in values if v is not None})
        if column == self.key:
            return self.rows().where(F.col(column).isin(*values) if values else F.lit(False))
        path = f"{self.path}/by-{column}"
        if not exists(self.spark, path):
            raise ValueError(f"the table was not written to be asked by {column}")
        keys = self.spark.read.parquet(path).where(F.col("value").isin(*values) if values else F.lit(False)).select(F.col("key").alias(self.key)).distinct()
        few = [r[0] for r in keys.limit(MOST_KEYS + 1).collect()]  # bounded
        rows = self.rows()
        array = isinstance(rows.schema[column].dataType, T.ArrayType)
        asked = F.exists(column, lambda x: x.isin(*values)) if array and values else F.col(column).isin(*values) if values else F.lit(False)
        if len(few) <= MOST_KEYS:
            return rows.where((F.col(self.key).isin(*few) if few else F.lit(False)) & asked)
        # a key may have many rows, and most keys the value: then all is read, without a shuffle of the rows by the key
        keys = F.broadcast(keys) if keys.limit(MOST_SENT + 1).count() <= MOST_SENT else None
        return (rows.where(F.col(self.key).isNotNull()) if keys is None else rows.join(keys, self.key, "left_semi")).where(asked)


def write_clustered(df: DataFrame, path: str, key: str, columns: Sequence[str] = (), *, group_bytes: int = GROUP_BYTES) -> ClusteredTable:
    """Writes `df` in the order of `key`, and for each of `columns` the distinct pairs `value, key` in the order of the
    value; elements count as values of an array. Ranges are cut by both, so a value that very many rows have lies in
    many files. Bloom filters on keys tell groups apart whose bounds do not. Rows with a null key stay in the table.
    A write that broke off is repeated as a whole."""
    ties = [F.xxhash64(*[c for c in df.columns if not isinstance(df.schema[c].dataType, T.MapType)])]
    clustered(df, [F.col(key), *ties], f"{path}/rows", key, group_bytes)
    stored = df.sparkSession.read.parquet(f"{path}/rows")
    for column in columns:
        value = F.explode(column) if isinstance(df.schema[column].dataType, T.ArrayType) else F.col(column)
        pairs = stored.select(value.alias("value"), F.col(key).alias("key")).dropna().distinct()
        clustered(pairs, [F.col("value"), F.col("key")], f"{path}/by-{column}", "value", group_bytes)
    return ClusteredTable(df.sparkSession, path, key)


def clustered(df: DataFrame, order: list, path: str, bloom: str, group_bytes: int) -> None:
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.write.mode("overwrite").option("parquet.block.size", group_bytes).option(f"parquet.bloom.filter.enabled#{bloom}", "true").option("parquet.bloom.filter.adaptive.enabled", "true").parquet(path)
