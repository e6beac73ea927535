"""A graph that is stored and merged into."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import rel_type
from ..sources.tables import exists, scratch_table
from .graph import CHUNK_COLUMNS, METADATA_COLUMNS, both_ways, content_as_chunks, id_column, normalize_chunks, require_columns
from .stored import StoredTable


class GraphStore:
    """Documents, chunks, and edges between documents in a folder. Edges that wait for a document at one end are kept
    aside and come in with it, so that several loads in any order give what one gives. Relations are noted by a load and
    settled, those of all loads since at once, when `edges`, `steps` or `waiting` are asked for."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        texts = lambda names: T.StructType([T.StructField(c, T.StringType()) for c in names])
        chunk = T.StructType([T.StructField(c, {"chunk_index": T.LongType(), "part_index": T.LongType(), "articles": T.ArrayType(T.StringType())}.get(c, T.StringType())) for c in CHUNK_COLUMNS])
        made = lambda name, schema, key, least=False: StoredTable(spark, f"{path}/{name}", with_order(schema, key), key, buckets, least)
        self.spark, self.path, self.buckets = spark, path, buckets
        self.documents = made("documents", texts(METADATA_COLUMNS), ("id",))
        self._edges = made("edges", texts("src rel_type dst raw_label".split()), ("src", "rel_type", "dst"))
        self._waiting = made("waiting", texts("src rel_type dst raw_label".split()), ("src", "rel_type", "dst"))
        self.chunks = made("chunks", chunk, ("chunk_id",))
        self._steps = StoredTable(spark, f"{path}/steps", texts("a b rel_type".split()), ("a", "b"), buckets, least=True)

    def load(self, metadata: DataFrame | None = None, relationships: DataFrame | None = None, chunks: DataFrame | None = None, content: DataFrame | None = None, order: str | None = None) -> dict[str, int]:
        """Merges tables into the stored ones, and tells how many folders of each were rewritten, and under
        `relations` whether they are new (0 or 1; such a table is read twice). Of rows with one key the last by the column
        `order` (a number) counts, of equals in it the greatest by all columns."""
        at = lambda df: F.col(order).cast("double") if order else F.lit(None).cast("double")
        done = {}
        if metadata is not None:
            named = lambda c: F.col(c).cast("string") if c in metadata.columns else F.lit(None).cast("string")
            rows = metadata.withColumn("id", id_column(metadata, "id")).where("id IS NOT NULL")
            came = exists(self.spark, f"{self.path}/unsettled")
            self.files.mkdirs(self.at("unsettled"))  # before the merge, which may break off
            done["documents"] = self.documents.merge(rows.select(at(rows).alias("at_"), *[named(c).alias(c) for c in METADATA_COLUMNS]))
            if not (came or done["documents"]):
                self.files.delete(self.at("unsettled"), True)
        if chunks is not None or content is not None:
            rows = normalize_chunks(require_columns(chunks, CHUNK_COLUMNS).withColumn("at_", at(chunks)), keep=("at_",)) if chunks is not None else content_as_chunks(content).withColumn("at_", F.lit(None).cast("double"))
            done["chunks"] = self.chunks.merge(rows)
        if relationships is not None:
            r = relationships
            new = r.select(id_column(r, "doc_id").alias("src"), id_column(r, "other_doc_id").alias("dst"), at(r).alias("at_"), F.col("relationship").alias("raw_label")).where("src IS NOT NULL AND dst IS NOT NULL")
            done["relations"] = self.note(new)
        return done

    def note(self, relations: DataFrame) -> int:
        """Keeps relations for `settle`, unless the same rows were loaded before: merging them again would change nothing,
        as stored rows only ever give way to better ones."""
        n, said = digest(relations)
        if not n or exists(self.spark, f"{self.path}/loaded/{said}") or exists(self.spark, f"{self.path}/noted/{said}/_SUCCESS"):
            return 0
        relations.write.mode("overwrite").parquet(f"{self.path}/noted/{said}")
        return 1

    def settle(self) -> None:
        """Brings noted relations, and waiting ones if documents have come, to the edges and steps if both of their ends
        are there, and else to those that wait. One that breaks off is repeated."""
        noted = [n for n in self.names("noted") if exists(self.spark, f"{self.path}/noted/{n}/_SUCCESS")]
        came = exists(self.spark, f"{self.path}/unsettled")
        plain = T.StructType([f for f in self._edges.schema if f.name != "rel_type"])  # the type follows from the label
        rows = [self.spark.read.schema(plain).parquet(*[f"{self.path}/noted/{n}" for n in noted]).select(*plain.names, F.lit(False).alias("waits"))] if noted else []
        if came and self._waiting.folders():
            rows.append(self._waiting.rows().select(*plain.names, F.lit(True).alias("waits")))
        if rows:
            end = lambda c: self.documents.rows().select(F.col("id").alias(c), F.lit(True).alias("known"))
            met = lambda df, c: df.join(end(c), c, "left").withColumn("known", F.col("known").isNotNull())
            typed = lambda df: df.withColumn("rel_type", rel_type(F.col("raw_label")))
            sources = scratch_table(met(reduce(DataFrame.unionByName, rows), "src"), "settled")
            ends = scratch_table(typed(met(sources.where("known").drop("known"), "dst")), "settled")
            known = ends.where("known")
            self._edges.merge(known)
            self._steps.merge(both_ways(known))
            self._waiting.merge(typed(sources.where("NOT known")).unionByName(ends.where("NOT known")).where("NOT waits"))
            if came:
                self._waiting.remove(known.where("waits"))
        for name in noted:
            self.files.mkdirs(self.at(f"loaded/{name}"))
            self.files.delete(self.at(f"noted/{name}"), True)
        if came:
            self.files.delete(self.at("unsettled"), True)

    @property
    def edges(self) -> StoredTable:
        self.settle()
        return self._edges

    @property
    def steps(self) -> StoredTable:
        self.settle()
        return self._steps

    @property
    def waiting(self) -> StoredTable:
        self.settle()
        return self._waiting

    @property
    def files(self):
        return self.at("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def names(self, folder: str) -> list[str]:
        return sorted(f.getPath().getName() for f in self.files.listStatus(self.at(folder))) if self.files.exists(self.at(folder)) else []

    def part_of(self) -> DataFrame:
        """`chunk_id, doc_id` of the chunks whose document is stored."""
        return self.chunks.rows().join(self.documents.rows().select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select("chunk_id", "doc_id")


def with_order(schema: T.StructType, key: tuple[str, ...]) -> T.StructType:
    """The columns of a stored table: its key, `at_` by which rows are ordered first, and the others."""
    return T.StructType([*(schema[k] for k in key), T.StructField("at_", T.DoubleType()), *(f for f in schema if f.name not in key)])


def digest(rows: DataFrame) -> tuple[int, str]:
    """How many rows a table has, and a name that is the same for the same rows in any order: of three sums of hashes."""
    values = [x for c in rows.columns for x in (F.col(c), F.col(c).isNull())]
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), *values).cast("decimal(38, 0)"))
    n, *sums = rows.agg(F.count("*"), *[total(seed).alias(f"h{seed}") for seed in range(3)]).first()
    return n, hashlib.sha256(f"{rows.columns} {n} {sums}".encode()).hexdigest()
