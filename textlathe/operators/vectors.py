"""A stored index of vectors: cells around centroids found by k-means, a folder for each cell, and a byte a dimension for
what a vector differs from its centroid. A search by cosine reads the bytes of some cells, and of the vectors that may be
among the best, by bounds on what the bytes leave open, the numbers themselves."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import scratch_path, scratch_table, spread, write_parquet

#: Rows that centroids are fitted on for each cell; bytes that all centroids have at most, as every task holds them.
FIT_ROWS, CENTROID_BYTES = 64, 1 << 26
#: Sampled queries, and neighbours of each, by which it is measured how many cells hold the wanted share of neighbours.
TRIALS, TRIAL_TOP, WANTED = 64, 10, 0.97
#: Up to this many candidates are named in a plan; more are joined.
NAMED = 1000
SLACK = 1e-6


def units(column: pa.Array) -> np.ndarray:
    """The vectors of an Arrow column by their lengths; zero vectors stay."""
    v = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def nearest_cell(v: np.ndarray, centroids: np.ndarray, block: int = 4096) -> np.ndarray:
    half = (centroids**2).sum(axis=1) / 2
    return np.concatenate([np.argmax(v[at : at + block] @ centroids.T - half, axis=1) for at in range(0, len(v), block)] or [np.zeros(0, int)])


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession = field(repr=False)
    path: str
    id_type: str
    probes: int

    def rows(self) -> DataFrame:
        return self.spark.read.schema(f"id {self.id_type}, embedding array<float>, code binary, step double, cell int").parquet(f"{self.path}/vectors")

    @cached_property
    def cells(self) -> pd.DataFrame:
        """`cell, n, radius, centroid` of the cells that hold vectors: one row each, as many as there are folders."""
        return self.spark.read.parquet(f"{self.path}/cells").toPandas().sort_values("cell", ignore_index=True)


def fitted(sample: DataFrame, centroids: np.ndarray, rounds: int) -> np.ndarray:
    """Lloyd's rounds over a stored sample: each task adds up its vectors by cell, Spark adds up the tasks. A cell that
    loses all its vectors keeps its centroid."""
    d = centroids.shape[1]

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(b) for b in frame["total"]], axis=0)
        return pd.DataFrame({"cell": frame["cell"].iloc[:1], "n": [int(frame["n"].sum())], "total": [total.tobytes()]})

    for _ in range(rounds):
        now = centroids

        def sums(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            n, total = np.zeros(len(now), int), np.zeros((len(now), d))
            for batch in batches:
                v = units(batch.column(0))
                cell = nearest_cell(v, now)
                n += np.bincount(cell, minlength=len(now))
                np.add.at(total, cell, v)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some], pa.int64()), pa.array([total[i].tobytes() for i in some], pa.binary())], names=["cell", "n", "total"])

        schema = "cell int, n long, total binary"
        found = sample.select("embedding").mapInArrow(sums, schema).groupBy("cell").applyInPandas(added, schema).collect()  # a row a cell
        centroids = now.copy()
        for r in found:
            centroids[r["cell"]] = np.frombuffer(r["total"]) / r["n"]
    return centroids


def build_vector_index(vectors: DataFrame, id_col: str, vector_col: str, path: str | None = None, *, cells: int | None = None, rounds: int = 6) -> VectorIndex:
    """Writes the index of all vectors that are not null; all have one length. Cells are about the square root of the
    number of vectors. Centroids are fitted on FIT_ROWS vectors a cell, by the hash of their ids; every vector is put into
    a cell. Vectors are shuffled once; a cell with very many is written by several tasks."""
    spark, kind = vectors.sparkSession, vectors.schema[id_col].dataType.simpleString()
    path = path or scratch_path(spark, "vector-index")
    base = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("embedding"))
    n = base.count()
    if not n:
        write_parquet(spark.createDataFrame([], f"id {kind}, embedding array<float>, code binary, step double, cell int"), f"{path}/vectors", partition_by=["cell"])
        write_parquet(spark.createDataFrame([], "cell int, n long, radius double, centroid array<double>"), f"{path}/cells")
        return stored(spark, path, kind, 0)
    d = len(base.first()["embedding"])
    k = min(n, cells or max(1, min(round(math.sqrt(n)), CENTROID_BYTES // (8 * d))))
    draw = F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(1 << 30)) / float(1 << 30)
    sample = scratch_table(base.where(draw < min(1.0, FIT_ROWS * k / n)), "fit-vectors")
    first = sample.orderBy(F.xxhash64("id"), "id").limit(k).collect()  # centroids to begin with
    start = units(pa.array([r["embedding"] for r in first], pa.list_(pa.float64()))) if first else np.zeros((1, d))
    centroids = fitted(sample, start, rounds)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = units(batch.column(1))
            cell = nearest_cell(v, centroids)
            rest = v - centroids[cell]
            step = np.maximum(np.abs(rest).max(axis=1), 1e-30) / 127
            code = np.rint(rest / step[:, None]).astype(np.int8)
            far = np.linalg.norm(rest, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(step), pa.array(cell, pa.int32()), pa.array(far)], names=["id", "embedding", "code", "step", "cell", "far"])

    rows = spread(base).mapInArrow(coded, f"id {kind}, embedding array<float>, code binary, step double, cell int, far double")
    dealt = rows.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(1 + n // (k * 100_000)))).sortWithinPartitions("cell", "id")
    written = write_parquet(dealt, f"{path}/vectors", partition_by=["cell"])
    held = {r["cell"]: r for r in written.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()}
    write_parquet(spark.createDataFrame([(c, r["n"], r["radius"], centroids[c].tolist()) for c, r in sorted(held.items())], "cell int, n long, radius double, centroid array<double>").coalesce(1), f"{path}/cells")
    index = VectorIndex(spark, path, kind, 0)
    return stored(spark, path, kind, needed_probes(index, sample))


def stored(spark: SparkSession, path: str, kind: str, probes: int) -> VectorIndex:
    write_parquet(spark.createDataFrame([(kind, probes)], "id_type string, probes int").coalesce(1), f"{path}/stats")
    return open_vector_index(spark, path)


def open_vector_index(spark: SparkSession, path: str) -> VectorIndex:
    return VectorIndex(spark, path, *spark.read.parquet(f"{path}/stats").first())


def needed_probes(index: VectorIndex, sample: DataFrame) -> int:
    """How many cells, nearest centroids first, hold the share WANTED of the true neighbours of TRIALS sampled vectors,
    which one pass over all vectors finds."""
    trials = sample.orderBy(F.xxhash64(F.lit(9), "id"), "id").limit(TRIALS).collect()
    ids, q = [r["id"] for r in trials], units(pa.array([r["embedding"] for r in trials], pa.list_(pa.float64())))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = units(batch.column(1)) @ q.T
            for t, own in enumerate(ids):
                score[np.asarray([i == own for i in batch.column(0).to_pylist()]), t] = -2
            top = np.argsort(-score, axis=0)[:TRIAL_TOP]
            cell = np.asarray(batch.column(2))
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(len(q)), len(top)), pa.int32()), pa.array(np.take_along_axis(score, top, axis=0).ravel()), pa.array(cell[top].ravel(), pa.int32())], names=["trial", "score", "cell"])

    found = index.rows().select("id", "embedding", "cell").mapInArrow(best, "trial int, score double, cell int")
    top = found.groupBy("trial").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "cell")), False), 1, TRIAL_TOP).alias("top"))
    order = {c: i for i, c in enumerate(index.cells["cell"])}
    ranks = np.argsort(np.argsort(-(np.stack(index.cells["centroid"]) @ q.T), axis=0), axis=0)
    at = sorted(int(ranks[order[x["cell"]], r["trial"]]) for r in top.collect() for x in r["top"] if x["score"] > -2)
    return at[min(len(at) - 1, math.ceil(WANTED * len(at)))] + 1 if at else 1


def scored(index: VectorIndex, q: np.ndarray, cells: list[int], top_k: int) -> list[tuple[float, object]]:
    """The `top_k` best `(score, id)` of some cells, exact: bytes bound the scores, and the numbers decide."""
    table = index.cells.set_index("cell")
    dots = {c: float(q @ table.at[c, "centroid"]) for c in cells}
    reach = float(np.abs(q).sum()) / 2

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int8).reshape(batch.num_rows, -1)
            step, base = np.asarray(batch.column(2)), np.array([dots[c] for c in batch.column(3).to_pylist()])
            about = base + step * (code @ q)
            low, high = about - step * reach - SLACK, about + step * reach + SLACK
            kept = high >= (np.partition(low, -top_k)[-top_k] if len(low) > top_k else -np.inf)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(kept)), pa.array(low[kept]), pa.array(high[kept])], names=["id", "low", "high"])

    rows = index.rows().where(F.col("cell").isin(cells))
    near = scratch_table(rows.select("id", "code", "step", "cell").mapInArrow(bounds, f"id {index.id_type}, low double, high double"), "vector-bounds")
    least = near.orderBy(F.desc("low")).limit(top_k).agg(F.min("low"), F.count("*")).first()
    near = near.where(F.col("high") >= least[0]) if least[1] == top_k else near
    few = near.select("id").limit(NAMED + 1).collect()
    chosen = rows.where(F.col("id").isin([r["id"] for r in few])) if len(few) <= NAMED else rows.join(near.select("id").distinct(), "id", "left_semi")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(units(batch.column(1)) @ q)], names=["id", "score"])

    best = chosen.select("id", "embedding").mapInArrow(exact, f"id {index.id_type}, score double")
    return [(r["score"], r["id"]) for r in best.orderBy(F.desc("score"), "id").limit(top_k).collect()]


def index_search(index: VectorIndex, query: list[float], top_k: int = 5, *, exact: bool = False, probes: int | None = None) -> DataFrame:
    """`id, score` of the vectors nearest to a query by cosine, ties to the smaller id.

    Without `exact` the cells with the nearest centroids are searched, as many as the index measured (or `probes`). With
    it cells are searched, more at a time, until no other one can hold a nearer vector, as a cell's centroid and radius
    tell. Zero vectors score 0.
    """
    q = np.asarray(query, float)
    q = q / max(float(np.linalg.norm(q)), 1e-300)
    cells = index.cells
    schema = f"id {index.id_type}, score double"
    if cells.empty or top_k <= 0:
        return index.spark.createDataFrame([], schema)
    dots = np.stack(cells["centroid"]) @ q
    if exact:
        bound = dots + cells["radius"].to_numpy() + SLACK
        order, at, size, best = np.argsort(-bound, kind="stable"), 0, max(1, index.probes), []
        while at < len(order) and (len(best) < top_k or bound[order[at]] >= best[-1][0]):
            found = scored(index, q, cells["cell"].to_numpy()[order[at : at + size]].tolist(), top_k)
            best = sorted([*best, *found], key=lambda x: (-x[0], x[1]))[:top_k]
            at, size = at + size, 2 * size
    else:
        chosen = np.argsort(-dots, kind="stable")[: probes or index.probes]
        best = scored(index, q, cells["cell"].to_numpy()[chosen].tolist(), top_k)
    return index.spark.createDataFrame([(i, float(s)) for s, i in best], schema).orderBy(F.desc("score"), "id")
