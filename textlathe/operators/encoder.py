"""Texts to vectors without a model file: latent semantic analysis, by a randomised truncated singular value decomposition
of the TF-IDF matrix of the texts at hand. Terms are hashed to a fixed number of columns, so what tasks and driver hold is
bounded by that, however many texts there are."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import scratch_table, spread

COLUMNS = 1 << 13
TERM = re.compile(r"[^\W_]+")
#: Rows of a product that are summed as one piece, pieces that a task sums at once, and texts that are multiplied at once.
PIECE, FAN, TEXTS = 512, 64, 256

Sparse = tuple[np.ndarray, np.ndarray, np.ndarray]


def term_counts(texts: Iterable[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of each text its columns, rising, and how often each occurs. A term is hashed once for all of the texts."""
    seen: dict[str, int] = {}
    columns, counts = [], []
    for text in texts:
        found = [seen[t] if t in seen else seen.setdefault(t, zlib.crc32(t.encode("utf-8", "replace")) % COLUMNS) for t in TERM.findall((text or "").lower())]
        own, n = np.unique(np.array(found, np.int32), return_counts=True)
        columns.append(own)
        counts.append(n.astype(np.float32))
    return columns, counts


def weighted(columns: list[np.ndarray], counts: list[np.ndarray], idf: np.ndarray) -> Sparse:
    """The rows of the TF-IDF matrix: (1 + ln count) idf, of unit length."""
    sizes = np.array([len(c) for c in columns], int)
    row, col = np.repeat(np.arange(len(sizes)), sizes), np.concatenate([*columns, np.zeros(0, np.int32)])
    value = (1 + np.log(np.concatenate([*counts, np.zeros(0, np.float32)]))) * idf[col]
    length = np.sqrt(np.bincount(row, weights=value**2, minlength=len(sizes)))
    return row, col, value / np.maximum(length, 1e-300)[row]


def times(a: Sparse, n: int, right: np.ndarray) -> np.ndarray:
    row, col, value = a
    out = np.zeros((n, right.shape[1]))
    if len(row):
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        out[row[starts]] = np.add.reduceat(value[:, None] * right[col], starts)
    return out


def transposed_times(a: Sparse, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of A' left that are not zero, and which they are."""
    order = np.argsort(a[1], kind="stable")
    row, col, value = (x[order] for x in a)
    starts = np.flatnonzero(np.diff(col, prepend=-1))
    return col[starts], np.add.reduceat(value[:, None] * left[row], starts) if len(row) else np.zeros((0, left.shape[1]))


@dataclass(frozen=True)
class Encoder:
    """`directions` (a column each) are right singular vectors of the matrix, `strengths` its singular values, falling."""

    idf: np.ndarray
    directions: np.ndarray
    strengths: np.ndarray

    def __call__(self, texts: list[str]) -> np.ndarray:
        """Unit vectors; a text without terms that are known has zeros."""
        out = times(weighted(*term_counts(texts), self.idf), len(texts), self.directions)
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def summed(parts: DataFrame, width: int) -> np.ndarray:
    """The sum of matrices whose pieces (`part` long, `piece` int, `total` binary) tasks have made: FAN of them at a time,
    until there is one of each piece."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(b) for b in frame["total"]], axis=0)
        return pd.DataFrame({"part": [int(frame["part"].iloc[0])], "piece": frame["piece"].iloc[:1].to_numpy(), "total": [total.tobytes()]})

    while True:
        parts = scratch_table(parts.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("piece", "part").applyInPandas(run, "part long, piece int, total binary"), "encoder-sums")
        if not parts.where("part > 0").limit(1).count():
            break
    out = np.zeros((COLUMNS, width))
    for r in parts.collect():  # COLUMNS / PIECE rows
        out[r["piece"] * PIECE : (r["piece"] + 1) * PIECE] = np.frombuffer(r["total"]).reshape(-1, width)
    return out


def product(rows: DataFrame, idf: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A'(A right) of the matrix A of all texts: each task multiplies its rows, block by block, and adds up."""
    width = right.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, touched = np.zeros((COLUMNS, width)), np.zeros(COLUMNS // PIECE, bool)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                columns, counts = ([np.asarray(x, kind) for x in part.column(i).to_pylist()] for i, kind in ((0, np.int32), (1, np.float32)))
                a = weighted(columns, counts, idf)
                which, add = transposed_times(a, times(a, part.num_rows, right))
                total[which] += add
                touched[which // PIECE] = True
        some = np.flatnonzero(touched)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([total[p * PIECE : (p + 1) * PIECE].tobytes() for p in some], pa.binary())], names=["piece", "total"])

    parts = rows.select("columns", "counts").mapInArrow(run, "piece int, total binary")
    return summed(parts.select(F.spark_partition_id().cast("long").alias("part"), "piece", "total"), width)


def fit_encoder(df: DataFrame, text_col: str, dim: int = 64, *, more: int = 8, passes: int = 2, seed: int = 0) -> Encoder:
    """An encoder from all texts. `more` directions beyond `dim` and `passes` products before the last one make the
    leading directions good ones. Terms of the texts are counted once and stored; each product is one scan of that, and
    matrices of COLUMNS by `dim + more` are all that reaches the driver. Null texts have no terms; without any term all
    vectors are zero."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                columns, counts = term_counts(batch.column(0).slice(at, TEXTS).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(columns, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.float32()))], names=["columns", "counts"])

    rows = scratch_table(spread(df.select(F.col(text_col).alias("text"))).mapInArrow(counted, "columns array<int>, counts array<float>"), "encoder-terms")
    total = rows.count()
    spread_over = np.zeros(COLUMNS)
    for r in rows.select(F.explode("columns").alias("c")).groupBy("c").count().collect():  # at most COLUMNS rows
        spread_over[r["c"]] = r["count"]
    idf = np.log((1 + total) / (1 + spread_over)) + 1
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(COLUMNS, dim + more)))[0]
    for _ in range(passes):
        basis = np.linalg.qr(product(rows, idf, basis))[0]
    inner = basis.T @ product(rows, idf, basis)
    power, turn = np.linalg.eigh((inner + inner.T) / 2)
    best = np.argsort(-power)[:dim]
    strengths = np.sqrt(np.maximum(power[best], 0))
    known = strengths > 1e-9 * max(strengths.max(initial=0.0), 1e-300)
    return Encoder(idf, basis @ turn[:, best] * known, strengths)
