"""Whitening of embeddings: a singular value decomposition of all distinct vectors without their covariance matrix.

The centred rows are never squared: blocks of them are reduced to triangles by QR, triangles are stacked and reduced again
until one is left (TSQR), and plane rotations from the right make the columns of that triangle orthogonal (one-sided
Jacobi). Their lengths are the standard deviations, small ones as exact as large ones, and the rotations together are the
components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

# Fixed values of the contract: how an entry becomes a whole number.
SCALE, OFFSET = 64, 1_000_000
#: Entries beyond this are taken for it, so that they fit a long.
LARGEST = 2**61
#: How many bytes of triangles one task stacks; of two at least.
STACK_BYTES = 1 << 26
#: A component whose deviation is less than this share of the greatest, for each dimension, has no variance.
NO_SPREAD = 1e-15


def whole_numbers(vector: Column) -> Column:
    """floor(64 c) + 1000000 of each entry."""
    limited = lambda c: F.greatest(F.least(SCALE * c.cast("double"), F.lit(float(LARGEST))), F.lit(-float(LARGEST)))
    return F.transform(vector, lambda c: F.floor(limited(c)).cast("long") + F.lit(OFFSET).cast("long"))


def usable(vector: Column) -> Column:
    """Whether a vector is there with entries that all are finite numbers."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    return F.coalesce(F.forall(vector, finite) & (F.size(vector) > 0), F.lit(False))


def matrix(column: pa.Array, d: int, kind: type = np.int64) -> np.ndarray:
    """The lists of an Arrow column, all of length `d`, as rows."""
    return np.asarray(column.flatten(), kind).reshape(-1, d)


def tree_reduced(parts: DataFrame, stacked: Callable[[np.ndarray], np.ndarray], d: int) -> np.ndarray | None:
    """Triangles (`part` long, `rows` binary: `d` columns of doubles) stacked and reduced in groups of bounded size until
    few are left, and these here; None if there are none. Groups are neighbours by number, of `fan` at most."""
    fan = max(2, STACK_BYTES // (8 * d * d))
    parts = written(parts, "triangles")
    n = parts.count()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = np.concatenate([np.frombuffer(b).reshape(-1, d) for b in frame["rows"]])
        return pd.DataFrame({"part": [int(frame["part"].min())], "rows": [stacked(rows).tobytes()]})

    while n > fan:
        parts = parts.withColumn("part", F.floor(F.col("part") / fan))
        parts = written(parts.groupBy("part").applyInPandas(run, "part long, rows binary"), "triangles")
        n = parts.count()
    rest = sorted(parts.collect(), key=lambda r: r["part"])  # at most `fan` triangles
    return stacked(np.concatenate([np.frombuffer(r["rows"]).reshape(-1, d) for r in rest])) if rest else None


def triangle(rows: np.ndarray) -> np.ndarray:
    """The upper triangle of a QR decomposition; fewer rows than columns stay as they are."""
    return np.ascontiguousarray(np.linalg.qr(rows, mode="r")) if len(rows) > rows.shape[1] else rows


def rounds_of_pairs(d: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of columns in rounds of disjoint ones: each column meets every other one once (a round-robin)."""
    size = d + d % 2
    seats, out = list(range(size)), []
    for _ in range(size - 1):
        pairs = [(min(a, b), max(a, b)) for a, b in zip(seats[: size // 2], seats[::-1]) if max(a, b) < d]
        out.append((np.array([p for p, _ in pairs], int), np.array([q for _, q in pairs], int)))
        seats = [seats[0], seats[-1], *seats[1:-1]]
    return out


def jacobi(r: np.ndarray, sweeps: int = 60, tolerance: float = 1e-15) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of the orthogonalised columns of `r`, falling, and the rotations together (columns: right singular
    vectors). A sweep turns each pair of columns in its plane until they are orthogonal; disjoint pairs turn at once."""
    a, d = np.array(r, float), r.shape[1]
    if len(a) > d:
        a = triangle(a)
    v, rounds = np.eye(d), rounds_of_pairs(d)
    for _ in range(sweeps):
        worst = 0.0
        for p, q in rounds:
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            turn = np.abs(xy) > tolerance * np.sqrt(xx * yy)
            if not turn.any():
                continue
            p, q, x, y, xx, yy, xy = p[turn], q[turn], x[:, turn], y[:, turn], xx[turn], yy[turn], xy[turn]
            worst = max(worst, float(np.max(np.abs(xy) / np.sqrt(xx * yy))))
            half = (yy - xx) / (2 * xy)
            t = np.where(half >= 0, 1.0, -1.0) / (np.abs(half) + np.hypot(1.0, half))
            c = 1 / np.hypot(1.0, t)
            s = c * t
            a[:, p], a[:, q] = c * x - s * y, s * x + c * y
            vp, vq = v[:, p], v[:, q]
            v[:, p], v[:, q] = c * vp - s * vq, s * vp + c * vq
        if worst <= 1e-14:
            break
    lengths = np.sqrt((a * a).sum(axis=0))
    order = np.argsort(-lengths, kind="stable")
    return lengths[order], v[:, order]


class Whitening:
    """What is known of the fit list: `n` vectors, their exact sums, and of each component its direction (a column),
    its standard deviation and its share of all variance."""

    def __init__(self, n: int, sums: list[int], lengths: np.ndarray, directions: np.ndarray, components: int) -> None:
        self.n, self.sums, self.d = n, sums, len(sums)
        #: The mean as a whole number and the rest over n, so that centring loses nothing.
        self.base = [s // n for s in sums]
        self.rest = np.array([(s - b * n) / n for s, b in zip(sums, self.base)])
        k = min(components, self.d)
        self.deviations, self.directions = lengths[:k] / np.sqrt(n), directions[:, :k]
        total = float((lengths**2).sum())
        self.explained = lengths[:k] ** 2 / total if total > 0 else np.zeros(k)
        self.spread = lengths[:k] > NO_SPREAD * self.d * lengths.max(initial=0.0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n; the whole part is taken off as whole numbers."""
        return (x - np.array(self.base, np.int64)) - self.rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """NaN for components without variance."""
        scale = np.where(self.spread, self.deviations, np.nan)
        return (self.centred(x) @ self.directions) / scale

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n x - S)^2, exact; None where it does not fit a long."""
        base = np.array(self.base, np.int64)
        left = np.array([s - b * self.n for s, b in zip(self.sums, self.base)], object)  # from 0 to n - 1
        reach = max((max(abs(int(x[:, j].max()) - self.base[j]), abs(int(x[:, j].min()) - self.base[j])) for j in range(self.d)), default=0) if len(x) else 0
        if self.d * (self.n * (reach + 1)) ** 2 < 2**63:
            off = (x - base) * self.n - left.astype(np.int64)
            return (off * off).sum(axis=1).tolist()
        near = ((((x - base) * float(self.n)) - left.astype(float)) ** 2).sum(axis=1) < 1.001 * 2**63  # the others need no exact sum
        exact = [sum(((v - b) * self.n - r) ** 2 for v, b, r in zip(row, self.base, left)) if fits else 2**63 for row, fits in zip(x.tolist(), near)]
        return [e if e < 2**63 else None for e in exact]


def exact_sums(distinct: DataFrame, d: int) -> tuple[int, list[int]]:
    """How many vectors (`x`) there are, and the exact sum of each dimension. Each task adds up its own; what is left, a
    row a task, is added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * d
        for batch in batches:
            x = matrix(batch.column(0), d)
            n += len(x)
            for half, weight in ((x >> 31, 1 << 31), (x & (2**31 - 1), 1)):  # halves cannot overflow
                sums = [s + weight * int(h) for s, h in zip(sums, half.sum(axis=0))]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([[str(s) for s in sums]])], names=["n", "sums"])

    parts = distinct.select("x").mapInArrow(run, "n long, sums array<string>")
    places = parts.select("n", F.posexplode("sums").alias("j", "s")).groupBy("j").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found = sorted(places.collect(), key=lambda r: r["j"])  # one row a dimension
    return (found[0]["n"], [int(r["s"]) for r in found]) if found else (0, [])


def fit(distinct: DataFrame, d: int, components: int) -> Whitening | None:
    """The decomposition of all vectors (`x`) of a table of distinct ones; None if there is none."""
    n, sums = exact_sums(distinct, d)
    if not n:
        return None
    blank = Whitening(n, sums, np.zeros(d), np.eye(d), components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, d))
        for batch in batches:
            held = triangle(np.concatenate([held, blank.centred(matrix(batch.column(0), d))]))
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(held).tobytes()], pa.binary())], names=["rows"])

    parts = distinct.select("x").mapInArrow(run, "rows binary").select(F.spark_partition_id().cast("long").alias("part"), "rows")
    r = tree_reduced(parts, triangle, d)
    if len(r) < d:
        r = np.concatenate([r, np.zeros((d - len(r), d))])
    lengths, directions = jacobi(r)
    return Whitening(n, sums, lengths, directions, components)


def identity_error(distinct: DataFrame, model: Whitening) -> float | None:
    """The largest absolute entry of the covariance of the whitened fit list less the identity, over the components with
    variance; None if there are none. Whitened vectors are centred already; the rest of their means is taken off too."""
    k = int(model.spread.sum())
    if not k:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, square = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = model.whitened(matrix(batch.column(0), model.d))[:, model.spread]
            total += w.sum(axis=0)
            square += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([total, square.ravel()]).tolist()], pa.list_(pa.float64()))], names=["sums"])

    parts = distinct.select("x").mapInArrow(run, "sums array<double>")
    found = sorted(parts.select(F.posexplode("sums").alias("j", "s")).groupBy("j").agg(F.sum("s").alias("s")).collect(), key=lambda r: r["j"])  # k + k * k rows
    sums = np.array([r["s"] for r in found]) / model.n
    covariance = sums[k:].reshape(k, k) - np.outer(sums[:k], sums[:k])
    return float(np.abs(covariance - np.eye(k)).max())


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16) -> DataFrame:
    """`vec_id, component, n, deviation, whitened, explained, identity_error` of each row with a vector and each of the
    first components, numbered from 1.

    Vectors that are null or empty or hold null or non-finite entries are left out, and so are those of another length
    than most have (of equally frequent lengths the greatest counts). Each distinct vector of whole numbers is in the fit
    list once, however many rows have it. Entries beyond 2**55 count as 2**55. A component without variance has
    null as `whitened` and is left out of `identity_error`, which is null if none has any; `deviation` is null where it
    does not fit a long. Repeated rows give repeated results, an empty table none; other columns are not read.

    Rows are shuffled once, to find the distinct vectors, equal ones after they have been reduced to one in each task.
    Triangles of d x d, one a task, are reduced in a tree; the last one, its rotations and d sums come to the driver.
    """
    read = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")).where(usable(F.col("v")))
    rows = read.select("vec_id", whole_numbers(F.col("v")).alias("x"))
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    d = lengths[0]["d"] if lengths else 1
    rows = rows.where(F.size("x") == d)
    distinct = written(rows.select("x").distinct(), "whitening-fit")
    model = fit(distinct, d, components)
    kind = vectors.schema[id_col].dataType.simpleString()
    if model is None:
        return rows.selectExpr("vec_id", "1 AS component", "0L AS n", "0L AS deviation", "0D AS whitened", "0D AS explained", "0D AS identity_error").limit(0)
    error, share = identity_error(distinct, model), [float(e) for e in model.explained]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), d)
            values = pa.array(model.whitened(x).ravel(), pa.float64(), from_pandas=True)  # NaN becomes null
            ends = pa.array(np.arange(len(x) + 1) * len(share), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.deviation(x), pa.int64()), pa.ListArray.from_arrays(ends, values)], names=["vec_id", "deviation", "w"])

    made = rows.mapInArrow(run, f"vec_id {kind}, deviation long, w array<double>").select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    explained = F.element_at(F.array(*map(F.lit, share)), F.col("at") + 1)
    return made.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).cast("double").alias("identity_error"))
