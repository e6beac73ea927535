"""Approximate nearest neighbours: concatenated cross-polytope hashes with multiprobe tables, and exact reranking.

A vector's cell in a table is the nearest signed axis after each of some pseudo-random rotations. How many axes are told
apart follows from the number of vectors, so that a cell holds about the same number of them however many there are. How
many cells a query asks follows from a sample of queries, whose true neighbours are found by comparing them with all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: A group of cells that one call searches has about so many vectors; small tables are dealt to so many groups.
GROUP_ROWS, LEAST_GROUPS = 32_768, 12
#: A cell of more vectors is cut into blocks; with so many blocks at most that are no whole cells.
BLOCK_ROWS, MOST_BLOCKS = 4096, 100_000
#: Vectors of one band differ in length by no more than this factor; shorter ones than those of so many bands share one.
BAND_RATIO, MOST_BANDS = 1.2, 16


def signs(tables: int, hashes: int, width: int, seed: int) -> np.ndarray:
    """Three diagonals of random signs for each rotation of each table."""
    return np.random.default_rng(seed).choice([-1.0, 1.0], (tables, max(1, hashes), 3, width))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of the rows, scaled to keep lengths."""
    n, half = x.shape[1], 1
    while half < n:
        pairs = x.reshape(len(x), n // (2 * half), 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), n)
        half *= 2
    return x / np.sqrt(n)


def axes(x: np.ndarray, diagonals: np.ndarray, kept: int) -> np.ndarray:
    """How far each row reaches along the signed axes, of the first `kept` axes, after a rotation."""
    for diagonal in diagonals:
        x = hadamard(x * diagonal)
    return np.concatenate([-x[:, :kept], x[:, :kept]], axis=1)


def hash_widths(n: int, width: int, cell_rows: int) -> tuple[int, ...]:
    """How many axes each hash of a table tells apart, for about `cell_rows` of `n` vectors in a cell: all of them, and
    of the last hash as many as are needed."""
    out, cells = [], n / cell_rows
    while cells > 1.5:
        kept = min(width, max(1, 1 << max(0, round(np.log2(cells / 2)))))
        out.append(kept)
        cells /= 2 * kept
    return tuple(out)


@dataclass(frozen=True)
class Band:
    """Vectors of similar lengths, the greatest of them, and the numbers of their cells from `first` on."""

    number: int
    rows: int
    longest: float
    lift: bool
    widths: tuple[int, ...]
    first: int

    @property
    def cells(self) -> int:
        return int(np.prod([2 * w for w in self.widths], dtype=np.int64)) if self.widths else 1


@dataclass(frozen=True)
class Plan:
    """All that tasks need to place vectors and queries; as large as the bands and the blocks."""

    width: int
    tables: int
    bands: tuple[Band, ...]
    diagonals: np.ndarray

    def padded(self, v: np.ndarray, band: Band, stored: bool) -> np.ndarray:
        """Stored vectors get one more coordinate where lengths differ, so that all are as long as the longest of the
        band and inner products are told by angles."""
        out = np.zeros((len(v), self.width))
        length = np.maximum(np.linalg.norm(v, axis=1, keepdims=True), np.finfo(float).tiny)
        out[:, : v.shape[1]] = v / (band.longest if stored and band.lift else length)
        if stored and band.lift:
            out[:, v.shape[1]] = np.sqrt(np.maximum(0, 1 - (out[:, : v.shape[1]] ** 2).sum(axis=1)))
        return out

    def cells_of(self, v: np.ndarray, band: Band) -> np.ndarray:
        """Of stored vectors, the cell in each table."""
        x, out = self.padded(v, band, True), np.zeros((len(v), self.tables), np.int64)
        for t in range(self.tables):
            for h, kept in enumerate(band.widths):
                out[:, t] = out[:, t] * 2 * kept + axes(x, self.diagonals[t, h], kept).argmax(axis=1)
            out[:, t] += band.first + t * band.cells
        return out

    def probes_of(self, v: np.ndarray, band: Band, table: int, probes: int) -> np.ndarray:
        """Of queries, the `probes` cells of a table whose axes they miss least, nearest first: those with the least sums
        over the hashes of how far the axis falls short of the nearest one, squared."""
        x = self.padded(v, band, False)
        codes, missed = np.zeros((len(v), 1), np.int64), np.zeros((len(v), 1))
        for h, kept in enumerate(band.widths):
            reach = axes(x, self.diagonals[table, h], kept)
            short = (reach.max(axis=1, keepdims=True) - reach) ** 2
            near = np.argsort(short, axis=1, kind="stable")[:, :probes]
            short = np.take_along_axis(short, near, 1)
            # the r-th and the s-th best can only be among the best together if r * s is no more than their number
            r, s = np.nonzero(np.outer(np.arange(1, codes.shape[1] + 1), np.arange(1, near.shape[1] + 1)) <= probes)
            total = missed[:, r] + short[:, s]
            best = np.argsort(total, axis=1, kind="stable")[:, :probes]
            codes, missed = np.take_along_axis(codes[:, r] * 2 * kept + near[:, s], best, 1), np.take_along_axis(total, best, 1)
        return codes + band.first + table * band.cells


def usable(vector: Column) -> Column:
    """Neither null nor zero, and all components are finite numbers."""
    good = F.forall(vector, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    return vector.isNotNull() & good & F.exists(vector, lambda x: x != 0)


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        level = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= level)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def probed(vectors: DataFrame, queries: DataFrame, plan: Plan, *, k: int, probes: int) -> DataFrame:
    """`query_id, query_mark, rep, rep_mark, score`: for each query (`id, mark, vector`) the best of the vectors (`id,
    mark, vector, band`) in the cells that it asks; at most `k` from each group of cells.

    Cells are dealt to groups of about GROUP_ROWS vectors, large ones in blocks, and a query travels once to each group
    that has one of its cells.
    """
    kind = vectors.schema["vector"].dataType.simpleString()
    placed = vectors.mapInPandas(place_stored(plan), f"id long, mark long, vector {kind}, cells array<long>")
    placed = written(placed, "ann-placed") if plan.bands[0].widths or len(plan.bands) > 1 else placed
    rows = sum(b.rows for b in plan.bands) * plan.tables
    block = max(BLOCK_ROWS, -(-rows // MOST_BLOCKS))
    counted = placed.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > block)
    large = {r["cell"]: -(-r["n"] // block) for r in counted.collect()}  # each has over `block` of `rows`: at most MOST_BLOCKS
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast((plan, large))
    groups = max(-(-rows // GROUP_ROWS), LEAST_GROUPS)

    def group_of(cell: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (mixed(mixed(cell.astype(np.uint64)) + at.astype(np.uint64)) % np.uint64(groups)).astype(np.int64)

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks = shared.value[1]
        for frame in frames:
            if not len(frame):
                continue
            cells = np.stack(frame["cells"].to_numpy())
            times = np.array([blocks.get(c, 1) for c in cells.ravel().tolist()]).reshape(cells.shape)
            at = (mixed(frame["id"].to_numpy().view(np.uint64) + frame["mark"].to_numpy().view(np.uint64))[:, None] % times.astype(np.uint64)).astype(np.int64)
            for t in range(cells.shape[1]):
                yield frame[["id", "mark", "vector"]].assign(grp=group_of(cells[:, t], at[:, t]), cell=cells[:, t], at=at[:, t])

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        the_plan, blocks = shared.value
        for whole in frames:
            for start in range(0, len(whole), 512):
                frame = whole.iloc[start : start + 512]
                v = matrix(frame["vector"])
                cells = np.concatenate([the_plan.probes_of(v, band, t, probes) for band in the_plan.bands for t in range(the_plan.tables)], axis=1)
                times = np.array([blocks.get(c, 1) for c in cells.ravel().tolist()])
                row = np.repeat(np.repeat(np.arange(len(v)), cells.shape[1]), times)
                cell = np.repeat(cells.ravel(), times)
                at = np.arange(len(cell)) - np.repeat(np.cumsum(times) - times, times)
                grp = group_of(cell, at)
                order = np.lexsort((grp, row))
                row, grp, cell, at = row[order], grp[order], cell[order], at[order]
                cuts = np.flatnonzero(np.diff(row, prepend=-1) | np.diff(grp, prepend=-1))
                ends = [*cuts[1:].tolist(), len(row)]
                out = frame[["id", "mark", "vector"]].iloc[row[cuts]].assign(grp=grp[cuts])
                yield out.assign(cells=[cell[a:b] for a, b in zip(cuts.tolist(), ends)], ats=[at[a:b] for a, b in zip(cuts.tolist(), ends)])

    def search(stored: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "query_mark", "rep", "rep_mark", "score"]
        if not len(stored) or not len(asked):
            return pd.DataFrame({n: np.zeros(0, np.float64 if n == "score" else np.int64) for n in names})
        stored = stored.sort_values(["cell", "at"], kind="stable")
        v, ids, marks = matrix(stored["vector"]), stored["id"].to_numpy(), stored["mark"].to_numpy()
        key = np.rec.fromarrays([stored["cell"].to_numpy(), stored["at"].to_numpy()])
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        ends = np.append(starts[1:], len(key))
        spans = {(c, a): (s, e) for c, a, s, e in zip(key["f0"][starts].tolist(), key["f1"][starts].tolist(), starts.tolist(), ends.tolist())}
        number = np.unique(np.rec.fromarrays([ids, marks]), return_inverse=True)[1]  # a vector can be in cells of several tables
        out = []
        for q, cells, ats in zip(matrix(asked["vector"]), asked["cells"], asked["ats"]):
            found = [np.arange(*spans[s]) for s in zip(cells.tolist(), ats.tolist()) if s in spans]
            near = np.concatenate(found) if found else np.zeros(0, np.int64)
            near = near[np.unique(number[near], return_index=True)[1]]
            scores = v[near] @ q
            top = best_of(scores, ids[near], k)
            out.append((near[top], scores[top]))
        times = [len(n) for n, _ in out]
        near = np.concatenate([n for n, _ in out])
        return pd.DataFrame(dict(zip(names, (np.repeat(asked["id"].to_numpy(), times), np.repeat(asked["mark"].to_numpy(), times), ids[near], marks[near], np.concatenate([s for _, s in out])))))

    stored = placed.mapInPandas(deal, f"id long, mark long, vector {kind}, grp long, cell long, at long")
    asked = queries.mapInPandas(ask, f"id long, mark long, vector {kind}, grp long, cells array<long>, ats array<long>")
    return stored.groupBy("grp").cogroup(asked.groupBy("grp")).applyInPandas(search, "query_id long, query_mark long, rep long, rep_mark long, score double")


def place_stored(plan: Plan):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for number, part in frame.groupby("band"):
                yield part[["id", "mark", "vector"]].assign(cells=list(plan.cells_of(matrix(part["vector"]), plan.bands[number])))

    return run


def banded(members: DataFrame, width: int, tables: int, cell_rows: int, seed: int) -> tuple[DataFrame, Plan]:
    """`members` with their `band`, and the plan of the tables. Bands are told by how much shorter a vector is than the
    longest one; those of few steps are counted on the driver (some thousands at most, as lengths are doubles)."""
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    sized = members.withColumn("length", length)
    high = sized.agg(F.max("length")).first()[0]
    step = F.floor(F.log(F.lit(high) / F.greatest("length", F.lit(1e-300))) / float(np.log(BAND_RATIO)) + 1e-3).cast("long")
    steps = {r["step"]: r for r in sized.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("length").alias("low"), F.max("length").alias("high")).collect()}
    order = sorted(steps)
    own = order[: MOST_BANDS - 1] if len(order) > MOST_BANDS else order
    parts = [[s] for s in own] + ([order[len(own) :]] if len(order) > len(own) else [])
    bounds = [(min(steps[s]["low"] for s in p), max(steps[s]["high"] for s in p), sum(steps[s]["n"] for s in p)) for p in parts]
    lifts = [low < top * (1 - 1e-4) for low, top, _ in bounds]
    wide = 1 << (width + any(lifts) - 1).bit_length() if width + any(lifts) > 1 else 2
    bands, first = [], 0
    for i, ((_, top, n), lift) in enumerate(zip(bounds, lifts)):
        bands.append(Band(i, n, top, lift, hash_widths(n, wide, cell_rows), first))
        first += tables * bands[-1].cells
    plan = Plan(wide, tables, tuple(bands), signs(tables, max(len(b.widths) for b in bands), wide, seed))
    of_step = F.create_map(*[F.lit(x) for i, s in enumerate(own) for x in (int(s), i)])
    band = F.coalesce(F.element_at(of_step, step), F.lit(len(parts) - 1))
    return sized.withColumn("band", band.cast("int")).select("id", "mark", "vector", "band"), plan


def sample_truth(members: DataFrame, queries: DataFrame, k: int, sample: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Of at most `sample` queries, chosen by hash, the vector of the query and of each of its `k` nearest others among
    all members, with the band: `sample * k` rows at most come to the driver."""
    chosen = [(r["id"], r["mark"], r["vector"]) for r in queries.orderBy(F.xxhash64("id", "mark"), "id", "mark").limit(sample).collect()]
    if not chosen:
        return []
    asked = np.array([c[2] for c in chosen], float)
    names = {(c[0], c[1]): i for i, c in enumerate(chosen)}

    def nearest_here(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: list[list] = [[] for _ in range(len(asked))]
        for frame in frames:
            if not len(frame):
                continue
            v = matrix(frame["vector"])
            scores = asked @ v.T
            for at, pair in enumerate(zip(frame["id"].tolist(), frame["mark"].tolist())):
                if pair in names:
                    scores[names[pair], at] = -np.inf
            top = np.argsort(-scores, axis=1)[:, :k]
            for q in range(len(asked)):
                best[q] = sorted([*best[q], *((float(scores[q, a]), int(frame["band"].iloc[a]), v[a]) for a in top[q] if scores[q, a] > -np.inf)], key=lambda b: -b[0])[:k]
        held = [(q, s, b, v) for q in range(len(asked)) for s, b, v in best[q]]
        yield pd.DataFrame({"q": [h[0] for h in held], "score": [h[1] for h in held], "band": [h[2] for h in held], "vector": [h[3] for h in held]})

    found = members.mapInPandas(nearest_here, "q int, score double, band int, vector array<double>")
    found = found.withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))).where(F.col("nth") <= k)
    return [(asked[r["q"]], np.array(r["vector"]), r["band"]) for r in found.collect()]


def enough_probes(truth: list[tuple[np.ndarray, np.ndarray, int]], plan: Plan, recall: float, most: int) -> int | None:
    """The least number of cells to ask in each table so that the share `recall` of the sample's neighbours is found;
    None if `most` cells are too few."""
    rank = np.full(len(truth), most)
    for band in plan.bands:
        at = np.array([i for i, (_, _, b) in enumerate(truth) if b == band.number], np.int64)
        if not len(at):
            continue
        asked, near = np.stack([truth[i][0] for i in at]), np.stack([truth[i][1] for i in at])
        cells = plan.cells_of(near, band)
        for t in range(plan.tables):
            equal = plan.probes_of(asked, band, t, most) == cells[:, t : t + 1]
            rank[at] = np.minimum(rank[at], np.where(equal.any(axis=1), equal.argmax(axis=1), most))
    need = int(np.sort(rank)[max(0, int(np.ceil(recall * len(rank))) - 1)])
    return need + 1 if need < most else None


def scored_share(plan: Plan, probes: int) -> float:
    """About which share of all vectors is scored for a query, counted once for each table."""
    rows = sum(b.rows for b in plan.bands)
    return sum(b.rows * plan.tables * min(probes, b.cells) / b.cells for b in plan.bands) / rows


def nearest(rows: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, tables: int = 8, cell_rows: int = 32, recall: float = 0.95, sample: int = 128, most_probes: int = 1024, exact: bool = False, seed: int = 5) -> DataFrame:
    """`query_id, rank, vec_id, score`: the k rows of the largest inner product for each row where `is_query` holds.

    Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, nor do
    rows without an id. A row is known by its id and its vector: rows that repeat both count once, rows that share only
    the id are queries and candidates of their own. Equal vectors are hashed once and stand for their k + 1 smallest ids,
    which is all that can be among k results. Scores are in double precision from the vectors as given. Ties go to the
    smaller id. An empty table gives no rows.

    Lengths may differ: vectors are hashed in bands of similar length. Enough cells are asked to find the share `recall`
    of the true neighbours of a sample of `sample` queries. Where that takes over `most_probes` cells, or cells that
    together hold more than all vectors (small tables; vectors without any structure in many dimensions), and with
    `exact`, every query is compared with all vectors in blocks. So is a query that finds fewer rows than there are.
    """
    kind = rows.schema[vector_col].dataType.elementType.simpleString()
    vector = F.col(vector_col).cast("array<float>" if kind == "float" else "array<double>")
    good = rows.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    good = good.where(F.col("id").isNotNull() & usable(F.col("vector"))).groupBy("id", "vector").agg(F.max("asks").alias("asks"))
    good = written(good.withColumn("mark", F.xxhash64("vector")), "ann-vectors")
    usual = good.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if usual is None:
        return good.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    good = good.where(F.size("vector") == usual["n"])
    first = good.withColumn("nth", F.row_number().over(Window.partitionBy("mark", "vector").orderBy("id"))).where(F.col("nth") <= k + 1)
    members = written(first.groupBy("mark", "vector").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("id", F.col("ids")[0]), "ann-members")
    queries = good.where("asks").select("id", "mark", "vector")
    stored, plan = banded(members, usual["n"], tables, cell_rows, seed)

    def compared(asked: DataFrame) -> DataFrame:
        """All vectors in one cell, which is searched in blocks."""
        whole, one = banded(members, usual["n"], 1, 1 << 62, seed)
        return probed(whole, asked, one, k=k + 1, probes=1)

    truth = [] if exact else sample_truth(stored, queries, k, sample)
    probes = enough_probes(truth, plan, recall, most_probes) if truth else None
    hashed = probes is not None and scored_share(plan, probes) <= 1
    found = written(probed(stored, queries, plan, k=k + 1, probes=probes) if hashed else compared(queries), "ann-found")
    lists = members.select(F.col("id").alias("rep"), F.col("mark").alias("rep_mark"), "ids")

    def ranked(found: DataFrame) -> DataFrame:
        own = ["query_id", "query_mark"]
        best = found.groupBy(*own, "rep", "rep_mark").agg(F.max("score").alias("score"))
        best = best.withColumn("nth", F.row_number().over(Window.partitionBy(*own).orderBy(F.desc("score"), "rep", "rep_mark"))).where(F.col("nth") <= k + 1)
        each = best.join(lists, ["rep", "rep_mark"]).select(*own, "score", "rep_mark", F.explode("ids").alias("vec_id")).where("vec_id <> query_id OR rep_mark <> query_mark")
        rank = F.row_number().over(Window.partitionBy(*own).orderBy(F.desc("score"), "vec_id", "rep_mark"))
        return each.withColumn("rank", rank).where(F.col("rank") <= k)

    columns = ["query_id", "rank", "vec_id", "score"]
    if not hashed:
        return ranked(found).select(*columns)
    out = written(ranked(found), "ann-ranked")
    some = F.least(F.lit(k), F.lit(good.count() - 1))
    full = out.where(F.col("rank") >= some).select(F.col("query_id").alias("id"), F.col("query_mark").alias("mark"))
    short = written(queries.join(full, ["id", "mark"], "left_anti"), "ann-short")
    if short.isEmpty():
        return out.select(*columns)
    again = ranked(compared(short)).select(*columns)
    done = out.join(short.select(F.col("id").alias("query_id"), F.col("mark").alias("query_mark")), ["query_id", "query_mark"], "left_anti")
    return done.select(*columns).unionByName(again)
