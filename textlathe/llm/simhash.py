"""SimHash near-duplicates: fingerprints, a positional byte index with count filtering, connected components."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shuffle_partitions, small, written

WIDTH = 3
SEED = 42


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of the 3-word shingles of a text, repeats included; 0 if it has no words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= WIDTH:
        return int(xxhash.xxh64_intdigest(joined, SEED))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.concatenate(([0], np.cumsum(sizes)))
    first, last = starts[: -WIDTH].tolist(), (starts[WIDTH:] - 1).tolist()
    digest, n = xxhash.xxh64_intdigest, len(words) - WIDTH + 1
    hashes = np.fromiter([digest(joined[a:b], SEED) for a, b in zip(first, last)], np.uint64, n)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):  # bounded memory for long texts
        block = hashes[at : at + (1 << 14)]
        ones += np.unpackbits(block.view(np.uint8).reshape(len(block), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, text_hash, fp` (the fingerprint as a signed long) of each row."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("text_hash", T.LongType()), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py()) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text")).mapInArrow(run, schema)


#: Two fingerprints with at most 3 differing bits share at least 5 of their 8 positional bytes.
BYTES, DISTANCE = 8, 3
SHARED = BYTES - DISTANCE
#: A list of more fingerprints than this is replaced by lists that have more in common.
LONG_LIST = 2048


def bits_of(positions: Sequence[int], width: int) -> int:
    """The bits of some positions of `width` bits each, as a signed long."""
    mask = sum(((1 << width) - 1) << (width * p) for p in positions)
    return mask - (1 << 64) if mask >> 63 else mask


def list_masks() -> tuple[dict[int, int], list[list[tuple[int, int, int]]]]:
    """The bits that the fingerprints of a list have in common, by the number of the list; and for each of two more
    levels, the lists that replace a long one, as its number, theirs and their bits.

    Of any 5 of the 8 bytes 3 lie in the same half, so 8 triples find every pair. Of the other 5 bytes a pair shares at
    least 2: ten lists. Of the 3 bytes left, taken as 6 half bytes, it shares at least 3: twenty lists, of no more than
    2**12 fingerprints each.
    """
    first, second, third = {}, [], []
    triples = [t for half in (range(4), range(4, 8)) for t in combinations(half, 3)]
    for i, triple in enumerate(triples):
        first[i] = bits_of(triple, 8)
        others = [p for p in range(BYTES) if p not in triple]
        for j, pair in enumerate(combinations(others, 2)):
            number = 100 * (i + 1) + j
            second.append((i, number, bits_of((*triple, *pair), 8)))
            halves = [h for p in others if p not in pair for h in (2 * p, 2 * p + 1)]
            known = [h for p in (*triple, *pair) for h in (2 * p, 2 * p + 1)]
            third += [(number, 100 * number + n, bits_of((*known, *some), 4)) for n, some in enumerate(combinations(halves, 3))]
    return first, [second, third]


def postings(fps: DataFrame) -> DataFrame:
    """`list, key, fp`: each fingerprint in the lists of its bytes."""
    rows = F.array(*[F.struct(F.lit(n).alias("list"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key")) for n, mask in list_masks()[0].items()])
    return fps.select("fp", F.explode(rows).alias("at")).select("at.list", "at.key", "fp")


def forest(fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges that connect exactly what the links among these distinct fingerprints connect; at most len(fps) - 1.

    From each fingerprint reached, the positional bytes shared with all not yet reached are tallied; those with the
    guaranteed number are compared bit by bit.
    """
    left = fps
    while len(left):
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            here = reached.pop()
            differing = left ^ here
            tally = (differing.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
            linked = (tally >= SHARED) & (np.bitwise_count(differing) <= DISTANCE)
            found = left[linked]
            if len(found):
                yield np.full(len(found), here), found
                reached.extend(found)
                left = left[~linked]


def link_edges(fps: DataFrame) -> DataFrame:
    """`a, b`: edges between distinct fingerprints (`fp`) whose components are those of all links.

    Lists are sorted and streamed; each gives at most one edge less than it has fingerprints. Long lists are replaced by
    lists of more common bits, see `list_masks`; those of the last level are bounded, and none is cut short.
    """
    spark = fps.sparkSession
    short = postings(fps)
    for level in list_masks()[1]:
        long_lists = written(short.groupBy("list", "key").count().where(F.col("count") > LONG_LIST).select("list", "key"), "simhash-long")
        if long_lists.isEmpty():
            break
        finer = F.broadcast(spark.createDataFrame(level, "list int, finer int, mask long"))  # 80 rows, then 1,600
        hot = short.join(small(long_lists), ["list", "key"], "left_semi").join(finer, "list")
        hot = hot.select(F.col("finer").alias("list"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
        short = short.join(small(long_lists), ["list", "key"], "left_anti").unionByName(hot)

    def edges_in(lists: np.ndarray, keys: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate(([True], (lists[1:] != lists[:-1]) | (keys[1:] != keys[:-1])))) if len(lists) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(lists))
        several = ends - starts > 1
        found = [edge for a, b in zip(starts[several].tolist(), ends[several].tolist()) for edge in forest(values[a:b])]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([e[i] for e in found]).view(np.int64)) for i in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)]  # the list that may go on
        for batch in batches:
            held = [np.concatenate((old, new)) for old, new in zip(held, (batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)))]
            if not len(held[0]):
                continue
            goes_on = (held[0] == held[0][-1]) & (held[1] == held[1][-1])
            yield from edges_in(*[h[~goes_on] for h in held])
            held = [h[goes_on] for h in held]
        yield from edges_in(*held)

    dealt = short.repartition(shuffle_partitions(spark), "list", "key").sortWithinPartitions("list", "key", "fp")
    return dealt.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """`node, root` of each node of the edges `a, b`: the same root for what is connected.

    Every round gives the nodes new random ranks, moves each to the one of the least rank among its neighbours and
    itself, and contracts the edges. What is left are nodes that are the least somewhere: on a chain, where they are
    the most, about half in each round, whatever the order of the nodes is. Each round is written to the shared folder.
    """
    rounds: list[DataFrame] = []
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "components-edges")
    while not edges.isEmpty():
        ranked = lambda c: F.struct(F.xxhash64(F.lit(len(rounds)), c).alias("rank"), F.col(c).alias("node"))  # noqa: B023, E731
        both = edges.select("a", ranked("b").alias("to")).unionByName(edges.select(F.col("b").alias("a"), ranked("a").alias("to")))
        moves = both.groupBy("a").agg(F.min("to").alias("to")).select(F.col("a").alias("node"), F.least("to", ranked("a"))["node"].alias("root"))
        moves = written(moves, "components-moves")
        rounds.append(moves)
        ends = edges.join(moves.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(moves.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        edges = written(ends.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "components-edges")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # from the last round back: what is looked up is always the smaller side
    found = rounds[-1]
    for number, moves in enumerate(reversed(rounds[:-1]), 1):
        then = found.select(F.col("node").alias("root"), F.col("root").alias("next"))
        found = moves.join(then, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        found = written(found, "components-found") if number % 4 == 0 else found
    return found


def classed(docs: DataFrame, *, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """`fingerprints` of the rows, and `fp, root, low` of each fingerprint: the same root for what is linked, the
    smallest id of its rows."""
    fps = written(fingerprints(docs, id_col=id_col, text_col=text_col), "simhash-fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = components(link_edges(nodes.select("fp")))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    return fps, written(rooted, "simhash-roots")


def copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, text_hash, n, first` of what is in `docs` more than once: with `first` false the documents that are not
    the first of their component, with `first` true those first ones that `n` rows, more than one, have.

    A document is known by its id and its text. The first is the one of the smallest id (those without an id come last),
    of these the one of the smallest text hash. Components are told apart by fingerprint, so those without any id, or
    with the same id, are not taken for one.
    """
    fps, rooted = classed(docs, id_col=id_col, text_col=text_col)
    pairs = fps.groupBy("doc_id", "text_hash", "fp").agg(F.count("*").alias("n")).withColumn("place", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash"))
    lowest = pairs.groupBy("fp").agg(F.min("place").alias("place"))
    lowest = lowest.join(rooted.select("fp", "root"), "fp").select("fp", "root", "place")
    firsts = lowest.groupBy("root").agg(F.min("place").alias("first_place"))
    firsts = written(lowest.join(firsts, "root").select("fp", "first_place"), "simhash-firsts")
    told = pairs.join(firsts, "fp").select("doc_id", "text_hash", "n", F.col("place").eqNullSafe(F.col("first_place")).alias("first"))
    return told.where(~F.col("first") | (F.col("n") > 1))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, fingerprint, component_id` of each row.

    Null and empty texts have fingerprint zero and are linked like any other; the component of a row is the smallest id
    of all rows that links reach from it. Copies meet in one fingerprint before any list is built. Repeated rows give
    repeated results, an empty table none; other columns are not read.
    """
    fps, rooted = classed(docs, id_col=id_col, text_col=text_col)
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = written(rooted.join(lowest, "root").select("fp", "component_id"), "simhash-classes")
    return fps.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
