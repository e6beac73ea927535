"""Chains of typed relations between documents, in which no edge occurs twice."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import scratch_table
from .graph import FRONTIER, among, with_steps
from .stored import Rows, StoredTable, all_rows, picked


@dataclass(frozen=True)
class Hop:
    """A relation of a pattern: of some types or any, along the edge (`out`), against it (`in`) or both ways (`any`);
    `low` to `high` edges in a row. `where` says which documents it may end at."""

    rel_types: tuple[str, ...] = ()
    direction: str = "out"
    low: int = 1
    high: int = 1
    where: Column | None = None

    def __post_init__(self) -> None:
        if self.direction not in ("out", "in", "any") or not 1 <= self.low <= self.high:
            raise ValueError(f"no such hop: {self}")


def chain_matches(documents: Rows, edges: Rows, hops: Sequence[Hop], *, start: Column | None = None, start_ids: Sequence[str] | None = None, closed: bool = False) -> DataFrame:
    """`nodes, path, rel_types` of all matches of a chain of hops: the documents at its places, all documents on the way,
    and the relations between them.

    `start` says of documents, `start_ids` of their ids, where a chain may begin; with `closed` it ends where it began. A
    match uses no edge (`src, rel_type, dst`) twice, but may meet a document again. A loop counts once in both directions.
    Edges with a null in their key, and those to or from documents that are not there, match nothing; repeated edges
    count once. Empty tables give no matches.

    Before edges are joined into chains, each place keeps only edges that the places before it reach and from which the
    places after it can be reached; so what is joined grows with the matches. Plain edges are stored once, those of the
    types of the hops only. Up to FRONTIER ids or chains are broadcast; more are shuffled, and the edges of documents with
    very many are salted, so that these are no single task's.
    """
    if not hops:
        raise ValueError("a chain has one hop at least")
    begin = all_rows(documents) if start_ids is None else picked(documents, "id", [str(i).strip() for i in start_ids])
    begin = scratch_table((begin if start is None else begin.where(start)).where("id IS NOT NULL").select("id").distinct(), "chain-start")
    documents = all_rows(documents).where("id IS NOT NULL")
    known = begin if start is None and start_ids is None else scratch_table(documents.select("id").distinct(), "chain-known")
    each, types = all_rows(edges).select("src", "rel_type", "dst").dropna(), sorted({t for h in hops for t in h.rel_types})
    if all(h.rel_types for h in hops):
        each = each.where(F.col("rel_type").isin(types))
    each = each if isinstance(edges, StoredTable) else scratch_table(each, "chain-edges")
    ends = [known if h.where is None else scratch_table(documents.where(h.where).select("id").distinct(), "chain-ends") for h in hops]
    found = []
    for lengths in product(*[range(h.low, h.high + 1) for h in hops]):
        # one entry for each edge: its hop, and whether the hop ends with it
        plan = [(i, at == n - 1) for i, n in enumerate(lengths) for at in range(n)]
        found.append(joined(reduced(each, hops, known, ends, begin, plan, closed), plan, begin, closed))
    return reduce(lambda a, b: a.unionByName(b), found)


def directed(edges: DataFrame, hop: Hop) -> DataFrame:
    """`at, to, src, rel_type, dst`: the edges of a hop's types in the directions it may go."""
    rows = edges.where(F.col("rel_type").isin(*hop.rel_types)) if hop.rel_types else edges
    forth, back = (rows.select(F.col(a).alias("at"), F.col(b).alias("to"), "src", "rel_type", "dst") for a, b in (("src", "dst"), ("dst", "src")))
    return {"out": forth, "in": back, "any": forth.unionByName(back.where("src <> dst"))}[hop.direction]


def reduced(edges: DataFrame, hops: Sequence[Hop], known: DataFrame, ends: list[DataFrame], begin: DataFrame, plan: list[tuple[int, bool]], closed: bool) -> list[DataFrame]:
    """The edges of each place of a chain, each once, without those that no chain can have there."""
    rows, reach = [], begin
    for hop, last in plan:
        here = among(among(directed(edges, hops[hop]), "at", reach, FRONTIER), "to", ends[hop] if last else known, FRONTIER)
        rows.append(scratch_table(here.distinct(), "chain-forth"))
        reach = scratch_table(rows[-1].select(F.col("to").alias("id")).distinct(), "chain-reach")
    reach = begin if closed else None
    for place in reversed(range(len(plan))):
        if reach is not None:
            rows[place] = scratch_table(among(rows[place], "to", reach, FRONTIER), "chain-back")
        if place:
            reach = scratch_table(rows[place].select(F.col("at").alias("id")).distinct(), "chain-reach")
    return rows


def joined(rows: list[DataFrame], plan: list[tuple[int, bool]], begin: DataFrame, closed: bool) -> DataFrame:
    edge = F.struct("src", "rel_type", "dst")
    level = begin.select(F.col("id").alias("at"), F.array("id").alias("nodes"), F.array("id").alias("path"), F.array().cast("array<string>").alias("rel_types"), F.array().cast("array<struct<src:string,rel_type:string,dst:string>>").alias("used"))
    for place, (_, last) in enumerate(plan):
        level = level if place == 0 else scratch_table(level, "chain-level")
        steps = rows[place].select("at", "to", F.col("rel_type").alias("kind"), edge.alias("edge"))
        grown = with_steps(steps, level, FRONTIER)
        grown = grown.where(~F.array_contains("used", F.col("edge")))
        if closed and place == len(plan) - 1:
            grown = grown.where(F.col("to") == F.col("path")[0])
        nodes = F.array_append("nodes", F.col("to")) if last else F.col("nodes")
        level = grown.select(F.col("to").alias("at"), nodes.alias("nodes"), F.array_append("path", F.col("to")).alias("path"), F.array_append("rel_types", F.col("kind")).alias("rel_types"), F.array_append("used", F.col("edge")).alias("used"))
    return level.select("nodes", "path", "rel_types")
