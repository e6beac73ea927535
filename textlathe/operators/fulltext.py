"""A stored full-text index and the queries that it answers: words, phrases, prefixes, misspelt words, and clauses of them.

Texts are dealt to shards of some thousand by a hash of their ids, and the postings of a term in a shard are one row, a
block, with the greatest weight in it. Blocks lie in folders by a hash of the term, sorted by term, so a search opens the
folders of its terms and reads there the row groups of its terms. Block weights bound what a shard can score: the best
shards are scored first, and shards that cannot reach the last of the top hits found there are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import tokens
from ..sources.tables import scratch_path, scratch_table, spread, write_parquet

K1, B = 1.2, 0.75
#: Up to this many terms that a prefix or a misspelt word stands for are named in the plan; more are joined.
NAMED_TERMS = 1000
#: Up to this many asked terms are a literal in the plan; more are a broadcast table of NAMED_TERMS a leaf at most.
FEW_NAMED = 16
#: How many shards are scored first, and up to how many all are.
FIRST_SHARDS, FEW_SHARDS = 16, 64
SCHEMAS = {
    "postings": "term string, shard long, top double, id array<{id}>, tf array<int>, n_terms array<long>, positions array<array<int>>, bucket int",
    "terms": "term string, df long", "spelling": "rest string, term string, df long", "stats": "n_docs long, mean double, n_shards long, buckets int, id_type string",
}
#: About how many terms of a folder one task writes at most, and of how many shards one task makes the blocks.
PART_ROWS, TASK_SHARDS = 1_000_000, 16
#: About how many bytes of blocks a task gives back as rows at once.
PAGES_BYTES = 8 << 20
#: Terms of more characters have no entries in the spelling table; they are compared one by one.
SPELT = 24


@dataclass(frozen=True)
class Index:
    """Where an index lies, and what its texts have in common."""

    spark: SparkSession = field(repr=False)
    path: str
    n_docs: int
    mean: float
    n_shards: int
    buckets: int
    id_type: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name].format(id=self.id_type)).parquet(f"{self.path}/{name}")


def weight(tf: Column, n_terms: Column, mean: float) -> Column:
    """What a term that a text has `tf` times counts, but for its rarity."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * n_terms / F.lit(mean or 1.0)))


def rarity(df: Column | int, n_docs: int):
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5)) if isinstance(df, Column) else math.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def folder(term: str, buckets: int) -> int:
    return zlib.crc32(term.encode()) % buckets


def grouped(ids: pa.Array, terms: pa.ListArray) -> pa.RecordBatch:
    """Of some texts and the lists of their terms the rows of `places`, by one stable sort of all terms by text."""
    flat, sizes = terms.flatten(), np.diff(np.asarray(terms.offsets, np.int64))
    words = flat.dictionary_encode()
    code, text = np.asarray(words.indices, np.int64), np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(text * max(1, len(words.dictionary)) + code, kind="stable")
    code, text = code[order], text[order]
    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(order)), bool), (code[1:] != code[:-1]) | (text[1:] != text[:-1]))))
    place = order - (np.cumsum(sizes) - sizes)[text]
    bare = np.flatnonzero(sizes == 0)
    owner = np.concatenate((text[starts], bare))
    first = np.concatenate((np.diff(text[starts], prepend=-1) > 0, np.ones(len(bare), bool)))
    ends = np.concatenate((starts, np.full(len(bare) + 1, len(order))))
    names = pa.concat_arrays([words.dictionary.take(pa.array(code[starts])).cast(pa.string()), pa.nulls(len(bare), pa.string())])
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place, pa.int32()))
    return pa.RecordBatch.from_arrays([ids.take(pa.array(owner)), names, pa.array(sizes[owner]), lists, pa.array(first)], names=["id", "term", "n_terms", "positions", "first"])


def places(df: DataFrame, id_col: str, text_col: str, most: int = 1 << 21) -> DataFrame:
    """`id, term, n_terms, positions, first`: of each text its terms, each once with its places (from 0); a text without
    any has one row without a term. `first` marks one row of each text. One map: the terms of a text are grouped where it
    is read, `most` terms of texts at once or one text."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, at = np.cumsum(np.diff(np.asarray(batch.column(1).offsets, np.int64))), 0
            while at < batch.num_rows:
                held = int(ends[at - 1]) if at else 0
                n = max(1, int(np.searchsorted(ends, held + most, "right")) - at)
                part = batch.slice(at, n)
                lists = part.column(1)
                yield grouped(part.column(0), pa.ListArray.from_arrays(pa.array(np.asarray(lists.offsets) - lists.offsets[0].as_py(), pa.int32()), lists.flatten()))
                at += n

    terms = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).select("id", tokens(F.coalesce("text", F.lit(""))).alias("terms"))
    return terms.mapInArrow(run, f"id {kind}, term string, n_terms long, positions array<int>, first boolean")


def postings(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`term, id, tf, n_terms` of all texts, each row a text of its own; no shuffle."""
    return places(df, id_col, text_col).where("term IS NOT NULL").select("term", "id", F.size("positions").cast("long").alias("tf"), "n_terms")


def shard_groups(batches: Iterator[pa.RecordBatch], n_shards: int, most: int) -> Iterator[tuple[int, pa.Array, pa.ListArray]]:
    """Of rows `shard, id, terms` in the order of the first two the shards with their ids and terms. One of over `most`
    terms is cut into several, with numbers of their own from `n_shards` on. Texts that share an id are not parted."""
    held: list[pa.RecordBatch] = []
    last, n, cut = None, 0, 0

    def group() -> tuple[int, pa.Array, pa.ListArray]:
        rows = pa.concat_batches(held)
        return last[0] + cut * n_shards, rows.column(1), rows.column(2)

    for batch in batches:
        sizes, first = np.diff(np.asarray(batch.column(2).offsets, np.int64)).tolist(), 0
        for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            if last is not None and key != last and (key[0] != last[0] or n >= most):
                held.append(batch.slice(first, i - first))
                yield group()
                held, n, first, cut = [], 0, i, cut + 1 if key[0] == last[0] else 0
            n, last = n + sizes[i], key
        held.append(batch.slice(first))
    if last is not None:
        yield group()


def page_schema(ids: pa.DataType, wide: bool) -> pa.Schema:
    """Of a page, one row of lists: its terms, in how many texts each is, the texts with their lengths, and of each hit its
    text, how many places it has, and how far each place is from the last one; numbers have two bytes, or four."""
    number = pa.uint32() if wide else pa.uint16()
    kinds = {"term": pa.string(), "n": number, "id": ids, "n_terms": number, "text": number, "tf": number, "step": number}
    return pa.schema([(name, pa.list_(kind)) for name, kind in kinds.items()])


def shard_pages(shard: int, ids: pa.Array, terms: pa.ListArray, buckets: int) -> pa.RecordBatch:
    """`bucket, shard, wide, size, page`: what a shard has for each folder, by one stable sort of all its terms. Pages are
    compressed: postings as rows take three times as much in a shuffle, and more."""
    flat, sizes = terms.flatten(), np.diff(np.asarray(terms.offsets, np.int64))
    words = flat.dictionary_encode()
    bucket = np.array([folder(t, buckets) for t in words.dictionary.to_pylist()], np.int64)
    by = np.argsort(bucket, kind="stable")
    rank = np.empty_like(by)
    rank[by] = np.arange(len(by))
    word, text = rank[np.asarray(words.indices, np.int64)], np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(word * max(1, len(sizes)) + text, kind="stable")
    word, text = word[order], text[order]
    place = order - (np.cumsum(sizes) - sizes)[text]
    hits = np.flatnonzero((np.diff(word, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
    step = np.diff(place, prepend=0)
    step[hits] = place[hits]
    n, tf = np.bincount(word[hits], minlength=len(by)), np.diff(hits, append=len(order))
    names, first = np.unique(bucket[by], return_index=True)
    w = np.append(first, len(by))
    h = np.append(0, np.cumsum(n))[w]
    p = np.append(hits, len(order))[h]
    wide = max(len(sizes), sizes.max(initial=0)) >= 1 << 16
    named, schema, pages = words.dictionary.take(pa.array(by)), page_schema(ids.type, wide), []
    for i in range(len(names)):
        own, which = np.unique(text[hits[h[i] : h[i + 1]]], return_inverse=True)
        values = [named.slice(w[i], w[i + 1] - w[i]), n[w[i] : w[i + 1]], ids.take(pa.array(own)), sizes[own], which, tf[h[i] : h[i + 1]], step[p[i] : p[i + 1]]]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), (x if isinstance(x, pa.Array) else pa.array(x)).cast(f.type.value_type)) for x, f in zip(values, schema)]
        pages.append(pa.RecordBatch.from_arrays(lists, schema=schema).serialize())
    codec = pa.Codec("zstd", compression_level=6)
    columns = [pa.array(names, pa.int32()), pa.array(np.full(len(names), shard), pa.int64()), pa.array(np.full(len(names), wide), pa.bool_()), pa.array([x.size for x in pages], pa.int64()), pa.array([codec.compress(x, asbytes=True) for x in pages], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "shard", "wide", "size", "page"])


def page_blocks(row: dict, ids: pa.DataType, mean: float) -> pa.RecordBatch:
    """The blocks of a row of `shard_pages`, with the greatest weight of each."""
    page = pa.ipc.read_record_batch(pa.decompress(row["page"], row["size"], "zstd"), page_schema(ids, row["wide"]))
    term, n, id, n_terms, text, tf, step = (c.flatten() for c in page.columns)
    n, n_terms, tf, step = (np.asarray(x, np.int64) for x in (n, n_terms.take(text), tf, step))
    blocks, hits, total = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(tf)), np.cumsum(step)
    places = total - np.repeat((total - step)[hits[:-1]], tf)
    top = np.maximum.reduceat(tf * (K1 + 1) / (tf + K1 * (1 - B + B * n_terms / (mean or 1.0))), blocks[:-1])
    positions = pa.ListArray.from_arrays(pa.array(hits, pa.int32()), pa.array(places, pa.int32()))
    lists = [pa.ListArray.from_arrays(pa.array(blocks, pa.int32()), x) for x in (id.take(text), pa.array(tf, pa.int32()), pa.array(n_terms, pa.int64()), positions)]
    number = lambda name, kind: pa.array(np.full(len(term), row[name]), kind)
    return pa.RecordBatch.from_arrays([number("bucket", pa.int32()), term, number("shard", pa.int64()), pa.array(top), *lists], names=["bucket", "term", "shard", "top", "id", "tf", "n_terms", "positions"])


def build_index(texts: DataFrame, id_col: str, text_col: str, path: str | None = None, *, block: int = 1024, buckets: int | None = None, spelling: bool = False, most: int = 1 << 21) -> Index:
    """Writes the index of `texts` to `path` (a scratch path if none is given). Null texts count as empty; ids are meant
    to be unique, and texts that share one are one hit. `texts` is read twice: for its numbers, and to deal the texts to
    their shards, where their blocks are made, `most` terms at once; only the blocks are dealt to folders, and nothing is
    written beside the index. There are as many folders as `buckets` says, or one for some thousand texts, from 4 to
    1,024. A folder is one file for each PART_ROWS terms in it, so files grow with the terms and not with folders times
    tasks."""
    spark = texts.sparkSession
    path = path or scratch_path(spark, "fulltext")
    kind, ids = texts.schema[id_col].dataType.simpleString(), to_arrow_type(texts.schema[id_col].dataType)
    rows = texts.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    stats = rows.agg(F.count("*").alias("n"), F.avg(F.size(tokens(F.col("text")))).alias("mean")).first()
    mean, n_shards = float(stats["mean"] or 0.0), max(1, -(-stats["n"] // block))
    buckets = buckets or min(1024, max(4, stats["n"] // 4096))
    parts = max(1, min(n_shards, -(-round(stats["n"] * mean) // (buckets * PART_ROWS))))
    tasks = min(n_shards, max(spark.sparkContext.defaultParallelism, -(-n_shards // TASK_SHARDS)))
    shard = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(n_shards))
    dealt = rows.select(shard.alias("shard"), "id", "text").repartitionById(tasks, F.floor(F.col("shard") * tasks / n_shards).cast("int")).sortWithinPartitions("shard", "id").select("shard", "id", tokens(F.col("text")).alias("terms"))


    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in shard_groups(batches, n_shards, most):
            yield shard_pages(*group, buckets)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for row in batch.to_pylist():
                held.append(page_blocks(row, ids, mean))
                size += held[-1].nbytes
                if size >= PAGES_BYTES:
                    yield pa.concat_batches(held)
                    held, size = [], 0
            if held:
                yield pa.concat_batches(held)

    pages = dealt.mapInArrow(pack, "bucket int, shard long, wide boolean, size long, page binary")
    placed = pages.repartitionById(buckets * parts, (F.col("bucket") * parts + F.floor(F.col("shard") % n_shards * parts / n_shards)).cast("int"))
    blocks = placed.mapInArrow(unpack, f"bucket int, term string, shard long, top double, id array<{kind}>, tf array<int>, n_terms array<long>, positions array<array<int>>")
    blocks.sortWithinPartitions("bucket", "term", "shard").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/postings")
    stored = spark.read.schema(SCHEMAS["postings"].format(id=kind)).parquet(f"{path}/postings")
    terms = stored.select("term", F.size("tf").alias("n")).groupBy("term").agg(F.sum("n").alias("df"))
    write_parquet(terms.repartitionByRange("term").sortWithinPartitions("term"), f"{path}/terms")
    index = Index(spark, path, stats["n"], mean, n_shards, buckets, kind)
    if spelling:
        add_spelling(index)
    spark.createDataFrame([(index.n_docs, mean, n_shards, buckets, index.id_type)], SCHEMAS["stats"]).coalesce(1).write.parquet(f"{path}/stats")
    return index


def open_index(spark: SparkSession, path: str) -> Index:
    return Index(spark, path, *spark.read.parquet(f"{path}/stats").first())


def rests(word: str, edits: int) -> set[str]:
    """All that is left of a word when up to `edits` characters are taken out."""
    found = last = {word}
    for _ in range(edits):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        found = found | last
    return found


def add_spelling(index: Index, edits: int = 2) -> None:
    """Stores what is left of each term of up to SPELT characters without some of them, sorted: two words within as many
    edits have one such rest in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                left = [sorted(rests(t, edits)) for t in part.column(0).to_pylist()]
                row = pa.array(np.repeat(np.arange(len(left)), [len(x) for x in left]))
                yield pa.RecordBatch.from_arrays([pa.array([w for x in left for w in x], pa.string()), part.column(0).take(row), part.column(1).take(row)], names=["rest", "term", "df"])

    short = spread(index.table("terms").where(F.char_length("term") <= SPELT).select("term", "df"))
    write_parquet(short.mapInArrow(run, SCHEMAS["spelling"]).repartitionByRange("rest").sortWithinPartitions("rest"), f"{index.path}/spelling")


class Query:
    """A part of a query: `&`, `|` and `~` combine them; `a & ~b` are hits of a without those of b."""

    def __and__(self, other: Query) -> Query:
        return Clauses(must=(self, other))

    def __or__(self, other: Query) -> Query:
        return Clauses(should=(self, other))

    def __invert__(self) -> Query:
        return Clauses(must_not=(self,))


@dataclass(frozen=True)
class Leaf(Query):
    """Words in places one after another (`phrase`), or all words that a prefix or a misspelt word stands for."""

    kind: str
    text: str
    edits: int = 0


@dataclass(frozen=True)
class Clauses(Query):
    """Hits of all of `must`, or of any of `should` if there is none of these; without those of `must_not`. Scores of what
    is hit are added."""

    must: tuple[Query, ...] = ()
    should: tuple[Query, ...] = ()
    must_not: tuple[Query, ...] = ()

    def __post_init__(self) -> None:
        # ~x inside `&` excludes; x | ~y would be nearly all texts
        if any(negative(q) for q in self.should):
            raise ValueError("NOT has no meaning beside OR")
        turned = [q for q in self.must if negative(q)]
        object.__setattr__(self, "must_not", (*self.must_not, *(n for q in turned for n in q.must_not)))
        object.__setattr__(self, "must", tuple(q for q in self.must if not negative(q)))


def negative(q: Query) -> bool:
    return isinstance(q, Clauses) and not q.must and not q.should and bool(q.must_not)


def word(text: str) -> Query:
    return Leaf("phrase", text)


phrase = word


def prefix(text: str) -> Query:
    return Leaf("prefix", text)


def fuzzy(text: str, edits: int = 2) -> Query:
    """Words within some edits (letters put in, left out or replaced), two at most."""
    if not 0 <= edits <= 2:
        raise ValueError("0, 1 or 2 edits")
    return Leaf("fuzzy", text, edits)


CLAUSE = re.compile(r'(?P<sign>[+-]?)(?:"(?P<phrase>[^"]*)"?|(?P<word>[^\s"]+))')


def keywords(spark: SparkSession, text: str) -> Query:
    """A search box's line as a query: words of which any may occur, `"phrases"`, `prefix*`, `misspelt~` (`~1`), `+` for
    what must occur and `-` for what must not; between clauses AND makes both sides needed, NOT excludes what follows, and
    OR changes nothing. A word that holds several terms stands for any of them. Without any term nothing is found."""
    found: dict[str, list[Query]] = {"+": [], "": [], "-": []}
    sign = ""
    for m in CLAUSE.finditer(text):
        if m["word"] in ("AND", "OR", "NOT") and not m["sign"]:
            if m["word"] == "AND" and found[""]:
                found["+"].append(found[""].pop())
            sign = {"AND": "+", "OR": "", "NOT": "-"}[m["word"]]
            continue
        own = m["word"] or m["phrase"] or ""
        form = re.fullmatch(r"(.+?)(?:(\*)|~([012]?))?", own) if m["word"] else None
        terms = split_terms(spark, form[1] if form else own)
        if terms:
            if not form:
                part = phrase(" ".join(terms))
            elif form[2]:
                part = prefix(terms[-1]) if len(terms) == 1 else Clauses(must=(phrase(" ".join(terms[:-1])), prefix(terms[-1])))
            elif form[3] is not None:
                part = Clauses(should=tuple(fuzzy(t, int(form[3] or 2)) for t in terms))
            else:
                part = word(terms[0]) if len(terms) == 1 else Clauses(should=tuple(map(word, dict.fromkeys(terms))))
            if part not in found[m["sign"] or sign]:
                found[m["sign"] or sign].append(part)
        sign = ""
    return Clauses(tuple(found["+"]), tuple(found[""]), tuple(found["-"]))


def split_terms(spark: SparkSession, text: str) -> list[str]:
    """The terms of a text as the index has them."""
    return spark.sql("SELECT :text AS text", args={"text": text}).select(tokens(F.col("text"))).first()[0]


def leaves_of(q: Query) -> Iterator[Leaf]:
    if isinstance(q, Leaf):
        yield q
    else:
        for part in (*q.must, *q.should, *q.must_not):
            yield from leaves_of(part)


def combined(q: Query, of: dict[Leaf, Column], exclude: bool = True) -> Column:
    """The score of a query from those of its leaves, null where it does not hit. Bounds of shards do not exclude."""
    if isinstance(q, Leaf):
        return of[q]
    must, should, must_not = ([combined(p, of, exclude) for p in parts] for parts in (q.must, q.should, q.must_not))
    total = reduce(lambda a, b: a + b, [*must, *(F.coalesce(s, F.lit(0.0)) for s in should)], F.lit(0.0))
    hit = reduce(lambda a, b: a & b, [m.isNotNull() for m in must]) if must else reduce(lambda a, b: a | b, [s.isNotNull() for s in should], F.lit(False))
    if exclude:
        hit = reduce(lambda a, b: a & b.isNull(), must_not, hit)
    return F.when(hit, total)


def stands_for(index: Index, leaf: Leaf) -> DataFrame:
    """`term, df, share`: the terms that a prefix or a misspelt word stands for, and what part of their score counts."""
    terms = index.table("terms")
    if leaf.kind == "prefix":
        return terms.where((F.col("term") >= leaf.text) & F.col("term").startswith(leaf.text)).select("term", "df", F.lit(1.0).alias("share"))
    near = terms.where(F.char_length("term").between(SPELT + 1, len(leaf.text) + leaf.edits)).select("term", "df")
    if len(leaf.text) <= SPELT + leaf.edits:
        near = near.unionByName(index.table("spelling").where(F.col("rest").isin(sorted(rests(leaf.text, leaf.edits)))).select("term", "df").distinct())
    off = F.levenshtein("term", F.lit(leaf.text))
    return near.where(off <= leaf.edits).select("term", "df", (1 - off / float(max(1, len(leaf.text)))).alias("share"))


@dataclass(frozen=True)
class Asked:
    """What the leaves of a query ask for: `leaf, place, term, worth` (the rarity of a term times its share), a few rows
    as they are, and those of leaves that stand for many terms as a table."""

    named: list[tuple[int, int, str, float]]
    more: DataFrame | None = None


def asked_terms(index: Index, leaves: list[Leaf]) -> Asked:
    words = {t for q in leaves if q.kind == "phrase" for t in q.text.split()}
    df = {r["term"]: r["df"] for r in index.table("terms").where(F.col("term").isin(sorted(words))).collect()} if words else {}
    named = [(i, at, t, rarity(df.get(t, 0), index.n_docs)) for i, q in enumerate(leaves) if q.kind == "phrase" for at, t in enumerate(q.text.split())]
    more = None
    for i, q in enumerate(leaves):
        if q.kind == "phrase":
            continue
        found = stands_for(index, q)
        few = found.limit(NAMED_TERMS + 1).collect()
        if len(few) <= NAMED_TERMS:
            named += [(i, 0, r["term"], rarity(r["df"], index.n_docs) * r["share"]) for r in few]
        else:
            rest = found.select(F.lit(i).alias("leaf"), F.lit(0).alias("place"), "term", (rarity(F.col("df"), index.n_docs) * F.col("share")).alias("worth"))
            more = rest if more is None else more.unionByName(rest)
    return Asked(named, more)


def blocks_of(index: Index, asked: Asked, columns: list[str]) -> DataFrame:
    """The blocks of the asked terms with `leaf, place, worth` of what asks for them. Terms are named in the plan, so that
    only their folders and row groups are read; many that one leaf stands for are joined."""
    rows = index.table("postings").select("bucket", "term", "shard", *columns)
    terms, columns = sorted({t for _, _, t, _ in asked.named}), ["term", "shard", *columns]
    here = rows.where(F.col("bucket").isin(sorted({folder(t, index.buckets) for t in terms})) & F.col("term").isin(terms)).select(*columns)
    if not terms:
        found = None
    elif len(asked.named) > FEW_NAMED:
        found = here.join(F.broadcast(index.spark.createDataFrame(asked.named, "leaf int, place int, term string, worth double")), "term").select(*columns, "leaf", "place", "worth")
    else:
        by = F.array(*[F.struct(F.lit(i).alias("leaf"), F.lit(at).alias("place"), F.lit(t).alias("of"), F.lit(float(w)).alias("worth")) for i, at, t, w in asked.named])
        found = here.select(*columns, F.explode(F.filter(by, lambda a: a["of"] == F.col("term"))).alias("a")).select(*columns, "a.leaf", "a.place", "a.worth")
    if asked.more is None:
        return found
    joined = rows.drop("bucket").join(asked.more, "term").select(*columns, "leaf", "place", "worth")
    return joined if found is None else found.unionByName(joined)


def scores(index: Index, q: Query, asked: Asked, shards: DataFrame | list[int] | None = None) -> DataFrame:
    """`id, score` of all hits, in some shards only if these are given."""
    leaves = list(dict.fromkeys(leaves_of(q)))
    phrases = [x for x in leaves if x.kind == "phrase" and len(x.text.split()) > 1]
    columns = ["id", "tf", "n_terms", *(["positions"] if phrases else [])]
    rows = blocks_of(index, asked, columns)
    if isinstance(shards, list):
        rows = rows.where(F.col("shard").isin(shards))
    elif shards is not None:
        rows = rows.join(shards.select("shard"), "shard", "left_semi")
    rows = rows.select("shard", "leaf", "place", "worth", F.explode(F.arrays_zip(*columns)).alias("h")).select("shard", "leaf", "place", "worth", "h.*")
    own = F.col("worth") * weight(F.col("tf"), F.col("n_terms"), index.mean)
    aggs, of = [F.max("n_terms").alias("n_terms")], {}
    moved = lambda by: F.transform("positions", lambda p: p - by)
    for i, leaf in enumerate(leaves):
        mine = F.col("leaf") == i
        if leaf in phrases:
            size = len(leaf.text.split())
            places = [F.first(F.when(mine & (F.col("place") == j), moved(j)), ignorenulls=True) for j in range(size)]
            aggs += [p.alias(f"p{i}_{j}") for j, p in enumerate(places)] + [F.sum(F.when(mine, F.col("worth"))).alias(f"w{i}")]
            together = reduce(F.array_intersect, [F.col(f"p{i}_{j}") for j in range(size)])
            of[leaf] = F.when(F.size(together) > 0, F.col(f"w{i}") * weight(F.size(together), F.col("n_terms"), index.mean))
        else:
            aggs.append((F.max(F.when(mine, F.lit(1.0))) if leaf.kind == "prefix" else F.sum(F.when(mine, own))).alias(f"s{i}"))
            of[leaf] = F.col(f"s{i}")
    found = rows.groupBy("shard", "id").agg(*aggs).select("id", combined(q, of).alias("score"))
    return found.where(F.col("score").isNotNull())


def bounds(index: Index, q: Query, asked: Asked) -> DataFrame:
    """`shard, bound`: more than `bound` no text of a shard can score; shards that cannot have a hit are left out."""
    leaves = list(dict.fromkeys(leaves_of(q)))
    aggs, of = [], {}
    for i, leaf in enumerate(leaves):
        mine, size = F.col("leaf") == i, len(leaf.text.split())
        if leaf.kind == "phrase" and size > 1:
            aggs += [F.when(F.count_if(mine) == size, F.sum(F.when(mine, F.col("worth"))) * F.min(F.when(mine, F.col("top")))).alias(f"b{i}")]
        else:
            aggs.append((F.max(F.when(mine, F.lit(1.0))) if leaf.kind == "prefix" else F.sum(F.when(mine, F.col("worth") * F.col("top")))).alias(f"b{i}"))
        of[leaf] = F.col(f"b{i}")
    found = blocks_of(index, asked, ["top"]).groupBy("shard").agg(*aggs)
    return found.select("shard", combined(q, of, exclude=False).alias("bound")).where(F.col("bound").isNotNull())


def search(index: Index, query: Query | str, top_k: int = 5) -> DataFrame:
    """`id, score` of the `top_k` best hits, ties to the smaller id.

    In an index of many shards the ones with the greatest bounds are scored first; of the others only those are read
    whose bound is not below the last of the top hits found. The result is the same as from all.
    """
    q = keywords(index.spark, query) if isinstance(query, str) else query
    leaves = list(dict.fromkeys(leaves_of(q)))
    best = lambda hits: hits.orderBy(F.desc("score"), "id").limit(top_k)
    asked = asked_terms(index, leaves)
    if negative(q) or (not asked.named and asked.more is None):
        return index.spark.createDataFrame([], f"id {index.id_type}, score double")
    if index.n_shards <= FEW_SHARDS:
        return best(scores(index, q, asked))
    limits = scratch_table(bounds(index, q, asked), "fulltext-bounds")
    first = [r["shard"] for r in limits.orderBy(F.desc("bound"), "shard").limit(FIRST_SHARDS).collect()]
    found = best(scores(index, q, asked, first)).collect()
    if len(found) == top_k and top_k:
        limits = limits.where(F.col("bound") >= found[-1]["score"] * (1 - 1e-9))
    return best(scores(index, q, asked, limits))
