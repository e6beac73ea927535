"""A property graph as node and edge tables: upserts, checks and read queries."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_id, parse_articles, rel_type
from ..sources.tables import scratch_table
from .profile import keep_first
from .stored import Rows, StoredTable, all_rows, picked

# The columns of documents and chunks.
METADATA_COLUMNS = (
    "id title so_ky_hieu ngay_ban_hanh loai_van_ban ngay_co_hieu_luc ngay_het_hieu_luc nguon_thu_thap ngay_dang_cong_bao nganh linh_vuc co_quan_ban_hanh "
    "chuc_danh nguoi_ky pham_vi thong_tin_ap_dung tinh_trang_hieu_luc"
).split()
CHUNK_COLUMNS = "chunk_id doc_id chunk_index part_index articles text".split()

#: Rows of a frontier that are broadcast, at most (ids, and paths of a few hops); into how many parts the steps of a node
#: with more than HEAVY are salted beyond.
FRONTIER, SALTS, HEAVY = 20_000, 16, 100_000


def with_steps(steps: DataFrame, level: DataFrame, frontier: int | None = None) -> DataFrame:
    """The steps (`at, to` and more) from the nodes `at` of a stored frontier. A small one is broadcast, so that a node
    with very many steps is no single task's; a larger one is shuffled, and only such nodes are salted."""
    if level.count() <= (FRONTIER if frontier is None else frontier):
        return steps.join(F.broadcast(level), "at")
    most = F.broadcast(steps.groupBy("at").count().where(F.col("count") > HEAVY).select("at", F.lit(True).alias("heavy")))  # few
    dealt = steps.join(most, "at", "left").withColumn("salt", F.when(F.col("heavy"), F.pmod(F.xxhash64("to"), F.lit(SALTS))).otherwise(0)).drop("heavy")
    every = F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")
    copied = level.join(most, "at", "left").withColumn("salt", F.explode(F.when(F.col("heavy"), every).otherwise(F.array(F.lit(0).cast("bigint"))))).drop("heavy")
    return dealt.join(copied.hint("merge"), ["at", "salt"]).drop("salt")


def among(rows: DataFrame, column: str, ids: DataFrame, frontier: int | None = None) -> DataFrame:
    """The rows with a `column` among stored distinct `id`s. More of these than FRONTIER do not go through the driver."""
    known = ids.select(F.col("id").alias(column))
    few = ids.count() <= (FRONTIER if frontier is None else frontier)
    return rows.join(F.broadcast(known) if few else known.hint("merge"), column, "left_semi")


def id_column(df: DataFrame, name: str) -> Column:
    return normalize_id(F.col(name), df.schema[name].dataType.simpleString())


def with_metadata_columns(df: DataFrame) -> DataFrame:
    """`df` with the metadata columns in order; absent ones are null."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in METADATA_COLUMNS])


def upsert_nodes(rows: DataFrame, id_col: str, order: Column | str) -> DataFrame:
    """One node for each id: the last row in `order` sets all properties, also to null. Rows without an id go."""
    rows = rows.withColumn(id_col, id_column(rows, id_col)).where(F.col(id_col).isNotNull())
    return keep_first(rows, [id_col], F.desc(order) if isinstance(order, str) else order.desc())


def upsert_edges(rels: DataFrame, nodes: DataFrame, order: str | None = None) -> DataFrame:
    """`src, rel_type, dst, raw_label`: one edge for each triple whose ends both are nodes (`id`), with the last label."""
    edges = rels.select(id_column(rels, "doc_id").alias("src"), id_column(rels, "other_doc_id").alias("dst"), rel_type(F.col("relationship")).alias("rel_type"), F.col("relationship").alias("raw_label"), *([order] if order else []))
    ids = nodes.select(id_column(nodes, "id").alias("id")).distinct()
    both = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    last = F.max_by("raw_label", order) if order else F.max("raw_label")
    return both.groupBy("src", "rel_type", "dst").agg(last.alias("raw_label"))


def normalize_chunks(chunks: DataFrame, plain_suffix: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Chunk rows with ids as text, missing document ids and indexes taken from the chunk id (`_c<n>`; `_<n>` too with
    `plain_suffix`), part 0 for none, and articles as an array. An index that cannot be found is an error."""
    mark = r"_c?(\d+)$" if plain_suffix else r"_c(\d+)$"
    chunk_id = id_column(chunks, "chunk_id")
    doc = F.regexp_replace(chunk_id, r"_c?\d+$", "") if plain_suffix else F.split(chunk_id, "_c")[0]
    index = F.coalesce(F.expr("try_cast(chunk_index AS bigint)"), F.expr("try_cast(nullif(regexp_extract(chunk_id, '" + mark.replace("\\", "\\\\") + "', 1), '') AS bigint)"))
    return chunks.select(
        chunk_id.alias("chunk_id"), F.coalesce(id_column(chunks, "doc_id"), doc).alias("doc_id"),
        F.coalesce(index, F.raise_error(F.concat(F.lit("no chunk_index for "), chunk_id)).cast("bigint")).alias("chunk_index"),
        F.coalesce(F.expr("try_cast(part_index AS bigint)"), F.lit(0)).cast("bigint").alias("part_index"), parse_articles(F.col("articles")).alias("articles"), "text", *keep,
    )


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    return df


def part_of(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """`chunk_id, doc_id` of the chunks whose document exists."""
    ids = documents.select(id_column(documents, "id").alias("doc_id")).distinct()
    return chunks.join(ids, "doc_id", "left_semi").select("chunk_id", "doc_id")


def content_as_chunks(content: DataFrame, text_col: str = "text") -> DataFrame:
    """One chunk for each document; rows without an id go."""
    doc = id_column(content, "id")
    return content.where(F.col("id").isNotNull()).select(F.concat(doc, F.lit("_c0")).alias("chunk_id"), doc.alias("doc_id"), F.lit(0).cast("long").alias("chunk_index"), F.lit(0).cast("long").alias("part_index"), F.array().cast("array<string>").alias("articles"), F.col(text_col).alias("text"))


def uniqueness(df: DataFrame, key: str) -> DataFrame:
    """Keys that more than one row has."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def verify_part_of(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    ids = documents.select(id_column(documents, "id").alias("doc_id"), F.lit(True).alias("known")).distinct()
    return chunks.join(ids, "doc_id", "left").agg(F.count("*").alias("n_chunks"), F.count("known").alias("n_connected"), F.count_if(F.col("known").isNull()).alias("n_orphans"))


def orphans(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    return chunks.join(documents.select(id_column(documents, "id").alias("doc_id")), "doc_id", "left_anti")


def relationship_summary(edges: DataFrame, links: DataFrame) -> DataFrame:
    """Edges by type, those from chunks to documents too, most first."""
    kinds = edges.select(F.lit("Document").alias("from_label"), "rel_type", F.lit("Document").alias("to_label"))
    parts = links.select(F.lit("Chunk").alias("from_label"), F.lit("PART_OF").alias("rel_type"), F.lit("Document").alias("to_label"))
    return kinds.unionByName(parts).groupBy("from_label", "rel_type", "to_label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rel_type")


def legal_status(documents: DataFrame, edges: DataFrame, doc_id: object) -> DataFrame:
    """The document with a list of its outgoing relations; one all-null entry if it has none, no row if it is unknown."""
    own = documents.where(F.col("id") == str(doc_id).strip())
    to = documents.select(F.col("id").alias("other_id"), F.col("title").alias("other_title"))
    out = own.join(edges, own["id"] == edges["src"], "left").join(to, F.col("dst") == F.col("other_id"), "left")
    return out.groupBy("id", own["title"], "tinh_trang_hieu_luc").agg(F.sort_array(F.collect_list(F.struct("rel_type", "other_id", "other_title"))).alias("quan_he"))


def incoming_relations(documents: DataFrame, edges: DataFrame, doc_id: object) -> DataFrame:
    names = documents.select(F.col("id").alias("other_id"), F.col("title").alias("other_title"))
    return edges.where(F.col("dst") == str(doc_id).strip()).join(names, F.col("src") == F.col("other_id")).select("rel_type", "other_id", "other_title")


def both_ways(edges: DataFrame) -> DataFrame:
    there = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "rel_type")
    return there.unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "rel_type"))


def steps_of(edges: DataFrame) -> DataFrame:
    """`a, b, rel_type`: one step in each direction for two documents with an edge, with the least type."""
    return both_ways(edges).groupBy("a", "b").agg(F.min("rel_type").alias("rel_type"))


def shortest_path(documents: Rows, steps: Rows, start: object, goal: object, max_hops: int = 4) -> DataFrame:
    """`hops, path, titles, rel_types` of the shortest undirected path, of several the one whose ids come first; no row if
    there is none of at most `max_hops`. `path` has ids, `titles` what `documents` calls them. `steps` is a stored table
    of steps, or that of `steps_of`.

    Both ends are searched, always the one with fewer nodes at its rim, until the rims meet. A hop reads the steps of the
    nodes at one rim, by name where they are few; rims are stored, and a node keeps one path, the first by ids. In an
    undirected graph what a rim reaches lies in it, in the one before, or is new, so only these two are compared.
    """
    ends = str(start).strip(), str(goal).strip()
    known_ends = scratch_table(picked(documents, "id", ends).select("id").distinct(), "path-ends")
    first = [known_ends.where(F.col("id") == end).select("id", F.array("id").alias("path"), F.array().cast("array<string>").alias("rel_types")) for end in ends]
    rims, before, sizes = [scratch_table(f, "path-rim") for f in first], [f.select("id").limit(0) for f in first], [1, 1]
    there = rims[1].select("id", F.col("path").alias("rest"), F.col("rel_types").alias("rest_types"))
    met = rims[0].join(there, "id")
    for _ in range(max_hops):
        if not met.isEmpty():
            break
        side = 0 if sizes[0] <= sizes[1] else 1
        near = picked(steps, "a", rims[side].select("id"))
        step = rims[side].withColumnRenamed("id", "a").join(near, "a")
        if side == 0:
            grown = step.select(F.col("b").alias("id"), F.array_append("path", F.col("b")).alias("path"), F.array_append("rel_types", F.col("rel_type")).alias("rel_types"))
        else:
            grown = step.select(F.col("b").alias("id"), F.array_prepend("path", F.col("b")).alias("path"), F.array_prepend("rel_types", F.col("rel_type")).alias("rel_types"))
        known = rims[side].select("id").unionByName(before[side])
        grown = grown.join(known, "id", "left_anti").groupBy("id").agg(F.min(F.struct("path", "rel_types")).alias("p")).select("id", "p.path", "p.rel_types")
        before[side], rims[side] = rims[side].select("id"), scratch_table(grown, "path-rim")
        sizes[side] = rims[side].count()
        if not sizes[side]:
            break
        met = rims[0].join(rims[1].select("id", F.col("path").alias("rest"), F.col("rel_types").alias("rest_types")), "id")
    whole = F.struct(F.concat("path", F.slice("rest", 2, F.size("rest"))).alias("path"), F.concat("rel_types", "rest_types").alias("rel_types"))
    best = met.agg(F.min(whole).alias("p")).where("p IS NOT NULL").select("p.*")
    best = scratch_table(best, "path-best")  # one row
    on_path = [i for r in best.select("path").collect() for i in r["path"]]
    names = picked(documents, "id", on_path).select("id", "title")
    placed = best.select(F.posexplode("path").alias("at", "id")).join(names, "id").agg(F.sort_array(F.collect_list(F.struct("at", "title"))).alias("named"))
    named = placed.select(F.transform("named", lambda n: n["title"]).alias("titles"))  # one row
    return best.join(F.broadcast(named), F.lit(True)).select((F.size("path") - 1).cast("long").alias("hops"), "path", "titles", "rel_types")


def shortest_paths(documents: Rows, steps: Rows, pairs: DataFrame, max_hops: int = 4) -> DataFrame:
    """`a, b, hops, path, titles, rel_types` of a table of pairs (`a, b`): what `shortest_path` gives for each, all at once.

    The searches go out from all distinct `a` and from all distinct `b` together; a row of a rim is an end and a node that
    it reached, with the first path by ids. The smaller rim grows, so a path is searched to half its length from each end.
    Ends whose pairs are all found stop. A rim of up to FRONTIER rows is broadcast to the steps; beyond, steps are shuffled
    and those of nodes with very many salted.
    """
    every = all_rows(steps).select(F.col("a").alias("at"), F.col("b").alias("to"), "rel_type")
    asked = scratch_table(pairs.select(*[F.trim(F.col(c).cast("string")).alias(c) for c in ("a", "b")]).distinct(), "paths-asked")
    known = picked(documents, "id", asked.select("a").union(asked.select("b"))).select("id").distinct()
    left = scratch_table(asked.join(known.withColumnRenamed("id", "a"), "a", "left_semi").join(known.withColumnRenamed("id", "b"), "b", "left_semi"), "paths-left")
    none = F.array().cast("array<string>")
    rims = [scratch_table(left.select(F.col(end).alias("src"), F.col(end).alias("at"), F.array(end).alias("path"), none.alias("rel_types")).distinct(), "paths-rim") for end in ("a", "b")]
    before, hits, sizes = [rim.select("src", "at").limit(0) for rim in rims], [], [rim.count() for rim in rims]
    for hop in range(max_hops + 1):
        if hop:
            side = 0 if sizes[0] <= sizes[1] else 1
            step, add = with_steps(every, rims[side], FRONTIER), (F.array_append, F.array_prepend)[side]
            grown = step.select("src", F.col("to").alias("at"), add("path", F.col("to")).alias("path"), add("rel_types", F.col("rel_type")).alias("rel_types"))
            grown = grown.join(rims[side].select("src", "at").unionByName(before[side]), ["src", "at"], "left_anti")
            grown = grown.groupBy("src", "at").agg(F.min(F.struct("path", "rel_types")).alias("p")).select("src", "at", "p.*")
            before[side], rims[side] = rims[side].select("src", "at"), scratch_table(grown, "paths-rim")
        one, other = (rim.select(F.col("src").alias(end), "at", F.struct("path", "rel_types").alias(f"from_{end}")) for rim, end in zip(rims, ("a", "b")))
        whole = F.struct(F.concat("from_a.path", F.slice("from_b.path", 2, F.size("from_b.path"))).alias("path"), F.concat("from_a.rel_types", "from_b.rel_types").alias("rel_types"))
        met = one.join(left, "a").join(other, ["b", "at"]).groupBy("a", "b").agg(F.min(whole).alias("p")).select("a", "b", "p.*")
        hits.append(scratch_table(met, "paths-hits"))
        left = scratch_table(left.join(hits[-1], ["a", "b"], "left_anti"), "paths-left")
        if left.isEmpty():
            break
        rims = [scratch_table(rim.join(left.select(F.col(end).alias("src")).distinct(), "src", "left_semi"), "paths-rim") for rim, end in zip(rims, ("a", "b"))]
        sizes = [rim.count() for rim in rims]
        if not min(sizes):
            break
    found = scratch_table(reduce(lambda x, y: x.unionByName(y), hits), "paths-found")
    nodes = found.select("a", "b", F.posexplode("path").alias("place", "id"))
    names = picked(documents, "id", nodes.select("id")).select("id", "title")
    titles = nodes.join(names, "id").groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("place", "title"))).alias("named"))
    told = titles.select("a", "b", F.transform("named", lambda x: x["title"]).alias("titles"))
    return found.join(told, ["a", "b"]).select("a", "b", (F.size("path") - 1).cast("long").alias("hops"), "path", "titles", "rel_types")


def around(edges: Rows, keys: list[str] | DataFrame) -> DataFrame:
    """`at, to`: the undirected steps from some documents, of a stored table of steps or of plain edges."""
    if isinstance(edges, StoredTable):
        return edges.picked(keys).select(F.col("a").alias("at"), F.col("b").alias("to"))
    ends = [("src", "dst"), ("dst", "src")]
    one, other = (picked(edges.select(F.col(a).alias("at"), F.col(b).alias("to")), "at", keys) for a, b in ends)
    return one.unionByName(other)


def neighbours(edges: Rows, sources: list[str], hops: int = 1) -> DataFrame:
    """`id, other`: documents within `hops` undirected steps of each of a few sources. Each hop takes the edges of what it
    has reached before anything is made distinct."""
    spark = edges.spark if isinstance(edges, StoredTable) else edges.sparkSession
    level, found = spark.createDataFrame([(s, s) for s in sorted(set(sources))], "id string, at string"), None
    for hop in range(hops):
        near = around(edges, level.select("at") if hop else sources)
        level = level.join(near, "at").select("id", F.col("to").alias("at")).distinct()
        level = scratch_table(level, "neighbours") if hop + 1 < hops else level
        found = level if found is None else found.unionByName(level).distinct()
    return found.select("id", F.col("at").alias("other"))


def search_by_article(chunks: DataFrame, documents: DataFrame, doc_id: object, article: object, part: int | None = None) -> DataFrame:
    rows = chunks.where((F.col("doc_id") == str(doc_id).strip()) & F.array_contains("articles", str(article)))
    rows = rows if part is None else rows.where(F.col("part_index") == part)
    names = documents.select(F.col("id").alias("doc_id"), "title")
    return rows.join(names, "doc_id").select("title", "part_index", "chunk_index", "articles", "text").orderBy("part_index", "chunk_index")


def document_parts(chunks: DataFrame, doc_id: object | None = None) -> DataFrame:
    """`part_index, num_chunks, articles` of each part, articles sorted as text."""
    rows = chunks if doc_id is None else chunks.where(F.col("doc_id") == str(doc_id).strip())
    keys = ["doc_id", "part_index"] if doc_id is None else ["part_index"]
    return rows.groupBy(*keys).agg(F.count("*").alias("num_chunks"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("articles")))).alias("articles")).orderBy(*keys)


def expired_guidance(documents: DataFrame, edges: DataFrame, doc_id: object, expired: str, rel_types: list[str] | None = None) -> DataFrame:
    """Documents of the status `expired` with a relation to `doc_id`."""
    rows = edges.where(F.col("dst") == str(doc_id).strip())
    rows = rows if rel_types is None else rows.where(F.col("rel_type").isin(rel_types))
    return rows.join(documents.where(F.col("tinh_trang_hieu_luc") == expired), F.col("src") == F.col("id")).select("id", "title", "rel_type").distinct()


def denormalized_edges(rels: DataFrame, meta: DataFrame) -> DataFrame:
    """Relations with the metadata of both ends: `doc_*` of the citing document, plain names of the cited one."""
    rels = rels.withColumns({c: id_column(rels, c) for c in ("doc_id", "other_doc_id")})
    meta = meta.withColumn("id", id_column(meta, "id"))
    own = meta.withColumnsRenamed({c: f"doc_{c}" for c in meta.columns}).withColumnRenamed("doc_id", "doc_id_")
    return rels.join(own, F.col("doc_id") == F.col("doc_id_"), "left").join(meta, F.col("other_doc_id") == F.col("id"), "left")


def build_graph(metadata: DataFrame, relationships: DataFrame, chunks: DataFrame | None = None, content: DataFrame | None = None, *, order: str | None = None, indexes: bool = True) -> dict[str, DataFrame]:
    """Nodes, edges and chunks of a graph from its tables. Of `chunks` and `content` one may be given; with neither there
    are no chunks, and a warning. Edges whose ends are not both documents go, and of chunks only those of documents are
    linked.

    Of rows with one id the last by the column `order`, which all tables must have then, sets all properties; without it
    the greatest by all columns does, so that the result does not depend on how files are laid out. `indexes` adds the
    search terms of titles and, where there are chunks, of chunk texts.
    """
    from .search import fulltext_index

    if chunks is not None and content is not None:
        raise ValueError("chunks and content exclude each other")
    if chunks is None and content is None:
        warnings.warn("neither chunks nor content: the graph will have no chunks", stacklevel=2)

    def last(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_at", F.col(order) if order else F.struct(*[F.col(f"`{c}`").cast("string") for c in rows.columns]))

    metadata = last(metadata)
    documents = with_metadata_columns(metadata).columns
    nodes = metadata.select(*[F.col(c) if c in metadata.columns else F.lit(None).cast("string").alias(c) for c in documents], "_at")
    nodes = upsert_nodes(nodes, "id", "_at").drop("_at")
    graph = {"documents": nodes, "edges": upsert_edges(last(relationships), nodes, "_at")}
    if chunks is not None:
        rows = last(require_columns(chunks, CHUNK_COLUMNS))
        graph["chunks"] = upsert_nodes(normalize_chunks(rows, keep=("_at",)), "chunk_id", "_at").drop("_at")
    elif content is not None:
        graph["chunks"] = content_as_chunks(content)
    if "chunks" in graph:
        graph["part_of"] = part_of(graph["chunks"], nodes)
    if indexes:
        graph["title_terms"] = fulltext_index(nodes, "id", "title")
        if "chunks" in graph:
            graph["chunk_terms"] = fulltext_index(graph["chunks"], "chunk_id", "text")
    return graph
