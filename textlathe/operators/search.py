"""Retrieval: an inverted index with BM25, exact vector search, and both with the graph around the hits."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.tables import scratch_table
from .encoder import fit_encoder
from .fulltext import K1, B, Index, Query, postings, search
from .graph import neighbours
from .stored import Rows, StoredTable, all_rows, picked


def fulltext_index(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`term, id, tf, n_terms`: the postings of all texts with their lengths; ids are meant to be unique."""
    return postings(df, id_col, text_col)


def keyword_scores(df: DataFrame, id_col: str, text_col: str, keyword: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """`id, score` (BM25) and the columns `keep` of the texts that hold a term of `keyword`; statistics are over all texts.

    One scan reads the texts: of each it stores how many terms it has and how often those of the keyword are among them.
    Statistics (one row) and scores come from these numbers, without a join or a shuffle of terms.
    """
    spark = df.sparkSession
    terms = spark.range(1).select(F.array_distinct(tokens(F.lit(keyword)))).first()[0]
    found = F.filter("terms", lambda x: x.isin(terms)) if terms else F.array().cast("array<string>")
    base = df.select(F.col(id_col).alias("id"), *keep, tokens(F.col(text_col)).alias("terms")).select("id", *keep, F.size("terms").alias("n_terms"), found.alias("found"))
    counts = F.transform(F.array(*map(F.lit, terms)), lambda t: F.size(F.filter("found", lambda x: x == t))) if terms else F.array().cast("array<int>")
    stored = scratch_table(base.select("id", *keep, "n_terms", counts.alias("tf")), "keyword-counts")
    stats = stored.agg(F.count("*").alias("n_docs"), F.avg("n_terms").alias("mean"), *[F.count_if(F.col("tf")[i] > 0).alias(f"df{i}") for i in range(len(terms))]).first()
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = math.log(1 + (stats["n_docs"] - stats[f"df{i}"] + 0.5) / (stats[f"df{i}"] + 0.5))
        tf = F.col("tf")[i]
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("n_terms") / (stats["mean"] or 1.0)))
    return stored.where(F.exists("tf", lambda n: n > 0)).select("id", *keep, score.alias("score"))


def keyword_search(df: DataFrame, id_col: str, text_col: str, keyword: str, top_k: int = 5) -> DataFrame:
    return keyword_scores(df, id_col, text_col, keyword).orderBy(F.desc("score"), "id").limit(top_k)


def with_chunks(hits: list[Row], chunks: Rows, documents: Rows) -> DataFrame:
    """Hits (`id` of a chunk, `score`; at most some top k) with their chunks and documents, best first. Chunks and
    documents are looked up by id, so of stored tables only their folders are read."""
    spark = chunks.spark if isinstance(chunks, StoredTable) else chunks.sparkSession
    found = spark.createDataFrame([(r["id"], r["score"]) for r in hits], "chunk_id string, score double")
    own = picked(chunks, "chunk_id", [r["id"] for r in hits])
    names = picked(documents, "id", own.select("doc_id")).select(F.col("id").alias("doc_id"), "title", "tinh_trang_hieu_luc")
    rows = own.join(F.broadcast(found), "chunk_id").join(names, "doc_id")
    return rows.select("doc_id", "title", F.col("tinh_trang_hieu_luc").alias("tinh_trang"), "part_index", "chunk_index", "articles", "text", "score").orderBy(F.desc("score"), "doc_id", "chunk_index")


def keyword_hits(chunks: Rows, keyword: str | Query, top_k: int, index: Index | None) -> list[Row]:
    """The best chunks by the index; without one the texts are read once, for words alone."""
    if index:
        return search(index, keyword, top_k).collect()
    if not isinstance(keyword, str):
        raise ValueError("queries other than words need an index")
    return keyword_search(all_rows(chunks), "chunk_id", "text", keyword, top_k).collect()


def search_by_keyword(chunks: Rows, documents: Rows, keyword: str | Query, top_k: int = 5, index: Index | None = None) -> DataFrame:
    """The best chunks of known documents for a keyword line or a query, with their documents. More hits are asked for
    until enough of them are of known documents."""
    most = 2 * top_k
    while True:
        hits = keyword_hits(chunks, keyword, most, index)
        own = picked(chunks, "chunk_id", [r["id"] for r in hits]).select("chunk_id", "doc_id")
        known = {r["chunk_id"] for r in own.join(picked(documents, "id", own.select("doc_id")).select(F.col("id").alias("doc_id")), "doc_id", "left_semi").collect()}
        if len(known) >= top_k or len(hits) < most:
            return with_chunks([r for r in hits if r["id"] in known][:top_k], chunks, documents)
        most *= 8


def search_by_vector(chunks: Rows, documents: Rows, vectors: DataFrame, query: list[float], top_k: int = 5) -> DataFrame:
    """The chunks nearest to a vector by (1 + cosine) / 2, with their documents; `vectors` has `chunk_id, embedding`. Of
    the top k those of no document go."""
    return with_chunks(vector_search(vectors, "chunk_id", "embedding", query, top_k, halved=True).collect(), chunks, documents).drop("tinh_trang")


def embedding_search(vectors: DataFrame, meta: DataFrame, query: list[float], top_k: int = 5) -> DataFrame:
    """`score, chunk_id, doc_id, articles, text` of the vectors (`vector_id, embedding`) nearest to a query; hits without
    metadata are skipped."""
    hits = scratch_table(vector_search(vectors, "vector_id", "embedding", query, top_k), "embedding-hits")
    return meta.join(F.broadcast(hits.withColumnRenamed("id", "vector_id")), "vector_id").select("score", "chunk_id", "doc_id", "articles", "text").orderBy(F.desc("score"), "chunk_id")


def dot(vector: Column, query: list[float]) -> Column:
    q = F.array(*[F.lit(float(x)) for x in query])
    return F.aggregate(F.zip_with(vector, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(vector: Column) -> Column:
    """The vector by its length, which is told once for all components; a zero vector stays."""
    scaled = lambda n: F.transform(vector, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0))
    return F.element_at(F.transform(F.array(norm(vector)), scaled), 1)


def vector_index(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """`vector_id, embedding` of the vectors that are there, as an exact search reads them."""
    return df.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("vector_id"), F.col(vector_col).cast("array<float>").alias("embedding"))


def vector_search(vectors: DataFrame, id_col: str, vector_col: str, query: list[float], top_k: int = 5, halved: bool = False) -> DataFrame:
    """`id, score`: the exact top by inner product of unit vectors; `halved` gives (1 + score) / 2."""
    sized = vectors.select(F.col(id_col).alias("id"), dot(F.col(vector_col), query).alias("dot"), norm(F.col(vector_col)).alias("norm"))
    score = F.when(F.col("norm") > 0, F.col("dot") / F.col("norm")).otherwise(0.0)
    rows = sized.select("id", ((1 + score) / 2 if halved else score).alias("score"))
    return rows.orderBy(F.desc("score"), "id").limit(top_k)


def hybrid_retrieve(chunks: Rows, documents: Rows, edges: Rows, keyword: str | Query, top_k: int = 5, hops: int = 1, most: int = 5, index: Index | None = None) -> DataFrame:
    """The best chunks for a keyword with their documents and up to `most` titles of documents around each. `edges` are
    plain ones or a stored table of steps."""
    found = scratch_table(with_chunks(keyword_hits(chunks, keyword, top_k, index), chunks, documents).drop("tinh_trang"), "hybrid-found")
    near = scratch_table(neighbours(edges, [r[0] for r in found.select("doc_id").distinct().collect()], hops), "hybrid-near")
    titles = near.join(picked(documents, "id", near.select("other")).select(F.col("id").alias("other"), F.col("title").alias("other_title")), "other")
    titles = titles.groupBy(F.col("id").alias("doc_id")).agg(F.slice(F.sort_array(F.collect_set("other_title")), 1, most).alias("related_docs"))
    columns = ["doc_id", "title", "part_index", "chunk_index", "articles", F.col("text").alias("chunk_text"), "score", F.coalesce("related_docs", F.array().cast("array<string>")).alias("related_docs")]
    return found.join(titles, "doc_id", "left").select(*columns).orderBy(F.desc("score"), "doc_id", "chunk_index")


def encode_texts(df: DataFrame, id_col: str, text_col: str, encoder=None, batch: int = 64) -> DataFrame:
    """`vector_id, embedding` from any function of a list of texts to a matrix, called with `batch` texts at a time; without
    one from an encoder that is fitted to these texts."""
    encoder = encoder or fit_encoder(df, text_col)
    shared = df.sparkSession.sparkContext.broadcast(encoder)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                yield pd.DataFrame({"vector_id": part["vector_id"], "embedding": list(shared.value(part["text"].tolist()))})

    return df.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("vector_id"), F.col(text_col).alias("text")).mapInPandas(run, "vector_id long, embedding array<float>")
