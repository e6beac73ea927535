"""Queries that cut documents into parts, articles, clauses, windows and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import profile as P
from ..operators import segment as S
from ..sources import adapters as A
from ..sources.tables import scratch_path, table
from .registry import query

TRIM = r"E' \t\n\r'"
#: The white space that TRIM takes away: the SQL of windows leaves that of other scripts at their ends.
BLANKS = " \t\n\r"
CLAUSE = r"\n\s*(?:\d+[.)]|[a-zA-ZđĐ][.)])\s"
PARAGRAPH = r"\n\s*\n+"
ARTICLE = {1: r"Điều\s+\d+[a-zA-Z]?\s*[:.]", 2: r"(?:^|\n)\s*[Đđ][Ii][Ềề][Uu]\s+\d+"}
PART = r"QUY\s*ĐỊNH\s*:|QUY\s*CHẾ\s*:|NỘI\s*QUY\s*:|ĐIỀU\s*LỆ\s*:|QUY\s*TRÌNH\s*:"


def pieces_sql(text: str, at: str) -> str:
    """The pieces of a text, each from a match on."""
    return f"list_filter(list_transform(string_split(regexp_replace({text}, '({at})', chr(1) || '\\1', 'g'), chr(1)), lambda x: trim(x, {TRIM})), lambda x: x <> '')"


def paragraphs_sql(text: str) -> str:
    return f"list_filter(list_transform(string_split_regex({text}, '{PARAGRAPH}'), lambda x: trim(x, {TRIM})), lambda x: x <> '')"


def exploded_sql(source: str, keys: str, pieces: str, at: str, more: str = "") -> str:
    """Rows `keys, at, text` (and `more`) of the pieces of each row, `at` from 0."""
    return f"SELECT {keys}, i - 1 AS {at}, pieces[i] AS text{more} FROM (SELECT *, {pieces} AS pieces FROM {source}), unnest(range(1, len(pieces) + 1)) u(i)"


def end_sql(version: int, size: int = S.MAX_CHARS) -> str:
    """Where the window of `text` (n characters) ends that starts at s."""
    e0 = f"least(s + {size}, n)"
    back = f"reverse(substr(text, s + 1, {e0} - s))"
    marks = ["chr(10)", "' '"] if version == 2 else ["' '"]
    ends = [f"CASE WHEN instr({back}, {m}) > 0 AND {e0} - instr({back}, {m}) > s THEN {e0} - instr({back}, {m}) END" for m in marks]
    return f"CASE WHEN {e0} = n THEN n ELSE coalesce({', '.join(ends)}, {e0}) END"


def windows_sql(name: str, source: str, keys: str, version: int, whole: str | None = "text", size: int = S.MAX_CHARS, overlap: int = S.OVERLAP) -> str:
    """Tables that end in `name`: `keys, w, text, articles` of the windows of `source` (`keys, text, articles`). `whole`
    is the only window of a text that fits."""
    k, step = keys, f"CASE WHEN e - {overlap} > s THEN e - {overlap} ELSE e END"
    window = f"trim(substr(text, s + 1, e - s), {TRIM})"
    piece, goes_on = (f"CASE WHEN n <= {size} THEN {whole} ELSE {window} END", f"n > {size} AND") if whole else (window, "")
    kept = f"piece <> '' OR n <= {size}" if whole else "piece <> ''"
    return f"""{name}_r AS (
        SELECT {k}, text, articles, n, 0::BIGINT AS w, 0::BIGINT AS s, CAST({end_sql(version, size)} AS BIGINT) AS e FROM (SELECT *, length(text) AS n, 0 AS s FROM {source}) WHERE n > 0
        UNION ALL SELECT {k}, text, articles, n, w, s, CAST({end_sql(version, size)} AS BIGINT) FROM (SELECT {k}, text, articles, n, w + 1 AS w, {step} AS s FROM {name}_r WHERE {goes_on} {step} < n)),
        {name} AS (SELECT {k}, w, piece AS text, articles FROM (SELECT *, {piece} AS piece FROM {name}_r) WHERE {kept})"""


def fold_sql(name: str, source: str, keys: str, order: str, joins: str, gathers: str = "list_concat(a.articles, b.articles)") -> str:
    """Tables that end in `name`: `keys, g, text, articles`, where a row of `source` is added to what is gathered before
    while `joins` holds of a (the gathered) and b (the row)."""
    on, ks = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", ")), ", ".join(f"b.{k}" for k in keys.split(", "))
    return f"""{name}_i AS (SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS i, text, articles FROM {source}),
        {name}_r AS (SELECT {keys}, i, text, articles, 1::BIGINT AS g FROM {name}_i WHERE i = 1
        UNION ALL SELECT {ks}, b.i, CASE WHEN {joins} THEN a.text || chr(10) || b.text ELSE b.text END, CASE WHEN {joins} THEN {gathers} ELSE b.articles END,
            a.g + CASE WHEN {joins} THEN 0 ELSE 1 END FROM {name}_r a JOIN {name}_i b ON {on} AND b.i = a.i + 1),
        {name} AS (SELECT {keys}, g, arg_max(text, i) AS text, arg_max(articles, i) AS articles FROM {name}_r GROUP BY {keys}, g)"""


def units_sql(name: str, source: str, keys: str, version: int) -> str:
    """`keys, u, text, articles`: what windows are cut from."""
    size = S.MAX_CHARS
    if version == 1:
        cut = pieces_sql("text", CLAUSE)
        return f"{name} AS ({exploded_sql(source, keys, f'CASE WHEN length(text) <= {size} THEN [text] ELSE {cut} END', 'u', ', articles')})"
    clauses = pieces_sql("p", CLAUSE)
    cut = f"flatten(list_transform({paragraphs_sql('text')}, lambda p: CASE WHEN length(p) > {size} THEN {clauses} ELSE [p] END))"
    return f"{name} AS ({exploded_sql(source, keys, f'CASE WHEN length(trim(text, {TRIM})) <= {size} THEN list_filter([trim(text, {TRIM})], lambda z: length(z) > 0) ELSE {cut} END', 'u', ', articles')})"


def chunks_sql(version: int) -> str:
    """Tables that end in `merged`: `id, part_index, g, text, articles` of the chunks of `legal`."""
    clean = r"regexp_replace(regexp_replace(text, '\.{4,}|_{4,}', ' [...] ', 'g'), '[ \t]{2,}', ' ', 'g')"
    number = r"nullif(regexp_extract(text, '(?i)^\s*điều\s+(\d+[a-z]?)', 1), '')"
    tagged = f"CASE WHEN {number} IS NULL THEN []::VARCHAR[] ELSE [{number}] END"
    tag = f"CASE WHEN n_pieces > 1 THEN {tagged} ELSE []::VARCHAR[] END" if version == 2 else tagged
    pieces = pieces_sql("text", ARTICLE[version])
    whole = f"CASE WHEN len({pieces}) > 1 THEN {pieces} ELSE [text] END" if version == 2 else pieces
    merges = f"length(a.text) < {S.MIN_CHARS}" + (f" AND length(a.text) + 1 + length(b.text) <= {S.MAX_CHARS}" if version == 2 else "")
    steps = [
        f"cleaned AS (SELECT id, trim(regexp_replace({clean}, '\\n[ \\t]*\\n+', chr(10) || chr(10), 'g'), {TRIM}) AS text FROM legal)",
        f"parts AS ({exploded_sql('cleaned', 'id', pieces_sql('text', PART), 'part_index')})",
        f"pieces AS (SELECT id, part_index, a, text, {tag} AS articles FROM ({exploded_sql('parts', 'id, part_index', whole, 'a', ', len(pieces) AS n_pieces')}))",
        units_sql("units", "pieces", "id, part_index, a", version),
        windows_sql("windows", "units", "id, part_index, a, u", version),
    ]
    if version == 1:
        # a unit that fits stays as it is; pieces of one article are packed again
        steps.append(fold_sql("packed", "windows", "id, part_index, a", "u, w", f"length(a.text) + length(b.text) <= {S.MAX_CHARS}", gathers="a.articles"))
        steps.append(fold_sql("merged", "packed", "id, part_index", "a, g", merges))
    else:
        steps.append(fold_sql("merged", "windows", "id, part_index", "a, u, w", merges))
    return "WITH RECURSIVE " + ",\n".join(steps)


CHUNKS = {v: chunks_sql(v) for v in (1, 2)}
NUMBERED = "row_number() OVER (PARTITION BY id ORDER BY part_index, g) - 1"
CHUNK_ROWS = f"SELECT id || '_' || ({NUMBERED}) AS chunk_id, id AS doc_id, {NUMBERED} AS chunk_index, part_index, CASE WHEN len(articles) = 0 THEN NULL ELSE array_to_string(articles, ',') END AS articles, text FROM merged"


@query(exploded_sql("legal", "id", pieces_sql("text", PART), "part_index"), "legal")
def split_parts(spark, sf):
    rows = A.legal(spark, sf).select("id", F.posexplode(X.part_pieces(F.col("text"))).alias("part_index", "text"))
    return rows.withColumn("part_index", F.col("part_index").cast("bigint"))


@query("SELECT CAST(doc_id AS BIGINT) AS id, part_index, chunk_index, array_to_string(articles, ',') AS article, text FROM article_chunks", "article_chunks")
def split_articles(spark, sf):
    return A.article_chunks(spark, sf).select(F.col("doc_id").cast("bigint").alias("id"), "part_index", "chunk_index", F.array_join("articles", ",").alias("article"), "text")


@query(exploded_sql("legal", "id", pieces_sql("text", ARTICLE[1]), "pos"), "legal")
def split_articles_v1(spark, sf):
    rows = A.legal(spark, sf).select("id", F.posexplode(X.article_pieces(F.col("text"), 1)).alias("pos", "text"))
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


@query(exploded_sql("(SELECT doc_id, replace(text, ', ', chr(10) || ' b) ') AS text FROM documents)", "doc_id", pieces_sql("text", CLAUSE), "pos"))
def split_clauses(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit(", "), F.lit("\n b) ")).alias("text"))
    return rows.select("doc_id", F.posexplode(X.clause_pieces(F.col("text"))).alias("pos", "text")).withColumn("pos", F.col("pos").cast("bigint"))


@query(exploded_sql("(SELECT doc_id, replace(text, '.' || chr(10), '.' || chr(10) || ' ' || chr(10)) AS text FROM documents)", "doc_id", paragraphs_sql("text"), "pos"))
def split_paragraphs(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit(".\n"), F.lit(".\n \n")).alias("text"))
    return rows.select("doc_id", F.posexplode(X.paragraph_pieces(F.col("text"))).alias("pos", "text")).withColumn("pos", F.col("pos").cast("bigint"))


PLAIN = "(SELECT doc_id, text, []::VARCHAR[] AS articles FROM documents)"


@query("WITH RECURSIVE " + windows_sql("windows", PLAIN, "doc_id", 2, whole=f"trim(text, {TRIM})") + " SELECT doc_id, w AS pos, text FROM windows")
def word_windows(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(S.window_array(F.col("text"), blanks=BLANKS)).alias("pos", "text"))
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


@query("WITH RECURSIVE " + windows_sql("windows", PLAIN, "doc_id", 1, whole=None) + " SELECT doc_id, w AS pos, text FROM windows")
def word_windows_v1(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(S.window_array(F.col("text"), version=1, blanks=BLANKS)).alias("pos", "text"))
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


MARKED = "(SELECT doc_id, replace(replace(text, '.' || chr(10), '.' || chr(10) || chr(10)), '; ', chr(10) || '1) ') AS text, []::VARCHAR[] AS articles FROM documents)"


@query("WITH RECURSIVE " + units_sql("units", MARKED, "doc_id", 2) + ", " + windows_sql("windows", "units", "doc_id, u", 2) + " SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY u, w) - 1 AS pos, text FROM windows")
def split_long_text(spark, sf):
    marked = F.replace(F.replace("text", F.lit(".\n"), F.lit(".\n\n")), F.lit("; "), F.lit("\n1) "))
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(S.bounded_array(marked)).alias("pos", "text"))
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


LINES = exploded_sql("documents", "doc_id", f"list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, {TRIM})), lambda x: x <> '')", "line", ", []::VARCHAR[] AS articles")


@query(f"WITH RECURSIVE lines AS ({LINES}), " + fold_sql("merged", "lines", "doc_id", "line", f"length(a.text) < {S.MIN_CHARS} AND length(a.text) + 1 + length(b.text) <= {S.MAX_CHARS}") + " SELECT doc_id, g - 1 AS pos, text FROM merged")
def merge_small(spark, sf):
    lines = X.present(F.split("text", "\n"))
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(S.joined_array(lines)).alias("pos", "text"))
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


@query(CHUNKS[2] + " SELECT id, part_index, g - 1 AS pos, array_to_string(articles, ',') AS articles, text FROM merged", "legal")
def chunk_parts(spark, sf):
    parts = A.legal(spark, sf).select("id", F.posexplode(X.part_pieces(X.clean_noise(F.col("text")))).alias("part_index", "part"))
    rows = parts.select("id", "part_index", F.posexplode(S.chunk_array(F.col("part"))).alias("pos", "c"))
    return rows.select("id", F.col("part_index").cast("bigint").alias("part_index"), F.col("pos").cast("bigint").alias("pos"), F.array_join("c.articles", ",").alias("articles"), "c.text")


@query("WITH RECURSIVE " + windows_sql("windows", PLAIN, "doc_id", 2) + " SELECT doc_id || '_' || (row_number() OVER (PARTITION BY doc_id ORDER BY w) - 1) AS chunk_id, CAST(doc_id AS VARCHAR) AS doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY w) - 1 AS chunk_index, 0::BIGINT AS part_index, '' AS articles, text FROM windows")
def enforce_max(spark, sf):
    return S.enforce_max(A.text_chunks(spark, sf), blanks=BLANKS).withColumn("articles", F.array_join("articles", ","))


@query(CHUNKS[2] + " " + CHUNK_ROWS, "legal")
def chunk_documents(spark, sf):
    return S.chunk_documents(A.legal(spark, sf))


@query(CHUNKS[1] + " " + CHUNK_ROWS, "legal")
def chunk_documents_v1(spark, sf):
    return S.chunk_documents(A.legal(spark, sf), version=1)


@query(CHUNKS[2] + " SELECT count(*) AS n_chunks, min(length(text)) AS least, max(length(text)) AS most, round(avg(length(text)), 6) AS mean, count(*) FILTER (length(text) > 1500) AS n_over, count(*) FILTER (length(text) > 10000) AS n_far_over FROM merged", "legal")
def chunk_length_report(spark, sf):
    return P.length_report(P.require_bounded(S.chunk_documents(A.legal(spark, sf))))


@query(CHUNKS[2] + " SELECT 'text' AS kind, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM merged WHERE length(text) <= 700 UNION ALL SELECT 'apart', count(*), CAST(sum(length(text)) AS BIGINT) FROM merged WHERE length(text) > 700 UNION ALL SELECT 'seen', count(*), max(length(text)) FROM merged", "legal")
def write_chunks(spark, sf):
    """Chunks written with their checks, those of more than 700 characters kept apart; numbers from the write itself."""
    good, apart, seen = P.write_chunks(S.chunk_documents(A.legal(spark, sf)), scratch_path(spark, "chunks"), 700)
    told = spark.createDataFrame([("seen", seen["n_rows"], seen["most"])], "kind string, n long, chars long")
    number = lambda df, kind: df.agg(F.count("*").alias("n"), F.sum(F.length("text").cast("long")).alias("chars")).select(F.lit(kind).alias("kind"), "n", "chars")
    return number(good, "text").unionByName(number(apart, "apart")).unionByName(told)


@query(CHUNKS[2] + f" SELECT doc_id, count(*) AS n, min(chunk_index) = 0 AND max(chunk_index) = count(*) - 1 AND count(DISTINCT chunk_index) = count(*) AS contiguous, count(DISTINCT chunk_id) = count(*) AS unique_ids FROM ({CHUNK_ROWS}) GROUP BY doc_id", "legal")
def chunk_integrity(spark, sf):
    return P.chunk_integrity(S.chunk_documents(A.legal(spark, sf)))
