"""The registered queries of the operators of this subpackage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontamination import contamination
from .html_text import extract_text
from .infill import infill_digests
from .languages import languages
from .licences import scan_licences
from .mixing import mix_sources
from .neighbours import nearest
from .quality import quality
from .simhash import near_duplicates
from .substrings import repeat_digests
from .token_counts import count_tokens
from .toxicity import toxicity
from .whitening import whiten


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digests(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slack=3)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill_digests(table(spark, sf_dir, "documents"))


def op12_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


#: For ids that are not null; rows that repeat an id and a text are one document here as well.
OP3_SQL = r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    win AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 20], ' ') AS words FROM w, unnest(range(0, len(w) - 19)) u(i)),
    again AS (SELECT doc_id, i FROM (SELECT doc_id, i, rank() OVER (PARTITION BY words ORDER BY doc_id, i) AS nth FROM win) WHERE nth > 1),
    gone AS (SELECT DISTINCT doc_id, i + j AS at_word FROM again, range(0, 20) v(j)),
    kept AS (SELECT t.doc_id, string_agg(t.word, ' ' ORDER BY t.at_word) AS text, count(*) AS n FROM (SELECT doc_id, i AS at_word, w[i + 1] AS word FROM w, unnest(range(0, len(w))) u(i)) t ANTI JOIN gone g ON t.doc_id = g.doc_id AND t.at_word = g.at_word GROUP BY t.doc_id)
    SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(w.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256 FROM w LEFT JOIN kept k ON w.doc_id = k.doc_id"""
TERMS_SQL = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
OP9_SQL = f"""WITH d AS (SELECT doc_id, {TERMS_SQL} AS w FROM documents), b AS (SELECT item_id, {TERMS_SQL} AS w FROM benchmark),
    item_windows AS (SELECT DISTINCT item_id, l, array_to_string(w[i + 1 : i + l], ' ') AS words FROM (SELECT *, least(13, len(w)) AS l FROM b WHERE len(w) > 0), unnest(range(0, len(w) - l + 1)) u(i)),
    doc_windows AS (SELECT doc_id, l, i, array_to_string(w[i + 1 : i + l], ' ') AS words FROM d, (SELECT DISTINCT l FROM item_windows) s, unnest(range(0, greatest(0, len(w) - l + 1))) u(i)),
    hits AS (SELECT doc_id, item_id, i, l FROM doc_windows JOIN item_windows USING (l, words)),
    covered AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, at_word FROM (SELECT doc_id, unnest(range(i, i + l)) AS at_word FROM hits)) GROUP BY doc_id),
    named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id),
    places AS (SELECT item_id, l, i AS at_word, i + j AS place, w[i + j + 1] AS term FROM (SELECT item_id, w, least(13, len(w)) AS l FROM b WHERE len(w) > 0), unnest(range(0, len(w) - l + 1)) u(i), unnest(range(0, l)) v(j)),
    tokens AS MATERIALIZED (SELECT * FROM (SELECT doc_id, i AS pos, w[i + 1] AS term FROM d, unnest(range(0, len(w))) u(i)) WHERE term IN (SELECT term FROM places)),
    ranked AS (SELECT p.*, count(n) OVER (PARTITION BY item_id, at_word) AS known, row_number() OVER (PARTITION BY item_id, at_word ORDER BY n NULLS LAST, place) AS nth FROM places p LEFT JOIN (SELECT term, count(*) AS n FROM tokens GROUP BY term) c USING (term)),
    pairs AS (SELECT DISTINCT item_id, one, other, gap FROM (SELECT item_id, at_word, arg_min(term, place) AS one, arg_max(term, place) AS other, max(place) - min(place) AS gap FROM ranked WHERE known = l AND nth <= 2 GROUP BY item_id, at_word)),
    near AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM (SELECT x.doc_id, p.item_id FROM pairs p JOIN tokens x ON x.term = p.one JOIN tokens y ON y.doc_id = x.doc_id AND y.term = p.other AND y.pos BETWEEN x.pos + p.gap - 3 AND x.pos + p.gap + 3 AND (p.gap > 0 AND x.pos < y.pos OR p.gap = 0 AND x.pos = y.pos)) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(r.n_near, 0) AS n_near, coalesce(n.n_items, 0) AS n_items, sha256(coalesce(n.items, '')) AS items_sha256,
        coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
    FROM d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN named n ON d.doc_id = n.doc_id LEFT JOIN near r ON d.doc_id = r.doc_id"""
OP11_SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents),
    r AS (SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS p1, ('0x' || h[9:16])::BIGINT % (n + 1) AS p2, ('0x' || h[17:24])::BIGINT % 100 AS r3, ('0x' || h[25:32])::BIGINT % 100 AS r4 FROM d),
    f AS (SELECT *, least(p1, p2) AS a, greatest(p1, p2) AS b, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r3 >= 90 THEN 'plain' WHEN r4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
    c AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1) AS suffix FROM f)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM c"""
#: SQL for DuckDB where it can express the operator; the others hash, learn, tokenize or parse in ways it has no words for.
ORACLES = {"op3_substring_dedup": OP3_SQL, "op9_decontamination": OP9_SQL, "op11_infill": OP11_SQL}

QUERIES = {f.__name__: f for f in (op1_main_text, op2_licences, op3_substring_dedup, op4_toxicity, op5_source_mix, op6_neighbours, op7_token_counts, op8_quality, op9_decontamination, op10_simhash, op11_infill, op12_languages, op13_whitening)}
