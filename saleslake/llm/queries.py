"""The queries of the operators, over whole tables, and the SQL that some of them must match."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from saleslake.llm import (
    embeddings,
    exact_dedup,
    html,
    language,
    line_dedup,
    packing,
    period_runs,
    ppm,
    sentencepieces,
    sharding,
    simhash,
    toxicity,
    whitening,
)
from saleslake.llm.common import table


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.coded_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.scored(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(table(spark, sf_dir, "documents"))


def op12_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return period_runs.run_digests(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_rows(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html": op1_html,
    "op2_simhash": op2_simhash,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_packing": op5_packing,
    "op6_ppm": op6_ppm,
    "op7_toxicity": op7_toxicity,
    "op8_embeddings": op8_embeddings,
    "op9_sharding": op9_sharding,
    "op10_language_id": op10_language_id,
    "op11_line_dedup": op11_line_dedup,
    "op12_period_runs": op12_period_runs,
    "op13_whitening": op13_whitening,
}

ORACLE: dict[str, str] = {
    # The sample pages have one article each; its tags are blanks here, and its references the few that occur.
    "op1_html": r"""
        WITH raw AS (
            SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS article FROM pages
        ), bare AS (
            SELECT page_id, url, replace(regexp_replace(article, '<[^>]*>', ' ', 'g'), '&quot;', '"') AS bare FROM raw
        ), decoded AS (
            SELECT page_id, url, regexp_replace(bare, '&amp;?', '&', 'g') AS decoded FROM bare
        ), texts AS (
            SELECT page_id, url, trim(regexp_replace(decoded, '\s+', ' ', 'g')) AS text FROM decoded
        )
        SELECT page_id, url, text, length(text) AS n_chars FROM texts
    """,
    # All pairs of one label, and the vectors that each can reach.
    "op8_embeddings": """
        WITH RECURSIVE vectors AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        ), links AS (
            SELECT a.vec_id AS x, b.vec_id AS y
            FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.e, b.e) >= 0.98
        ), reached(x, y) AS (
            SELECT vec_id, vec_id FROM vectors
            UNION
            SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x
        ), components AS (
            SELECT x, min(y) AS component_id FROM reached GROUP BY x
        ), counted AS (
            SELECT x, count(*) AS n FROM links GROUP BY x
        )
        SELECT v.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, v.vec_id = component_id AS kept
        FROM vectors v JOIN components c ON c.x = v.vec_id LEFT JOIN counted k ON k.x = v.vec_id
    """,
    "op4_exact_dedup": r"""
        WITH bare AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare
            FROM documents
        )
        SELECT doc_id,
               first_value(doc_id) OVER preferred AS keep_id,
               count(*) OVER (PARTITION BY bare) AS group_size,
               row_number() OVER preferred = 1 AS kept,
               sha256(bare) AS text_sha256
        FROM bare
        WINDOW preferred AS (PARTITION BY bare ORDER BY n DESC, doc_id)
    """,
    # The first document of each key keeps its lines; keys that only one document holds are their first document's.
    "op11_line_dedup": r"""
        WITH split AS (
            SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
        ), lines AS (
            SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS position FROM split
        ), keyed AS (
            SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM lines
        ), firsts AS (
            SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key
        ), judged AS (
            SELECT k.doc_id, line, position, coalesce(k.doc_id <> f.first, false) AS dropped
            FROM keyed k LEFT JOIN firsts f ON f.key = k.key
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY position) FILTER (NOT dropped), '')) AS kept_sha256
        FROM judged GROUP BY doc_id
    """,
}
