"""The queries pN_... and the SQL of those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.session import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def rank_file() -> str:
    """Of ``byte_bpe_50k``: DOCSPARK_RANK_FILE, or else the file of the installed package of vocabularies."""
    if path := os.environ.get("DOCSPARK_RANK_FILE"):
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    from docspark.llm.tokens import encode_corpus

    return encode_corpus(read(spark, folder, "documents"), rank_file())


@query
def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    from docspark.llm.fm_index import leaks

    found = leaks(read(spark, folder, "documents"), read(spark, folder, "eval_items"))
    return found.select("doc_id", "item_id").distinct()


@query
def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    from docspark.llm.shared_spans import shared_spans

    return shared_spans(read(spark, folder, "documents"))


@query
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    from docspark.llm.hnsw import neighbours

    near = neighbours(read(spark, folder, "sama_nora_chunks"))
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


@query
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    from docspark.llm.conversations import conversations

    turns = conversations(read(spark, folder, "session_messages"), read(spark, folder, "session_feedback"))
    return turns.select("session_id", "turn_no", "message_id", "role")


SQL["p2_found"] = r"""
WITH f AS (SELECT message_id, min(nullif(lower(trim(session_id, chr(32) || chr(9) || chr(10) || chr(13) || chr(160))), '')) AS f
           FROM session_feedback GROUP BY message_id),
d AS (SELECT message_id, user_message AS u, assistant_message AS a, min(timestamp) AS ts,
             min(nullif(lower(trim(session_id, chr(32) || chr(9) || chr(10) || chr(13) || chr(160))), '')) AS s
      FROM session_messages WHERE message_id IS NOT NULL GROUP BY ALL),
x AS (SELECT message_id, min(s) AS s,
             min(CASE WHEN regexp_matches(u, '[\pL\pN]') THEN ts END) AS q, min(CASE WHEN regexp_matches(a, '[\pL\pN]') THEN ts END) AS r,
             bool_and(ts IS NOT NULL) AS timed
      FROM d GROUP BY message_id),
e AS (SELECT x.message_id, coalesce(x.s, f.f) AS session_id, q, coalesce(timed AND q <= r, false) AS good FROM x LEFT JOIN f USING (message_id)),
k AS (SELECT *, bool_and(good) OVER (PARTITION BY session_id) AS kept FROM e WHERE session_id IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY q, message_id) AS nth FROM k WHERE kept)
SELECT session_id, CAST(2 * nth - 1 AS INTEGER) AS turn_no, message_id, 'user' AS role FROM n
UNION ALL SELECT session_id, CAST(2 * nth AS INTEGER), message_id, 'assistant' FROM n
"""


def items(spark: SparkSession, folder: str) -> DataFrame:
    """(item_kind, item_key, text, label): chunks, and the questions of session_messages, each once."""
    chunks = read(spark, folder, "sama_nora_chunks").select(F.lit("chunk").alias("item_kind"), F.col("id").alias("item_key"), F.col("content").alias("text"), F.col("language").alias("label"))
    asked = read(spark, folder, "session_messages").where("message_id is not null and user_message is not null")
    asked = asked.select(F.lit("message").alias("item_kind"), F.col("message_id").alias("item_key"), F.col("user_message").alias("text"), F.lit(None).cast("string").alias("label"))
    return chunks.unionByName(asked)


@query
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    from docspark.llm.visual_form import look_alike_pairs

    return look_alike_pairs(items(spark, folder))


@query
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    from docspark.llm.splitter import boundaries

    return boundaries(read(spark, folder, "sama_nora_chunks")).withColumnRenamed("id", "chunk_id")


@query
def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    from docspark.llm.splitter import pieces

    return pieces(read(spark, folder, "sama_nora_chunks")).withColumnRenamed("id", "chunk_id")


_WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SQL["p5_found"] = rf"""
WITH c AS (SELECT id, string_split_regex(content, '{_WS}*\n{_WS}*\n{_WS}*') AS p FROM sama_nora_chunks WHERE length(content) > 1600),
s AS (SELECT id, p, flatten(list_transform(p, lambda x: string_split(regexp_replace(x, '([.!?؟]){_WS}+', '\1' || chr(57344), 'g'), chr(57344)))) AS s FROM c),
w AS (SELECT id, p, s, flatten(list_transform(p, lambda x: string_split_regex(x, '{_WS}+'))) AS w FROM s)
SELECT id AS chunk_id, CASE WHEN list_max(list_transform(p, lambda x: length(x))) <= 1600 THEN 'paragraph'
  WHEN list_max(list_transform(s, lambda x: length(x))) <= 1600 THEN 'sentence' WHEN list_max(list_transform(w, lambda x: length(x))) <= 1600 THEN 'word' ELSE 'none' END AS boundary FROM w
"""


def _language_filters(spark: SparkSession, folder: str):
    from docspark.llm.lang_id import fit_filters, label_language

    chunks = read(spark, folder, "sama_nora_chunks").select("content", label_language(F.col("language")).alias("l"))
    return fit_filters(chunks, "content", "l")


@query
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    from docspark.llm.lang_id import label_language, languages

    filters, look = _language_filters(spark, folder)
    found = languages(items(spark, folder), filters, look, "text", ["item_kind", "item_key", "label"])
    each = found.select("item_kind", "item_key", label_language(F.col("label")).alias("named"), F.explode("passages").alias("x"))
    each = each.where("x.lang is not null and x.words >= 4 and not (x.lang <=> named)")
    return each.select("item_kind", "item_key", F.col("x.lang").alias("lang")).distinct()


def _scans(spark: SparkSession, folder: str) -> DataFrame:
    chunks = read(spark, folder, "sama_nora_chunks").select(
        F.lit("chunk").alias("item_kind"), F.col("id").alias("item_key"), F.col("content").alias("text"),
        F.col("document_name").alias("name"), F.col("section_title").alias("title"), F.col("page_start").alias("first"), F.col("page_end").alias("last"),
    )
    sources = read(spark, folder, "answer_sources").select(
        F.lit("source").alias("item_kind"), F.col("source_id").cast("string").alias("item_key"), F.col("snippet").alias("text"),
        F.col("document_name").alias("name"), F.col("section_title").alias("title"), F.col("page_start").alias("first"), F.col("page_end").alias("last"),
    )
    return chunks.unionByName(sources)


@query
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    from docspark.llm.lang_id import look_table
    from docspark.llm.ocr_repair import fit_layout, scan_noise

    texts = _scans(spark, folder)
    return scan_noise(texts, fit_layout(texts.where("item_kind = 'chunk'")), look_table())


@query
def p4_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    from docspark.llm.lang_id import look_table
    from docspark.llm.ocr_repair import fit_layout, repaired

    texts = _scans(spark, folder)
    return repaired(texts, fit_layout(texts.where("item_kind = 'chunk'")), look_table())


@query
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    from docspark.llm.pair_defects import defects

    filters, look = _language_filters(spark, folder)
    return defects(read(spark, folder, "session_messages"), filters, look)
