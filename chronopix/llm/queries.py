"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, jaccard, language, oracles, packing, planes, quality, sharding, topk, warc
from .common import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    score = F.round("score", 6)
    return scored.select("doc_id", "held_out", score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), with_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, with the trigrams, suffixes, confusion and priors of web pages as further evidence."""
    pages = language.evidence_rows(language.page_evidence(table(spark, sf_dir, "pages")), declared_col="declared", host_col="host")
    judged = language.identify(table(spark, sf_dir, "documents"), evidence=pages)
    return judged.select("doc_id", "language", F.round("posterior", 6).alias("posterior"), "text_language", "declared", "kept")


def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages: languages from the text, the markup's declaration, and host and suffix of the address."""
    pages = language.page_evidence(table(spark, sf_dir, "pages"))
    judged = language.identify(pages, declared_col="declared", host_col="host", evidence=language.evidence_rows(table(spark, sf_dir, "documents")))
    return judged.select(F.col("doc_id").alias("page_id"), "language", F.round("posterior", 6).alias("posterior"), "text_language", "declared", "kept")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", "item_id", "n_items", "kind", "first_word", "n_words", "n_matched", "longest_run")


def op7_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = planes.write_store(table(spark, sf_dir, "documents"))
    return planes.read_store(store, with_ids=False)


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings")).select("query_id", "rank", "vec_id", "score")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write_archive(table(spark, sf_dir, "pages"))
    parsed = warc.parse_records(warc.read_records(archive))
    return parsed.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": op1_sharding,
        "op2_quality": op2_quality,
        "op3_packing": op3_packing,
        "op4_language": op4_language,
        "op5_ngram_jaccard": op5_ngram_jaccard,
        "op6_decontamination": op6_decontamination,
        "op7_bit_planes": op7_bit_planes,
        "op8_exact_top_k": op8_exact_top_k,
        "op9_warc": op9_warc,
        "op10_chat": op10_chat,
        "page_languages": page_languages,
    }


def oracle_sql() -> dict[str, str]:
    languages = {"op4_language": oracles.language_sql(False), "page_languages": oracles.language_sql(True)}
    return {"op2_quality": oracles.quality_sql(), **languages, "op5_ngram_jaccard": jaccard.ORACLE_SQL, "op8_exact_top_k": TOP_K_SQL, "op9_warc": WARC_SQL, "op10_chat": chat.ORACLE_SQL}


TOP_K_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, body, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha1(body) AS hex, max(page_id) OVER (PARTITION BY body) AS top FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM d
"""
