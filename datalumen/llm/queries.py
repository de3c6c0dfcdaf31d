"""The registered queries of the text operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datalumen.llm import (alignment, conversations, decontamination, extraction, licenses, packing, quality, retrieval_packing, secrets,
                           sharding, simhash, substrings, token_counts)

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTE_BPE_FILE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def html_text(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.extract(_table(spark, folder, "pages"))


def contamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def repeats(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.repeat_digests(_table(spark, folder, "documents"))


def tokens(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.section_tokens(_table(spark, folder, "documents"), BYTE_BPE, public_tokenizers.PATTERN)


def packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"), WORD_BPE)


def rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.assess(_table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed")


def shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard(_table(spark, folder, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def near_copies(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_copies(_table(spark, folder, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


def license_labels(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_report(_table(spark, folder, "documents"))


def secret_spans(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secret_report(_table(spark, folder, "documents"))


def repaired(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.assess(conversations.damaged(_table(spark, folder, "conversations")), "present")


def token_links(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.cross_tokenizer(_table(spark, folder, "documents"), BYTE_BPE_FILE, public_tokenizers.PATTERN, PIECES)


def packed_with_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval_packing.pack(_table(spark, folder, "documents"), WORD_BPE)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": html_text,
    "op2_contamination": contamination,
    "op3_substring_dedup": repeats,
    "op4_token_counts": tokens,
    "op5_packing": packed,
    "op6_quality_rules": rules,
    "op7_sharding": shards,
    "op8_simhash": near_copies,
    "op9_licenses": license_labels,
    "op10_secrets": secret_spans,
    "op11_conversations": repaired,
    "op12_alignment": token_links,
    "op13_retrieval_packing": packed_with_neighbours,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op2_contamination": rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOWER}, '{licenses.WORD}') AS words FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '{licenses.WORD}') AS words FROM benchmark),
sized AS (SELECT item, words, least(len(words), {decontamination.WINDOW}) AS size FROM i WHERE len(words) > 0),
windows AS (SELECT DISTINCT item, size, array_to_string(words[s:s + size - 1], ' ') AS txt
            FROM (SELECT item, words, size, unnest(range(1, len(words) - size + 2)) AS s FROM sized)),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (SELECT r, size, s, array_to_string(words[s:s + size - 1], ' ') AS txt
           FROM (SELECT r, words, size, unnest(range(1, len(words) - size + 2)) AS s FROM d, sizes WHERE len(words) >= size)),
hits AS (SELECT r, s, size, item FROM places JOIN windows USING (size, txt)),
spots AS (SELECT r, count(DISTINCT w) AS n_hit FROM (SELECT r, unnest(range(s, s + size)) AS w FROM hits) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items, sha256(array_to_string(list_sort(list(DISTINCT item)), ',')) AS items_sha256 FROM hits GROUP BY r)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spots USING (r) LEFT JOIN items USING (r)""",
    "op3_substring_dedup": rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
places AS (SELECT r, doc_id, s, md5(array_to_string(words[s:s + {substrings.WINDOW} - 1], ' ')) AS h
           FROM (SELECT r, doc_id, words, unnest(range(1, len(words) - {substrings.WINDOW} + 2)) AS s FROM d)),
firsts AS (SELECT h, min(doc_id) AS holder FROM places GROUP BY h),
gone AS (SELECT DISTINCT r, unnest(range(s, s + {substrings.WINDOW})) AS w FROM places JOIN firsts USING (h) WHERE doc_id > holder),
left_over AS (SELECT r, list(word ORDER BY w) AS kept FROM
    (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS w FROM d) ANTI JOIN gone USING (r, w) GROUP BY r)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(len(kept), 0) AS n_removed,
  sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256
FROM d LEFT JOIN left_over USING (r)""",
    "op9_licenses": licenses.SQL,
    "op11_conversations": conversations.SQL,
}
