"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import bpe, chat, embeddings, langid, lexical, licenses, merkle, minhash, mixing, pii, quality, spotsigs, token_counts
from siltstone.llm.common import read


def tokenizer(name: str) -> tuple[str, str]:
    """Path of an installed public tokenizer file, and the pre-token pattern."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in every document."""
    return licenses.license_scan(read(spark, sf_dir, "documents"))


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors: vec_id, n_links, component_id, kept."""
    return embeddings.near_vectors(read(spark, sf_dir, "embeddings"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE round trip of every document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.round_trip(read(spark, sf_dir, "documents"), *tokenizer("byte_bpe_multi_50k.tiktoken"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical turns recovered from plain transcripts of all conversations."""
    return chat.format_chats(read(spark, sf_dir, "conversations"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate documents: doc_id, n_shingles, component_id, kept."""
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and digest of base spans, all spans."""
    return pii.report(read(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document: doc_id, n_bytes, n_tokens, over_limit."""
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), *tokenizer("byte_bpe_50k.json"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SpotSigs fingerprints of every document and of its edited text."""
    return spotsigs.fingerprint_report(read(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document: doc_id, held_out, score, predicted."""
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix of all documents by source weight: doc_id, size, source_size, target, taken."""
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle manifest of all documents by language: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    return merkle.manifest(read(spark, sf_dir, "documents"))


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document: doc_id, held_out, lang_pred, score."""
    return langid.identify(read(spark, sf_dir, "documents"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents of every benchmark item: item_id, rank, doc_id, score."""
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight, (source_size * 3)::BIGINT AS cap FROM s),
-- the level: the smallest candidate at which the capped and the uncapped sources together take everything
o AS (SELECT *, row_number() OVER (ORDER BY cap::DOUBLE / weight, source ASC NULLS LAST) AS r FROM w),
l AS (
  SELECT a.source, a.source_size, a.cap, a.weight, a.r,
         ((SELECT sum(source_size) FROM o) - coalesce((SELECT sum(cap) FROM o b WHERE b.r < a.r), 0))::DOUBLE
         / ((SELECT sum(weight) FROM o) - coalesce((SELECT sum(weight) FROM o b WHERE b.r < a.r), 0))::DOUBLE AS level
  FROM o a),
f AS (SELECT level FROM l WHERE level * weight < cap ORDER BY r LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN level * weight >= cap THEN cap::DOUBLE ELSE (SELECT level FROM f) * weight END AS target FROM l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
        + least(greatest(budget - CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * source_size - before, 0), size))::BIGINT AS taken
FROM p
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": op1_licenses,
    "op2_embeddings": op2_embeddings,
    "op3_bpe": op3_bpe,
    "op4_chat": op4_chat,
    "op5_minhash": op5_minhash,
    "op6_pii": op6_pii,
    "op7_token_counts": op7_token_counts,
    "op8_fingerprints": op8_fingerprints,
    "op9_quality": op9_quality,
    "op10_mixing": op10_mixing,
    "op11_manifest": op11_manifest,
    "op12_language": op12_language,
    "op13_search": op13_search,
}
SQL: dict[str, str] = {
    "op1_licenses": licenses.license_sql(),
    "op2_embeddings": embeddings.near_vectors_sql(),
    "op5_minhash": minhash.near_duplicates_sql(),
    "op8_fingerprints": spotsigs.fingerprint_sql(),
    "op10_mixing": OP10_SQL,
    "op11_manifest": merkle.manifest_sql(),
    "op13_search": lexical.search_sql(),
}
