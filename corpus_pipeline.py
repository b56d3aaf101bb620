"""Corpus pipeline: quality, near-duplicates, personal data, source mix, token ids, each stage on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import bpe, minhash, mixing, pii, quality
from siltstone.llm.common import read, table
from siltstone.llm.queries import tokenizer


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learnt from the labels, doesn't reject."""
    return quality.filter_good(docs, read(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return minhash.one_of_each(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets."""
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or cut so that sources meet their target weights; a document that occurs k times is k rows."""
    return mixing.realise(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document: doc_id, lang, source, n_tokens, ids, intact (the ids decode to the text)."""
    return bpe.encoded_documents(docs, *tokenizer("byte_bpe_multi_50k.tiktoken"))


STAGES = [("quality", good_quality), ("near_dedup", distinct), ("pii", without_personal_data), ("mixing", mixed), ("bpe", encoded)]
#: SQL can't express the stages; tests/llm/test_brute_force.py compares the whole run with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is a table in the shared folder before the next one starts."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
