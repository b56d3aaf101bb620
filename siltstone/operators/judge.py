"""Pairwise judging against a baseline: swap, parse, deduplicate; the judge itself is a pluggable function with a lexical stub."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.operators import sweep
from siltstone.plans.store import stage

BASELINE = "L1_SPARSE_PLAIN_A0"


def should_swap(*parts: Column) -> Column:
    """Low bit of the first byte of the MD5 of the parts joined by a double bar; nulls count as empty."""
    joined = F.concat_ws("||", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 2), 16, 10).cast("int") % 2


def unswap(verdict: Column, swapped: Column) -> Column:
    return F.when(swapped == 1, F.when(verdict == "A", "B").when(verdict == "B", "A").otherwise(verdict)).otherwise(verdict)


def parse_response(response: Column) -> tuple[Column, Column]:
    """(relevance, completeness) of the first JSON object in a reply; a missing key is "?", no object is parse_error."""
    blob = F.regexp_extract(F.coalesce(response, F.lit("")), r"(?s)(\{.*?\})", 1)
    bad = (blob == "") | F.try_parse_json(blob).isNull()
    get = lambda key: F.when(bad, "parse_error").otherwise(F.coalesce(F.get_json_object(blob, f"$.{key}"), F.lit("?")))
    return get("relevance"), get("completeness")


def lexical(own: Column, other: Column) -> Column:
    """Stub of the judge: the answer with the larger recall wins."""
    return F.when(own > other, "A").when(own < other, "B").otherwise("Tie")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``runs`` with verdicts against the baseline: judged once for each distinct context, then fanned out.

    The baseline is is_baseline, an equal context same_as_baseline, a question without a baseline no_baseline.
    """
    r = sweep.runs(spark, sf_dir)
    base = r.where(F.col("config_key") == BASELINE).select("finder_id", F.col("retrieved_ids").alias("b_ids"), F.col("word_recall").alias("b_word"), F.col("soft_mrr").alias("b_mrr"))
    pairs = r.select("finder_id", "retrieved_ids", "word_recall", "soft_mrr").distinct().join(base, "finder_id", "left")
    swap = should_swap(F.col("finder_id"), F.col("retrieved_ids"))

    def verdict(own, other):
        shown = F.when(swap == 1, lexical(F.col(other), F.col(own))).otherwise(lexical(F.col(own), F.col(other)))  # the judge sees A and B in hashed order
        return unswap(shown, swap)

    judged = pairs.select("finder_id", "retrieved_ids", "b_ids", verdict("word_recall", "b_word").alias("v_rel"), verdict("soft_mrr", "b_mrr").alias("v_comp"))
    rows = r.join(judged, ["finder_id", "retrieved_ids"])
    final = lambda v: F.when(F.col("config_key") == BASELINE, "is_baseline").when(F.col("b_ids").isNull(), "no_baseline").when(F.col("retrieved_ids") == F.col("b_ids"), "same_as_baseline").otherwise(F.col(v))
    return rows.withColumn("relevance", final("v_rel")).withColumn("completeness", final("v_comp")).drop("b_ids", "v_rel", "v_comp")


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, sf_dir, "judged", _judged)


def overlap_groups(runs: DataFrame) -> DataFrame:
    """finder_id, config_key, n, canonical: groups of two or more runs of a question with the same ordered ids; the baseline or else the smallest key stands for a group."""
    group = W.partitionBy("finder_id", "retrieved_ids")
    rows = runs.where("retrieved_ids <> ''").withColumn("n", F.count("*").over(group))
    order = F.when(F.col("config_key") == BASELINE, F.lit("")).otherwise(F.col("config_key"))
    return rows.withColumn("canonical", F.min_by("config_key", order).over(group)).where("n >= 2").select("finder_id", "config_key", "n", "canonical")


def reply(own: Column, other: Column, own2: Column, other2: Column, swap: Column) -> Column:
    """Stub of a judge that writes: a reply with a JSON object of both verdicts, A and B in the order in which it is shown them."""
    shown = lambda a, b: F.when(swap == 1, lexical(b, a)).otherwise(lexical(a, b))
    return F.concat(F.lit('Compared. {"relevance": "'), shown(own, other), F.lit('", "completeness": "'), shown(own2, other2), F.lit('"} Done.'))


def resumed(rows: DataFrame, verdict) -> DataFrame:
    """``rows`` whose relevance is null get ``verdict``; what has been judged stays."""
    todo = rows.where("relevance IS NULL").withColumn("relevance", verdict)
    return rows.where("relevance IS NOT NULL").unionByName(todo)
