"""Table upkeep: keyed overwrite, move with verification, additive builds, integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.operators.retrieval import year_weights


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: what a keyed overwrite leaves."""
    w = W.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("__latest", F.row_number().over(w)).where("__latest = 1").drop("__latest")


def additive(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't done yet."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def move(source: DataFrame, confirmed: DataFrame, key: str) -> DataFrame:
    """One row: source rows that the destination confirms (these leave the source) and rows that stay."""
    marked = source.join(confirmed.select(key).distinct().withColumn("__there", F.lit(True)), key, "left")
    return marked.agg(F.count_if(F.col("__there").isNotNull()).alias("moved"), F.count_if(F.col("__there").isNull()).alias("kept"))


def orphans(chunks: DataFrame) -> DataFrame:
    """One row: chunks without a parent, chunks whose parent is missing, all chunks."""
    parents = chunks.where("level = 1").select(F.col("chunk_id").alias("parent_id"), F.lit(True).alias("there"))
    rows = chunks.select("chunk_id", "parent_id").join(parents, "parent_id", "left")
    return rows.agg(F.count_if(F.col("parent_id").isNull()).alias("without_parent"), F.count_if(F.col("parent_id").isNotNull() & F.col("there").isNull()).alias("orphans"), F.count("*").alias("n"))


def year_shares(orders: DataFrame) -> DataFrame:
    """year, n, weight: recency weights of the years that orders have."""
    counts = orders.groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))
    weights = counts.agg(year_weights(F.collect_list("year")).alias("w")).select(F.inline("w"))
    return counts.join(weights, "year").select("year", "n", F.round("weight", 9).alias("weight"))
