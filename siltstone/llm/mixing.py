"""Mixing sources to target weights.

Every row gets a hash-random key.  Rows are range-partitioned by that key within their source, distributed prefix sums
give each row the words that precede it, and each source is cut at its exact word budget; budgets above a source's size
repeat it by whole epochs first.

The prefix sums have two levels: running sums inside buckets of about ``bucket_rows`` rows (a key is uniform, so equal
key ranges are equally full), running sums of bucket totals inside blocks of 1024 buckets, and of blocks inside the
source.  No task holds a source, so one that has a third of all rows is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.llm.common import SPACE, null_safe, table

KEY_BITS = 48


def n_words(text):
    """Number of white-space separated words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, cycle: int = 3, most: int = 3) -> DataFrame:
    """Word targets of sources.

    ``sizes``: one row per source (source, source_size, n_rows); it is the catalogue of sources, small beside the data,
    and the ranking below sorts it in one task.  Sources in code-point order, null last, weigh 1..``cycle`` repeating
    and share the total size; a target stops at ``most`` times its source's size and the excess is shared again by
    weight until no target is above, which is the level L with sum(min(most * size, L * weight)) = total.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    full = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    ranked = (
        sizes.withColumn("weight", ((F.row_number().over(order) - 1) % cycle + 1).cast("long"))
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("total", F.sum("source_size").over(W.partitionBy()))
        .withColumn("weights", F.sum("weight").over(W.partitionBy()))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(full.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(full.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    )
    # In order of cap / weight: a source is capped while the level of the rest is at or above its own ratio.
    level = (F.col("total") - F.col("cap_before")) / (F.col("weights") - F.col("weight_before")).cast("double")
    capped = ranked.withColumn("level", level.cast("double")).withColumn("capped", F.col("level") * F.col("weight") >= F.col("cap"))
    final = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(W.partitionBy())
    return capped.withColumn("final", final.getField("level")).select(
        "source", "source_size", "n_rows", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("final") * F.col("weight")).alias("target")
    )


def mix(docs: DataFrame, seed: str = "0", bucket_rows: int = 1024) -> DataFrame:
    """doc_id, source, key_hash, size, source_size, target, taken: the words that the mix takes of each row.

    ``docs`` needs doc_id, text and source; other columns are ignored.  A null text has size 0; a null source is a
    source of its own, last in order.  Rows of one doc_id are ordered by a hash of their text, and rows that are equal in
    both are interchangeable.  Empty texts take nothing; an empty table gives an empty result.  The same rows and seed
    always give the same result, whatever the partitioning.
    """
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, KEY_BITS // 4), 16, 10).cast("long")
    sized = table(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("key"), F.xxhash64("text").alias("text_hash")), "mix-sizes")
    sources = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows")))
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n_rows") / bucket_rows))).cast("int")
    sources = table(sources.withColumn("shift", F.lit(KEY_BITS) - bits), "mix-sources")

    def bucket(shift):
        return F.expr(f"shiftright(key, {shift})")

    placed = null_safe(sized, sources.select("source", "shift", "target", "source_size"), ["source"]).withColumn("bucket", bucket("shift"))
    totals = null_safe(sized, sources.select("source", "shift"), ["source"]).groupBy("source", bucket("shift").alias("bucket")).agg(F.sum("size").alias("words"))
    totals = totals.withColumn("block", F.shiftright("bucket", 10))
    in_block = W.partitionBy("source", "block").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    in_source = W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = totals.groupBy("source", "block").agg(F.sum("words").alias("words")).select("source", "block", F.coalesce(F.sum("words").over(in_source), F.lit(0)).alias("base"))
    offsets = null_safe(totals.withColumn("inner", F.coalesce(F.sum("words").over(in_block), F.lit(0))), blocks, ["source", "block"])
    offsets = offsets.select("source", "bucket", (F.col("base") + F.col("inner")).alias("offset"))
    run = W.partitionBy("source", "bucket").orderBy("key", "doc_id", "text_hash").rowsBetween(W.unboundedPreceding, -1)
    summed = placed.withColumn("inside", F.coalesce(F.sum("size").over(run), F.lit(0)))
    joined = null_safe(summed, offsets, ["source", "bucket"])
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target + 0.5) div source_size")).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    last = F.least(F.greatest(rest - F.col("offset") - F.col("inside"), F.lit(0)), F.col("size"))
    return joined.select("doc_id", "source", "text_hash", "size", "source_size", "target", (epochs * F.col("size") + last).cast("long").alias("taken"))


def first_words(text, n):
    """``text`` up to and including its ``n``-th word, white space before it as it is."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"[{SPACE}]*[^{SPACE}]+"), F.lit(0)), F.lit(1), n), "")


def realise(docs: DataFrame, seed: str = "0") -> DataFrame:
    """The mixed corpus: rows of ``docs`` repeated as ``mix`` says, all columns kept (n_chars, where present, follows the text).

    A row is given once for each whole epoch, and once more, cut after the words that are still in the budget, where the
    cut falls on it.  Rows of which nothing is taken go, so empty texts go too.
    """
    cols = docs.columns
    # A key that is never null, so that texts are moved once, by the join alone.
    key = lambda c: F.coalesce(F.concat(F.lit(":"), F.col(c).cast("string")), F.lit(""))
    keys = ["__key", "__hash"]
    taken = mix(docs, seed).where("taken > 0").select(key("doc_id").alias("__key"), F.col("text_hash").alias("__hash"), F.col("size").alias("__size"), F.col("taken").alias("__taken"))
    # The row is carried whole, so its columns can have any names.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("__row"))
    rows = rows.select("__row", key("__row.doc_id").alias("__key"), F.xxhash64("__row.text").alias("__hash"))
    repeated = table(rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys), "repeated-rows")
    if repeated.limit(1).count():
        # Equal rows may take unequally, so each is matched by its rank among its equals.
        ranked = lambda df, order: df.join(repeated, keys, "left_semi").withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(order)))
        several = ranked(rows, F.lit(1)).join(ranked(taken, F.col("__taken").desc()), [*keys, "__n"]).drop("__n")
        out = rows.join(repeated, keys, "left_anti").join(taken.join(repeated, keys, "left_anti"), keys).unionByName(several)
    else:
        out = rows.join(taken, keys)
    whole = F.expr("__taken div __size")
    rest = F.col("__taken") - whole * F.col("__size")
    pieces = F.concat(F.array_repeat(F.col("__size"), whole.cast("int")), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    out = out.withColumn("__words", F.explode(pieces))
    text = F.col("__row.text")
    out = out.withColumn("__text", F.when(F.col("__words") == F.col("__size"), text).otherwise(first_words(text, F.col("__words").cast("int"))))
    kept = {"text": F.col("__text"), "n_chars": F.length("__text").cast("long")}
    return out.select(*[kept.get(c, F.col("__row").getField(c)).alias(c) for c in cols])
