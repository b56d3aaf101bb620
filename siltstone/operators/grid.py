"""The whole sweep: 72 configs of three levels over one shared retrieval, with set-valued routes and years of the question.

A cell is a section and a year.  Retrieval runs once for each distinct question text, level, source and cell; every list that a
config needs, by whatever set of sections and years, is the best of its cells' lists, so routers, years and configs only merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators import retrieval as R
from siltstone.operators import sweep
from siltstone.operators import understanding as U
from siltstone.plans.store import stage

ROUTERS = ("single", "pair", "shy")
MODES = ("dense", "sparse", "hybrid")
DEPTH = 3 * sweep.TOP_K
KEYS = ("finder_id", "enhance", "level")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of three levels with year: documents, lines, and lines with a description (section and ticker) behind them."""
    two = sweep.chunks(spark, sf_dir).withColumn("year", F.year("fiscal_year_end"))
    lines = two.where("level = 2")
    three = lines.withColumn("level", F.lit(3)).withColumn("chunk_id", F.concat("chunk_id", F.lit("+"))).withColumn("text", F.concat_ws(" ", "text", "section", "ticker"))
    return two.unionByName(three)


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """finder_id, router, section: the sections that each router chooses.  "pair" names two; "shy" abstains (no row) from every fifth question and else names another than "single"."""
    q = sweep.questions(spark, sf_dir).select("finder_id", "route")
    others = F.array(*[F.lit(x) for x in ("en", "fr", "de", "es")])
    other = F.get(others, ((F.col("finder_id") + 1) % 4).cast("int"))
    choice = F.array(F.struct(F.lit(ROUTERS[0]).alias("router"), F.array("route").alias("s")), F.struct(F.lit(ROUTERS[1]).alias("router"), F.array("route", other).alias("s")), F.struct(F.lit(ROUTERS[2]).alias("router"), F.when(F.col("finder_id") % 5 != 0, F.array(other)).alias("s")))
    return q.select("finder_id", F.inline(choice)).select("finder_id", "router", F.explode("s").alias("section"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """finder_id, enhance, level, source, section, year, chunk_id, score: the best of each cell."""
    rows = corpus(spark, sf_dir).withColumn("cell", F.concat_ws("|", "section", "year"))
    cells = rows.where("level = 1").select("cell", "section", "year").distinct()
    q = sweep.questions(spark, sf_dir)
    texts = q.select("finder_id", F.lit(0).alias("enhance"), F.col("query").alias("text")).unionByName(q.select("finder_id", F.lit(1).alias("enhance"), F.col("enhanced").alias("text")))
    asked = texts.select("text").distinct().crossJoin(F.broadcast(cells.select("cell"))).select(F.xxhash64("text", "cell").alias("query_id"), "text", "cell")  # sections times years
    out = []
    found = (*R.bm25_texts_and_lines(asked, rows.where("level = 1"), DEPTH, ("cell",), "cell"), R.bm25_texts(asked, rows.where("level = 3"), DEPTH, ("cell",), "cell"))
    for level, best in enumerate(found, 1):
        out.append(best.select("query_id", F.lit(level).alias("level"), "chunk_id", "score"))
    sparse = out[0].unionByName(out[1]).unionByName(out[2]).join(asked, "query_id").join(texts, "text").join(cells, "cell")
    sparse = sparse.select(*KEYS, F.lit("sparse").alias("source"), "section", "year", "chunk_id", "score")
    # A question's vector is the one with its id; a chunk has its document's, so the lines of a document are equal.
    vectors = sweep.read(spark, sf_dir, "embeddings").where("embedding IS NOT NULL").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    questions = q.join(vectors, q.finder_id == vectors.doc_id).select(F.col("finder_id").alias("query_id"), F.col("vector").alias("query_vector"))
    lined = F.col("text").rlike("[^ \n]").alias("lined")  # some line isn't blank
    docs = rows.where("level = 1").select("chunk_id", "doc_id", "section", "year", lined).join(vectors, "doc_id").select("chunk_id", "section", "year", "lined", "vector")
    near = R.dense(questions, docs, DEPTH, ("section", "year", "lined"))
    # Of a document's lines, which are equal here, the first are enough.
    order = W.partitionBy("level", "parent_id").orderBy("chunk_id")
    few = rows.where("level > 1").select("level", "chunk_id", "parent_id", "section", "year").withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= DEPTH).drop("__n")
    deep = near.where("lined").withColumnRenamed("chunk_id", "parent_id").drop("section", "year").join(few, "parent_id").drop("parent_id", "lined")
    dense = near.drop("lined").withColumn("level", F.lit(1)).unionByName(deep)
    dense = dense.join(texts.select(F.col("finder_id").alias("query_id"), "enhance"), "query_id").withColumnRenamed("query_id", "finder_id")
    every = sparse.unionByName(dense.select(*KEYS, F.lit("dense").alias("source"), "section", "year", "chunk_id", "score"))
    return R.top(every, DEPTH, (*KEYS, "source", "section", "year")).drop("rank")


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """finder_id, enhance, level, source, router ("" for no sections), chunk_id, rank, score: the lists that configs merge.

    Questions that name years have the best chunks of these; the others each year's share of the depth, newest first.
    """
    cells = stage(spark, sf_dir, "cells", _cells)
    named = sweep.questions(spark, sf_dir).select("finder_id", U.years(F.col("period")).alias("years"))
    rows = cells.withColumn("router", F.lit("")).unionByName(cells.join(routes(spark, sf_dir), ["finder_id", "section"])).join(named, "finder_id")
    keys = (*KEYS, "source", "router")
    flat = R.top(rows.where("array_contains(years, year)"), DEPTH, keys).select(*keys, "chunk_id", "rank", "score")
    window = spark.range(1).select(F.inline(R.year_weights(U.default_window())))
    share = window.select("year", F.greatest(F.lit(1), F.bround(F.col("weight") * DEPTH).cast("int")).alias("share"))
    recent = rows.where("years IS NULL").join(F.broadcast(share), "year")  # as many rows as the window has years
    place = W.partitionBy(*keys, "year").orderBy(F.desc("score"), "chunk_id")
    recent = recent.withColumn("place", F.row_number().over(place)).where("place <= share").withColumn("score", F.round(1 / (R.FUSE_K + F.col("place")), 9))
    order = W.partitionBy(*keys).orderBy(F.desc("score"), F.desc("year"), "chunk_id")
    recent = recent.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= DEPTH).withColumn("rank", F.col("rank") - 1)
    return flat.unionByName(recent.select(*keys, "chunk_id", "rank", "score"))


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """finder_id, config_key, chunk_id, rank, score: final lists of all 72 configs."""
    lists = stage(spark, sf_dir, "lists", _lists)
    routed, out = (*KEYS, "router"), []
    for mode in MODES:
        if mode == "hybrid":
            own = R.fuse([lists.where("source = 'dense'"), lists.where("source = 'sparse'")], DEPTH, routed)
        else:
            own = lists.where(F.col("source") == mode).select(*routed, "chunk_id", "rank", "score")
        every, name = own.where("router = ''").drop("router"), F.lit(mode).alias("mode")
        out.append(every.where(F.col("rank") < sweep.TOP_K).select(*KEYS, name, F.lit(0).alias("alpha"), F.lit("").alias("router"), "chunk_id", "rank", "score"))
        for router in ROUTERS:
            inside = own.where(F.col("router") == router).drop("router").where(F.col("rank") < max(DEPTH // 2, sweep.TOP_K))
            out.append(R.fuse([inside, every], sweep.TOP_K, KEYS, [1.0, 0.0]).select(*KEYS, name, F.lit(1).alias("alpha"), F.lit(router).alias("router"), "chunk_id", "rank", "score"))
    union = out[0]
    for x in out[1:]:
        union = union.unionByName(x)
    rows = corpus(spark, sf_dir).select("chunk_id", "parent_id")
    keys = (*KEYS, "mode", "alpha", "router")
    done = R.collapse(union.join(rows, "chunk_id", "left"), rows.where("parent_id IS NULL"), keys)
    grid = sweep.configs(spark, levels=(1, 2, 3), routers=ROUTERS).withColumn("router", F.when(F.col("alpha") == 0, "").otherwise(F.col("router")))
    return done.join(F.broadcast(grid.select("level", "mode", "enhance", "alpha", "router", "config_key")), ["level", "mode", "enhance", "alpha", "router"]).select("finder_id", "config_key", "level", "mode", "enhance", "alpha", "router", "chunk_id", "rank", "score")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, sf_dir, "grid-results", ranked)


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """finder_id, config_key, axes and three metrics of every run of the grid."""
    found = results(spark, sf_dir)
    text = sweep.chunks(spark, sf_dir, found.select("chunk_id").distinct()).where("level = 1").select("chunk_id", "text")
    pairs = found.select("finder_id", "chunk_id").distinct().join(sweep.questions(spark, sf_dir).select("finder_id", "truth"), "finder_id").join(text, "chunk_id")
    rel = pairs.select("finder_id", "chunk_id", X.word_recall("truth", "text").alias("word"), X.num_recall("truth", "text").alias("num"))
    rows = found.join(rel, ["finder_id", "chunk_id"]).withColumn("good", F.greatest("word", "num") >= 0.5)
    return rows.groupBy("finder_id", "config_key", "level", "mode", "enhance", "alpha", "router").agg(
        F.bround(F.max("word"), 4).alias("word_recall"), F.coalesce(F.round(1.0 / F.min(F.when(F.col("good"), F.col("rank") + 1)), 6), F.lit(0.0)).alias("soft_mrr"),
        F.max((F.col("good") & (F.col("rank") < 3)).cast("int")).cast("double").alias("soft_recall3"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, sf_dir, "grid-runs", _runs)
