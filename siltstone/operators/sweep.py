"""Configuration sweep: corpus levels, questions, config grid, shared retrieval, overlap dedup, generation, run table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators import retrieval as R
from siltstone.operators import understanding as U
from siltstone.plans.store import stage

TOP_K = 5
ANCHOR_YEAR = 2024


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """Corpus of two levels.  Level 1: documents; level 2: their non-blank lines, children of the document.  ``only``: of these documents (chunk_id).

    ticker is the source, section the language, fiscal_year_end the last day of a year that follows from the id.
    """
    docs = read(spark, sf_dir, "documents").select(
        F.format_string("d%08d", "doc_id").alias("chunk_id"), F.lit(1).alias("level"), F.col("doc_id"), F.lit(None).cast("string").alias("parent_id"),
        F.coalesce("source", F.lit("")).alias("ticker"), F.coalesce("lang", F.lit("")).alias("section"),
        F.make_date(F.lit(ANCHOR_YEAR - 4) + (F.col("doc_id") % 5).cast("int"), F.lit(12), F.lit(31)).alias("fiscal_year_end"), F.coalesce("text", F.lit("")).alias("text"),
    )
    docs = docs if only is None else docs.join(only, "chunk_id", "left_semi")
    lines = docs.select("*", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.trim("line") != "")
    lines = lines.select(F.concat("chunk_id", F.format_string("/%06d", "pos")).alias("chunk_id"), F.lit(2).alias("level"), "doc_id", F.col("chunk_id").alias("parent_id"), "ticker", "section", "fiscal_year_end", F.col("line").alias("text"))
    return docs.unionByName(lines)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """finder_id, query (12 words of a passage), enhanced (24), truth (the passage), category, route (a section), period (words that name years, or none)."""
    rows = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("finder_id"), F.coalesce("text", F.lit("")).alias("truth"))
    sections = F.array(*[F.lit(x) for x in ("en", "fr", "de", "es")])
    return rows.select(
        "finder_id", X.first_words("truth", 12).alias("query"), X.first_words("truth", 24).alias("enhanced"), "truth",
        F.concat(F.lit("c"), (F.col("finder_id") % 4).cast("string")).alias("category"), F.get(sections, (F.col("finder_id") % 4).cast("int")).alias("route"),
        F.get(F.array(*[F.lit(x) for x in ("FY2024", "2022-2023", "")]), (F.col("finder_id") % 3).cast("int")).alias("period"),
    )


def configs(spark: SparkSession, levels=(1, 2), modes=("dense", "sparse", "hybrid"), enhance=(0, 1), alphas=(0, 1), routers=("",)) -> DataFrame:
    """The grid; alpha 0 is given once, without a router.  prefetch is the largest depth that a config of its (enhance, level) needs."""
    axis = lambda name, values: F.explode(F.array(*[F.lit(v) for v in values])).alias(name)
    grid = spark.range(1).select(axis("level", levels)).select("*", axis("mode", modes)).select("*", axis("enhance", enhance)).select("*", axis("alpha", alphas)).select("*", axis("router", routers))
    grid = grid.where((F.col("alpha") != 0) | (F.col("router") == routers[0]))
    router = F.when((F.col("alpha") == 0) | (F.col("router") == ""), "").otherwise(F.concat(F.lit("_"), F.upper("router")))
    key = F.concat(F.lit("L"), "level", F.lit("_"), F.upper("mode"), F.lit("_"), F.when(F.col("enhance") == 1, "ENH").otherwise("PLAIN"), F.lit("_A"), "alpha", router)
    depth = F.max(F.when(F.col("mode") == "hybrid", 3 * TOP_K).otherwise(TOP_K)).over(W.partitionBy("enhance", "level"))
    return grid.withColumn("config_key", key).withColumn("prefetch", depth)


def _tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked lists (finder_id, enhance, level, track, source, chunk_id, rank, score): retrieval once for each distinct question text and level, whatever the number of configs."""
    corpus = chunks(spark, sf_dir)
    q = questions(spark, sf_dir)
    texts = q.select("finder_id", "route", F.lit(0).alias("enhance"), F.col("query").alias("text")).unionByName(q.select("finder_id", "route", F.lit(1).alias("enhance"), F.col("enhanced").alias("text")))
    # Once for each distinct text (and, for its section's own list, route).
    free = texts.select("text", F.lit(None).cast("string").alias("section")).distinct()
    asked = free.unionByName(texts.select("text", F.col("route").alias("section")).where("section IS NOT NULL").distinct()).select(F.xxhash64("text", "section").alias("query_id"), "text", "section")
    out = []
    for level, best in enumerate(R.bm25_texts_and_lines(asked, corpus.where("level = 1"), 3 * TOP_K, ("section",), "section"), 1):
        out.append(best.select("query_id", F.lit(level).alias("level"), F.lit("sparse").alias("source"), "chunk_id", "section", "score"))
    sparse = out[0].unionByName(out[1])
    # A question's vector is the one with its id; a chunk has its document's.
    vectors = read(spark, sf_dir, "embeddings").where("embedding IS NOT NULL").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    asked = q.join(vectors, q.finder_id == vectors.doc_id).select(F.col("finder_id").alias("query_id"), F.col("vector").alias("query_vector"))
    # Lines have their document's score, so documents compete for both levels: the best of those that have lines, and of the rest.
    lined = F.col("text").rlike("[^ \n]").alias("lined")  # some line isn't blank
    docs = corpus.where("level = 1").select("chunk_id", "doc_id", "section", lined).join(vectors, "doc_id").select("chunk_id", "section", "lined", "vector")
    near = stage(spark, sf_dir, "dense-best", lambda *_: R.dense(asked, docs, 3 * TOP_K, ("section", "lined")))
    few = F.slice(F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("pos"), x.alias("line"))), lambda x: F.trim(x["line"]) != ""), 1, 3 * TOP_K)
    lines = corpus.where("level = 1").join(near.where("lined").select("chunk_id").distinct(), "chunk_id").select(F.col("chunk_id").alias("parent_id"), F.explode(few).alias("x"))
    lines = lines.select("parent_id", F.concat("parent_id", F.format_string("/%06d", "x.pos")).alias("chunk_id"))
    deep = near.withColumnRenamed("chunk_id", "parent_id").join(lines, "parent_id")
    lists = texts.select("finder_id", "enhance", "route", F.xxhash64("text", F.lit(None).cast("string")).alias("free"), F.xxhash64("text", "route").alias("routed"))
    named = lambda column: sparse.withColumnRenamed("query_id", column).join(lists, column).drop("free", "routed")
    dense = near.select("query_id", "chunk_id", "section", "score").withColumn("level", F.lit(1)).unionByName(deep.select("query_id", "chunk_id", "section", "score").withColumn("level", F.lit(2)))
    dense = dense.withColumn("source", F.lit("dense")).join(lists.drop("free", "routed"), dense.query_id == F.col("finder_id")).drop("query_id")
    everywhere, inside = named("free").unionByName(dense), named("routed").unionByName(dense).where("section = route")
    depth = configs(spark).groupBy("enhance", "level").agg(F.max("prefetch").alias("k"))
    keys = ("finder_id", "enhance", "level", "source")
    b = R.top(everywhere, 3 * TOP_K, keys).join(F.broadcast(depth), ["enhance", "level"]).where("rank < k").withColumn("track", F.lit("B"))
    a = R.top(inside, 3 * TOP_K, keys).join(F.broadcast(depth), ["enhance", "level"]).where(F.col("rank") < F.greatest(F.expr("k div 2"), F.lit(TOP_K))).withColumn("track", F.lit("A"))
    return b.unionByName(a).select("finder_id", "enhance", "level", "track", "source", "chunk_id", "rank", "score")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, sf_dir, "tracks", _tracks)


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final ranked lists of every (finder_id, config_key): mode, section blend, parent collapse, top 5."""
    t = tracks(spark, sf_dir)
    keys = ("finder_id", "enhance", "level")
    found_in = t.select(F.substring_index("chunk_id", "/", 1).alias("chunk_id")).distinct()  # only these are split into lines again
    corpus = chunks(spark, sf_dir, found_in).select("chunk_id", "parent_id")
    by = lambda track, source: t.where((F.col("track") == track) & (F.col("source") == source))
    out = []
    for mode in ("dense", "sparse", "hybrid"):
        for alpha in (0, 1):
            if mode == "hybrid":
                b = R.fuse([by("B", "dense"), by("B", "sparse")], 3 * TOP_K, keys)
                a = R.fuse([by("A", "dense"), by("A", "sparse")], 3 * TOP_K, keys)
            else:
                a, b = by("A", mode), by("B", mode)
            found = R.fuse([a, b], TOP_K, keys, [float(alpha), 1.0 - alpha]) if alpha else b.where(F.col("rank") < TOP_K).select(*keys, "chunk_id", "rank", "score")
            out.append(found.withColumn("mode", F.lit(mode)).withColumn("alpha", F.lit(alpha)))
    union = out[0]
    for x in out[1:]:
        union = union.unionByName(x)
    keys = ("finder_id", "enhance", "level", "mode", "alpha")
    union = union.join(corpus, "chunk_id", "left")
    done = R.collapse(union, corpus.where("parent_id IS NULL"), keys)
    grid = configs(spark).select("level", "mode", "enhance", "alpha", "config_key")
    return done.join(F.broadcast(grid), ["level", "mode", "enhance", "alpha"]).select("finder_id", "config_key", "level", "mode", "enhance", "alpha", "chunk_id", "rank", "score")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, sf_dir, "results", ranked)


def _relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and numbers of a question's passage in each chunk that some config found for it: relevance is the larger recall."""
    pairs = results(spark, sf_dir).select("finder_id", "chunk_id").distinct()
    text = chunks(spark, sf_dir, pairs.select("chunk_id").distinct()).where("level = 1").select("chunk_id", "ticker", "section", "fiscal_year_end", "text")  # only texts that were found are shuffled
    rows = pairs.join(questions(spark, sf_dir).select("finder_id", "truth"), "finder_id").join(text, "chunk_id")
    return rows.select("finder_id", "chunk_id", "ticker", "section", "fiscal_year_end", X.word_recall("truth", "text").alias("word"), X.num_recall("truth", "text").alias("num"), "text")


def relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, sf_dir, "relevance", _relevance)


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = relevance(spark, sf_dir)
    r = results(spark, sf_dir).join(rel.drop("text"), ["finder_id", "chunk_id"]).withColumn("rel", F.greatest("word", "num"))
    one = r.groupBy("finder_id", "config_key", "level", "mode", "enhance", "alpha").agg(
        F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "section", "ticker", F.year("fiscal_year_end").alias("year"), "rel"))).alias("found"),
        F.bround(F.max("word"), 4).alias("word_recall"), F.bround(F.max("num"), 4).alias("num_recall"), (F.max((F.col("word") >= 0.5).cast("int")) + F.max((F.col("num") >= 0.7).cast("int")) > 0).alias("evidence_hit"),
        F.coalesce(F.round(1.0 / F.min(F.when(F.col("rel") >= 0.5, F.col("rank") + 1)), 6), F.lit(0.0)).alias("soft_mrr"),
        F.max(((F.col("rel") >= 0.5) & (F.col("rank") < 3)).cast("int")).cast("double").alias("soft_recall3"),
    )
    q = questions(spark, sf_dir).select("finder_id", "category", "query", "route", U.years(F.col("period")).alias("years"))
    ids = F.transform("found", lambda s: s["chunk_id"])
    wrong = F.when(F.col("years").isNull(), 0).otherwise(F.size(F.filter("found", lambda s: ~F.array_contains("years", s["year"]))))
    return one.join(q, "finder_id").select(
        "finder_id", "config_key", "level", "mode", "enhance", "alpha", "category", "query", "route", F.array_join(ids, "|").alias("retrieved_ids"), F.size("found").alias("n_retrieved"), "word_recall", "num_recall",
        "evidence_hit", "soft_mrr", "soft_recall3", F.size(F.array_distinct(F.transform("found", lambda s: F.struct(s["section"], s["ticker"])))).alias("section_diversity"), most_common(F.transform("found", lambda s: s["section"])).alias("top_section"),
        F.get("found", F.lit(0))["ticker"].alias("ticker"), wrong.alias("wrong_year"), F.get("found", F.lit(0))["chunk_id"].alias("top_chunk"),
    )


def most_common(values):
    """The most frequent of an array, the first seen among equals."""
    counted = F.transform(F.array_distinct(values), lambda v, i: F.struct(F.size(F.filter(values, lambda x: x == v)).alias("n"), (-i).alias("first"), v.alias("v")))
    return F.array_max(counted)["v"]


def sparse_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """finder_id, retrieved_ids, soft_mrr, soft_recall3 of the baseline: sparse search of documents by the plain question."""
    corpus = chunks(spark, sf_dir).where("level = 1")
    q = questions(spark, sf_dir)
    asked = q.select(F.col("finder_id").alias("query_id"), F.col("query").alias("text"))
    found = R.bm25_texts(asked, corpus, TOP_K)
    rows = found.withColumnRenamed("query_id", "finder_id").join(q.select("finder_id", "truth"), "finder_id").join(corpus.select("chunk_id", "text"), "chunk_id")
    rows = rows.select("finder_id", "chunk_id", "rank", (F.greatest(X.word_recall("truth", "text"), X.num_recall("truth", "text")) >= 0.5).alias("good"))
    return rows.groupBy("finder_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda s: s["chunk_id"]), "|").alias("retrieved_ids"),
        F.coalesce(F.round(1.0 / F.min(F.when(F.col("good"), F.col("rank") + 1)), 6), F.lit(0.0)).alias("soft_mrr"),
        F.max((F.col("good") & (F.col("rank") < 3)).cast("int")).cast("double").alias("soft_recall3"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact table: one row for each question and config."""
    return stage(spark, sf_dir, "runs", _runs)
