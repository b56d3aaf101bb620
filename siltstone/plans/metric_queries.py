"""Queries of row-level metrics, generation, judging and reports over the run table."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators import dense, judge, stats, sweep, truth
from siltstone.operators import retrieval as R
from siltstone.operators import understanding as U
from siltstone.plans import routing_queries, table_queries
from siltstone.plans.sweep_sql import salient, share, tokens, upto, words


def calibration(spark, sf_dir):
    """Relevance of what was found, and of as many chunks drawn at random, at each threshold."""
    rel = sweep.relevance(spark, sf_dir)
    found = rel.select(F.greatest("word", "num").alias("score"))
    draws = rel.select("finder_id", F.concat_ws(":", "finder_id", "chunk_id").alias("draw"))
    corpus = sweep.chunks(spark, sf_dir).where("level = 1")
    null = truth.random_chunks(draws, corpus).join(corpus.select("chunk_id", "text"), "chunk_id").join(sweep.questions(spark, sf_dir).select("finder_id", "truth"), "finder_id")
    null = null.select(F.greatest(X.word_recall("truth", "text"), X.num_recall("truth", "text")).alias("score"))
    return truth.calibration(found, "retrieved").unionByName(truth.calibration(null, "random"))


def wide(spark, sf_dir):
    """The wide row of each run: question, retrieval, metrics, truth, features, flags."""
    runs = sweep.runs(spark, sf_dir)
    q = sweep.questions(spark, sf_dir).select("finder_id", "truth", "period")
    ans = answered(spark, sf_dir).select("finder_id", "retrieved_ids", "answer")
    rows = runs.join(routing_queries.aligned(spark, sf_dir), ["finder_id", "config_key"]).join(q, "finder_id").join(ans, ["finder_id", "retrieved_ids"])
    years = U.years(F.col("period"))
    return rows.select(
        *[c for c in runs.columns if c not in ("query", "retrieved_ids")], "n_truth", "n_found", "best_rank", truth.pitfalls(F.col("wrong_year"), F.col("flag")).alias("pitfalls"), F.size(F.split(F.trim("query"), r"\s+")).alias("query_length"),
        F.coalesce(F.size(years) > 1, F.lit(False)).alias("year_is_multi"), F.length("answer").alias("answer_length"), F.col("answer").rlike(r"\d").alias("answer_has_number"),
        F.bround(X.word_recall("truth", "answer"), 4).alias("answer_word_recall"), F.bround(X.num_recall("truth", "answer"), 4).alias("answer_num_recall"), F.md5("retrieved_ids").alias("ids_md5"),
    )


def stub(context):
    """Stub of the answering model: the third line of the context that it is shown (the first source's first line follows a heading)."""
    return F.get(F.split(context, "\n"), F.lit(1))


def answered(spark, sf_dir):
    found = truth.contexts(sweep.results(spark, sf_dir), sweep.chunks(spark, sf_dir).where("level = 1").select("chunk_id", "ticker", "fiscal_year_end", "text"))
    none = sweep.questions(spark, sf_dir).join(sweep.results(spark, sf_dir).select("finder_id").distinct(), "finder_id", "left_anti").select("finder_id", F.lit("").alias("retrieved_ids"), F.lit(0).alias("n_sources"), F.lit(None).cast("string").alias("context"))
    return truth.answers(found.unionByName(none), stub)


def judged_replies(spark, sf_dir):
    """Verdicts by way of written replies: hashed order, reply, parse, order undone."""
    r = sweep.runs(spark, sf_dir)
    base = r.where(F.col("config_key") == judge.BASELINE).select("finder_id", F.col("retrieved_ids").alias("b_ids"), F.col("word_recall").alias("b_word"), F.col("soft_mrr").alias("b_mrr"))
    pairs = r.select("finder_id", "retrieved_ids", "word_recall", "soft_mrr").distinct().join(base, "finder_id").where("retrieved_ids <> b_ids")
    pairs = pairs.withColumn("swap", judge.should_swap(F.col("finder_id"), F.col("retrieved_ids")))
    pairs = pairs.withColumn("reply", judge.reply(F.col("word_recall"), F.col("b_word"), F.col("soft_mrr"), F.col("b_mrr"), F.col("swap")))
    rel, comp = judge.parse_response(F.col("reply"))
    return pairs.select("finder_id", F.md5("retrieved_ids").alias("ids_md5"), judge.unswap(rel, F.col("swap")).alias("relevance"), judge.unswap(comp, F.col("swap")).alias("completeness"))


def resumed(spark, sf_dir):
    """Half of the verdicts exist; only the others are judged."""
    rows = judge.judged(spark, sf_dir).select("finder_id", "config_key", "word_recall", F.col("relevance").alias("full"))
    half = rows.withColumn("relevance", F.when(F.col("finder_id") % 2 == 0, F.lit("kept")))
    return judge.resumed(half, F.col("full")).groupBy("relevance").agg(F.count("*").alias("n"))


def run_ids(spark, sf_dir):
    o = sweep.read(spark, sf_dir, "orders")
    ticker = F.when(F.col("o_orderkey") % 5 == 0, F.lit("None")).otherwise(F.lower("o_orderstatus"))
    mode = F.get(F.array(F.lit("dense_"), F.lit("sparse_"), F.lit("hybrid_"), F.lit("")), (F.col("o_orderkey") % 4).cast("int"))
    y = F.year("o_orderdate")
    p = o.select("o_orderkey", truth.run_id_parts(F.concat(ticker, F.lit("_"), y, F.lit("-"), y + 1, F.lit("_header_"), mode, F.col("o_orderkey"))).alias("p"), truth.field_values(F.concat(F.lit("['"), "o_orderstatus", F.lit("', None, "), y, F.lit("]"))).alias("f"))
    return p.select("o_orderkey", F.coalesce("p.ticker", F.lit("")).alias("ticker"), F.array_join("p.years", ",").alias("years"), F.coalesce("p.mode", F.lit("")).alias("mode"), F.array_join("f", "|").alias("field"))


def years_budget(spark, sf_dir):
    """Recency budgets over the sparse scores of each question: shares of 15 by year of the document."""
    scored, window = _scored(spark, sf_dir)
    return R.budgeted(scored, window, 15).select("query_id", "chunk_id", F.col("year"), "rank", F.round("score", 9).alias("score"))


def _scored(spark, sf_dir):
    corpus = sweep.chunks(spark, sf_dir).where("level = 1")
    q = sweep.questions(spark, sf_dir).select(F.col("finder_id").alias("query_id"), F.col("query").alias("text"))
    years = corpus.select("chunk_id", F.year("fiscal_year_end").alias("year"))
    window = spark.range(1).select(F.inline(R.year_weights(U.default_window())))
    return R.bm25(q, R.postings(corpus), R.corpus_stats(corpus)).join(years, "chunk_id"), window


def resolved(spark, sf_dir):
    """Questions that name years search these years alone; the others have recency budgets over the default window."""
    scored, window = _scored(spark, sf_dir)
    named = sweep.questions(spark, sf_dir).select(F.col("finder_id").alias("query_id"), U.years(F.col("period")).alias("years"))
    rows = scored.join(named, "query_id")
    flat = R.top(rows.where("array_contains(years, year)"), 5).select("query_id", "chunk_id", "year", "rank")
    return flat.unionByName(R.budgeted(rows.where("years IS NULL").drop("years"), window, 5).select("query_id", "chunk_id", "year", "rank"))


def tickers(spark, sf_dir):
    """Questions by the set of tickers that some config found for them."""
    sets = sweep.relevance(spark, sf_dir).groupBy("finder_id").agg(F.array_join(F.array_sort(F.collect_set("ticker")), ",").alias("tickers"))
    return sets.groupBy("tickers").agg(F.count("*").alias("n"))


def level_overlap(spark, sf_dir):
    r = judge.judged(spark, sf_dir)
    a = r.select("finder_id", "mode", "enhance", "alpha", "level", F.split("retrieved_ids", r"\|").alias("ids"))
    b = a.withColumnsRenamed({"level": "level_b", "ids": "ids_b"})
    both = a.join(b, ["finder_id", "mode", "enhance", "alpha"]).where("level < level_b")
    return both.groupBy("level", "level_b").agg(F.count("*").alias("cells"), F.count_if(F.col("ids") == F.col("ids_b")).alias("equal"), F.round(F.avg(R.jaccard(F.col("ids"), F.col("ids_b"))), 6).alias("mean_jaccard"))


METRICS = ("word_recall", "soft_mrr", "soft_recall3")


def contrasts(spark, sf_dir):
    rows = stats.arms(sweep.runs(spark, sf_dir), METRICS)
    return rows.groupBy("contrast", "metric").agg(F.count("*").alias("questions"), F.round(F.avg("d") + 1e-10, 6).alias("effect"), F.min("crossed").alias("crossed"))


def category_report(spark, sf_dir):
    """Per category and over all: means without and with the section blend, their difference, gains and losses, p and its corrections."""
    r = sweep.runs(spark, sf_dir)
    one = r.groupBy(F.coalesce("category", F.lit("?")).alias("category"), "finder_id").agg(F.avg(F.when(F.col("alpha") == 0, F.col("soft_recall3"))).alias("a0"), F.avg(F.when(F.col("alpha") == 1, F.col("soft_recall3"))).alias("a1")).where("a0 IS NOT NULL AND a1 IS NOT NULL")
    both = one.unionByName(one.withColumn("category", F.lit("OVERALL")))
    means = both.groupBy("category").agg(F.count("*").alias("questions"), *[F.round(F.avg(c) + 1e-10, 6).alias(c) for c in ("a0", "a1")], F.round(F.avg(F.col("a1") - F.col("a0")) + 1e-10, 6).alias("delta"), F.count_if(F.col("a1") > F.col("a0")).alias("gains"), F.count_if(F.col("a1") < F.col("a0")).alias("losses"))
    tests = means.select("category", F.round(stats.binomial_p(F.col("gains"), F.col("losses")), 6).alias("p"), F.when(F.col("category") == "OVERALL", "overall").otherwise("categories").alias("family"))
    return means.join(stats.corrections(tests, ["family"], "category").drop("family"), "category")


def query_detail(spark, sf_dir):
    """One row for each question and metric: without and with the section blend."""
    r = sweep.runs(spark, sf_dir)
    long = r.select("finder_id", "alpha", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in METRICS])))
    a = lambda k: F.avg(F.when(F.col("alpha") == k, F.col("v")))
    return long.groupBy("finder_id", "metric").agg(F.round(a(0) + 1e-10, 6).alias("a0"), F.round(a(1) + 1e-10, 6).alias("a1"), F.round(a(1) - a(0) + 1e-10, 6).alias("delta"))


def pooled(spark, sf_dir):
    rows = stats.pooled(sweep.runs(spark, sf_dir), judge.BASELINE)
    return rows.groupBy("arm").agg(F.count("*").alias("questions"), F.round(F.avg("d") + 1e-10, 6).alias("mean_delta"), F.count_if(F.col("d") > 0).alias("better"), F.count_if(F.col("d") < 0).alias("worse"))


def retrieval_report(spark, sf_dir):
    """Per metric: leader, size of the leading set, pooled top three against the baseline, share of resamples that the leader wins."""
    r = sweep.runs(spark, sf_dir)
    out = None
    for m in METRICS:
        sep = stats.separation(r, m)
        lead = sep.agg(F.min_by("config_key", "place").alias("leader"), F.count_if("leading").alias("n_leading"))
        pool = stats.tested(stats.pooled(r, judge.BASELINE, metric=m).where("arm = 'top3'"), ["arm"]).select(F.col("mean_delta").alias("pooled_delta"), F.col("p").alias("pooled_p"))
        best = stats.bootstrap_best(r, 5000, m).agg(F.max("p_best").alias("p_best"))
        one = lead.crossJoin(pool).crossJoin(best).withColumn("metric", F.lit(m))  # one row each
        out = one if out is None else out.unionByName(one)
    return out


def leaders(spark, sf_dir):
    """What is exact in the retrieval report: per metric the leader, its mean, and the share of 5,000 resamples that it wins."""
    r, out = sweep.runs(spark, sf_dir), None
    for m in METRICS:
        means = r.groupBy("config_key").agg(F.round(F.avg(m), 9).alias("mean"))
        first = means.orderBy(F.desc("mean"), "config_key").limit(1)
        one = first.join(stats.bootstrap_best(r, 5000, m), "config_key").select(F.lit(m).alias("metric"), F.col("config_key").alias("leader"), F.round(F.col("mean") + 1e-10, 6).alias("mean"), "p_best")
        out = one if out is None else out.unionByName(one)
    return out


def dense_indexed(spark, sf_dir):
    """The 10 nearest of all vectors to each vector whose id 50 divides, on inverted lists."""
    v = sweep.read(spark, sf_dir, "embeddings").where("embedding IS NOT NULL")
    size = v.agg(F.max(F.size("embedding"))).first()[0] or 1
    index = dense.inverted_lists(v.select(F.format_string("v%09d", "vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label"), size)
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return dense.search(asked, index, 10)[0]


def tie_agreement(spark, sf_dir):
    """Crosstab of both verdicts of judged pairs, win, tie or loss, and the share of each with structural rows left out."""
    kind = lambda c: F.when(F.col(c) == "A", "win").when(F.col(c) == "B", "loss").otherwise("tie")
    rows = judge.judged(spark, sf_dir).where(~F.col("relevance").isin("is_baseline", "no_baseline", "same_as_baseline"))
    cells = rows.groupBy(kind("relevance").alias("relevance"), kind("completeness").alias("completeness")).agg(F.count("*").alias("n"))
    return cells.select("*", F.round(F.col("n") / F.sum("n").over(stats.W.partitionBy()), 6).alias("share"))  # nine rows


def pitfall_counts(spark, sf_dir):
    """A14: how often each pitfall occurs, by mode."""
    return wide(spark, sf_dir).select("mode", F.explode(F.split("pitfalls", ", ")).alias("pitfall")).groupBy("mode", "pitfall").agg(F.count("*").alias("n"))


def config_summary(spark, sf_dir):
    """A2 with the truth count."""
    w = wide(spark, sf_dir)
    return w.groupBy("config_key").agg(F.first("mode", True).alias("mode"), F.count("*").alias("n"), F.sum("n_truth").alias("n_truth"), F.round(F.avg("answer_word_recall") + 1e-10, 6).alias("answer_recall"), F.count_if("evidence_hit").alias("hits"))


def correlation_rows(spark, sf_dir):
    hit = F.col("evidence_hit").cast("int").alias("hit")
    verdict = lambda c, name: F.when(F.col(c) == "A", 1).when(F.col(c) == "B", 0).alias(name)
    rows = judge.judged(spark, sf_dir).select("*", hit, F.size(F.split(F.trim("query"), r"\s+")).alias("query_length"))
    rows = rows.select(*COLUMNS_OWN, "hit", "query_length", "enhance", "level", "alpha")
    return stats.correlations(rows, COLUMNS)


COLUMNS_OWN = ["word_recall", "num_recall", "soft_mrr", "soft_recall3", "n_retrieved", "section_diversity", "wrong_year"]
COLUMNS = [*COLUMNS_OWN, "hit", "query_length", "enhance", "level", "alpha"]


def full_grid(spark, sf_dir):
    """G1 at its full size: three levels, three modes, both wordings, no blend or one of three routers."""
    grid = sweep.configs(spark, levels=(1, 2, 3), alphas=(0, 1), routers=("oracle", "classifier", "agent"))
    return grid.join(sweep.questions(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n_questions"))).select("config_key", "level", "mode", "enhance", "alpha", "category", "n_questions")


QUERIES = {
    "m09_calibration": calibration,
    "m10_coverage": lambda s, d: sweep.runs(s, d).groupBy("level").agg(F.count("*").alias("n"), F.count_if("evidence_hit").alias("hits"), F.round(F.avg(F.col("evidence_hit").cast("int")), 3).alias("hit_rate")),
    "m11_fingerprints": lambda s, d: truth.fingerprints(sweep.chunks(s, d).where("level = 2")).select(F.md5("prefix").alias("prefix_md5"), "chunk_id"),
    "m18_wide_rows": wide,
    "m22_replies": judged_replies,
    "m24_resumed": resumed,
    "g01_full_grid": full_grid,
    "g03_ticker_sets": tickers,
    "g06_answers": lambda s, d: answered(s, d).select("finder_id", "n_sources", F.md5("retrieved_ids").alias("ids_md5"), F.md5(truth.shown(F.col("answer"))).alias("answer_md5")),
    "g08_third_failures": lambda s, d: truth.third_failures(sweep.read(s, d, "events").withColumn("failed", F.col("event_type") == "error"), ["user_id"], ["ts", "event_id"], "failed").select("user_id", "event_id"),
    "g11_run_ids": run_ids,
    "r07_year_budgets": years_budget,
    "r08_resolved_years": resolved,
    "o08_level_overlap": level_overlap,
    "a02_truth_counts": config_summary,
    "a05_all_correlations": correlation_rows,
    "a14_pitfalls": pitfall_counts,
    "x07_category_report": category_report,
    "x09_metric_detail": query_detail,
    "x14_leading_set": lambda s, d: stats.separation(sweep.runs(s, d)),
    "x15_pooled": pooled,
    "x16_versus_baseline": lambda s, d: stats.versus_baseline(sweep.runs(s, d), judge.BASELINE),
    "x18_tie_agreement": tie_agreement,
    "x20_all_contrasts": contrasts,
    "x21_retrieval_report": retrieval_report,
    "x21_leaders": leaders,
    "r02_indexed": dense_indexed,
}

_H = "('0x' || substr(md5({c}), {at}, 7))::BIGINT"
_ANSWERS = """, l AS (SELECT DISTINCT finder_id, string_agg(chunk_id, '|' ORDER BY rank) AS retrieved_ids FROM results GROUP BY finder_id, config_key),
ans AS (SELECT l.finder_id, retrieved_ids, len(string_split(retrieved_ids, '|'))::INT AS n_sources, string_split(text, chr(10))[1] AS answer FROM l JOIN docs1 c ON c.chunk_id = string_split(retrieved_ids, '|')[1]
 UNION ALL SELECT finder_id, '', 0, 'No relevant context retrieved.' FROM questions WHERE finder_id NOT IN (SELECT finder_id FROM results))"""
_ALIGNED = routing_queries.SQL["m14_truth_alignment"]
_ALIGNED_WITH = _ALIGNED[: _ALIGNED.rindex(" SELECT finder_id, config_key, n_truth")]
_WIDE = _ALIGNED_WITH + _ANSWERS + rf""", wide AS (SELECT u.* EXCLUDE (query, retrieved_ids), n_truth, n_found, best_rank,
 CASE WHEN wrong_year > 0 AND n_truth = 0 THEN 'WRONG_YEAR, TRUTH_NOT_IN_CORPUS' WHEN wrong_year > 0 AND n_found = 0 THEN 'WRONG_YEAR, TRUTH_NOT_RETRIEVED' WHEN wrong_year > 0 THEN 'WRONG_YEAR' WHEN n_truth = 0 THEN 'TRUTH_NOT_IN_CORPUS' WHEN n_found = 0 THEN 'TRUTH_NOT_RETRIEVED' ELSE '-' END AS pitfalls,
 len(string_split_regex(trim(u.query), '\s+'))::INT AS query_length, period = '2022-2023' AS year_is_multi, length(answer)::INT AS answer_length, regexp_matches(answer, '\d') AS answer_has_number,
 round_even({share('ew', 'cw')}, 4) AS answer_word_recall, round_even(CASE WHEN len(en) < 4 THEN 0.0 ELSE {share('en', 'cn')} END, 4) AS answer_num_recall, md5(u.retrieved_ids) AS ids_md5
 FROM runs u JOIN r USING (finder_id, config_key) JOIN c USING (finder_id) JOIN (SELECT finder_id, period, {words('truth')} AS ew, {salient('truth')} AS en FROM questions) q USING (finder_id)
 JOIN (SELECT finder_id, retrieved_ids, answer, {words('answer')} AS cw, {salient('answer')} AS cn FROM ans) a ON a.finder_id = u.finder_id AND a.retrieved_ids = u.retrieved_ids)"""
_BUDGET = """, sp AS (SELECT finder_id AS query_id, t.chunk_id, year(fiscal_year_end) AS year, score FROM sparse t JOIN docs1 USING (chunk_id) WHERE t.level = 1 AND enhance = 0),
bud(year, k5, k15) AS (VALUES (2024, 3, 8), (2023, 1, 4), (2022, 1, 2), (2021, 1, 1), (2020, 1, 1))"""
_KIND = "CASE {c} WHEN 'A' THEN 'win' WHEN 'B' THEN 'loss' ELSE 'tie' END"
_CELLS = " UNION ALL ".join(f"SELECT finder_id, mode, level, enhance, alpha, '{m}' AS metric, {m}::DOUBLE AS v FROM runs" for m in METRICS)
_ARMS = " UNION ALL ".join(
    f"SELECT '{name}' AS contrast, metric, finder_id, avg(v) FILTER ({axis} IN {(*t, t[0])!r}) AS t, avg(v) FILTER ({axis} IN {(*c, c[0])!r}) AS c FROM cells GROUP BY metric, finder_id" for name, axis, t, c in stats.CONTRASTS
)
_LEADERS = upto("runs") + """, v AS (SELECT finder_id, config_key, metric, value FROM (SELECT finder_id, config_key, word_recall::DOUBLE AS word_recall, soft_mrr::DOUBLE AS soft_mrr, soft_recall3::DOUBLE AS soft_recall3 FROM runs) UNPIVOT (value FOR metric IN (word_recall, soft_mrr, soft_recall3))),
q AS (SELECT finder_id, row_number() OVER (ORDER BY finder_id) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT finder_id FROM runs)),
d AS (SELECT b, ('0x' || substr(md5('0:' || b || ':' || k), 1, 8))::BIGINT % n AS k FROM q, range(5000) r(b)),
c AS (SELECT b, k, count(*) AS times FROM d GROUP BY ALL),
s AS (SELECT b, metric, config_key, round(sum(times * value) / sum(times), 9) AS m FROM c JOIN q USING (k) JOIN v USING (finder_id) GROUP BY ALL),
w AS (SELECT metric, config_key, count(*) / 5000.0 AS p_best FROM (SELECT *, row_number() OVER (PARTITION BY b, metric ORDER BY m DESC, config_key) AS place FROM s) WHERE place = 1 GROUP BY ALL),
l AS (SELECT metric, config_key, round(avg(value), 9) AS mean FROM v GROUP BY ALL),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY mean DESC, config_key) AS place FROM l) WHERE place = 1)
SELECT t.metric, t.config_key AS leader, round(mean + 1e-10, 6) AS mean, round(coalesce(p_best, 0.0), 6)::DOUBLE AS p_best FROM t LEFT JOIN w USING (metric, config_key)"""
_INDEXED = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
u AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS n FROM v WHERE list_inner_product(v, v) > 0),
p AS (SELECT a.vec_id AS query_id, printf('v%09d', b.vec_id) AS chunk_id, round(list_inner_product(a.v, b.v) / (a.n * b.n), 5) AS score FROM u a JOIN u b ON a.vec_id % 50 = 0 AND len(a.v) = len(b.v))
SELECT query_id, chunk_id, rank::INT AS rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM p) WHERE rank < 10"""
SQL = {
    "x21_leaders": _LEADERS,
    "r02_indexed": _INDEXED,
    "m09_calibration": upto("runs") + f""", own AS (SELECT chunk_id, text, md5(chunk_id) AS h, {_H.format(c='chunk_id', at=1)} % (SELECT greatest(16, (count(*) + 4095) // 4096) FROM docs1) AS bucket FROM docs1),
 placed AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY h) - 1 AS place, count(*) OVER (PARTITION BY bucket) AS size FROM own),
 d AS (SELECT finder_id, '0:' || finder_id || ':' || chunk_id AS draw FROM relevance), dr AS (SELECT d.*, {_H.format(c='draw', at=1)} % (SELECT greatest(16, (count(*) + 4095) // 4096) FROM docs1) AS bucket FROM d),
 z AS (SELECT dr.*, {_H.format(c='draw', at=8)} % size AS place FROM dr JOIN (SELECT DISTINCT bucket, size FROM placed) USING (bucket)),
 e AS (SELECT {words('truth')} AS ew, {words('text')} AS cw, {salient('truth')} AS en, {salient('text')} AS cn FROM z JOIN placed USING (bucket, place) JOIN questions USING (finder_id)),
 pools AS (SELECT 'retrieved' AS pool, greatest(word, num) AS score FROM relevance UNION ALL SELECT 'random', greatest({share('ew', 'cw')}, CASE WHEN len(en) < 4 THEN 0.0 ELSE {share('en', 'cn')} END) FROM e)
 SELECT threshold, pool, count(*) AS n, round(avg(CASE WHEN score >= threshold THEN 1.0 ELSE 0.0 END), 6) AS labelled FROM pools, (VALUES (0.3::DOUBLE), (0.4::DOUBLE), (0.5::DOUBLE), (0.6::DOUBLE), (0.7::DOUBLE)) v(threshold) GROUP BY threshold, pool""",
    "m10_coverage": upto("runs") + " SELECT level, count(*) AS n, count(*) FILTER (evidence_hit) AS hits, round(avg(evidence_hit::INT), 3) AS hit_rate FROM runs GROUP BY level",
    "m11_fingerprints": upto("chunks") + r", p AS (SELECT chunk_id, substr(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 1, 200) AS p FROM chunks WHERE level = 2) SELECT md5(p) AS prefix_md5, min(chunk_id) AS chunk_id FROM p WHERE p <> '' GROUP BY p",
    "m18_wide_rows": _WIDE + " SELECT * FROM wide",
    "m22_replies": table_queries.PREFIX + " SELECT DISTINCT finder_id, md5(retrieved_ids) AS ids_md5, CASE WHEN word_recall > b_word THEN 'A' WHEN word_recall < b_word THEN 'B' ELSE 'Tie' END AS relevance, CASE WHEN soft_mrr > b_mrr THEN 'A' WHEN soft_mrr < b_mrr THEN 'B' ELSE 'Tie' END AS completeness FROM runs JOIN base USING (finder_id) WHERE retrieved_ids <> b_ids",
    "m24_resumed": table_queries.PREFIX + " SELECT CASE WHEN finder_id % 2 = 0 THEN 'kept' ELSE relevance END AS relevance, count(*) AS n FROM verdicts GROUP BY 1",
    "g01_full_grid": upto("questions") + """, g AS (SELECT DISTINCT level, mode, enhance, CASE WHEN router = '' THEN 0 ELSE 1 END AS alpha, router FROM (VALUES (1), (2), (3)) l(level), (VALUES ('dense'), ('sparse'), ('hybrid')) m(mode), (VALUES (0), (1)) e(enhance), (VALUES (''), ('_ORACLE'), ('_CLASSIFIER'), ('_AGENT')) r(router))
 SELECT 'L' || level || '_' || upper(mode) || '_' || CASE WHEN enhance = 1 THEN 'ENH' ELSE 'PLAIN' END || '_A' || alpha || router AS config_key, level, mode, enhance, alpha, category, n_questions FROM g, (SELECT category, count(*) AS n_questions FROM questions GROUP BY category)""",
    "g03_ticker_sets": upto("runs") + " SELECT tickers, count(*) AS n FROM (SELECT finder_id, array_to_string(list_sort(list(DISTINCT ticker)), ',') AS tickers FROM relevance GROUP BY finder_id) GROUP BY tickers",
    "g06_answers": upto("results") + _ANSWERS + " SELECT finder_id, n_sources, md5(retrieved_ids) AS ids_md5, md5(CASE WHEN trim(answer) = '' THEN ' NO GENERATED ANSWER ' ELSE answer END) AS answer_md5 FROM ans",
    "g08_third_failures": "WITH e AS (SELECT user_id, ts, event_id, event_type = 'error' AS f, lag(event_type = 'error', 1, false) OVER w AS f1, lag(event_type = 'error', 2, false) OVER w AS f2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id FROM e WHERE f AND f1 AND f2 GROUP BY user_id",
    "g11_run_ids": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE lower(o_orderstatus) END AS ticker, year(o_orderdate) || ',' || (year(o_orderdate) + 1) AS years, ['dense', 'sparse', 'hybrid', ''][o_orderkey % 4 + 1] AS mode, o_orderstatus || '|' || year(o_orderdate) AS field FROM orders",
    "r07_year_budgets": upto("sparse") + _BUDGET + """, k AS (SELECT sp.*, row_number() OVER (PARTITION BY query_id, year ORDER BY score DESC, chunk_id) - 1 AS r, k15 FROM sp JOIN bud USING (year)),
 f AS (SELECT query_id, chunk_id, year, r, row_number() OVER (PARTITION BY query_id ORDER BY r, year DESC, chunk_id) - 1 AS rank FROM k WHERE r < k15) SELECT query_id, chunk_id, year, rank, round(1 / (60 + r + 1), 9) AS score FROM f WHERE rank < 15""",
    "r08_resolved_years": upto("sparse") + _BUDGET + """, s AS (SELECT sp.*, period FROM sp JOIN questions ON finder_id = query_id),
 flat AS (SELECT query_id, chunk_id, year, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM s WHERE (period = 'FY2024' AND year = 2024) OR (period = '2022-2023' AND year IN (2022, 2023))),
 k AS (SELECT s.*, row_number() OVER (PARTITION BY query_id, year ORDER BY score DESC, chunk_id) - 1 AS r, k5 FROM s JOIN bud USING (year) WHERE period = ''),
 f AS (SELECT query_id, chunk_id, year, row_number() OVER (PARTITION BY query_id ORDER BY r, year DESC, chunk_id) - 1 AS rank FROM k WHERE r < k5) SELECT * FROM flat WHERE rank < 5 UNION ALL SELECT * FROM f WHERE rank < 5""",
    "o08_level_overlap": upto("runs") + """, s AS (SELECT *, string_split(retrieved_ids, '|') AS ids FROM runs) SELECT a.level, b.level AS level_b, count(*) AS cells, count(*) FILTER (a.ids = b.ids) AS equal,
 round(avg(len(list_intersect(a.ids, b.ids)) / len(list_distinct(list_concat(a.ids, b.ids)))::DOUBLE), 6) AS mean_jaccard FROM s a JOIN s b ON a.finder_id = b.finder_id AND a.mode = b.mode AND a.enhance = b.enhance AND a.alpha = b.alpha AND a.level < b.level GROUP BY a.level, b.level""",
    "a02_truth_counts": _WIDE + " SELECT config_key, any_value(mode) AS mode, count(*) AS n, sum(n_truth)::BIGINT AS n_truth, round(avg(answer_word_recall) + 1e-10, 6) AS answer_recall, count(*) FILTER (evidence_hit) AS hits FROM wide GROUP BY config_key",
    "a05_all_correlations": upto("runs") + r", t AS (SELECT *, evidence_hit::INT AS hit, len(string_split_regex(trim(query), '\s+')) AS query_length FROM runs) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(CASE WHEN stddev_pop({a}) = 0 OR stddev_pop({b}) = 0 THEN NULL ELSE corr({a}, {b}) END, 6) + 0.0 AS r FROM t" for i, a in enumerate(COLUMNS) for b in COLUMNS[i + 1 :]),
    "a14_pitfalls": _WIDE + " SELECT mode, pitfall, count(*) AS n FROM (SELECT mode, unnest(string_split(pitfalls, ', ')) AS pitfall FROM wide) GROUP BY mode, pitfall",
    "x07_category_report": upto("runs") + """, o AS (SELECT category, finder_id, avg(soft_recall3) FILTER (alpha = 0) AS a0, avg(soft_recall3) FILTER (alpha = 1) AS a1 FROM runs GROUP BY ALL),
 b AS (SELECT * FROM o WHERE a0 IS NOT NULL AND a1 IS NOT NULL UNION ALL SELECT 'OVERALL', finder_id, a0, a1 FROM o WHERE a0 IS NOT NULL AND a1 IS NOT NULL),
 m AS (SELECT category, count(*) AS questions, round(avg(a0) + 1e-10, 6) AS a0, round(avg(a1) + 1e-10, 6) AS a1, round(avg(a1 - a0) + 1e-10, 6) AS delta, count(*) FILTER (a1 > a0) AS gains, count(*) FILTER (a1 < a0) AS losses FROM b GROUP BY category),
 t AS (SELECT *, category = 'OVERALL' AS family, round(CASE WHEN gains + losses = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(gains, losses) + 1), lambda i: exp(coalesce(list_sum(list_transform(range(1, i + 1), lambda j: ln((gains + losses - j + 1) / j))), 0) - (gains + losses) * ln(2))))) END, 6) AS p FROM m),
 k AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, category) AS r, count(*) OVER (PARTITION BY family) AS n FROM t)
 SELECT category, questions, a0, a1, delta, gains, losses, p, round(least(1.0, max((n - r + 1) * p) OVER (PARTITION BY family ORDER BY r)), 6) AS holm, round(least(1.0, min(n * p / r) OVER (PARTITION BY family ORDER BY r DESC)), 6) AS bh FROM k""",
    "x09_metric_detail": upto("runs") + f", cells AS ({_CELLS}) SELECT finder_id, metric, round(avg(v) FILTER (alpha = 0) + 1e-10, 6) AS a0, round(avg(v) FILTER (alpha = 1) + 1e-10, 6) AS a1, round(avg(v) FILTER (alpha = 1) - avg(v) FILTER (alpha = 0) + 1e-10, 6) AS delta FROM cells GROUP BY finder_id, metric",
    "x15_pooled": upto("runs") + f""", m AS (SELECT config_key, round(avg(word_recall), 9) AS m FROM runs GROUP BY config_key),
 a AS (SELECT 'leader' AS arm, config_key FROM (SELECT config_key FROM m ORDER BY m DESC, config_key LIMIT 1) UNION ALL SELECT 'top3', config_key FROM (SELECT config_key FROM m WHERE config_key <> '{judge.BASELINE}' ORDER BY m DESC, config_key LIMIT 3)),
 v AS (SELECT arm, finder_id, avg(word_recall) AS v FROM runs JOIN a USING (config_key) GROUP BY ALL), d AS (SELECT arm, round(v - b.word_recall, 6) AS d FROM v JOIN runs b ON b.finder_id = v.finder_id AND b.config_key = '{judge.BASELINE}')
 SELECT arm, count(*) AS questions, round(avg(d) + 1e-10, 6) AS mean_delta, count(*) FILTER (d > 0) AS better, count(*) FILTER (d < 0) AS worse FROM d GROUP BY arm""",
    "x18_tie_agreement": table_queries.PREFIX + f" SELECT {_KIND.format(c='relevance')} AS relevance, {_KIND.format(c='completeness')} AS completeness, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM verdicts WHERE relevance NOT IN ('is_baseline', 'no_baseline', 'same_as_baseline') GROUP BY 1, 2",
    "x20_all_contrasts": upto("runs") + f", cells AS ({_CELLS}), arms AS ({_ARMS}) SELECT contrast, metric, count(*) AS questions, round(avg(round(t - c + 1e-10, 6)) + 1e-10, 6) AS effect, true AS crossed FROM arms WHERE t IS NOT NULL AND c IS NOT NULL GROUP BY contrast, metric",
}
