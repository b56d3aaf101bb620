"""Queries of the whole sweep: three levels, routers that choose sets of sections, years of the question."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import grid, stats
from siltstone.operators import retrieval as R
from siltstone.plans.metric_queries import _ARMS, _CELLS, METRICS
from siltstone.plans.sweep_sql import fused, salient, share, tokens, upto, words


def lists(spark, sf_dir):
    return grid.stage(spark, sf_dir, "lists", grid._lists).where("rank < 5").select("finder_id", "enhance", "level", "source", "router", "chunk_id", "rank")


def keep_sets(spark, sf_dir):
    """O7 for pairs of levels and routers: cells of a question and design in which both lists agree, and their mean overlap."""
    r = grid.results(spark, sf_dir).groupBy("finder_id", "mode", "enhance", "alpha", "router", "level").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("l"))
    r = r.select("finder_id", "mode", "enhance", "alpha", "router", "level", F.transform("l", lambda s: s["chunk_id"]).alias("ids"))
    both = r.join(r.withColumnsRenamed({"level": "level_b", "ids": "ids_b"}), ["finder_id", "mode", "enhance", "alpha", "router"]).where("level < level_b")
    return both.groupBy("router", "level", "level_b").agg(F.count("*").alias("cells"), F.count_if(F.col("ids") == F.col("ids_b")).alias("equal"), F.round(F.avg(R.jaccard(F.col("ids"), F.col("ids_b"))), 6).alias("mean_jaccard"))


def contrasts(spark, sf_dir):
    """X20 over three levels: what each design choice adds, level 3 against level 2 included."""
    rows = stats.arms(grid.runs(spark, sf_dir), METRICS)
    return rows.groupBy("contrast", "metric").agg(F.count("*").alias("questions"), F.round(F.avg("d") + 1e-10, 6).alias("effect"), F.min("crossed").alias("crossed"))


QUERIES = {
    "x20_grid": contrasts,
    "g01_lists": lists,
    "g01_results": lambda s, d: grid.results(s, d).select("finder_id", "config_key", "level", "mode", "enhance", "alpha", "router", "chunk_id", "rank"),
    "o07_keep_sets": keep_sets,
}

_BASE = upto("questions") + rf""",
corp AS MATERIALIZED (SELECT chunk_id, level, doc_id, parent_id, section, year(fiscal_year_end) AS year, text FROM chunks
  UNION ALL SELECT chunk_id || '+', 3, doc_id, parent_id, section, year(fiscal_year_end), text || ' ' || section || ' ' || ticker FROM chunks WHERE level = 2),
texts AS (SELECT finder_id, 0 AS enhance, query AS text FROM questions UNION ALL SELECT finder_id, 1, enhanced FROM questions),
toks AS MATERIALIZED (SELECT chunk_id, level, section, year, {tokens('text')} AS w FROM corp),
tf AS (SELECT chunk_id, level, section, year, dl, term, count(*) AS tf FROM (SELECT chunk_id, level, section, year, len(w) AS dl, unnest(w) AS term FROM toks) GROUP BY ALL),
lens AS (SELECT level, count(*)::DOUBLE AS n, avg(len(w))::DOUBLE AS avgdl FROM toks GROUP BY level),
qt AS (SELECT finder_id, enhance, unnest(list_distinct({tokens('text')})) AS term FROM texts),
idf AS (SELECT level, term, ln((n - df + 0.5) / (df + 0.5) + 1.0) AS idf, avgdl FROM (SELECT level, term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM qt) GROUP BY ALL) JOIN lens USING (level)),
sp AS (SELECT finder_id, enhance, tf.level, 'sparse' AS source, chunk_id, section, year, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
       FROM qt JOIN tf USING (term) JOIN idf ON idf.term = tf.term AND idf.level = tf.level GROUP BY ALL),
vec AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
ds AS (SELECT t.finder_id, t.enhance, c.level, 'dense' AS source, c.chunk_id, c.section, c.year, round(list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))), 5) AS score
       FROM texts t JOIN vec a ON a.doc_id = t.finder_id, corp c JOIN vec b ON b.doc_id = c.doc_id),
every AS (SELECT * FROM sp UNION ALL BY NAME SELECT * FROM ds),
pick AS (SELECT finder_id, r.router, unnest(r.s) AS section FROM (SELECT finder_id, unnest([{{'router': 'single', 's': [route]}}, {{'router': 'pair', 's': [route, o]}}, {{'router': 'shy', 's': CASE WHEN finder_id % 5 <> 0 THEN [o] ELSE [] END}}]) AS r
         FROM (SELECT *, ['en', 'fr', 'de', 'es'][(finder_id + 1) % 4 + 1] AS o FROM questions))),
wide AS (SELECT e.*, '' AS router FROM every e UNION ALL BY NAME SELECT e.*, p.router FROM every e JOIN pick p USING (finder_id, section)),
yr AS (SELECT w.*, period FROM wide w JOIN questions USING (finder_id)),
flat AS (SELECT finder_id, enhance, level, source, router, chunk_id, row_number() OVER (PARTITION BY finder_id, enhance, level, source, router ORDER BY score DESC, chunk_id) - 1 AS rank FROM yr WHERE (period = 'FY2024' AND year = 2024) OR (period = '2022-2023' AND year IN (2022, 2023))),
shares(year, share) AS (VALUES (2024, 8), (2023, 4), (2022, 2), (2021, 1), (2020, 1)),
rec AS (SELECT y.*, share, row_number() OVER (PARTITION BY finder_id, enhance, level, source, router, year ORDER BY score DESC, chunk_id) AS place FROM yr y JOIN shares USING (year) WHERE period = ''),
rec2 AS (SELECT *, row_number() OVER (PARTITION BY finder_id, enhance, level, source, router ORDER BY round(1 / (60 + place), 9) DESC, year DESC, chunk_id) - 1 AS rank FROM rec WHERE place <= share),
lst AS MATERIALIZED (SELECT * FROM flat WHERE rank < 15 UNION ALL SELECT finder_id, enhance, level, source, router, chunk_id, rank FROM rec2 WHERE rank < 15)"""


def _of(mode: str) -> str:
    return "SELECT * FROM hyb" if mode == "hybrid" else f"SELECT finder_id, enhance, level, router, chunk_id, rank FROM lst WHERE source = '{mode}'"


_MERGED = [fused("hyb", [("SELECT * FROM lst WHERE source = 'dense'", 1.0), ("SELECT * FROM lst WHERE source = 'sparse'", 1.0)], 15, "finder_id, enhance, level, router")]
_FINAL = []
for _mode in grid.MODES:
    _FINAL.append(f"SELECT finder_id, enhance, level, chunk_id, rank, '{_mode}' AS mode, 0 AS alpha, '' AS router FROM ({_of(_mode)}) WHERE router = '' AND rank < 5")
    for _router in grid.ROUTERS:
        _MERGED.append(fused(f"f_{_mode}_{_router}", [(f"SELECT * FROM ({_of(_mode)}) WHERE router = '{_router}' AND rank < 7", 1.0), (f"SELECT * FROM ({_of(_mode)}) WHERE router = ''", 0.0)], 5))
        _FINAL.append(f"SELECT finder_id, enhance, level, chunk_id, rank, '{_mode}', 1, '{_router}' FROM f_{_mode}_{_router}")
_RESULTS = _BASE + "," + ",".join(_MERGED) + f""",
fin AS MATERIALIZED ({' UNION ALL '.join(_FINAL)}),
up AS (SELECT finder_id, enhance, f.level, mode, alpha, router, parent_id AS chunk_id, round(sum(1 / (3 + rank)), 9) AS score, min(rank) AS seen FROM fin f JOIN corp c USING (chunk_id) WHERE parent_id IS NOT NULL GROUP BY ALL),
res AS MATERIALIZED (SELECT finder_id, enhance, level, mode, alpha, router, chunk_id, row_number() OVER (PARTITION BY finder_id, enhance, level, mode, alpha, router ORDER BY score DESC, seen) - 1 AS rank FROM up
  UNION ALL SELECT finder_id, enhance, level, mode, alpha, router, chunk_id, rank FROM fin WHERE level = 1)"""
_RUNS = _RESULTS + f""",
g1 AS (SELECT r.finder_id, r.chunk_id, {words('q.truth')} AS ew, {words('c.text')} AS cw, {salient('q.truth')} AS en, {salient('c.text')} AS cn FROM (SELECT DISTINCT finder_id, chunk_id FROM res) r JOIN questions q USING (finder_id) JOIN docs1 c ON c.chunk_id = r.chunk_id),
g2 AS (SELECT finder_id, chunk_id, {share('ew', 'cw')} AS word, CASE WHEN len(en) < 4 THEN 0.0 ELSE {share('en', 'cn')} END AS num FROM g1),
runs AS (SELECT finder_id, level, mode, enhance, alpha, router, round_even(max(word), 4) AS word_recall, coalesce(round(1.0 / min(CASE WHEN greatest(word, num) >= 0.5 THEN rank + 1 END), 6), 0.0)::DOUBLE AS soft_mrr,
         max(CASE WHEN greatest(word, num) >= 0.5 AND rank < 3 THEN 1 ELSE 0 END)::DOUBLE AS soft_recall3 FROM res JOIN g2 USING (finder_id, chunk_id) GROUP BY finder_id, level, mode, enhance, alpha, router)"""
SQL = {
    "x20_grid": _RUNS + f", cells AS ({_CELLS}), arms AS ({_ARMS}) SELECT contrast, metric, count(*) AS questions, round(avg(round(t - c + 1e-10, 6)) + 1e-10, 6) AS effect, true AS crossed FROM arms WHERE t IS NOT NULL AND c IS NOT NULL GROUP BY contrast, metric",
    "g01_lists": _BASE + " SELECT finder_id, enhance, level, source, router, chunk_id, rank FROM lst WHERE rank < 5",
    "g01_results": _RESULTS + " SELECT finder_id, 'L' || level || '_' || upper(mode) || '_' || CASE WHEN enhance = 1 THEN 'ENH' ELSE 'PLAIN' END || '_A' || alpha || CASE WHEN router = '' THEN '' ELSE '_' || upper(router) END AS config_key, level, mode, enhance, alpha, router, chunk_id, rank FROM res",
    "o07_keep_sets": _RESULTS + """, l AS (SELECT finder_id, mode, enhance, alpha, router, level, list(chunk_id ORDER BY rank) AS ids FROM res GROUP BY ALL)
 SELECT a.router, a.level, b.level AS level_b, count(*) AS cells, count(*) FILTER (a.ids = b.ids) AS equal, round(avg(len(list_intersect(a.ids, b.ids)) / len(list_distinct(list_concat(a.ids, b.ids)))::DOUBLE), 6) AS mean_jaccard
 FROM l a JOIN l b USING (finder_id, mode, enhance, alpha, router) WHERE a.level < b.level GROUP BY ALL""",
}
