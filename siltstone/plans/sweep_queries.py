"""Queries over the sweep's own stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import sweep
from siltstone.plans.sweep_sql import upto

QUERIES = {
    "questions": lambda s, d: sweep.questions(s, d),
    "config_grid": lambda s, d: sweep.configs(s).join(sweep.questions(s, d).groupBy("category").agg(F.count("*").alias("n_questions"))).select("config_key", "level", "mode", "enhance", "alpha", "prefetch", "category", "n_questions"),
    "tracks": lambda s, d: sweep.tracks(s, d),
    "sweep_results": lambda s, d: sweep.results(s, d),
    "sweep_runs": lambda s, d: sweep.runs(s, d),
    "slice": lambda s, d: sweep.sparse_slice(s, d),
}
SQL = {
    "questions": upto("questions").replace("WITH chunks", "WITH chunks") + " SELECT * FROM questions",
    "config_grid": upto("grid") + " SELECT config_key, level, mode, enhance, alpha, prefetch, category, n_questions FROM grid, (SELECT category, count(*) AS n_questions FROM questions GROUP BY category)",
    "tracks": upto("tracks") + " SELECT * FROM tracks",
    "sweep_results": upto("results") + " SELECT * FROM results",
    "sweep_runs": upto("runs") + " SELECT * FROM runs",
    "slice": upto("runs") + " SELECT finder_id, retrieved_ids, soft_mrr, soft_recall3 FROM runs WHERE config_key = 'L1_SPARSE_PLAIN_A0'",
}
