"""Query name -> (callable, oracle SQL)."""

from __future__ import annotations

from siltstone.plans import call_queries, filing_queries, grid_queries, level_queries, markup_queries, metric_queries, question_queries, router_queries, routing_queries, source_queries, stream_queries, sweep_queries, table_queries, text_queries

MODULES = (sweep_queries, grid_queries, call_queries, markup_queries, table_queries, text_queries, routing_queries, filing_queries, question_queries, level_queries, source_queries, metric_queries, router_queries, stream_queries)


def entry(spark, sf_dir):
    """Flagship: BM25 top 5 of every question, with soft recall and reciprocal rank."""
    return queries()["slice"](spark, sf_dir)


def queries():
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql():
    return {name: q for m in MODULES for name, q in m.SQL.items()}
