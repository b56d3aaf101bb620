"""Search on inverted lists against every pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import dense
from siltstone.operators.retrieval import dense as all_pairs


def vectors(seed, n=900, d=8, groups=12):
    """Clusters of vectors with copies; ids, vectors, a year."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, d)) * 3
    x = centres[rng.integers(0, groups, n)] + rng.normal(size=(n, d)) * 0.4
    x[n // 2 : n // 2 + 60] = x[0]
    return [(f"c{k:05d}", [float(v) for v in row], 2020 + k % 3) for k, row in enumerate(x)]


ODD = [("n1", None, 2020), ("n2", [], 2020), ("n3", [0.0] * 8, 2020), ("n4", [1.0] * 7, 2020), ("n5", [float("nan")] * 8, 2020), ("n6", [float("inf")] + [1.0] * 7, 2020), ("n7", [None] * 8, 2020), ("t1", [1e-200] * 8, 2021), ("t2", [1e300] * 8, 2021)]


@pytest.mark.parametrize("lists,block,k", [(30, 2048, 10), (30, 5, 3), (1, 2048, 5), (200, 2048, 1)])
def test_best_chunks_are_those_of_all_pairs(spark, monkeypatch, lists, block, k):
    monkeypatch.setattr(dense, "BLOCK", block)
    rows = vectors(lists)
    df = spark.createDataFrame(rows + ODD, "chunk_id string, vector array<double>, year int").repartition(5)
    asked = [(i, v) for i, (_, v, _) in enumerate(rows[:700:50])] + [(900, None), (901, [0.0] * 8), (902, [1.0] * 8), (903, [-1.0, 2.0] * 4)]
    queries = spark.createDataFrame(asked, "query_id long, query_vector array<double>")
    index = dense.inverted_lists(df, 8, sample=300, lists=lists)
    got, share = dense.search(queries, index, k)
    plain = spark.createDataFrame(rows + [("t1", [1.0] * 8, 2021), ("t2", [1.0] * 8, 2021)], "chunk_id string, vector array<double>, year int")
    want = {(r["query_id"], r["chunk_id"]): r["score"] for r in all_pairs(queries, plain, k).collect()}
    assert {(r["query_id"], r["chunk_id"]): r["score"] for r in got.collect()} == pytest.approx(want, abs=1.1e-5) and index.sizes.sum() == len(rows) + 2
    assert {r["query_id"]: r["n"] for r in got.groupBy("query_id").agg(F.count("*").alias("n")).collect()} == {i: k for i, v in asked if i not in (900, 901)}
    assert share <= 1 and (lists < 30 or share < 0.6)


def test_conditions_hold_and_few_rows_are_all_found(spark):
    rows = vectors(3, 60)
    index = dense.inverted_lists(spark.createDataFrame(rows, "chunk_id string, vector array<double>, year int"), 8, lists=7)
    queries = spark.createDataFrame([(1, rows[0][1]), (2, rows[9][1])], "query_id long, query_vector array<double>")
    got = dense.search(queries, index, 40, F.col("year") == 2021)[0].collect()
    assert len(got) == 40 and {r["chunk_id"] for r in got} == {c for c, _, y in rows if y == 2021}
    none = dense.inverted_lists(spark.createDataFrame([], "chunk_id string, vector array<double>"), 8)
    assert dense.search(queries, none, 5)[0].count() == 0 and dense.search(queries.limit(0), index, 5)[0].count() == 0
