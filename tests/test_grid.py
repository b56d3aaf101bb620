"""The whole sweep: its configs, routers that abstain, years of the question."""

from pyspark.sql import functions as F

from siltstone.operators import grid, sweep

DIR = "/root/testdata/sf0.001"


def test_grid_has_72_configs(spark):
    rows = grid.results(spark, DIR)
    keys = {r["config_key"] for r in rows.select("config_key").distinct().collect()}
    assert len(keys) == 72 and {"L3_HYBRID_ENH_A1_SHY", "L1_SPARSE_PLAIN_A0", "L2_DENSE_PLAIN_A1_PAIR"} <= keys
    assert rows.groupBy("finder_id", "config_key").agg(F.count("*").alias("n"), F.max("rank").alias("r")).where("n > 5 OR r >= 5").count() == 0
    assert {r["level"] for r in rows.join(sweep.chunks(spark, DIR).where("level = 1").select("chunk_id"), "chunk_id").select("level").distinct().collect()} == {1, 2, 3}  # parents alone


def test_an_abstaining_router_leaves_the_list_as_it_is(spark):
    rows = grid.results(spark, DIR).where("finder_id % 5 = 0 AND mode = 'sparse' AND level = 1 AND enhance = 0")
    lists = rows.groupBy("finder_id", "router").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("l")).collect()
    by = {(r["finder_id"], r["router"]): [x["chunk_id"] for x in r["l"]] for r in lists}
    assert by and all(by[f, ""] == by[f, "shy"] for f, router in by if router == "")


def test_named_years_are_the_only_ones(spark):
    chunks = sweep.chunks(spark, DIR).select("chunk_id", F.year("fiscal_year_end").alias("year"))
    rows = grid.results(spark, DIR).join(chunks, "chunk_id").groupBy(F.col("finder_id") % 3).agg(F.array_sort(F.collect_set("year")).alias("years"))
    years = {r[0]: r["years"] for r in rows.collect()}
    assert years[0] == [2024] and set(years[1]) <= {2022, 2023} and len(years[2]) == 5
