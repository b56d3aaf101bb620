"""Paired tests against values derived by hand."""

from siltstone.operators import judge, stats
from siltstone.functions import text as X
from pyspark.sql import functions as F


def test_mcnemar(spark):
    df = spark.createDataFrame([(8, 2), (5, 5), (0, 0), (60, 30)], "gains long, losses long")
    got = [round(r[0], 8) for r in df.select(stats.binomial_p(F.col("gains"), F.col("losses"))).collect()]
    assert got[0] == 0.109375 and got[1] == 1 and got[2] == 1 and abs(got[3] - 0.00206027) < 1e-7


def test_corrections(spark):
    df = spark.createDataFrame([("f", str(i), p) for i, p in enumerate((0.01, 0.02, 0.03, 0.04))], "family string, base_config string, p double")
    got = [(r["holm"], r["bh"]) for r in stats.corrections(df, ["family"]).orderBy("p").collect()]
    assert got == [(0.04, 0.04), (0.06, 0.04), (0.06, 0.04), (0.06, 0.04)]


def test_wilcoxon(spark):
    df = spark.createDataFrame([("c", float(d)) for d in (1, -2, 3, 4, -5, 6, 0, 7)], "config_key string, d double")
    r = stats.wilcoxon(df, ["config_key"]).first()
    assert (r["n"], r["w_plus"], r["w_minus"]) == (7, 21.0, 7.0)
    assert abs(stats.wilcoxon_p(df, ["config_key"]).first()["p"] - 0.296875) < 1e-12


def test_numbers_and_recall(spark):
    t = "Revenue rose 12.5% to 1,234 in 2023 (2022-2024), margin 7, loss -45.6"
    r = spark.range(1).select(X.numbers(F.lit(t)).alias("n"), X.salient_numbers(F.lit(t)).alias("s"), X.word_recall(F.lit(""), F.lit("x")).alias("z")).first()
    assert set(r["n"]) == {"12.5", "1,234", "2023", "2022", "-2024", "7", "-45.6"} and set(r["s"]) == {"12.5", "1,234", "-2024", "7", "-45.6"} and r["z"] == 0


def test_judge_parsing(spark):
    df = spark.createDataFrame([('reason {"relevance": "A", "completeness": "B"}',), ("no json",), ('{"relevance": "A"}',), (None,)], "t string")
    got = [tuple(r) for r in df.select(*judge.parse_response(F.col("t"))).collect()]
    assert got == [("A", "B"), ("parse_error", "parse_error"), ("A", "?"), ("parse_error", "parse_error")]
    for v in ("A", "B", "Tie"):
        assert spark.range(1).select(judge.unswap(judge.unswap(F.lit(v), F.lit(1)), F.lit(1))).first()[0] == v
    swap = [spark.range(1).select(judge.should_swap(*[F.lit(x) for x in parts])).first()[0] for parts in (("q", "t", "r", "b"), ("q1", "t", "r", "b"), ("q2", "t", "r", "b"))]
    assert set(swap) <= {0, 1}
