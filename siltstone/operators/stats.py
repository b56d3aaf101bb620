"""Paired tests, corrections and resampling, as grouped aggregates and windows."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.plans import store


def correlations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r for each pair of columns; null where one is constant.  One pass over the rows."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = rows.agg(*[F.stddev_pop(c).alias(f"s_{c}") for c in columns], *[F.expr(f"try_divide(covar_pop({a}, {b}), stddev_pop({a}) * stddev_pop({b}))").alias(f"r_{a}__{b}") for a, b in pairs])
    items = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.when((F.col(f"s_{a}") == 0) | (F.col(f"s_{b}") == 0), None).otherwise(F.round(F.col(f"r_{a}__{b}"), 6) + 0.0).alias("r")) for a, b in pairs])
    return one.select(F.inline(items))


def paired_hits(runs: DataFrame) -> DataFrame:
    """family, base_config, finder_id, h0, h1: evidence hit without and with the section blend."""
    base = F.regexp_replace("config_key", "_A[01]$", "")
    hit = lambda a: F.max(F.when((F.col("alpha") == a) & F.col("evidence_hit"), 1).otherwise(0))
    return runs.groupBy(F.col("category").alias("family"), base.alias("base_config"), "finder_id").agg(hit(0).alias("h0"), hit(1).alias("h1"))


def binomial_p(gains, losses):
    """Exact two-sided p of an even split; 1 without discordant pairs.  One pass, each logarithm of a binomial from the one before, so any n."""
    n = gains + losses
    step = lambda a, i: F.struct((a["total"] + F.exp(a["log_c"] - n * F.log(F.lit(2.0)))).alias("total"), (a["log_c"] + F.log((n - i) / (i + 1))).alias("log_c"))
    total = F.aggregate(F.sequence(F.lit(0).cast("long"), F.least(gains, losses)), F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("log_c")), step, lambda a: a["total"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * total))


def mcnemar(pairs: DataFrame) -> DataFrame:
    counts = pairs.groupBy("family", "base_config").agg(F.sum((1 - F.col("h0")) * F.col("h1")).alias("gains"), F.sum(F.col("h0") * (1 - F.col("h1"))).alias("losses"))
    return counts.withColumn("p", F.round(binomial_p(F.col("gains"), F.col("losses")), 6))


def corrections(tests: DataFrame, family: list[str], tie: str = "base_config") -> DataFrame:
    """Holm and Benjamini-Hochberg of p within each family."""
    order = W.partitionBy(*family).orderBy("p", tie)
    rows = tests.withColumn("r", F.row_number().over(order)).withColumn("m", F.count("*").over(W.partitionBy(*family)))
    up, down = W.partitionBy(*family).orderBy("r"), W.partitionBy(*family).orderBy(F.desc("r"))
    holm = F.least(F.lit(1.0), F.max((F.col("m") - F.col("r") + 1) * F.col("p")).over(up))
    bh = F.least(F.lit(1.0), F.min(F.col("m") * F.col("p") / F.col("r")).over(down))
    return rows.select(*family, tie, "p", F.round(holm, 6).alias("holm"), F.round(bh, 6).alias("bh"))


def differences(runs: DataFrame, baseline: str, metric: str = "word_recall") -> DataFrame:
    base = runs.where(F.col("config_key") == baseline).select("finder_id", F.col(metric).alias("b"))
    return runs.where(F.col("config_key") != baseline).join(base, "finder_id").select("config_key", "finder_id", F.round(F.col(metric) - F.col("b"), 6).alias("d"))


def signed_ranks(diffs: DataFrame, keys: list[str]) -> DataFrame:
    """Non-zero differences with average ranks r of their sizes, and t equals."""
    size = F.abs("d")
    same = F.count("*").over(W.partitionBy(*keys, size))
    return diffs.where("d <> 0").select(*keys, "d", (F.rank().over(W.partitionBy(*keys).orderBy(size)) + (same - 1) / 2).alias("r"), same.alias("t"))


def wilcoxon(diffs: DataFrame, keys: list[str]) -> DataFrame:
    """n, w_plus, w_minus, z (normal approximation with tie correction; null without spread)."""
    one = signed_ranks(diffs, keys).groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("d") < 0, F.col("r")).otherwise(0.0)).alias("w_minus"), F.sum(F.col("t") * F.col("t") - 1).alias("ties")
    )
    n = F.col("n")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    return one.select(*keys, "n", "w_plus", "w_minus", F.round(F.try_divide(F.col("w_plus") - n * (n + 1) / 4, spread), 6).alias("z"))


def exact_p(ranks: list[float], w: float) -> float:
    """Two-sided p of the smaller rank sum under random signs, by counting sums of doubled ranks."""
    sums = {0: 1}
    for r in (round(2 * r) for r in ranks):
        nxt = dict(sums)
        for s, c in sums.items():
            nxt[s + r] = nxt.get(s + r, 0) + c
        sums = nxt
    return min(1.0, 2 * sum(c for s, c in sums.items() if s <= 2 * w + 1e-9) / 2 ** len(ranks))


def wilcoxon_p(diffs: DataFrame, keys: list[str], exact: int = 25) -> DataFrame:
    """p of each test: exact up to ``exact`` differences, else normal.  Groups are the questions of one config; a group is one test."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r, plus = pdf.r.to_list(), float(pdf.r[pdf.d > 0].sum())
        n, minus = len(r), sum(r) - plus
        if n <= exact:
            p = exact_p(r, min(plus, minus))
        else:
            spread = math.sqrt(max(n * (n + 1) * (2 * n + 1) / 24 - float((pdf.t**2 - 1).sum()) / 48, 1e-300))
            p = math.erfc(abs(plus - n * (n + 1) / 4) / spread / math.sqrt(2))
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "n": [n], "p": [p]})

    return signed_ranks(diffs, keys).groupBy(*keys).applyInPandas(run, ", ".join(f"{k} string" for k in keys) + ", n long, p double")


def bootstrap_best(runs: DataFrame, resamples: int, metric: str = "word_recall", seed: str = "0") -> DataFrame:
    """p_best and a percentile interval of each config's mean over resampled questions; draws come from a hash, so reruns agree.

    A question is one row with an array of its configs' values, and so is a draw: resamples times questions rows, not
    times configs, each added to its resample's sums where it is made.  There are as many configs as the grid has.
    """
    spark = runs.sparkSession
    configs = [r["config_key"] for r in runs.select("config_key").distinct().orderBy("config_key").collect()]
    by = F.map_from_entries(F.collect_list(F.struct("config_key", F.col(metric).cast("double").alias("v"))))
    rows = store.numbered(runs.groupBy("finder_id").agg(by.alias("by")), "finder_id")
    rows = store.written(rows.select("__k", F.array(*[F.try_element_at("by", F.lit(c)) for c in configs]).alias("values")), "questions-by-config")
    n = rows.count()
    # Draw k of resample b is question hash(b, k) mod n.
    b, k = F.expr(f"id div {max(n, 1)}"), F.col("id") % max(n, 1)
    hashed = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), b, k)), 1, 8), 16, 10).cast("long")
    draws = spark.range(resamples * n).select(b.alias("b"), (hashed % n).alias("__k"))
    sums = [F.round(F.avg(F.get("values", F.lit(i))), 9).alias(f"m{i}") for i in range(len(configs))]
    means = draws.join(rows, "__k").groupBy("b").agg(*sums)
    long = F.array(*[F.struct(F.lit(c).alias("config_key"), F.col(f"m{i}").alias("m")) for i, c in enumerate(configs)])
    # The best of a resample: the largest mean, the first name among equals.
    best = F.array_max(F.transform(F.filter(long, lambda s: s["m"].isNotNull()), lambda s: s["m"]))
    first = F.try_element_at(F.filter(long, lambda s: s["m"] == F.col("best")), F.lit(1))["config_key"]
    placed = means.withColumn("best", best).withColumn("first", first).select("first", F.inline(long)) if configs else runs.select(F.col("config_key").alias("first"), "config_key", F.col(metric).cast("double").alias("m"))
    placed = placed.where("m IS NOT NULL")
    return placed.groupBy("config_key").agg(F.round(F.avg((F.col("first") == F.col("config_key")).cast("double")), 6).alias("p_best"), F.round(F.percentile("m", 0.025) + 1e-10, 6).alias("low"), F.round(F.percentile("m", 0.975) + 1e-10, 6).alias("high"))


def against_top(runs: DataFrame, metric: str = "word_recall") -> DataFrame:
    """config_key, finder_id, d: the best config's metric (by mean, ties by name) minus each other config's.  The best config is one row."""
    best = runs.groupBy("config_key").agg(F.round(F.avg(metric), 9).alias("m")).orderBy(F.desc("m"), "config_key").limit(1).select(F.col("config_key").alias("best"))
    top = runs.join(F.broadcast(best), F.col("config_key") == F.col("best"), "left_semi").select("finder_id", F.col(metric).alias("b"))
    others = runs.join(F.broadcast(best), F.col("config_key") == F.col("best"), "left_anti")
    return others.join(top, "finder_id").select("config_key", "finder_id", F.round(F.col("b") - F.col(metric), 6).alias("d"))


def separation(runs: DataFrame, metric: str = "word_recall", alpha: float = 0.05) -> DataFrame:
    """config_key, place, mean_delta, p, leading of every config: the best one against each below it, by signed ranks.

    leading: places before the first config that the test tells from the best.  As many rows as there are configs.
    """
    diffs = against_top(runs, metric)
    tests = diffs.groupBy("config_key").agg(F.round(F.avg("d"), 6).alias("mean_delta")).join(wilcoxon_p(diffs, ["config_key"]).select("config_key", "p"), "config_key", "left").na.fill(1.0, ["p"])
    places = runs.groupBy("config_key").agg(F.round(F.avg(metric), 9).alias("m")).withColumn("place", F.row_number().over(W.orderBy(F.desc("m"), "config_key")))
    rows = places.join(tests, "config_key", "left")
    first = F.min(F.when(F.col("p") < alpha, F.col("place"))).over(W.partitionBy())
    return rows.select("config_key", "place", F.coalesce("mean_delta", F.lit(0.0)).alias("mean_delta"), "p", F.coalesce(F.col("place") < first, F.lit(True)).alias("leading"))


def pooled(runs: DataFrame, baseline: str, n: int = 3, metric: str = "word_recall") -> DataFrame:
    """arm, finder_id, d: the best config, and the best ``n`` other than the baseline averaged for each question, minus the baseline."""
    order = W.orderBy(F.desc("m"), "config_key")
    ranked = runs.groupBy("config_key").agg(F.round(F.avg(metric), 9).alias("m"))
    best = ranked.withColumn("k", F.row_number().over(order)).where("k = 1").select("config_key", F.lit("leader").alias("arm"))
    top = ranked.where(F.col("config_key") != baseline).withColumn("k", F.row_number().over(order)).where(F.col("k") <= n).select("config_key", F.lit(f"top{n}").alias("arm"))
    arms = runs.join(F.broadcast(best.unionByName(top)), "config_key").groupBy("arm", "finder_id").agg(F.avg(metric).alias("v"))  # n + 1 rows
    base = runs.where(F.col("config_key") == baseline).select("finder_id", F.col(metric).alias("b"))
    return arms.join(base, "finder_id").select("arm", "finder_id", F.round(F.col("v") - F.col("b"), 6).alias("d"))


def tested(diffs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, questions, mean_delta, p (1 where nothing differs)."""
    return diffs.groupBy(*keys).agg(F.count("*").alias("questions"), F.round(F.avg("d") + 1e-10, 6).alias("mean_delta")).join(wilcoxon_p(diffs, keys).select(*keys, "p"), keys, "left").na.fill(1.0, ["p"])


def versus_baseline(runs: DataFrame, baseline: str, metric: str = "word_recall") -> DataFrame:
    """config_key, mean_delta, p, bh, beats: every config against the baseline, corrected over all of them."""
    tests = tested(differences(runs, baseline, metric), ["config_key"]).withColumn("family", F.lit("all"))
    fixed = corrections(tests, ["family"], "config_key").select("config_key", "bh")
    return tests.join(fixed, "config_key").select("config_key", "mean_delta", "p", "bh", (F.col("bh") < 0.05).alias("beats"))


#: Design contrasts: name, axis, treatment, control.
CONTRASTS = (
    ("hybrid - sparse", "mode", ("hybrid",), ("sparse",)), ("dense - sparse", "mode", ("dense",), ("sparse",)), ("hybrid - dense", "mode", ("hybrid",), ("dense",)), ("children - level 1", "level", (2, 3), (1,)),
    ("level 3 - level 2", "level", (3,), (2,)), ("enhanced - plain", "enhance", (1,), (0,)), ("alpha 1 - alpha 0", "alpha", (1,), (0,)),
)


def arms(runs: DataFrame, metrics: tuple[str, ...], contrasts=CONTRASTS) -> DataFrame:
    """contrast, metric, finder_id, d, crossed: treatment minus control, each averaged for the question over all other axes.

    crossed: both arms span the same combinations of the other axes (over all questions).  A contrast one of whose arms
    has no rows gives none.
    """
    axes = ("mode", "level", "enhance", "alpha")
    out = None
    for name, axis, treatment, control in contrasts:
        arm = F.when(F.col(axis).isin(*treatment), 1).when(F.col(axis).isin(*control), 0)
        rest = F.struct(*[a for a in axes if a != axis])
        rows = runs.withColumn("arm", arm).where("arm IS NOT NULL").withColumn("rest", rest)
        spans = rows.select("arm", "rest").distinct().groupBy("rest").agg(F.count("*").alias("n")).agg((F.min("n") == 2).alias("crossed"))  # one row
        values = F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics]))
        long = rows.select("finder_id", "arm", values).groupBy("finder_id", "metric").agg(F.avg(F.when(F.col("arm") == 1, F.col("v"))).alias("t"), F.avg(F.when(F.col("arm") == 0, F.col("v"))).alias("c")).where("t IS NOT NULL AND c IS NOT NULL")
        part = long.join(F.broadcast(spans)).select(F.lit(name).alias("contrast"), "metric", "finder_id", F.round(F.col("t") - F.col("c") + 1e-10, 6).alias("d"), "crossed")  # a nudge, so that halves don't hang on the order of sums
        out = part if out is None else out.unionByName(part)
    return out
