"""Section routing: category items, class shares, three-band decisions, threshold tuning, reply validation, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Items that answer a question of each category (with spellings of scanned text).
CATEGORY_ITEMS = {
    "company overview": ("1",), "financials": ("7", "7a", "7 a", "8"), "footnotes": ("8",), "governance": ("10", "11", "12", "13", "14"),
    "accounting": ("8",), "shareholder return": ("5",), "risk": ("1a", "1 a"), "legal": ("3",),
}


def word_tokens(text: Column) -> Column:
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+")


def in_category(subsection: Column, category: Column) -> Column:
    """Whether a subsection names an item of the category (all words of "item N" occur in it); null for an unknown category."""
    have, out = word_tokens(subsection), F.lit(None).cast("boolean")
    for name, items in CATEGORY_ITEMS.items():
        hit = F.lit(False)
        for item in items:
            hit = hit | (F.size(F.array_except(F.array(*[F.lit(w) for w in f"item {item}".split()]), have)) == 0)
        out = F.when(F.lower(F.trim(category)) == name, hit).otherwise(out)
    return out


def class_shares(lists: DataFrame, label: str = "section") -> DataFrame:
    """finder_id, class, p: reciprocal-rank share of each class among the ranked rows of a question."""
    votes = lists.groupBy("finder_id", F.col(label).alias("class")).agg(F.sum(1.0 / (F.col("rank") + 1)).alias("v"))
    return votes.select("finder_id", "class", F.round(F.col("v") / F.sum("v").over(W.partitionBy("finder_id")), 4).alias("p"))


def top_two(shares: DataFrame) -> DataFrame:
    """finder_id, c1, p1, c2, p12: the two likeliest classes, ties by name; c2 is null and p12 = p1 where there is one class only."""
    k = F.row_number().over(W.partitionBy("finder_id").orderBy(F.col("p").desc(), "class"))
    one = lambda c, i: F.max(F.when(F.col("k") == i, F.col(c)))
    rows = shares.withColumn("k", k).where("k <= 2").groupBy("finder_id")
    return rows.agg(one("class", 1).alias("c1"), one("p", 1).alias("p1"), one("class", 2).alias("c2"), F.round(F.sum("p"), 4).alias("p12"))


def decide(two: DataFrame, hard, pair) -> DataFrame:
    """Adds band, categories (array) and alpha: the first class alone, the first two, or none."""
    p1, p12 = F.col("p1") >= hard, F.col("p12") >= pair
    none = F.array().cast("array<string>")
    return two.select(
        "*", F.when(p1, "confident").when(p12, "ambiguous").otherwise("uncertain").alias("band"),
        F.when(p1, F.array("c1")).when(p12, F.array_compact(F.array("c1", "c2"))).otherwise(none).alias("categories"), F.when(p1 | p12, 1.0).otherwise(0.0).alias("alpha"),
    )


def lowest_threshold(rows: DataFrame, score: str, ok: str, target: float, support: int) -> DataFrame:
    """One row, tau: the lowest score with precision ``target`` and ``support`` rows at or above it; infinity where none has.

    Rows are counted by score first; scores have four decimals, so that the running sums see 10,001 rows at most.
    """
    by = rows.groupBy(F.round(score, 4).alias("s")).agg(F.count("*").alias("n"), F.count_if(F.col(ok)).alias("hits"))
    w = W.orderBy(F.col("s").desc())
    run = by.select("s", F.sum("n").over(w).alias("n"), F.sum("hits").over(w).alias("hits"))
    good = run.where((F.col("hits") >= target * F.col("n")) & (F.col("n") >= support))
    return good.agg(F.coalesce(F.min("s"), F.lit(float("inf"))).alias("tau"))


def tune(two: DataFrame, truth: str, target_hard: float, target_pair: float, support: int, items=None) -> DataFrame:
    """Rows of ``two`` with both thresholds (tau_hard over all, tau_pair over what tau_hard leaves) and whether each class set covers the truth.

    ``items``: a function from a class to the array of its items; then a class set covers the truth if it has all items of
    the true class (which another class may have too), else if it has the true class.  A class without items covers nothing and isn't covered.
    """
    if items is None:
        one, pair = F.col(truth) == F.col("c1"), (F.col(truth) == F.col("c1")) | (F.col(truth) == F.col("c2"))
    else:
        of = lambda c: F.coalesce(items(F.col(c)), F.array().cast("array<string>"))
        covered = lambda own: (F.size(of(truth)) > 0) & (F.size(F.array_except(of(truth), own)) == 0)
        one, pair = covered(of("c1")), covered(F.array_union(of("c1"), of("c2")))
    rows = two.withColumn("cover1", one).withColumn("cover2", F.coalesce(pair, F.lit(False)))
    hard = lowest_threshold(rows, "p1", "cover1", target_hard, support).withColumnRenamed("tau", "tau_hard")
    rows = rows.crossJoin(F.broadcast(hard))  # one row
    pair = lowest_threshold(rows.where("p1 < tau_hard"), "p12", "cover2", target_pair, support).withColumnRenamed("tau", "tau_pair")
    return rows.crossJoin(F.broadcast(pair))


def band_report(rows: DataFrame) -> DataFrame:
    """One row over ``rows`` (tuned, with band): share of each band, how often the confident and the ambiguous cover the truth, and what the uncertain would have covered with one class and with two (null for an empty band)."""
    share = lambda b: F.round(F.avg((F.col("band") == b).cast("int")), 6).alias(f"share_{b}")
    cover = lambda b, c, name: F.round(F.avg(F.when(F.col("band") == b, F.col(c).cast("int"))), 6).alias(name)
    bands = [share(b) for b in ("confident", "ambiguous", "uncertain")]
    return rows.agg(*bands, cover("confident", "cover1", "cover_confident"), cover("ambiguous", "cover2", "cover_ambiguous"), cover("uncertain", "cover1", "uncertain_top1_cover"), cover("uncertain", "cover2", "uncertain_top2_cover"))


def chosen_categories(reply: Column, candidates: Column) -> Column:
    """Categories that a reply chooses, in candidate order; null where it is unusable or leaves the candidates.

    The last object of the reply that has a list of categories counts; a reply that ends early is read up to its list.
    """
    lists = F.regexp_extract_all(F.coalesce(reply, F.lit("")), F.lit(r'"categories"\s*:\s*(\[[^\]]*\])'), F.lit(1))
    chosen = F.transform(F.from_json(F.try_element_at(lists, F.lit(-1)), "array<string>"), lambda c: F.lower(F.trim(c)))
    return F.when(F.size(F.array_except(chosen, candidates)) == 0, F.array_intersect(candidates, chosen))


def fingerprint(ids: Column) -> Column:
    """Aggregate: 12 hex digits that depend on the set of ids and not on their order (sums of hashes, combined before any shuffle)."""
    part = lambda at: F.sum(F.conv(F.substring(F.md5(ids.cast("string")), at, 8), 16, 10).cast("bigint")).cast("string")
    return F.substring(F.sha1(F.concat_ws("|", F.count(ids).cast("string"), part(1), part(9))), 1, 12)


def accuracy(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """One row: n, accuracy, macro_f1 (mean over all classes that occur as truth or guess; a class without a hit counts 0).  From the confusion table."""
    cells = rows.groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count("*").alias("n"))
    hit, sides = F.when(F.col("t") == F.col("g"), F.col("n")).otherwise(0), F.array(F.struct(F.col("t").alias("class"), F.lit(1).alias("side")), F.struct(F.col("g").alias("class"), F.lit(0).alias("side")))
    classes = cells.select("n", hit.alias("hit"), F.inline(sides)).where("class IS NOT NULL").groupBy("class").agg(F.sum("n").alias("both"), F.sum(F.when(F.col("side") == 1, F.col("hit")).otherwise(0)).alias("tp"))
    f1 = classes.agg(F.round(F.avg(2.0 * F.col("tp") / F.col("both")), 6).alias("macro_f1"))
    return cells.agg(F.sum("n").alias("n"), F.round(F.try_divide(F.sum(hit), F.sum("n")), 6).alias("accuracy")).crossJoin(F.broadcast(f1))  # one row each


def canonical_items(items: Column) -> Column:
    """Items without inner spaces, distinct, in order of their number."""
    own = F.array_distinct(F.transform(items, lambda x: F.replace(F.lower(x), F.lit(" "), F.lit(""))))
    key = lambda x: F.struct(F.regexp_extract(x, r"^(\d+)", 1).cast("int").alias("n"), x.alias("x"))
    return F.transform(F.array_sort(F.transform(own, key)), lambda s: s["x"])


def items_of(category: Column) -> Column:
    """Items of a category, in any case; null for an unknown one."""
    out = F.lit(None).cast("array<string>")
    for name, items in CATEGORY_ITEMS.items():
        out = F.when(F.lower(F.trim(category)) == name, F.array(*[F.lit(i) for i in items])).otherwise(out)
    return out


def items_title(category: Column) -> Column:
    return F.concat(F.lit("Item "), F.array_join(canonical_items(items_of(category)), ", "))


def oracle_route(category: Column) -> Column:
    """struct<categories, alpha, band, source> of a question whose category is known; an unknown category doesn't route."""
    known = items_of(category).isNotNull()
    return F.struct(
        F.when(known, F.array(F.lower(F.trim(category)))).otherwise(F.array().cast("array<string>")).alias("categories"), F.when(known, 1.0).otherwise(0.0).alias("alpha"), F.lit("oracle").alias("band"), F.lit("oracle").alias("source"),
    )


def effective_alpha(section_alpha: Column, route_alpha: Column, categories: Column) -> Column:
    """A config's alpha, scaled by a route that is active; 0 without one."""
    return F.when((route_alpha > 0) & (F.size(categories) > 0), section_alpha * route_alpha).otherwise(0.0)


def two_digits(p: Column) -> Column:
    """A share with two digits: 100 times the double, halves to the even digit, as DuckDB's round_even has it."""
    return F.format_number(F.rint(p * 100) / 100, 2)


def agent_message(query: Column, band: Column, hard: Column, pair: Column, candidates: Column) -> Column:
    """What the agent is asked: the question, the band, and a line for each candidate (array of struct<class, p, terms>)."""
    line = lambda c: F.concat(F.lit('- "'), c["class"], F.lit('" p='), two_digits(c["p"]), F.when(F.size(c["terms"]) > 0, F.concat(F.lit(" because of "), F.array_join(c["terms"], ", "))).otherwise(""))
    return F.concat(F.lit("Question: "), query, F.lit("\nBand: "), band, F.lit(" (alone from "), F.format_number(hard, 2), F.lit(", in pairs from "), F.format_number(pair, 2), F.lit(")\n"), F.array_join(F.transform(candidates, line), "\n"))


def routed(rows: DataFrame, model=None) -> DataFrame:
    """``rows`` (of ``decide``, with candidates: array<string>) with source and the agent's changes.

    Confident rows stay with the classifier.  Of the others ``model`` (a function of the row's candidates that replies) is
    asked; a usable reply decides, an empty choice abstains.  Without a model, or a usable reply, the band stands ("fallback").
    """
    ask = F.col("band") != "confident"
    if model is None:
        return rows.withColumn("source", F.when(ask, "fallback").otherwise("classifier"))
    chosen = chosen_categories(model(F.col("candidates")), F.col("candidates"))
    rows = rows.withColumn("chosen", F.when(ask, chosen))
    source = F.when(~ask, "classifier").when(F.col("chosen").isNotNull(), "llm").otherwise("fallback")
    return rows.withColumns({
        "source": source, "categories": F.coalesce("chosen", "categories"), "alpha": F.when(F.col("chosen").isNotNull(), F.when(F.size("chosen") > 0, 1.0).otherwise(0.0)).otherwise(F.col("alpha")),
    }).drop("chosen")


def backfilled(routes: DataFrame, fresh: DataFrame, key: str, current: str) -> DataFrame:
    """``routes`` whose fingerprint isn't ``current`` (or is null) are replaced by ``fresh`` ones of the same columns, which get it."""
    stale = routes.where(~F.col("fingerprint").eqNullSafe(current))
    renewed = fresh.drop("fingerprint").join(stale.select(key), key, "left_semi").withColumn("fingerprint", F.lit(current))
    return routes.where(F.col("fingerprint") == current).unionByName(renewed.select(*routes.columns))


def guarded(questions: DataFrame, routes: DataFrame, key: str) -> DataFrame:
    """``questions`` with their route; the job fails where one is missing or routes come from several models."""
    models = routes.agg(F.count_distinct("fingerprint").alias("models"))  # one row
    rows = questions.join(routes, key, "left").join(F.broadcast(models))
    wrong = F.when(F.col("fingerprint").isNull(), F.raise_error(F.lit("a question without route"))).when(F.col("models") > 1, F.raise_error(F.lit("routes of several models")))
    return rows.withColumn("fingerprint", F.coalesce(wrong.cast("string"), F.col("fingerprint"))).drop("models")
