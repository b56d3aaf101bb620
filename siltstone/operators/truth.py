"""Where a passage stands in the corpus (prefixes, shared numbers), how retrieval found it, and the context of an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators import gestalt

#: Prefix lengths, from the strictest; shared-number threshold and fewest numbers of a chunk.
PREFIXES, CONTAINMENT, MIN_NUMBERS = (200, 100, 50), 0.85, 4


def by_prefix(passages: DataFrame, corpus: DataFrame) -> DataFrame:
    """finder_id, chunk_id: the first chunk whose normal form begins as the passage does, by the longest prefix that has one.

    The corpus side is reduced to one row for each prefix before the join, so that a common opening is no hot key.
    Of a text only the opening is brought to normal form.
    """
    def prefixes(rows, key, column):
        pairs = F.array(*[F.struct(F.lit(k).alias("length"), F.substring("normal", 1, k).alias("prefix")) for k in PREFIXES])
        return rows.select(key, X.opening(column, max(PREFIXES)).alias("normal")).where("normal <> ''").select(key, F.inline(pairs))

    index = prefixes(corpus, "chunk_id", "text").groupBy("length", "prefix").agg(F.min("chunk_id").alias("chunk_id"))
    found = prefixes(passages, "finder_id", "truth").join(index, ["length", "prefix"])
    return found.groupBy("finder_id").agg(F.max_by("chunk_id", "length").alias("chunk_id"))


def by_numbers(passages: DataFrame, corpus: DataFrame) -> DataFrame:
    """finder_id, chunk_id: chunks of four salient numbers or more, of which the passage holds 85 %.

    Only as many of a chunk's numbers as can't all be missing are joined, those first that fewest passages hold; pairs are confirmed on all numbers.
    """
    asked = passages.select("finder_id", X.salient_numbers("truth").alias("theirs")).where(F.size("theirs") > 0)
    terms = asked.select("finder_id", F.explode("theirs").alias("number"))
    chunks = corpus.select("chunk_id", X.salient_numbers("text").alias("own")).where(F.size("own") >= MIN_NUMBERS)
    rare = chunks.select("chunk_id", F.size("own").alias("n"), F.explode("own").alias("number")).join(terms.groupBy("number").agg(F.count("*").alias("df")), "number", "left")
    k = F.row_number().over(W.partitionBy("chunk_id").orderBy(F.coalesce("df", F.lit(0)), "number"))
    lead = rare.withColumn("k", k).where(F.col("df").isNotNull() & (F.col("k") <= F.col("n") - F.ceil(F.col("n") * CONTAINMENT) + 1))
    pairs = lead.join(terms, "number").select("finder_id", "chunk_id").distinct()
    shared = F.size(F.array_intersect("own", "theirs")) / F.size("own")
    return pairs.join(chunks, "chunk_id").join(asked, "finder_id").where(shared >= CONTAINMENT).select("finder_id", "chunk_id")


def truth_chunks(passages: DataFrame, corpus: DataFrame) -> DataFrame:
    """finder_id, chunk_id: chunks that hold a passage, once for each distinct passage.  Without the fuzzy step."""
    return by_prefix(passages, corpus).unionByName(by_numbers(passages, corpus)).distinct()


def truth_lookup(passages: DataFrame, corpus: DataFrame) -> DataFrame:
    """finder_id, chunk_id, step: the chunks of ``truth_chunks`` (step "exact"), and for passages that have none the first chunk of like text (step "fuzzy")."""
    exact = truth_chunks(passages, corpus)
    left = passages.join(exact, "finder_id", "left_anti").select("finder_id", "truth")
    return exact.withColumn("step", F.lit("exact")).unionByName(gestalt.first_alike(left, corpus).withColumn("step", F.lit("fuzzy")))


def alignment(results: DataFrame, questions: DataFrame, places: DataFrame) -> DataFrame:
    """finder_id, config_key, n_truth (chunks), n_found, best_rank (from 1, else null), flag."""
    counts = questions.select("finder_id").join(places.groupBy("finder_id").agg(F.count("*").alias("n_truth")), "finder_id", "left").na.fill(0, ["n_truth"])
    hits = results.join(places.withColumn("hit", F.lit(1)), ["finder_id", "chunk_id"], "left")
    runs = hits.groupBy("finder_id", "config_key").agg(F.count("hit").alias("n_found"), F.min(F.when(F.col("hit") == 1, F.col("rank") + 1)).alias("best_rank"))
    flag = F.when(F.col("n_truth") == 0, "TRUTH_NOT_IN_CORPUS").when(F.col("n_found") == 0, "TRUTH_NOT_RETRIEVED").otherwise("-")
    return runs.join(counts, "finder_id").select("finder_id", "config_key", "n_truth", "n_found", "best_rank", flag.alias("flag"))


def contexts(results: DataFrame, corpus: DataFrame) -> DataFrame:
    """finder_id, retrieved_ids, n_sources, context: the numbered sources of each distinct ranked list."""
    lists = results.groupBy("finder_id", "config_key").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("found"))
    lists = lists.select("finder_id", F.array_join(F.transform("found", lambda s: s["chunk_id"]), "|").alias("retrieved_ids"), F.transform("found", lambda s: s["chunk_id"]).alias("ids")).dropDuplicates(["finder_id", "retrieved_ids"])
    rows = lists.select("finder_id", "retrieved_ids", F.posexplode("ids").alias("pos", "chunk_id")).join(corpus, "chunk_id")
    head = F.concat(F.lit("--- Source "), F.col("pos") + 1, F.lit(" (Ticker: "), F.upper("ticker"), F.lit(", Year: "), F.year("fiscal_year_end"), F.lit(") ---\n"), "text")
    made = rows.groupBy("finder_id", "retrieved_ids").agg(F.array_sort(F.collect_list(F.struct("pos", head.alias("block")))).alias("b"))
    return made.select("finder_id", "retrieved_ids", F.size("b").alias("n_sources"), F.array_join(F.transform("b", lambda s: s["block"]), "\n\n").alias("context"))


def sources_of(context: Column) -> Column:
    """Array of ticker:year that a context's headings name."""
    pattern = r"(?m)^--- Source \d+ \(Ticker: (.*?), Year: (\d{4})\) ---$"
    part = lambda g: F.regexp_extract_all(context, F.lit(pattern), F.lit(g))
    return F.transform(F.arrays_zip(part(1).alias("t"), part(2).alias("y")), lambda s: F.concat_ws(":", F.lower(s["t"]), s["y"]))


#: Relevance thresholds that are compared.
THRESHOLDS = (0.3, 0.4, 0.5, 0.6, 0.7)


def random_chunks(draws: DataFrame, corpus: DataFrame, least: int = 16, fill: int = 4096, seed: str = "0") -> DataFrame:
    """``draws`` (with draw, a text that names each) joined to the chunk_id that its hash picks: a bucket of the chunks' hashes, and a place in it.

    The same draws give the same chunks in every run; a draw into an empty bucket gives none.  There are ``least`` buckets,
    or as many more as it takes for about ``fill`` chunks in each, so that none grows with the corpus.
    """
    buckets = max(least, -(-corpus.count() // fill))
    hashed = lambda c, at: F.conv(F.substring(F.md5(c), at, 7), 16, 10).cast("long")
    own = corpus.select("chunk_id", F.md5("chunk_id").alias("h")).withColumn("bucket", F.conv(F.substring("h", 1, 7), 16, 10).cast("long") % buckets)
    placed = own.withColumn("place", F.row_number().over(W.partitionBy("bucket").orderBy("h")) - 1).withColumn("size", F.count("*").over(W.partitionBy("bucket")))
    sizes = placed.groupBy("bucket").agg(F.first("size").alias("size"))
    key = F.concat(F.lit(seed + ":"), "draw")
    asked = draws.withColumn("bucket", hashed(key, 1) % buckets).join(sizes, "bucket").withColumn("place", hashed(key, 8) % F.col("size"))
    return asked.join(placed.select("bucket", "place", "chunk_id"), ["bucket", "place"]).drop("bucket", "place", "size")


def calibration(scored: DataFrame, pool: str, thresholds=THRESHOLDS) -> DataFrame:
    """threshold, pool, n, labelled: share of ``scored`` (score) at or above each threshold."""
    one = scored.agg(F.count("*").alias("n"), *[F.avg((F.col("score") >= t).cast("int")).alias(f"t{k}") for k, t in enumerate(thresholds)])
    return one.select("n", F.inline(F.array(*[F.struct(F.lit(t).alias("threshold"), F.round(F.col(f"t{k}"), 6).alias("labelled")) for k, t in enumerate(thresholds)]))).select("threshold", F.lit(pool).alias("pool"), "n", "labelled")


def fingerprints(corpus: DataFrame, length: int = 200) -> DataFrame:
    """prefix, chunk_id: the first chunk of each distinct opening of ``length`` normal characters."""
    rows = corpus.select("chunk_id", X.opening("text", length).alias("prefix")).where("prefix <> ''")
    return rows.groupBy("prefix").agg(F.min("chunk_id").alias("chunk_id"))


def pitfalls(wrong_year: Column, flag: Column) -> Column:
    """What went wrong with a run, joined by commas; a dash for nothing."""
    found = F.array_compact(F.array(F.when(wrong_year > 0, "WRONG_YEAR"), F.when(flag != "-", flag)))
    return F.when(F.size(found) > 0, F.array_join(found, ", ")).otherwise("-")


#: What stands for an answer where nothing was retrieved, and in a context of an empty answer.
NOTHING, NO_ANSWER = "No relevant context retrieved.", " NO GENERATED ANSWER "


def answers(contexts: DataFrame, model) -> DataFrame:
    """``contexts`` (finder_id, retrieved_ids, context) with answer: ``model(context)`` once for each distinct context, NOTHING where there is none, "" where the model fails (null)."""
    context = F.col("context")
    return contexts.withColumn("answer", F.when(context.isNull() | (F.trim(context) == ""), NOTHING).otherwise(F.coalesce(model(context), F.lit(""))))


def shown(answer: Column) -> Column:
    return F.when(F.trim(F.coalesce(answer, F.lit(""))) == "", NO_ANSWER).otherwise(answer)


def third_failures(rows: DataFrame, keys: list[str], order: list[str], failed: str, n: int = 3) -> DataFrame:
    """keys and the order columns of each row at which ``n`` rows in a row have failed for the first time: where a run would have stopped."""
    w = W.partitionBy(*keys).orderBy(*order)
    run = rows.withColumn("__fine", F.sum((~F.col(failed)).cast("int")).over(w))
    run = run.where(failed).withColumn("__n", F.row_number().over(W.partitionBy(*keys, "__fine").orderBy(*order))).where(F.col("__n") == n)
    return run.withColumn("__first", F.row_number().over(w)).where("__first = 1").select(*keys, *order)


def run_id_parts(run_id: Column) -> Column:
    """struct<ticker, years, mode> of "ticker_years_header_mode_number"; the mode is null in old ids, the ticker where it is None."""
    headed = run_id.contains("_header_")
    before = F.when(headed, F.substring_index(run_id, "_header_", 1)).otherwise(run_id)
    after = F.when(headed, F.substring_index(F.regexp_extract(run_id, "(?s)_header_(.*)", 1), "_", 1))
    ticker = F.substring_index(before, "_", 1)
    rest = F.when(before.contains("_"), F.regexp_extract(before, "(?s)^[^_]*_(.*)$", 1)).otherwise("")
    years = F.transform(F.regexp_extract_all(rest, F.lit(r"\d{4}"), F.lit(0)), lambda y: y.cast("int"))
    return F.struct(F.when(ticker != "None", ticker).alias("ticker"), years.alias("years"), F.when(after.isin("dense", "sparse", "hybrid"), after).alias("mode"))


def field_values(text: Column) -> Column:
    """array<string> of a printed field: a scalar, None (empty), or a list in brackets with quoted or bare items."""
    plain = F.trim(F.coalesce(text, F.lit("")))
    inner = F.regexp_extract(plain, r"(?s)^\[(.*)\]$", 1)
    items = F.transform(F.split(F.when(plain.rlike(r"(?s)^\[.*\]$"), inner).otherwise(plain), ","), lambda x: F.regexp_replace(F.trim(x), "^['\"]|['\"]$", ""))
    return F.filter(items, lambda x: ~x.isin("", "None"))
