"""Queries of the question front end: aliases, tickers, metadata, refusals, references, vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import sweep
from siltstone.operators import understanding as U

#: Digits as letters: a part's symbol.
LETTERS = ("0123456789", "ABCDEFGHIJ")


def symbol(key):
    return F.translate(F.lpad(key.cast("string"), 4, "0"), *LETTERS)


def companies(spark, sf_dir):
    """Companies made of parts: a symbol of letters, a name that several share, a name with a word of its own."""
    p = sweep.read(spark, sf_dir, "part")
    own = F.concat(F.lit("Kor"), F.lower(symbol(F.col("p_partkey"))))
    return p.select(symbol(F.col("p_partkey")).alias("symbol"), F.concat(F.initcap("p_name"), F.lit(" Inc.")).alias("shortname"), F.concat(F.initcap("p_name"), F.lit(" "), own, F.lit(" Holdings Company (The)")).alias("longname"), F.col("p_partkey").alias("ord"))


def asked(spark, sf_dir):
    """Questions about parts, in the forms in which people name companies."""
    line = sweep.read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("p_partkey"))
    rows = line.join(sweep.read(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey")
    sym, own = symbol(F.col("p_partkey")), F.concat(F.lit("Kor"), F.lower(symbol(F.col("p_partkey"))))
    forms = F.array(
        F.concat(F.lit("What did ("), sym, F.lit(") earn in 2021?")), F.concat(F.lit("Compare US margins of "), sym, F.lit(" and ABCDE of last year")),
        F.concat(F.lit("revenue of "), own, F.lit("'s segment FY22-FY24")), F.concat(F.lit("the "), F.col("p_name"), F.lit(" "), own, F.lit(" holdings yoy")),
        F.concat(F.lit("outlook of the "), F.col("p_name"), F.lit(" business")), F.lit("what is the outlook for QZX."), F.lit("what is it FOR"),
    )
    return rows.select(F.col("l_orderkey").alias("key"), F.get(forms, (F.col("l_orderkey") % 7).cast("int")).alias("query"))


def replies(spark, sf_dir):
    """Replies of a model to the benchmark's questions: plain, refusing, refusing and going on, empty."""
    q = sweep.questions(spark, sf_dir).select(F.col("finder_id").alias("key"), "query")

    def model(query, attempt):
        k = F.col("key") % 5
        return F.when(k == 0, F.concat(F.lit("  more on "), query, F.lit(" "))).when(k == 1, F.lit("I cannot help")).when(k == 2, F.concat(F.lit("Sorry, no. However, here is "), F.substring_index(query, " ", 5))).when((k == 3) & F.lit(attempt == 2), F.concat(query, F.lit(", with its figures. I'm sorry"))).otherwise("")

    return U.enhanced(q, model)


def references(spark, sf_dir):
    lab = sweep.read(spark, sf_dir, "labels").select("doc_id", "quality")
    refs = F.array(F.when(F.col("quality") == 1, "None. ").otherwise("none"), F.when(F.col("doc_id") % 3 == 0, F.lit("")).when(F.col("doc_id") % 3 == 1, F.lit(None).cast("string")).otherwise("page 4"))
    return lab.select("doc_id", U.real_references(refs).alias("real"))


def with_years(spark, sf_dir):
    rows = U.metadata(asked(spark, sf_dir), companies(spark, sf_dir))
    return rows.select("key", F.coalesce("ticker", F.lit("")).alias("ticker"), F.coalesce(F.array_join("years", ","), F.lit("")).alias("years"), "form_type")


def overridden(spark, sf_dir):
    """U13: the ticker of a question's own bucket (its order's priority, where it has one) stands over the one found."""
    bucket = sweep.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderstatus") == "F", F.lit("fix")).alias("bucket"))
    found = U.tickers(asked(spark, sf_dir), companies(spark, sf_dir)).join(bucket, "key")
    return found.groupBy(F.coalesce("bucket", "ticker", F.lit("")).alias("ticker")).agg(F.count("*").alias("n"))


QUERIES = {
    "u02_real_references": references,
    "u09_aliases": lambda s, d: U.aliases(companies(s, d)).select("alias", "symbol"),
    "u10_ticker_hint": lambda s, d: asked(s, d).select("key", F.coalesce(U.ticker_hint(F.col("query")), F.lit("")).alias("hint")),
    "u12_metadata": with_years,
    "u13_override": overridden,
    "u14_enhanced": lambda s, d: replies(s, d).select("key", "reply"),
    "u16_vectors": lambda s, d: U.vectors_of(replies(s, d), sweep.read(s, d, "embeddings").select(F.col("vec_id").alias("vector_id"))),
    "u06_resolved_years": lambda s, d: asked(s, d).groupBy(F.array_join(U.resolved_years(F.col("query")), ",").alias("years")).agg(F.count("*").alias("n")),
}

_SYM = "translate(lpad(p_partkey::VARCHAR, 4, '0'), '0123456789', 'ABCDEFGHIJ')"
_COMPANIES = f"""comp AS (SELECT {_SYM} AS symbol, p_name AS short, p_name || ' kor' || lower({_SYM}) AS long, p_partkey AS ord FROM part),
names AS (SELECT symbol, ord, 0 AS which, trim(regexp_replace(regexp_replace(short, '\\bnew\\b', ' ', 'g'), ' +', ' ', 'g')) AS name FROM comp UNION ALL SELECT symbol, ord, 1, trim(regexp_replace(regexp_replace(long, '\\bnew\\b', ' ', 'g'), ' +', ' ', 'g')) FROM comp),
words AS (SELECT symbol, ord, which, unnest(string_split(name, ' ')) AS alias, generate_subscripts(string_split(name, ' '), 1) AS k FROM names),
own AS (SELECT alias FROM words GROUP BY alias HAVING count(DISTINCT symbol) = 1 AND length(alias) >= 4),
al0 AS (SELECT name AS alias, symbol, ord, which, -1 AS k FROM names UNION ALL SELECT alias, symbol, ord, which, k FROM words WHERE alias IN (SELECT alias FROM own)),
alias AS MATERIALIZED (SELECT alias, symbol, ord, which, k FROM al0 QUALIFY row_number() OVER (PARTITION BY alias ORDER BY ord, which, k) = 1)""".replace("\\\\", "\\")
_ASKED = f"""line AS (SELECT l_orderkey, min(l_partkey) AS p_partkey FROM lineitem GROUP BY 1),
asked AS (SELECT l_orderkey AS key, trim(regexp_replace(regexp_replace(p_name, '\\bnew\\b', ' ', 'g'), ' +', ' ', 'g')) AS p_name, {_SYM} AS sym, l_orderkey % 7 AS f FROM line JOIN part USING (p_partkey))"""
# What each form names follows from how it is made: its symbol, its own word, the first company of its name, a hint, nothing.
_TICKER = """tick AS (SELECT a.key, f, CASE WHEN f IN (0, 1, 2, 3) THEN lower(sym) WHEN f = 4 THEN lower(alias.symbol) WHEN f = 5 THEN 'qzx' END AS ticker FROM asked a LEFT JOIN alias ON alias.alias = a.p_name)"""
_YEARS = "CASE f WHEN 0 THEN '2021' WHEN 1 THEN '2023' WHEN 2 THEN '2022,2023,2024' WHEN 3 THEN '2023,2024' ELSE {none} END"
_REPLY = """q AS (SELECT finder_id AS key, query FROM questions),
r AS (SELECT key, query, CASE key % 5 WHEN 0 THEN 'more on ' || query WHEN 2 THEN array_to_string(string_split(query, ' ')[1:5], ' ') WHEN 3 THEN query || ', with its figures.' ELSE query END AS reply FROM q)"""


def _questions() -> str:
    from siltstone.plans.sweep_sql import QUESTIONS

    return QUESTIONS


SQL = {
    "u02_real_references": "SELECT doc_id, doc_id % 3 = 2 AS real FROM labels",
    "u09_aliases": f"WITH {_COMPANIES} SELECT alias, symbol FROM alias",
    "u10_ticker_hint": f"WITH {_ASKED} SELECT key, CASE WHEN f = 0 THEN lower(sym) WHEN f = 5 THEN 'qzx' ELSE '' END AS hint FROM asked",
    "u12_metadata": f"WITH {_COMPANIES}, {_ASKED}, {_TICKER} SELECT key, coalesce(ticker, '') AS ticker, {_YEARS.format(none=repr(''))} AS years, '10-k' AS form_type FROM tick",
    "u13_override": f"WITH {_COMPANIES}, {_ASKED}, {_TICKER} SELECT CASE WHEN o_orderstatus = 'F' THEN 'fix' ELSE coalesce(ticker, '') END AS ticker, count(*) AS n FROM tick JOIN orders ON o_orderkey = key GROUP BY 1",
    "u14_enhanced": f"WITH {_questions()}, {_REPLY} SELECT key, reply FROM r",
    "u16_vectors": f"WITH {_questions()}, {_REPLY}, t AS (SELECT query AS text, 0 AS kind, key FROM r UNION ALL SELECT reply, 1, key FROM r), f AS (SELECT text, kind, key AS vector_id FROM t QUALIFY row_number() OVER (PARTITION BY text ORDER BY kind, key) = 1) SELECT key, vector_id, kind = 0 AS reused FROM r JOIN f ON f.text = r.reply WHERE vector_id IN (SELECT vec_id FROM embeddings)",
    "u06_resolved_years": f"WITH {_ASKED} SELECT {_YEARS.format(none=repr('2020,2021,2022,2023,2024'))} AS years, count(*) AS n FROM asked GROUP BY 1",
}
