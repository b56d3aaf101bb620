"""Question understanding: years that a question names, company names, item numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.plans import store

ANCHOR = 2024
#: Relative phrases and the years that they mean (offsets from the anchor year).
RELATIVE = {
    "current fiscal year": (0,), "current fy": (0,), "current year": (0,), "this year": (0,), "most recent": (0,),
    "previous fiscal year": (-1,), "last fiscal year": (-1,), "prior fiscal year": (-1,), "previous year": (-1,), "prior year": (-1,), "last year": (-1,),
    "year-over-year": (-1, 0), "yoy": (-1, 0), "prior year trends": (-1, 0), "prior year comparison": (-1, 0), "compared to prior": (-1, 0),
    "prior fiscal years": (-2, -1, 0), "prior years": (-2, -1, 0), "multi-year": (-2, -1, 0),
}
#: Words that a company's name doesn't need.
SUFFIXES = ("incorporated", "corporation", "holdings inc", "holding company", "holdings", "holding", "company", "companies", "corp", "inc", "group", "plc", "ltd", "limited", "llc", "l l c", "co", "the", "class a", "class b", "class c", "new")
#: The forms in which years are named.
FY_RANGE = r"(?i)\bFY(\d{2,4})\s*(?:-|to|–|—)\s*FY(\d{2,4})\b"
YEAR_RANGE = r"\b(20[12][0-9])\s*(?:-|to|–|—)\s*(20[12][0-9])\b"
SLASH = r"\b(20[12][0-9])/(\d{2})\b"
FY_SINGLE, YEAR_SINGLE = r"(?i)\bFY(\d{2,4})\b", r"\b(20[12][0-9])\b"


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x: x.cast("int"))


def _full(year: Column) -> Column:
    return F.when(year < 100, year + 2000).otherwise(year)


def _spans(text: Column, pattern: str) -> Column:
    """Years of ranges, of those whose first year isn't after their last."""
    pairs = F.arrays_zip(_all(text, pattern, 1).alias("a"), _all(text, pattern, 2).alias("b"))
    ok = F.filter(F.transform(pairs, lambda p: F.struct(_full(p["a"]).alias("a"), _full(p["b"]).alias("b"))), lambda p: p["a"] <= p["b"])
    return F.flatten(F.transform(ok, lambda p: F.sequence(p["a"], p["b"])))


def explicit_years(text: Column) -> Column:
    """Sorted distinct years that a question names: slash pairs, ranges, and single years outside of both (a reversed range is used up)."""
    rest = text
    for p in (FY_RANGE, YEAR_RANGE, SLASH):
        rest = F.regexp_replace(rest, p, " ")
    slash = F.concat(_all(text, SLASH, 1), F.transform(_all(text, SLASH, 2), _full))
    single = F.concat(F.transform(_all(rest, FY_SINGLE, 1), _full), _all(rest, YEAR_SINGLE, 1))
    return F.array_sort(F.array_distinct(F.concat(slash, _spans(text, FY_RANGE), _spans(text, YEAR_RANGE), single)))


def relative_years(text: Column, anchor: int = ANCHOR) -> Column:
    """Years of the longest relative phrase in a question (first in the table among equals), else null."""
    low, out = F.lower(text), F.lit(None).cast("array<int>")
    for phrase in sorted(RELATIVE, key=len):
        out = F.when(low.rlike(rf"\b{phrase}\b"), F.array(*[F.lit(anchor + k) for k in RELATIVE[phrase]])).otherwise(out)
    return out


def years(text: Column) -> Column:
    """Explicit years, else relative ones, else null (no signal; never an empty array)."""
    own = explicit_years(text)
    return F.when(F.size(own) > 0, own).otherwise(relative_years(text))


def default_window(anchor: int = ANCHOR, back: int = 4) -> Column:
    """The years searched where a question names none."""
    return F.sequence(F.lit(anchor - back), F.lit(anchor))


def resolved_years(text: Column, anchor: int = ANCHOR) -> Column:
    """Years to search: those of the question, else the default window."""
    return F.coalesce(years(text), default_window(anchor))


def company_name(name: Column) -> Column:
    """Lower case, without parentheses, possessives, punctuation and legal words."""
    n = F.regexp_replace(F.lower(name), r"\([^)]*\)", " ")
    for pattern, by in (("&", " and "), (r"[’']s\b", ""), (r"[.,’']", ""), (r"[^a-z0-9 ]", " "), (r"\b(?:" + "|".join(SUFFIXES) + r")\b", " "), (r"\s+", " ")):
        n = F.regexp_replace(n, pattern, by)
    return F.trim(n)


def item_numbers(section: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(section, F.lit(""))), F.lit(r"\bitem\s+(\d+[a-z]*)"), F.lit(1))


#: Capitals that aren't tickers, and the forms in which tickers are written.
NOT_TICKERS = ("FOR", "THE", "AND", "INC", "LLC", "SEC", "FY", "US", "AT", "EPS", "GAAP")
IN_PARENTHESES, CAPITALS, LAST_WORD = r"\(([A-Z]{1,5})\)", r"\b[A-Z]{2,5}(?:-[A-Z])?\b", r"\b([A-Z]{2,5})\s*[.,]?\s*$"


def aliases(companies: DataFrame) -> DataFrame:
    """alias, symbol, place of ``companies`` (symbol, shortname, longname, ord): normal names, and their words of four letters or more that only one symbol's names hold.

    An alias that several companies have is the first one's by (ord, short before long, name before its words); ``place``
    is that order.  Null and empty names have no aliases.
    """
    names = companies.select("symbol", "ord", F.posexplode(F.array("shortname", "longname")).alias("which", "raw")).where("raw IS NOT NULL")
    names = names.select("symbol", "ord", "which", company_name(F.col("raw")).alias("name")).where("name <> ''")
    words = names.select("symbol", "ord", "which", F.posexplode(F.split("name", " ")).alias("k", "alias"))
    own = words.groupBy("alias").agg(F.count_distinct("symbol").alias("n")).where((F.col("n") == 1) & (F.length("alias") >= 4)).select("alias")
    every = names.select(F.col("name").alias("alias"), "symbol", F.struct("ord", "which", F.lit(-1).alias("k")).alias("place"))
    every = every.unionByName(words.join(own, "alias", "left_semi").select("alias", "symbol", F.struct("ord", "which", "k").alias("place")))
    return every.groupBy("alias").agg(F.min_by("symbol", "place").alias("symbol"), F.min("place").alias("place"))


def ticker_hint(text: Column) -> Column:
    """A symbol in parentheses, else a last word in capitals; lower case, or null."""
    inside, last = F.regexp_extract(text, IN_PARENTHESES, 1), F.regexp_extract(text, LAST_WORD, 1)
    return F.lower(F.when(inside != "", inside).when((last != "") & ~last.isin(*NOT_TICKERS), last))


def tickers(asked: DataFrame, companies: DataFrame) -> DataFrame:
    """key, ticker (lower case, or null) of each row of ``asked`` (key, query).

    First a known symbol in parentheses, then the first known symbol in capitals, then the longest alias that stands in
    the normal form of the question (the first among equals), then the hint.  Symbols and
    aliases are joined by their text, so neither table has to fit anywhere.
    """
    known = companies.select(F.upper("symbol").alias("token")).distinct()
    capitals = F.filter(F.regexp_extract_all("query", F.lit(CAPITALS), F.lit(0)), lambda t: ~t.isin(*NOT_TICKERS))
    tokens = asked.select("key", F.posexplode(F.concat(F.array(F.regexp_extract("query", IN_PARENTHESES, 1)), capitals)).alias("pos", "token"))
    named = tokens.join(known, "token", "left_semi").groupBy("key").agg(F.min_by("token", "pos").alias("named"))
    words = asked.select("key", F.split(company_name(F.col("query")), " ").alias("w"))
    named_as = store.written(aliases(companies), "aliases")
    longest = named_as.agg(F.max(F.size(F.split("alias", " ")))).first()[0] or 1  # words of the longest alias that there is
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("w") - i + 1)), lambda n: F.array_join(F.slice("w", i, n), " "))))
    found = words.select("key", F.explode(F.array_distinct(runs)).alias("alias")).join(named_as, "alias")
    found = found.groupBy("key").agg(F.min_by("symbol", F.struct(-F.length("alias"), "place")).alias("by_name"))
    rows = asked.join(named, "key", "left").join(found, "key", "left")
    return rows.select("key", F.lower(F.coalesce("named", "by_name", ticker_hint(F.col("query")))).alias("ticker"))


def metadata(asked: DataFrame, companies: DataFrame) -> DataFrame:
    """key, ticker, years, form_type of each question, always from its original wording."""
    own = asked.select("key", years(F.col("query")).alias("years"), F.lit("10-k").alias("form_type"))
    return tickers(asked, companies).join(own, "key").select("key", "ticker", "years", "form_type")


#: How a model refuses, and after what it goes on.
REFUSAL = r"(?i)i (?:can'?t|cannot|am unable|won'?t|must decline|'?m not able)|i'?m sorry|^sorry[,. ]|this (?:request|query|question) (?:is|involves|relates to)|as an? (?:ai|language model|assistant)[,. ]"
GOES_ON = r"(?i)(?:as requested[,.]?|however[,.]?|here is[,:]?)\s*"


def without_refusal(reply: Column, original: Column) -> Column:
    """The reply; where it refuses: what stands before, if over 20 characters; else what follows the last "however" or its like, if some word of the original stands in it; else the original."""
    before = F.trim(F.get(F.split(reply, REFUSAL, 2), F.lit(0)))
    parts = F.split(reply, GOES_ON)
    last = F.when(F.size(parts) > 1, F.trim(F.element_at(parts, -1))).otherwise("")
    shares = F.exists(F.filter(F.split(F.lower(original), r"\s+"), lambda w: w != ""), lambda w: F.lower(last).contains(w))
    return F.when(~reply.rlike(REFUSAL), F.trim(reply)).when(F.length(before) > 20, before).when((last != "") & shares, last).otherwise(original)


def enhanced(asked: DataFrame, model, attempts: int = 3) -> DataFrame:
    """``asked`` (key, query) with reply: ``model(query column, attempt)`` is asked up to ``attempts`` times for what is still empty, then the original stands."""
    reply = F.lit("")
    for k in range(attempts):
        reply = F.when(F.trim(reply) != "", reply).otherwise(F.coalesce(model(F.col("query"), k), F.lit("")))
    return asked.withColumn("reply", F.when(F.trim(reply) == "", F.col("query")).otherwise(without_refusal(reply, F.col("query"))))


def real_references(refs: Column) -> Column:
    """Whether some reference isn't empty, "none" or "none."; null references are none."""
    return F.exists(F.coalesce(refs, F.array().cast("array<string>")), lambda r: ~F.lower(F.trim(F.coalesce(r, F.lit("")))).isin("none", "none.", ""))


def vectors_of(asked: DataFrame, known: DataFrame) -> DataFrame:
    """key, vector_id, reused: the vector of each question's enhanced text, of equal texts the one of the smallest key; an unchanged text takes the original's.

    ``asked`` (key, query, reply); ``known`` (vector_id) are the vectors that exist, numbered as keys.
    """
    texts = asked.select("key", F.col("query").alias("text"), F.lit(0).alias("kind")).unionByName(asked.select("key", F.col("reply").alias("text"), F.lit(1).alias("kind")))
    first = texts.groupBy("text").agg(F.min(F.struct("kind", "key")).alias("f")).select("text", F.col("f.key").alias("vector_id"), F.col("f.kind").alias("kind"))
    rows = asked.select("key", "query", F.col("reply").alias("text")).join(first, "text").join(known, "vector_id", "left_semi")
    return rows.select("key", "vector_id", (F.col("kind") == 0).alias("reused"))
