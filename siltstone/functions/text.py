"""Text kernel: column expressions for tokens, recall and normal forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numeric tokens, bare years, content words.
NUMBER = r"-?\d[\d,]*(?:\.\d+)?"
YEAR = r"^(?:19|20)\d{2}$"
WORD = r"[a-z][a-z\-]{2,}"
#: Words of every filing, which say nothing about a passage.
STOPWORDS = (
    "the and for our are was were with that this from has have had not any all its their which "
    "such other than been will may can into under over more most upon also both each per "
    "company companies inc corporation business financial statements year years fiscal "
    "including include includes included related respectively approximately during"
).split()
#: Fewest salient numbers for which numeric recall means anything.
MIN_SALIENT = 4


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def numbers(text) -> Column:
    """Distinct numeric tokens without surrounding commas."""
    found = F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(NUMBER), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.btrim(x, F.lit(","))))


def salient_numbers(text) -> Column:
    """Numeric tokens that aren't bare years."""
    return F.filter(numbers(text), lambda x: ~x.rlike(YEAR))


def content_words(text) -> Column:
    """Distinct content words of three letters or more, without stopwords."""
    found = F.regexp_extract_all(F.lower(F.coalesce(_c(text), F.lit(""))), F.lit(WORD), F.lit(0))
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(w) for w in STOPWORDS]))


def share(evidence: Column, context: Column) -> Column:
    """Share of ``evidence`` (an array) that ``context`` holds; 0 for no evidence."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(evidence, context)), F.nullif(F.size(evidence), F.lit(0))), F.lit(0.0))


def word_recall(evidence, context) -> Column:
    return share(content_words(evidence), content_words(context))


def num_recall(evidence, context) -> Column:
    own = salient_numbers(evidence)
    return F.when(F.size(own) < MIN_SALIENT, 0.0).otherwise(share(own, salient_numbers(context)))


def normal(text) -> Column:
    """White space collapsed, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(_c(text), r"\s+", " ")))


def opening(text, length: int) -> Column:
    """The first ``length`` characters of the normal form, from the words that hold as many characters alone (a whole last word: how a letter is lowered can depend on the rest of its word)."""
    return F.substring(normal(F.regexp_extract(_c(text), rf"\A(?:\s*+\S){{0,{length}}}+\S*+", 0)), 1, length)


def tokens(text) -> Column:
    """Lower-case runs of letters and digits (all beyond ASCII counts as a letter)."""
    return F.filter(F.split(F.lower(F.coalesce(_c(text), F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def first_words(text, n: int) -> Column:
    """The first ``n`` space-separated words."""
    return F.substring_index(_c(text), " ", n)
