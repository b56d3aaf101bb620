"""HTML pages to markdown, header chunks and packed child chunks; titles and dates of payloads."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUDGET, OVERLAP = 200, 40
#: (pattern, replacement) in order; the patterns mean the same in Java and RE2.
TO_MARKDOWN = [
    (r"(?s)<!--.*?-->", ""), *[(rf"(?is)<{tag}[ >].*?</{tag}>", "") for tag in ("script", "style", "head", "nav", "footer")],
    *[(rf"(?i)<h{k}(?:\s[^>]*)?>\s*", "\n\n" + "#" * k + " ") for k in (1, 2, 3, 4)], (r"(?i)</h[1-4]>", "\n\n"), (r"(?i)<b>([^<]*)</b>", "**$1**"),
    (r"(?i)<li(?:\s[^>]*)?>", "\n- "), (r"(?i)</?(?:p|div|ul|ol|br|tr|table|section|article)(?:\s[^>]*)?/?>", "\n\n"), (r"(?s)<[^>]*>", ""),
    ("&nbsp;", " "), ("&copy;", "©"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"),
    (r"[ \t\r]+", " "), (r" ?\n ?", "\n"), (r"\n{3,}", "\n\n"), (r"\A\s+|\s+\z", ""),
]
#: (pattern, level) of lines that head what follows, first match wins.
HEADS = [(r"^#### ", 4), (r"^### ", 3), (r"^## ", 2), (r"^# ", 1), (r"(?i)^part [ivx]+\b", 1), (r"(?i)^item \d+[a-z]?\b", 2), (r"^\*{2,3}[^*]{1,99}\*{2,3}$", 3)]
LEVELS = ("section", "subsection", "item", "subitem")


def markdown(html: Column) -> Column:
    """Markdown of a page: headings, list items, bold runs and paragraphs; null is empty."""
    out = F.coalesce(html, F.lit(""))
    for pattern, by in TO_MARKDOWN:
        out = F.regexp_replace(out, pattern, by)
    return out


def head_level(line: Column) -> Column:
    """1 to 4 for a heading, else 0."""
    out = F.lit(0)
    for pattern, level in reversed(HEADS):
        out = F.when(line.rlike(pattern), level).otherwise(out)
    return out


def header_chunks(pages: DataFrame, key: str, md: str) -> DataFrame:
    """key, chunk, section, subsection, item, subitem, paragraphs: one row for each heading with text below it.

    A heading keeps the headings above it; a shallower one resets the deeper ones.  Headings without text only give their title on.
    Windows hold one page each.
    """
    lines = pages.select(key, F.posexplode(F.split(md, "\n")).alias("pos", "line")).where("line <> ''").withColumn("head", head_level(F.col("line")))
    rows = lines.withColumn("chunk", F.sum((F.col("head") > 0).cast("int")).over(W.partitionBy(key).orderBy("pos")))
    title = F.regexp_replace("line", r"^#{1,4} |^\*+|\*+$", "")
    scope = [key]
    for k, name in enumerate(LEVELS, 1):
        w = W.partitionBy(*scope).orderBy("pos")
        rows = rows.withColumn(name, F.last(F.when(F.col("head") == k, title), True).over(w)).withColumn(f"island{k}", F.sum(F.when((F.col("head") > 0) & (F.col("head") <= k), 1).otherwise(0)).over(w))
        scope.append(f"island{k}")
    text = F.array_sort(F.collect_list(F.struct("pos", "line")))
    return rows.where("head = 0").groupBy(key, "chunk", *LEVELS).agg(F.transform(text, lambda s: s["line"]).alias("paragraphs"))


def pieces(paragraphs: Column, budget: int = BUDGET, overlap: int = OVERLAP) -> Column:
    """Array of (n, piece): a paragraph within the budget whole, a longer one in overlapping windows of words."""
    def cut(p):
        words = F.split(F.trim(p), r"\s+")
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - overlap), F.lit(budget - overlap))
        windows = F.transform(starts, lambda s: F.slice(words, s, budget))
        return F.when(F.size(words) <= budget, F.array(F.struct(F.size(words).alias("n"), F.trim(p).alias("piece")))).otherwise(F.transform(windows, lambda w: F.struct(F.size(w).alias("n"), F.array_join(w, " ").alias("piece"))))

    return F.flatten(F.transform(paragraphs, cut))


def _pack(sizes: pd.Series, texts: pd.Series, budget: pd.Series) -> pd.Series:
    out = []
    for ns, ps, most in zip(sizes, texts, budget, strict=True):
        groups, used = [], 0
        for n, p in zip(ns, ps, strict=True):
            if not groups or used + n > most:
                groups.append([])
                used = 0
            groups[-1].append(p)
            used += n
        out.append(["\n\n".join(g) for g in groups])
    return pd.Series(out)


def children(chunks: DataFrame, key: str, budget: int = BUDGET, overlap: int = OVERLAP) -> DataFrame:
    """key, chunk, child, n_words, text: the pieces of each header chunk packed in order, each child as full as the budget allows (one pass, in time linear in the text)."""
    pack = F.pandas_udf(_pack, "array<string>")
    cut = chunks.select(key, "chunk", pieces(F.col("paragraphs"), budget, overlap).alias("p"))
    made = cut.select(key, "chunk", F.posexplode(pack(F.col("p.n"), F.col("p.piece"), F.lit(budget))).alias("child", "text"))
    return made.select(key, "chunk", "child", F.size(F.split("text", r"\s+")).alias("n_words"), "text")


def fiscal_date(text: Column) -> Column:
    """Date of "MM-DD-YY" or "MM-DD-YYYY"; null for anything else."""
    full = F.when(text.rlike(r"^\d{2}-\d{2}-\d{2}$"), F.concat(F.substring(text, 1, 6), F.lit("20"), F.substring(text, 7, 2))).otherwise(text)
    return F.when(full.rlike(r"^\d{2}-\d{2}-\d{4}$"), F.try_to_timestamp(full, F.lit("MM-dd-yyyy")).cast("date"))


def title(*fields: str) -> Column:
    """"title: name: value, …" of the fields that aren't empty."""
    parts = F.array(*[F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) != "", F.concat(F.lit(f + ": "), F.col(f).cast("string"))) for f in fields])
    return F.concat(F.lit("title: "), F.array_join(F.array_compact(parts), ", "))
