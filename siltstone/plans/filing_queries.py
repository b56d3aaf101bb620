"""Queries of page conversion and chunking over the supplied pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import filings as H
from siltstone.operators import sweep


def pages(spark, sf_dir):
    return sweep.read(spark, sf_dir, "pages").select("page_id", H.markdown(F.col("html")).alias("md"))


def chunks(spark, sf_dir):
    return H.header_chunks(pages(spark, sf_dir), "page_id", "md")


def dates(spark, sf_dir):
    d = F.date_format("o_orderdate", "MM-dd-")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(d, F.date_format("o_orderdate", "yyyy"))).when(F.col("o_orderkey") % 3 == 1, F.concat(d, F.date_format("o_orderdate", "yy"))).otherwise("unknown")
    return sweep.read(spark, sf_dir, "orders").select("o_orderkey", H.fiscal_date(text).cast("string").alias("fye"))


QUERIES = {
    "c01_markdown": lambda s, d: pages(s, d).select("page_id", F.md5("md").alias("md5"), F.size(F.split("md", "\n")).alias("n_lines")),
    "c05_header_chunks": lambda s, d: chunks(s, d).select("page_id", "chunk", *[F.coalesce(c, F.lit("")).alias(c) for c in H.LEVELS], F.size("paragraphs").alias("n_paragraphs"), F.md5(F.array_join("paragraphs", "\n")).alias("text_md5")),
    "c11_children": lambda s, d: H.children(chunks(s, d), "page_id").select("page_id", "chunk", "child", "n_words", F.md5("text").alias("text_md5")),
    "c24_fiscal_dates": dates,
    "c25_titles": lambda s, d: sweep.chunks(s, d).where("level = 1").select("chunk_id", H.title("ticker", "section", "fiscal_year_end").alias("title")),
}


def _lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _markdown_sql() -> str:
    out = "coalesce(html, '')"
    for pattern, by in H.TO_MARKDOWN:
        out = f"regexp_replace({out}, {_lit(pattern)}, {_lit(by.replace('$1', chr(92) + '1'))}, 'g')"
    return out


_HEAD = " ".join(f"WHEN regexp_matches(line, {_lit(p)}) THEN {k}" for p, k in H.HEADS)
_TITLE = r"regexp_replace(line, '^#{1,4} |^\*+|\*+$', '', 'g')"
_CHUNKS = f"""WITH RECURSIVE md AS MATERIALIZED (SELECT page_id, {_markdown_sql()} AS md FROM pages),
l0 AS (SELECT page_id, unnest(string_split(md, chr(10))) AS line, generate_subscripts(string_split(md, chr(10)), 1) AS pos FROM md),
l1 AS (SELECT *, CASE {_HEAD} ELSE 0 END AS head FROM l0 WHERE line <> ''),
l2 AS (SELECT *, sum((head > 0)::INT) OVER (PARTITION BY page_id ORDER BY pos) AS chunk,
 sum((head = 1)::INT) OVER (PARTITION BY page_id ORDER BY pos) AS i1, sum((head BETWEEN 1 AND 2)::INT) OVER (PARTITION BY page_id ORDER BY pos) AS i2, sum((head BETWEEN 1 AND 3)::INT) OVER (PARTITION BY page_id ORDER BY pos) AS i3 FROM l1),
l3 AS (SELECT *, last_value(CASE WHEN head = 1 THEN {_TITLE} END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos) AS section,
 last_value(CASE WHEN head = 2 THEN {_TITLE} END IGNORE NULLS) OVER (PARTITION BY page_id, i1 ORDER BY pos) AS subsection,
 last_value(CASE WHEN head = 3 THEN {_TITLE} END IGNORE NULLS) OVER (PARTITION BY page_id, i2 ORDER BY pos) AS item,
 last_value(CASE WHEN head = 4 THEN {_TITLE} END IGNORE NULLS) OVER (PARTITION BY page_id, i3 ORDER BY pos) AS subitem FROM l2)"""
_CHILDREN = rf""", par AS (SELECT page_id, chunk, pos, trim(line) AS line, string_split_regex(trim(line), '\s+') AS w FROM l3 WHERE head = 0),
cut AS (SELECT page_id, chunk, pos, 0 AS sub, len(w) AS n, line AS piece FROM par WHERE len(w) <= {H.BUDGET} UNION ALL
 SELECT page_id, chunk, pos, s, len(w[s:s + {H.BUDGET - 1}]), array_to_string(w[s:s + {H.BUDGET - 1}], ' ') FROM (SELECT *, unnest(range(1, len(w) - {H.OVERLAP} + 1, {H.BUDGET - H.OVERLAP})) AS s FROM par WHERE len(w) > {H.BUDGET})),
num AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY page_id, chunk ORDER BY pos, sub) AS k FROM cut),
f AS (SELECT page_id, chunk, k, 0 AS child, n AS used, n, piece FROM num WHERE k = 1 UNION ALL
 SELECT p.page_id, p.chunk, p.k, CASE WHEN f.used + p.n > {H.BUDGET} THEN f.child + 1 ELSE f.child END, CASE WHEN f.used + p.n > {H.BUDGET} THEN p.n ELSE f.used + p.n END, p.n, p.piece
 FROM f JOIN num p ON p.page_id = f.page_id AND p.chunk = f.chunk AND p.k = f.k + 1)"""
SQL = {
    "c01_markdown": f"SELECT page_id, md5(md) AS md5, len(string_split(md, chr(10)))::INT AS n_lines FROM (SELECT page_id, {_markdown_sql()} AS md FROM pages)",
    "c05_header_chunks": _CHUNKS + " SELECT page_id, chunk, coalesce(section, '') AS section, coalesce(subsection, '') AS subsection, coalesce(item, '') AS item, coalesce(subitem, '') AS subitem, count(*)::INT AS n_paragraphs, md5(string_agg(line, chr(10) ORDER BY pos)) AS text_md5 FROM l3 WHERE head = 0 GROUP BY page_id, chunk, section, subsection, item, subitem",
    "c11_children": _CHUNKS + _CHILDREN + " SELECT page_id, chunk, child, sum(n)::INT AS n_words, md5(string_agg(piece, chr(10) || chr(10) ORDER BY k)) AS text_md5 FROM f GROUP BY page_id, chunk, child",
    "c24_fiscal_dates": "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN '20' || strftime(o_orderdate, '%y-%m-%d') END AS fye FROM orders",
    "c25_titles": "SELECT printf('d%08d', doc_id) AS chunk_id, 'title: ' || concat_ws(', ', 'ticker: ' || nullif(source, ''), 'section: ' || nullif(lang, ''), 'fiscal_year_end: ' || make_date((2020 + doc_id % 5)::BIGINT, 12, 31)) AS title FROM documents",
}
