"""Queries of HTML conversion, heading lines and splitting, over pages and filings that Spark writes from orders and their lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import levels as L
from siltstone.operators import markup, splitter, sweep


def html_filings(spark, sf_dir):
    """order, html: one filing for each order, with nested lists, bold and italic runs, character references, unclosed elements and a table of its lines."""
    line = F.struct("l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("q"), "l_returnflag")
    lines = sweep.read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("l"))
    o = sweep.read(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    key, text = F.col("o_orderkey").cast("string"), lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    row = lambda s: text("<tr><td>", s["l_partkey"].cast("string"), "<td><p>", s["q"].cast("string"), "</p></td><td>", s["l_returnflag"], F.when(s["q"] % 2 == 0, "|&lt;even&gt;").otherwise(""))
    table = text("<table><thead><tr><th>part</th><th>quantity</th><th><b>mode</b></th></tr></thead><tbody>", F.array_join(F.transform("l", row), ""), "</tbody></table>")
    html = text(
        "<html><head><title>no</title><style>p{}</style></head><body><nav>no</nav><h1>Order ", key, "</h1><script>var t='</p>';</script><p>Placed by <b>customer ", F.col("o_custkey").cast("string"), "</b> &amp; Co.<br>Status <i>", F.col("o_orderstatus"), "</i>",
        "<ul><li>first<ul><li>", F.col("o_orderpriority"), "<li>in <em>", F.year("o_orderdate").cast("string"), "</em></ul><li>second</ul><ol><li>a<li>b</ol><h2>Lines</h2>", table, "<!-- no --><p>Total&nbsp;&euro;", F.size("l").cast("string"), "<footer>no</footer></body></html>",
    )
    return o.select("o_orderkey", html.alias("html"))


def converted(spark, sf_dir):
    return markup.markdown_pages(html_filings(spark, sf_dir))


def page_lines(spark, sf_dir):
    """Every page through the converter: lines, headings, lines of lists and bold runs."""
    md = markup.markdown_pages(sweep.read(spark, sf_dir, "pages").select("page_id", "html"))
    rows = F.split("md", "\n")
    count = lambda p: F.size(F.filter(rows, lambda x: x.rlike(p)))
    return md.select("page_id", F.md5("md").alias("md5"), F.size(rows).alias("n_lines"), count("^#{1,6} ").alias("n_heads"), count("^ *- ").alias("n_items"), count(r"\*\*").alias("n_bold"))


def table_rows(spark, sf_dir):
    """The tables that the converter finds, as rows by the segmenter that packs filings."""
    parts = converted(spark, sf_dir).select("o_orderkey", F.explode(L.segments(F.col("md"))).alias("s")).where("s.kind = 'table'")
    return parts.select("o_orderkey", F.col("s.caption").alias("caption"), F.size(L.table_parts(F.col("s.text"))["rows"]).alias("n_rows"), F.md5("s.text").alias("md5"))


#: Lines by kind, so that every rule and its near misses occur; {k} stands for the order.
LINES = [
    "PART II", "| part iv | Exhibits {k} |", "Item 1A. Risk Factors {k}", "**Item 7.** Discussion", "| Item 8 | Statements |", "***Both {k}***", "**Bold {k}**", "**Run in {k}.** Text goes on", "## Kept {k}", "Plain text of order {k}.",
    "Floating Title of Orders", "floating title of orders", "Floating title that has few capitals in it", "**" + "long " * 30 + "**", "", "Net Sales", "**Two.** *marks* {k}", "PARTNERS III", "Item", "   indented Words Here   ",
]


def lined(spark, sf_dir):
    """o_orderkey, md: eight lines of each order, by key, some without blank lines between; one order in three has a contents line."""
    k = F.col("o_orderkey")
    kinds = F.array(*[F.lit(x) for x in LINES])
    line = lambda i: F.replace(F.get(kinds, F.pmod(k * (i + 3) + i * i, F.lit(len(LINES))).cast("int")), F.lit("{k}"), k.cast("string"))
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.concat(line(i), F.when((k + i) % 3 == 0, "\n").otherwise("\n\n"))), "")
    orders = sweep.read(spark, sf_dir, "orders").select("o_orderkey")
    # Keys are small and their lines dear: a file of a few megabytes would otherwise be one task.
    orders = orders.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "o_orderkey")
    return orders.select(k, F.concat(F.when(k % 3 == 0, "PART I\nTable of Contents\n\n").when(k % 3 == 1, "").otherwise("\n\n\nIntro\r\n"), text).alias("md"))


def headed(spark, sf_dir):
    return lined(spark, sf_dir).select("o_orderkey", F.md5(markup.enriched(F.col("md"))).alias("md5"))


def word_count(text: str) -> int:
    return len(text.split())


def splits(spark, sf_dir):
    """Chunks of every document by the ladder of separators: number, characters, words."""
    docs = sweep.read(spark, sf_dir, "documents").select("doc_id", F.posexplode(splitter.chunks(F.col("text"), 60, 12, count=word_count)).alias("chunk", "text"))
    return docs.select("doc_id", "chunk", F.length("text").alias("n_chars"), F.size(F.split("text", r"\s+")).alias("n_words"), F.md5("text").alias("md5"))


QUERIES = {"c01_html": lambda s, d: converted(s, d).select("o_orderkey", F.md5("md").alias("md5")), "c01_pages": page_lines, "c02_heading_lines": headed, "c07_html_tables": table_rows, "c14_ladder": splits}

_FILING = r"""l AS (SELECT l_orderkey, string_agg('| ' || l_partkey || ' | ' || l_quantity::BIGINT || ' | ' || l_returnflag || CASE WHEN l_quantity::BIGINT % 2 = 0 THEN '\|<even>' ELSE '' END || ' |', chr(10) ORDER BY l_linenumber, l_partkey, l_quantity::BIGINT, l_returnflag) AS body, count(*) AS n FROM lineitem GROUP BY ALL),
t AS (SELECT l_orderkey, n, '| part | quantity | **mode** |' || chr(10) || '|---|---|---|' || chr(10) || body AS tab FROM l),
f AS (SELECT o_orderkey, tab, n, replace('# Order ' || o_orderkey || '~~Placed by **customer ' || o_custkey || '** & Co.~Status *' || o_orderstatus || '*~~- first~  - ' || o_orderpriority || '~  - in *' || year(o_orderdate) || '*~- second~~1. a~2. b~~## Lines~~', '~', chr(10)) || tab || chr(10) || chr(10) || 'Total €' || n AS md
      FROM orders JOIN t ON l_orderkey = o_orderkey)"""
_LINES = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in LINES) + "]"
_HEADED = rf"""WITH m AS (SELECT o_orderkey AS k, list_reduce(list_prepend('', list_transform(range(8), lambda i: replace({_LINES}[(o_orderkey * (i + 3) + i * i) % {len(LINES)} + 1], '{{k}}', o_orderkey::VARCHAR) || CASE WHEN (o_orderkey + i) % 3 = 0 THEN chr(10) ELSE chr(10) || chr(10) END)), lambda a, b: a || b) AS t FROM orders),
r AS (SELECT k, CASE WHEN k % 3 = 0 THEN 'PART I' || chr(10) || 'Table of Contents' || chr(10) || chr(10) WHEN k % 3 = 1 THEN '' ELSE repeat(chr(10), 3) || 'Intro' || chr(10) END || t[:-2] AS md FROM m),
x AS (SELECT k, unnest(string_split(md, chr(10))) AS raw, generate_subscripts(string_split(md, chr(10)), 1) AS i FROM r),
c AS (SELECT *, trim(raw, ' ') AS s, min(CASE WHEN lower(trim(raw, ' ')) IN ('contents', 'table of contents') THEN i END) OVER (PARTITION BY k) AS toc FROM x),
b AS (SELECT *, min(CASE WHEN s <> '' AND i > coalesce(toc, 0) THEN i END) OVER (PARTITION BY k) AS lead FROM c),
n AS (SELECT *, toc IS NULL OR i >= lead AS body FROM b),
v AS (SELECT *, coalesce(lag(s) OVER w, '') = '' AS above, coalesce(lead(s) OVER w, '') = '' AS below, list_filter(string_split_regex(s, '\s+'), lambda y: regexp_matches(y, '^\p{{L}}+$')) AS words FROM n WINDOW w AS (PARTITION BY k, body ORDER BY i)),
o AS (SELECT k, i, CASE
  WHEN NOT body OR s = '' OR s[1] = '#' THEN raw
  WHEN regexp_matches(s, '(?i)^\| *PART (I|II|III|IV) *\|') THEN '# ' || upper(trim(string_split(s, '|')[2])) || ' ' || trim(string_split(s, '|')[3])
  WHEN regexp_matches(s, '(?i)^\| *ITEM \d+[A-Z]?\.? *\|') THEN '## ' || upper(trim(string_split(s, '|')[2])) || ' ' || trim(string_split(s, '|')[3])
  WHEN regexp_matches(s, '(?i)^PART (I|II|III|IV)$') THEN '# ' || upper(s) || ' '
  WHEN regexp_matches(s, '(?i)^(\*\*)?ITEM \d+[A-Z]?\b') THEN '## ' || upper(regexp_extract(s, '(?i)(item \d+[a-z]?)', 1)) || ' ' || trim(regexp_replace(s, '(?i)^(\*\*)?item \d+[a-z]?\.?', ''))
  WHEN s LIKE '***%***' THEN '### ' || s[4:-4]
  WHEN s LIKE '**%**' AND len(s) < 104 THEN '### ' || trim(s[3:-3])
  WHEN s LIKE '**%.** %' THEN '#### ' || string_split(s[3:], '.** ')[1] || chr(10) || chr(10) || string_split(s, '.** ')[2]
  WHEN above AND below AND len(s) BETWEEN 4 AND 79 AND regexp_matches(s, '^\p{{Lu}}') AND s NOT LIKE '%.' AND len(words) > 0 AND len(list_filter(words, lambda y: regexp_matches(y, '^\p{{Lu}}'))) > 0.6 * len(words) THEN '### ' || s
  ELSE raw END AS made FROM v)"""
SQL = {
    "c01_html": f"WITH {_FILING} SELECT o_orderkey, md5(md) AS md5 FROM f",
    "c07_html_tables": f"WITH {_FILING} SELECT o_orderkey, '## Lines' AS caption, n::INT AS n_rows, md5(tab) AS md5 FROM f",
    "c02_heading_lines": _HEADED + r" SELECT k AS o_orderkey, md5(regexp_replace(string_agg(made, chr(10) ORDER BY i), '\n{3,}', chr(10) || chr(10), 'g')) AS md5 FROM o GROUP BY k",
}
