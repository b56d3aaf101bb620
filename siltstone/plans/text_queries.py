"""Queries of the text kernel, question understanding and table upkeep over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators import sweep
from siltstone.operators import understanding as U
from siltstone.plans import sweep_sql as S
from siltstone.sources import tables


def asked(spark, sf_dir):
    """Questions about orders, in the forms in which people name years."""
    y = F.year("o_orderdate")
    form = F.get(F.array(F.concat(F.lit("revenue of "), y + 20), F.concat(F.lit("FY"), (y + 20) % 100, F.lit("-FY"), (y + 22) % 100, F.lit(" growth")), F.concat(y + 22, F.lit(" to "), y + 20, F.lit(" margin")), F.concat(y + 18, F.lit("/"), (y + 17) % 100, F.lit(" cost")), F.lit("margin of last year"), F.lit("yoy change"), F.lit("board oversight")), (F.col("o_orderkey") % 7).cast("int"))
    return sweep.read(spark, sf_dir, "orders").select("o_orderkey", form.alias("query"))


ASKED = "asked AS (SELECT o_orderkey, year(o_orderdate) AS y, o_orderkey % 7 AS f FROM orders)"
QUERIES = {
    "m01_numbers_words": lambda s, d: sweep.read(s, d, "documents").select("doc_id", F.size(X.numbers("text")).alias("n_numbers"), F.size(X.salient_numbers("text")).alias("n_salient"), F.size(X.content_words("text")).alias("n_words"), F.md5(X.normal(F.coalesce("text", F.lit("")))).alias("normal_md5")),
    "u03_years": lambda s, d: asked(s, d).select("o_orderkey", F.coalesce(F.array_join(U.years(F.col("query")), ","), F.lit("none")).alias("years")),
    "u08_company_names": lambda s, d: sweep.read(s, d, "part").select("p_partkey", U.company_name(F.concat(F.lit("The "), F.initcap("p_name"), F.lit(" & Sons' Holdings, Inc. ("), "p_brand", F.lit(")"))).alias("name")),
    "u07_year_weights": lambda s, d: tables.year_shares(sweep.read(s, d, "orders")),
    "c23_chunk_statistics": lambda s, d: sweep.chunks(s, d).groupBy("ticker").agg(F.count_if(F.col("level") == 1).alias("n_docs"), F.count_if(F.col("level") == 2).alias("n_lines"), F.count_if(F.col("section") != "").alias("n_section")),
    "l02_orphans": lambda s, d: tables.orphans(sweep.chunks(s, d)),
    "io12_upsert_latest": lambda s, d: tables.latest(sweep.read(s, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", F.round("value", 6).alias("value")),
    "io15_move": lambda s, d: tables.move(sweep.read(s, d, "orders").select("o_orderkey"), sweep.read(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct(), "o_orderkey"),
    "io20_additive": lambda s, d: tables.additive(sweep.read(s, d, "documents").select("doc_id"), sweep.read(s, d, "labels").select("doc_id"), ["doc_id"]),
}
SQL = {
    "m01_numbers_words": rf"SELECT doc_id, len({S.numbers('text')})::INT AS n_numbers, len({S.salient('text')})::INT AS n_salient, len({S.words('text')})::INT AS n_words, md5(lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')))) AS normal_md5 FROM documents",
    "u03_years": f"""WITH {ASKED} SELECT o_orderkey, CASE f WHEN 0 THEN (y + 20)::VARCHAR WHEN 1 THEN (y + 20) || ',' || (y + 21) || ',' || (y + 22) WHEN 2 THEN 'none' WHEN 3 THEN (y + 17) || ',' || (y + 18) WHEN 4 THEN '2023' WHEN 5 THEN '2023,2024' ELSE 'none' END AS years FROM asked""",
    "u08_company_names": r"SELECT p_partkey, trim(regexp_replace(regexp_replace(p_name || ' and sons', '\bnew\b', ' ', 'g'), '\s+', ' ', 'g')) AS name FROM part",
    "u07_year_weights": "SELECT y AS year, n, round(pow(2, rank() OVER (ORDER BY y) - 1) / (pow(2, count(*) OVER ()) - 1), 9) AS weight FROM (SELECT year(o_orderdate)::INT AS y, count(*) AS n FROM orders GROUP BY 1)",
    "c23_chunk_statistics": "WITH " + S.CHUNKS + " SELECT ticker, count(*) FILTER (level = 1) AS n_docs, count(*) FILTER (level = 2) AS n_lines, count(*) FILTER (section <> '') AS n_section FROM chunks GROUP BY ticker",
    "l02_orphans": "WITH " + S.CHUNKS + " SELECT count(*) FILTER (parent_id IS NULL) AS without_parent, count(*) FILTER (parent_id IS NOT NULL AND parent_id NOT IN (SELECT chunk_id FROM docs1)) AS orphans, count(*) AS n FROM chunks",
    "io12_upsert_latest": "SELECT user_id, event_type, event_id, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
    "io15_move": "SELECT count(*) FILTER (o_orderkey IN (SELECT l_orderkey FROM lineitem)) AS moved, count(*) FILTER (o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS kept FROM orders",
    "io20_additive": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
}
