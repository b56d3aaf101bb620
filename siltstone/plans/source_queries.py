"""Queries of files in and out: each writes what it reads to the shared folder first, from the supplied tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from siltstone.operators import filings, grid
from siltstone.operators import retrieval as R
from siltstone.operators import sweep
from siltstone.plans import question_queries, sweep_sql
from siltstone.plans.store import shared
from siltstone.sources import files


def fresh(spark, name):
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


def encodings(spark, sf_dir):
    """Pages as bytes, every other one in the Windows code page."""
    html = F.regexp_replace(F.coalesce("html", F.lit("")), r"[^\x00-\x7F\xA0-\xFF]", "?")
    content = F.when(F.col("page_id") % 2 == 0, F.encode(html, "UTF-8")).otherwise(F.encode(html, "ISO-8859-1"))
    return sweep.read(spark, sf_dir, "pages").select("page_id", F.md5(files.decoded(content)).alias("md5"))


def whole_texts(spark, sf_dir):
    path = fresh(spark, "texts")
    sweep.read(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("none")).alias("lang"), F.translate(F.coalesce("text", F.lit("")), "\r\n", "  ").alias("value")).write.partitionBy("lang").text(path)
    rows = files.markdown_files(spark, path)
    lang = F.regexp_extract("path", "lang=([^/]*)/", 1)
    return rows.groupBy(lang.alias("lang")).agg(F.sum(F.size(F.split(F.rtrim(F.regexp_replace("md", r"\n\z", "")), "\n"))).alias("n_lines"))


def csv_reference(spark, sf_dir):
    path = fresh(spark, "companies")
    question_queries.companies(spark, sf_dir).select(F.col("symbol").alias("Symbol"), F.col("shortname").alias("Shortname"), F.concat(F.lit('"A, B" '), "longname").alias("Longname")).write.csv(path, header=True, quote='"', escape='"')
    return files.reference(spark, path, {"Symbol": "symbol", "Shortname": "shortname", "Longname": "longname"})


def tagged(spark, sf_dir):
    path = fresh(spark, "runs")
    sweep.read(spark, sf_dir, "events").write.partitionBy("event_type").parquet(path)
    return files.tagged(spark, path).groupBy(F.regexp_replace("source_file", "event_type=", "").alias("source_file")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


def column_json(spark, sf_dir):
    o = sweep.read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_partkey", "l_suppkey", "l_quantity"))).alias("l"))
    column = lambda f: F.map_from_entries(F.transform("l", lambda s, i: F.struct(i.cast("string").alias("key"), s[f].cast("long").cast("string").alias("value"))))
    text = o.select("l_orderkey", F.to_json(F.map_from_arrays(F.array(F.lit("part"), F.lit("quantity")), F.array(column("l_partkey"), column("l_quantity")))).alias("json"))
    return files.from_columns(text, "l_orderkey", ["part", "quantity", "none"])


def json_lines(spark, sf_dir):
    path = fresh(spark, "lines")
    sweep.read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("Firm "), "o_orderpriority").alias("company"), F.concat(F.lit("REPORT_"), F.year("o_orderdate")).alias("doc_name")).write.json(path)
    return files.matching_lines(spark.read.schema("o_orderkey bigint, company string, doc_name string").json(path), "urgent", "report_1997").select("o_orderkey")


def scan(spark, sf_dir):
    corpus = sweep.chunks(spark, sf_dir)
    found = corpus.where(R.predicate(must={"level": 1, "year": ["2022", "2024", "soon"], "ticker": None}, must_not={"section": "en"}, should={"section": ["fr", "de"], "doc_id": [1, 2, 3]}))
    return found.select("chunk_id", "ticker", "section")


def by_level(spark, sf_dir):
    path = fresh(spark, "levels")
    rows = grid.corpus(spark, sf_dir).drop("year")
    files.write_levels(rows, path)
    files.write_levels(rows, None)
    rows = spark.read.parquet(path)
    return rows.groupBy("level").agg(F.count("*").alias("n"), F.max((F.col("level") == 3).cast("int")).alias("enriched"))


def additive(spark, sf_dir):
    path = fresh(spark, "additive")
    docs = sweep.read(spark, sf_dir, "documents")
    files.append_new(sweep.read(spark, sf_dir, "labels").select("doc_id", F.lit("label").alias("kind")), path, ["doc_id"])
    for _ in range(2):
        files.append_new(docs.select("doc_id", F.lit("document").alias("kind")), path, ["doc_id"])
    return spark.read.parquet(path).groupBy("kind").agg(F.count("*").alias("n"))


def moved(spark, sf_dir):
    o = sweep.read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    ids = o.where("o_orderkey % 3 = 0").select("o_orderkey").union(spark.sql("SELECT -1L"))
    source, there, report = files.move(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), ids, "o_orderkey", f"moved-{uuid.uuid4().hex}")
    counts = lambda df, name: df.select(F.lit(name).alias("state"), F.col("o_orderkey"))
    return report.select("state", "o_orderkey").unionByName(counts(source, "source")).unionByName(counts(there, "destination")).groupBy("state").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("total"))


def lookups(spark, sf_dir):
    docs, lab = sweep.read(spark, sf_dir, "documents").select("doc_id"), sweep.read(spark, sf_dir, "labels").select("doc_id").union(spark.sql("SELECT -5L"))
    parts = [("found", files.lookup(docs, lab, "doc_id")), ("left", files.delete(docs, lab, "doc_id")), ("missing", files.missing(docs, lab, "doc_id"))]
    out = None
    for name, df in parts:
        rows = df.agg(F.lit(name).alias("state"), F.count("*").alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out


def ids(spark, sf_dir):
    rows = sweep.read(spark, sf_dir, "documents").select("doc_id", "source", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("own-"), "doc_id")).alias("id"))
    return files.with_provenance(files.with_ids(rows, ["source", "doc_id"]), "0123456789abcdef", False).select("doc_id", "id", "code_commit", "code_dirty")


def trimmed(spark, sf_dir):
    """What a download leaves behind the end of a page goes."""
    html = F.concat(F.coalesce("html", F.lit("")), F.when(F.col("page_id") % 2 == 0, "\n<!-- served -->\n</HTML> more").otherwise(""))
    return sweep.read(spark, sf_dir, "pages").select("page_id", F.length(files.trimmed_html(html)).cast("long").alias("n"))


def titled_postings(spark, sf_dir):
    """Sparse index of titles and texts: terms and tokens of each document."""
    rows = sweep.chunks(spark, sf_dir).where("level = 1").select("chunk_id", F.concat(filings.title("ticker", "section"), F.lit(" | text: "), F.lower("text")).alias("text"))
    return R.postings(rows).groupBy("chunk_id").agg(F.count("*").alias("n_terms"), F.sum("tf").alias("n_tokens"))


def orchestrated(spark, sf_dir):
    """One job for all levels: each level's dense and sparse rows, the enriched flag only for level 3."""
    path = fresh(spark, "orchestrated")
    rows = grid.corpus(spark, sf_dir)
    kinds = F.explode(F.array(F.lit("dense"), F.lit("sparse")))
    files.write_levels(rows.select("chunk_id", "level", kinds.alias("kind"), (F.col("level") == 3).alias("enriched")), path)
    return spark.read.parquet(path).groupBy("level", "kind", "enriched").agg(F.count("*").alias("n"))


def called(spark, sf_dir):
    """Replies to conversation turns by a function that fails for short ones."""

    def call(text):
        if len(text) < 40:
            raise ValueError("too short")
        return str(len(text))

    rows = sweep.read(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    return files.batch_call(rows, "text", call).select("conv_id", "turn", "reply")


def created(spark, sf_dir):
    """The table is made once; the second call finds what has been written meanwhile."""
    path = fresh(spark, "created")
    schema = "chunk_id string, level int"
    before = files.create_levels(spark, path, schema).count()
    sweep.chunks(spark, sf_dir).select("chunk_id", "level").write.mode("append").parquet(path)
    return files.create_levels(spark, path, schema).groupBy("level").agg(F.count("*").alias("n")).withColumn("before", F.lit(before).cast("long"))


SHEETS = ("a02_config_summary", "a03_category_breakdown", "a04_failure_analysis", "a05_correlations", "a06_dimension_summary", "a07_baseline_delta", "a11_sections", "a12_section_shift", "a13_overlapping_context", "a14_console_summary")


def report(spark, sf_dir):
    """Rows of each of a report's ten sheets, read back from where they were written."""
    from siltstone.plans import table_queries

    places = files.write_sheets({name: table_queries.QUERIES[name](spark, sf_dir) for name in SHEETS}, fresh(spark, "report"))
    out = None
    for name, path in places.items():
        rows = spark.read.parquet(path).agg(F.lit(name).alias("sheet"), F.count("*").alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _report_sql() -> str:
    from siltstone.plans import table_queries

    head = table_queries.PREFIX
    bodies = {name: table_queries.SQL[name][len(head) :] for name in SHEETS}
    return head + " " + " UNION ALL ".join(f"SELECT '{name}' AS sheet, count(*) AS n FROM ({body.strip().removeprefix(',')})" for name, body in bodies.items())


QUERIES = {
    "io01_encodings": encodings,
    "io02_whole_texts": whole_texts,
    "io03_trimmed": trimmed,
    "io13_titled_postings": titled_postings,
    "io17_orchestrated": orchestrated,
    "io04_renamed": lambda s, d: files.renamed(sweep.read(s, d, "benchmark"), {"item_id": "finder_id", "text": "query", "references": "truth_ref"}),
    "io05_reference": csv_reference,
    "io06_tagged": tagged,
    "io07_column_json": column_json,
    "io08_json_lines": json_lines,
    "io10_scan": scan,
    "io11_lookups": lookups,
    "io15_move_verified": moved,
    "io16_created": created,
    "io18_levels": by_level,
    "io26_batch_calls": called,
    "io28_batches": lambda s, d: files.batched(sweep.read(s, d, "events").select("event_id"), 100).groupBy("batch").agg(F.count("*").alias("size")).agg(F.sum("size").alias("n"), F.max("size").alias("largest")),
    "io20_append_new": additive,
    "io21_report_sheets": report,
    "io30_ids": ids,
    "l05_contains": lambda s, d: sweep.read(s, d, "documents").where(F.lower("text").contains("license")).select("doc_id"),
}
_LATIN = r"regexp_replace(coalesce(html, ''), '[^\x00-\x7F\x{A0}-\x{FF}]', '?', 'g')"
SQL = {
    "io01_encodings": f"SELECT page_id, md5({_LATIN}) AS md5 FROM pages",
    "io02_whole_texts": "SELECT coalesce(lang, 'none') AS lang, count(*) AS n_lines FROM documents GROUP BY 1",
    "io03_trimmed": "SELECT page_id, CASE WHEN strpos(lower(h), '</html>') > 0 THEN strpos(lower(h), '</html>') + 6 ELSE length(h) END AS n FROM (SELECT page_id, coalesce(html, '') || CASE WHEN page_id % 2 = 0 THEN chr(10) || '<!-- served -->' || chr(10) || '</HTML> more' ELSE '' END AS h FROM pages)",
    "io13_titled_postings": "WITH " + sweep_sql.CHUNKS + f", w AS (SELECT chunk_id, unnest({sweep_sql.tokens("'title: ' || concat_ws(', ', 'ticker: ' || nullif(ticker, ''), 'section: ' || nullif(section, '')) || ' | text: ' || text")}) AS term FROM docs1) SELECT chunk_id, count(DISTINCT term) AS n_terms, count(*) AS n_tokens FROM w GROUP BY chunk_id",
    "io17_orchestrated": "WITH " + sweep_sql.CHUNKS + " SELECT level, kind, level = 3 AS enriched, count(*) AS n FROM (SELECT level FROM chunks UNION ALL SELECT 3 FROM chunks WHERE level = 2), (VALUES ('dense'), ('sparse')) v(kind) GROUP BY level, kind",
    "io04_renamed": "SELECT item_id AS finder_id, text AS query FROM benchmark",
    "io05_reference": f"""SELECT sym AS symbol, name || ' Inc.' AS shortname, '"A, B" ' || name || ' Kor' || lower(sym) || ' Holdings Company (The)' AS longname
        FROM (SELECT {question_queries._SYM} AS sym, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS name FROM part)""",
    "io06_tagged": "SELECT event_type AS source_file, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1",
    "io07_column_json": "SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_quantity) - 1)::INT AS ord, l_partkey::VARCHAR AS part, l_quantity::BIGINT::VARCHAR AS quantity, NULL::VARCHAR AS none FROM lineitem",
    "io08_json_lines": "SELECT o_orderkey FROM orders WHERE o_orderpriority ILIKE '%urgent%' AND year(o_orderdate) = 1997",
    "io10_scan": "WITH " + sweep_sql.CHUNKS + " SELECT chunk_id, ticker, section FROM chunks WHERE level = 1 AND year(fiscal_year_end) IN (2022, 2024) AND section <> 'en' AND (section IN ('fr', 'de') OR doc_id IN (1, 2, 3))",
    "io11_lookups": "SELECT 'found' AS state, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT 'left', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'missing', count(DISTINCT doc_id) + 1 FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)",
    "io15_move_verified": """SELECT 'moved' AS state, count(*) AS n, sum(o_orderkey)::BIGINT AS total FROM orders WHERE o_orderkey % 6 = 0 UNION ALL SELECT 'missing', count(*) + 1, sum(o_orderkey)::BIGINT - 1 FROM orders WHERE o_orderkey % 6 = 3
        UNION ALL SELECT 'source', count(*), sum(o_orderkey)::BIGINT FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 UNION ALL SELECT 'destination', count(*), sum(o_orderkey)::BIGINT FROM orders WHERE o_orderkey % 2 = 1 OR o_orderkey % 3 = 0""",
    "io18_levels": "WITH " + sweep_sql.CHUNKS + " SELECT level, count(*) AS n, (level = 3)::INT AS enriched FROM (SELECT level FROM chunks UNION ALL SELECT 3 FROM chunks WHERE level = 2) GROUP BY level",
    "io16_created": "WITH " + sweep_sql.CHUNKS + " SELECT level, count(*) AS n, 0 AS before FROM chunks GROUP BY level",
    "io26_batch_calls": "SELECT conv_id, turn, CASE WHEN length(coalesce(text, '')) < 40 THEN '' ELSE length(text)::VARCHAR END AS reply FROM conversations",
    "io28_batches": "SELECT count(*) AS n, least(count(*), 100) AS largest FROM events",
    "io20_append_new": "SELECT 'label' AS kind, count(DISTINCT doc_id) AS n FROM labels UNION ALL SELECT 'document', count(DISTINCT doc_id) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "io21_report_sheets": _report_sql(),
    "io30_ids": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'own-' || doc_id ELSE sha1(coalesce(source, '') || '/' || doc_id) END AS id, '01234567' AS code_commit, false AS code_dirty FROM documents",
    "l05_contains": "SELECT doc_id FROM documents WHERE contains(lower(text), 'license')",
}
