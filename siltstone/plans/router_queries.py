"""Queries of the router: its model over the openings of documents, and what becomes of its routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators import router as M
from siltstone.operators import routing as T
from siltstone.operators import sweep
from siltstone.plans import routing_queries, store
from siltstone.plans.store import stage
from siltstone.plans.sweep_sql import upto


def openings(spark, sf_dir):
    """id, text, label, ticker: the first twelve words of each document, and its language; a table, so that the texts are scanned once."""
    return stage(spark, sf_dir, "router-openings", _openings)


def _openings(spark, sf_dir):
    return sweep.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), X.first_words(F.coalesce("text", F.lit("")), 12).alias("text"), F.col("lang").alias("label"), F.col("source").alias("ticker"))


def evaluated(spark, sf_dir):
    """Every seventh document, and all documents of two sources."""
    return openings(spark, sf_dir).where("id % 7 = 0").select("id", F.when(F.col("id") % 70 == 0, F.lit("forum")).alias("ticker"))


def training(spark, sf_dir):
    """id, text, label, fold."""
    return M.dealt(M.held_out(openings(spark, sf_dir), evaluated(spark, sf_dir), "id", "ticker").select("id", "text", "label"), "label")


def terms(spark, sf_dir):
    return stage(spark, sf_dir, "router-terms", lambda s, d: M.vocabulary(stage(s, d, "router-texts", training)))


def featured(spark, sf_dir):
    """Training rows with their features."""
    return stage(spark, sf_dir, "router-rows", lambda s, d: M.vectors(stage(s, d, "router-texts", training), known=terms(s, d)))


def trained(spark, sf_dir):
    """(model, class names)."""
    rows = featured(spark, sf_dir)
    names = M.classes(rows, "label")
    return M.fit(M.numbered(rows, "label", names)), names


def out_of_fold(spark, sf_dir):
    rows = featured(spark, sf_dir)
    p = M.out_of_fold(rows, "label", M.classes(rows, "label")).withColumnRenamed("id", "finder_id")
    two = T.top_two(p).join(rows.select(F.col("id").alias("finder_id"), "label"), "finder_id")
    return T.accuracy(two, "label", "c1")


def held_out(spark, sf_dir):
    model, names = trained(spark, sf_dir)
    mine = openings(spark, sf_dir).join(evaluated(spark, sf_dir).select("id"), "id", "left_semi").where("label IS NOT NULL").select("id", "text", "label")
    mine = store.written(M.vectors(mine, known=terms(spark, sf_dir)), "router-held-out")
    p = M.probabilities(model, mine, names).withColumnRenamed("id", "finder_id")
    return T.accuracy(T.top_two(p).join(mine.select(F.col("id").alias("finder_id"), "label"), "finder_id"), "label", "c1")


def evidence(spark, sf_dir):
    model, names = trained(spark, sf_dir)
    asked = sweep.questions(spark, sf_dir).select(F.col("finder_id").alias("id"), F.col("query").alias("text"))
    return M.evidence(model, asked, None, names, known=terms(spark, sf_dir)).select("id", "class", F.array_join("terms", "|").alias("terms"))


def messages(spark, sf_dir):
    """What the agent is asked about each question that isn't confident."""
    two = T.decide(routing_queries.two(spark, sf_dir), F.lit(0.95), F.lit(0.99)).where("band <> 'confident'").join(sweep.questions(spark, sf_dir).select("finder_id", "route"), "finder_id")
    none = F.array().cast("array<string>")
    first = F.struct(F.col("c1").alias("class"), F.col("p1").alias("p"), F.array("route").alias("terms"))
    second = F.struct(F.col("c2").alias("class"), F.round(F.col("p12") - F.col("p1"), 4).alias("p"), none.alias("terms"))
    found = F.when(F.col("c2").isNotNull(), F.array(first, second)).otherwise(F.array(first))
    return two.join(sweep.questions(spark, sf_dir).select("finder_id", "query"), "finder_id").select("finder_id", T.agent_message(F.col("query"), F.col("band"), F.lit(0.95), F.lit(0.99), found).alias("message"))


def routed(spark, sf_dir):
    """Routes with an agent that takes the second candidate of questions 0, 4, 8 …, abstains for 1, 5, … and is unusable otherwise."""
    two = T.decide(routing_queries.tuned(spark, sf_dir), F.col("tau_hard"), F.col("tau_pair")).withColumn("candidates", F.array_compact(F.array("c1", "c2")))

    def model(candidates):
        k = F.col("finder_id") % 4
        return F.when(k == 0, F.concat(F.lit('{"categories": ["'), F.element_at(candidates, -1), F.lit('"], "reason": "r"}'))).when(k == 1, '{"categories": []}').otherwise("I can't tell")

    rows = T.routed(two, model)
    return rows.select("finder_id", "band", "source", F.array_join("categories", ",").alias("categories"), "alpha")


def oracle_routes(spark, sf_dir):
    rows = routing_queries.subsections(spark, sf_dir)
    route = T.oracle_route(F.concat(F.lit(" "), F.upper("category")))
    return rows.select("p_partkey", F.to_json(route).alias("route"), F.coalesce(T.items_title(F.col("category")), F.lit("")).alias("title"), F.get_json_object(F.to_json(route), "$.alpha").cast("double").alias("alpha"))


def alphas(spark, sf_dir):
    grid = sweep.configs(spark).select("config_key", F.col("alpha").cast("double").alias("section_alpha"))
    rows = T.decide(routing_queries.tuned(spark, sf_dir), F.col("tau_hard"), F.col("tau_pair")).select("finder_id", "categories", F.col("alpha").alias("route_alpha"))
    return rows.join(F.broadcast(grid)).groupBy("config_key").agg(F.sum(T.effective_alpha(F.col("section_alpha"), F.col("route_alpha"), F.col("categories"))).alias("alpha"))  # the grid has 24 rows


def backfilled(spark, sf_dir):
    docs = sweep.read(spark, sf_dir, "documents").select("doc_id", F.lit("old").alias("band"), F.when(F.col("doc_id") % 3 == 0, F.lit("now")).when(F.col("doc_id") % 3 == 1, F.lit("before")).alias("fingerprint"))
    fresh = sweep.read(spark, sf_dir, "labels").select("doc_id", F.lit("new").alias("band"), F.lit("?").alias("fingerprint"))
    done = T.backfilled(docs, fresh, "doc_id", "now")
    return T.guarded(done.select("doc_id"), done, "doc_id").groupBy("band", "fingerprint").agg(F.count("*").alias("n"))


QUERIES = {
    "t02_items": lambda s, d: routing_queries.subsections(s, d).groupBy("category").agg(F.first(F.coalesce(F.array_join(T.canonical_items(T.items_of(F.col("category"))), ","), F.lit(""))).alias("items")),
    "t04_oracle_routes": oracle_routes,
    "t05_tfidf": lambda s, d: M.tfidf(sweep.questions(s, d).select(F.col("finder_id").alias("id"), F.col("query").alias("text"))).select("id", "term", F.round("weight", 6).alias("weight")),
    "t06_out_of_fold": out_of_fold,
    "t09_held_out": held_out,
    "t12_evidence": evidence,
    "t13_messages": messages,
    "t15_routed": routed,
    "t16_backfilled": backfilled,
    "r13_effective_alpha": alphas,
}
_TWO = routing_queries._TWO
SQL = {
    "t02_items": "SELECT category, items FROM (VALUES ('company overview', '1'), ('financials', '7,7a,8'), ('footnotes', '8'), ('governance', '10,11,12,13,14'), ('accounting', '8'), ('shareholder return', '5'), ('risk', '1a'), ('legal', '3'), ('other', '')) v(category, items) WHERE category IN (SELECT ['company overview', 'financials', 'footnotes', 'governance', 'accounting', 'shareholder return', 'risk', 'legal', 'other'][p_partkey % 9 + 1] FROM part)",
    "t04_oracle_routes": """SELECT p_partkey, CASE WHEN k = 'other' THEN '{"categories":[],"alpha":0.0,"band":"oracle","source":"oracle"}' ELSE '{"categories":["' || k || '"],"alpha":1.0,"band":"oracle","source":"oracle"}' END AS route,
 ['Item 1', 'Item 7, 7a, 8', 'Item 8', 'Item 10, 11, 12, 13, 14', 'Item 8', 'Item 5', 'Item 1a', 'Item 3', ''][p_partkey % 9 + 1] AS title, CASE WHEN k = 'other' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS alpha
 FROM (SELECT p_partkey, ['company overview', 'financials', 'footnotes', 'governance', 'accounting', 'shareholder return', 'risk', 'legal', 'other'][p_partkey % 9 + 1] AS k FROM part)""",
    "t05_tfidf": upto("questions") + r""", w AS (SELECT finder_id AS id, regexp_extract_all(lower(query), '\w{2,}') AS w FROM questions),
 t AS (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w),
 tf AS (SELECT id, term, count(*) AS tf FROM t GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2),
 x AS (SELECT id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM questions)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term)) SELECT id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS weight FROM x""",
    "t13_messages": upto("tracks") + _TWO + """ SELECT finder_id, 'Question: ' || query || chr(10) || 'Band: ' || band || ' (alone from 0.95, in pairs from 0.99)' || chr(10) || '- "' || c1 || '" p=' || printf('%.2f', round_even(p1, 2)) || ' because of ' || route
 || CASE WHEN c2 IS NULL THEN '' ELSE chr(10) || '- "' || c2 || '" p=' || printf('%.2f', round_even(round(p12 - p1, 4), 2)) END AS message FROM (SELECT *, CASE WHEN p1 >= 0.95 THEN 'confident' WHEN p12 >= 0.99 THEN 'ambiguous' ELSE 'uncertain' END AS band FROM two) JOIN questions USING (finder_id) WHERE band <> 'confident'""",
    "t15_routed": upto("tracks") + _TWO + """ SELECT finder_id, band, CASE WHEN band = 'confident' THEN 'classifier' WHEN finder_id % 4 < 2 THEN 'llm' ELSE 'fallback' END AS source,
 CASE WHEN band = 'confident' THEN c1 WHEN finder_id % 4 = 0 THEN coalesce(c2, c1) WHEN finder_id % 4 = 1 THEN '' WHEN band = 'ambiguous' THEN concat_ws(',', c1, c2) ELSE '' END AS categories,
 CASE WHEN band = 'confident' OR finder_id % 4 = 0 THEN 1.0::DOUBLE WHEN finder_id % 4 = 1 THEN 0.0::DOUBLE WHEN band = 'ambiguous' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS alpha FROM routed""",
    "t16_backfilled": "SELECT 'old' AS band, 'now' AS fingerprint, count(*) AS n FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT 'new', 'now', count(*) FROM documents WHERE doc_id % 3 <> 0 AND doc_id IN (SELECT doc_id FROM labels)",
    "r13_effective_alpha": upto("tracks") + _TWO + " SELECT config_key, sum(CASE WHEN band = 'uncertain' THEN 0.0 ELSE alpha END)::DOUBLE AS alpha FROM grid, routed GROUP BY config_key",
}
