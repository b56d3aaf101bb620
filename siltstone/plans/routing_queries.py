"""Queries of routing, passage lookup and contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import routing as T
from siltstone.operators import stats, sweep, truth
from siltstone.operators import understanding as U
from siltstone.plans.sweep_sql import salient, upto

HARD, PAIR, SUPPORT = 0.2, 0.3, 5  # the routes of the questions are arbitrary sections: a fourth of them is right by chance


def two(spark, sf_dir):
    lists = sweep.tracks(spark, sf_dir).where("track = 'B' AND source = 'sparse' AND level = 1 AND enhance = 0")
    sections = sweep.chunks(spark, sf_dir).where("level = 1").select("chunk_id", "section")
    return T.top_two(T.class_shares(lists.join(sections, "chunk_id")))


def tuned(spark, sf_dir):
    return T.tune(two(spark, sf_dir).join(sweep.questions(spark, sf_dir).select("finder_id", "route"), "finder_id"), "route", HARD, PAIR, SUPPORT)


def decided(spark, sf_dir):
    rows = T.decide(tuned(spark, sf_dir), F.col("tau_hard"), F.col("tau_pair"))
    return rows.select("finder_id", "c1", "p1", "c2", "p12", "band", F.array_join("categories", ",").alias("categories"), "alpha")


def thresholds(spark, sf_dir):
    rows = T.decide(tuned(spark, sf_dir), F.col("tau_hard"), F.col("tau_pair"))
    text = lambda c: F.when(F.max(c) == float("inf"), "none").otherwise(F.round(F.max(c), 4).cast("string"))
    share = lambda b: F.round(F.avg((F.col("band") == b).cast("int")), 6).alias(f"share_{b}")
    return rows.agg(text("tau_hard").alias("tau_hard"), text("tau_pair").alias("tau_pair"), share("confident"), share("ambiguous"), share("uncertain"))


#: Category that stands for each section, so that one category's items hold another's.
STANDS_FOR = {"en": "financials", "fr": "footnotes", "de": "risk", "es": "legal"}


def section_items(section):
    out = F.lit(None).cast("array<string>")
    for name, category in STANDS_FOR.items():
        out = F.when(section == name, T.canonical_items(T.items_of(F.lit(category)))).otherwise(out)
    return out


def item_report(spark, sf_dir):
    """T8 with coverage of items: shares of the bands and what each covers."""
    truth = sweep.questions(spark, sf_dir).select("finder_id", "route")
    rows = T.tune(two(spark, sf_dir).join(truth, "finder_id"), "route", HARD, PAIR, SUPPORT, items=section_items)
    return T.band_report(T.decide(rows, F.col("tau_hard"), F.col("tau_pair")))


def subsections(spark, sf_dir):
    names = F.array(*[F.lit(c) for c in [*T.CATEGORY_ITEMS, "other"]])
    item = F.concat(F.lit("Part II - Item "), F.col("p_size") % 16, F.when(F.col("p_size") % 3 == 0, "A").when(F.col("p_size") % 3 == 1, " A").otherwise(""), F.lit(". "), "p_name")
    return sweep.read(spark, sf_dir, "part").select("p_partkey", item.alias("subsection"), F.get(names, (F.col("p_partkey") % 9).cast("int")).alias("category"))


def replies(spark, sf_dir):
    """Router replies about conversation turns, in the forms in which models answer."""
    forms = F.array(*[F.lit(x) for x in (
        'Sure. {"categories": ["c2", "c1"], "reason": "both"}', '{"categories": [" C0 "], "reason": "cut of', '{"categories": ["c9"], "reason": "outside"}',
        "no object at all", '{"categories": [], "reason": "abstain"}', '{"note": "x"} then {"categories": ["c1", "c1"]}')])
    return sweep.read(spark, sf_dir, "conversations").select("conv_id", "turn", F.get(forms, ((F.col("conv_id") + F.col("turn")) % 6).cast("int")).alias("reply"))


def lookup(spark, sf_dir):
    """Every passage among all lines, by openings, by numbers, and where both find nothing by like text."""
    return truth.truth_lookup(sweep.questions(spark, sf_dir), sweep.chunks(spark, sf_dir).where("level = 2"))


def places(spark, sf_dir):
    """Lines that whole documents hold, by their openings and by shared numbers: each document is a passage, each line a chunk."""
    corpus = sweep.chunks(spark, sf_dir)
    return truth.truth_chunks(corpus.where("level = 1").select(F.col("doc_id").alias("finder_id"), F.col("text").alias("truth")), corpus.where("level = 2"))


def aligned(spark, sf_dir):
    """Passages stand inside of lines, so that openings find few: chunks that some config found with a relevance of 0.9 count as well (a pool)."""
    found = truth.truth_chunks(sweep.questions(spark, sf_dir), sweep.chunks(spark, sf_dir).where("level = 1"))
    pool = sweep.relevance(spark, sf_dir).where(F.greatest("word", "num") >= 0.9).select("finder_id", "chunk_id")
    return truth.alignment(sweep.results(spark, sf_dir), sweep.questions(spark, sf_dir), found.unionByName(pool).distinct())


def prompts(spark, sf_dir):
    found = truth.contexts(sweep.results(spark, sf_dir), sweep.chunks(spark, sf_dir).where("level = 1").select("chunk_id", "ticker", "fiscal_year_end", "text"))
    return found.select("finder_id", "retrieved_ids", "n_sources", F.md5("context").alias("context_md5"), F.array_join(truth.sources_of(F.col("context")), ",").alias("sources"))


QUERIES = {
    "t03_category_items": lambda s, d: subsections(s, d).select("p_partkey", F.array_join(U.item_numbers(F.col("subsection")), ",").alias("items"), T.in_category(F.col("subsection"), F.col("category")).alias("hit")),
    "t08_thresholds": thresholds,
    "t08_items": item_report,
    "t10_fingerprints": lambda s, d: sweep.read(s, d, "documents").groupBy("source").agg(T.fingerprint(F.col("doc_id")).alias("fingerprint")),
    "t11_routes": decided,
    "t14_replies": lambda s, d: replies(s, d).select("conv_id", "turn", F.coalesce(F.array_join(T.chosen_categories(F.col("reply"), F.array(F.lit("c0"), F.lit("c1"), F.lit("c2"))), ","), F.lit("unusable")).alias("chosen")),
    "x24_accuracy": lambda s, d: T.accuracy(two(s, d).join(sweep.questions(s, d).select("finder_id", "route"), "finder_id"), "route", "c1"),
    "x14_separation": lambda s, d: stats.wilcoxon(stats.against_top(sweep.runs(s, d)), ["config_key"]),
    "m17_features": lambda s, d: sweep.runs(s, d).select("finder_id", "config_key", F.size(F.split(F.trim("query"), r"\s+")).alias("query_length"), (F.size(U.explicit_years(F.col("query"))) > 1).alias("year_is_multi")),
    "u01_keywords": lambda s, d: sweep.read(s, d, "documents").where(F.coalesce(F.col("text").rlike(r"(?i)(?:^|[^a-z0-9])(?:license|copyright|email)(?:[^a-z0-9]|$)"), F.lit(False))).select("doc_id"),
    "m12_truth_chunks": places,
    "m12_truth_lookup": lookup,
    "m14_truth_alignment": aligned,
    "g05_contexts": prompts,
}
_TWO = """, shares AS (SELECT finder_id, section AS class, round(v / sum(v) OVER (PARTITION BY finder_id), 4) AS p FROM
 (SELECT finder_id, c.section, sum(1.0::DOUBLE / (rank + 1)) AS v FROM tracks t JOIN chunks c USING (chunk_id) WHERE track = 'B' AND source = 'sparse' AND t.level = 1 AND enhance = 0 GROUP BY ALL)),
two AS (SELECT finder_id, max(CASE WHEN k = 1 THEN class END) AS c1, max(CASE WHEN k = 1 THEN p END) AS p1, max(CASE WHEN k = 2 THEN class END) AS c2, round(sum(p), 4) AS p12
 FROM (SELECT *, row_number() OVER (PARTITION BY finder_id ORDER BY p DESC, class) AS k FROM shares) WHERE k <= 2 GROUP BY finder_id),
cov AS (SELECT two.*, route = c1 AS cover1, coalesce(route = c1 OR route = c2, false) AS cover2 FROM two JOIN questions USING (finder_id)),
h AS (SELECT coalesce(min(a.p1), 'inf'::DOUBLE) AS tau_hard FROM cov a WHERE (SELECT count(*) FILTER (b.cover1) >= 0.2 * count(*) AND count(*) >= 5 FROM cov b WHERE b.p1 >= a.p1)),
rest AS (SELECT cov.* FROM cov, h WHERE p1 < tau_hard),
q AS (SELECT coalesce(min(a.p12), 'inf'::DOUBLE) AS tau_pair FROM rest a WHERE (SELECT count(*) FILTER (b.cover2) >= 0.3 * count(*) AND count(*) >= 5 FROM rest b WHERE b.p12 >= a.p12)),
routed AS (SELECT cov.*, tau_hard, tau_pair, CASE WHEN p1 >= tau_hard THEN 'confident' WHEN p12 >= tau_pair THEN 'ambiguous' ELSE 'uncertain' END AS band FROM cov, h, q)"""


def _places(chunks: str, passages: str) -> str:
    """Oracle of the lookup: CTE ``places`` from tables (chunk_id, text) and (finder_id, truth)."""
    return rf""", norm AS (SELECT chunk_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS t, {salient('text')} AS nums FROM {chunks}),
asked AS (SELECT finder_id, lower(trim(regexp_replace(truth, '\s+', ' ', 'g'))) AS t, {salient('truth')} AS nums FROM {passages}),
pre AS (SELECT finder_id, k, min(chunk_id) AS chunk_id FROM (VALUES (200), (100), (50)) l(k), asked a JOIN norm n ON n.t <> '' AND a.t <> '' AND substr(n.t, 1, 50) = substr(a.t, 1, 50) WHERE substr(n.t, 1, k) = substr(a.t, 1, k) GROUP BY finder_id, k),
places AS (SELECT finder_id, max_by(chunk_id, k) AS chunk_id FROM pre GROUP BY finder_id
 UNION SELECT finder_id, chunk_id FROM (SELECT * FROM asked WHERE len(nums) > 0) a, (SELECT * FROM norm WHERE len(nums) >= 4) n WHERE len(list_intersect(n.nums, a.nums)) / len(n.nums)::DOUBLE >= 0.85)"""


_CATEGORY = " ".join(f"WHEN {n} THEN " + " OR ".join("(" + " AND ".join(f"list_contains(w, '{x}')" for x in f"item {i}".split()) + ")" for i in items) for n, items in enumerate(T.CATEGORY_ITEMS.values()))
_ITEMS = "CASE {c} WHEN 'en' THEN ['7', '7a', '8'] WHEN 'fr' THEN ['8'] WHEN 'de' THEN ['1a'] WHEN 'es' THEN ['3'] ELSE [] END"
_OWN, _ONE, _OTHER = (_ITEMS.format(c=c) for c in ("route", "c1", "c2"))
_TWO_ITEMS = _TWO.replace("route = c1 AS cover1, coalesce(route = c1 OR route = c2, false) AS cover2", f"len({_OWN}) > 0 AND len(list_intersect({_OWN}, {_ONE})) = len({_OWN}) AS cover1, len({_OWN}) > 0 AND len(list_intersect({_OWN}, list_concat({_ONE}, {_OTHER}))) = len({_OWN}) AS cover2")
SQL = {
    "t08_items": upto("tracks") + _TWO_ITEMS + """ SELECT round(avg((band = 'confident')::INT), 6) AS share_confident, round(avg((band = 'ambiguous')::INT), 6) AS share_ambiguous, round(avg((band = 'uncertain')::INT), 6) AS share_uncertain,
 round(avg(cover1::INT) FILTER (band = 'confident'), 6) AS cover_confident, round(avg(cover2::INT) FILTER (band = 'ambiguous'), 6) AS cover_ambiguous, round(avg(cover1::INT) FILTER (band = 'uncertain'), 6) AS uncertain_top1_cover, round(avg(cover2::INT) FILTER (band = 'uncertain'), 6) AS uncertain_top2_cover FROM routed""",
    "t03_category_items": rf"""WITH s AS (SELECT p_partkey, lower('Part II - Item ' || (p_size % 16) || CASE p_size % 3 WHEN 0 THEN 'A' WHEN 1 THEN ' A' ELSE '' END || '. ' || p_name) AS t FROM part),
 t AS (SELECT *, string_split_regex(t, '[^a-z0-9]+') AS w FROM s) SELECT p_partkey, array_to_string(regexp_extract_all(t, '\bitem\s+(\d+[a-z]*)', 1), ',') AS items, CASE p_partkey % 9 {_CATEGORY} END AS hit FROM t""",
    "t08_thresholds": upto("tracks") + _TWO + """ SELECT CASE WHEN isinf(max(tau_hard)) THEN 'none' ELSE round(max(tau_hard), 4)::VARCHAR END AS tau_hard, CASE WHEN isinf(max(tau_pair)) THEN 'none' ELSE round(max(tau_pair), 4)::VARCHAR END AS tau_pair,
 round(avg((band = 'confident')::INT), 6) AS share_confident, round(avg((band = 'ambiguous')::INT), 6) AS share_ambiguous, round(avg((band = 'uncertain')::INT), 6) AS share_uncertain FROM routed""",
    "t10_fingerprints": "SELECT source, substr(sha1(count(doc_id) || '|' || sum(('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT)::VARCHAR || '|' || sum(('0x' || substr(md5(doc_id::VARCHAR), 9, 8))::BIGINT)::VARCHAR), 1, 12) AS fingerprint FROM documents GROUP BY source",
    "t11_routes": upto("tracks") + _TWO + " SELECT finder_id, c1, p1, c2, p12, band, CASE band WHEN 'confident' THEN c1 WHEN 'ambiguous' THEN concat_ws(',', c1, c2) ELSE '' END AS categories, CASE band WHEN 'uncertain' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS alpha FROM routed",
    "t14_replies": "SELECT conv_id, turn, ['c1,c2', 'c0', 'unusable', 'unusable', '', 'c1'][(conv_id + turn) % 6 + 1] AS chosen FROM conversations",
    "x24_accuracy": upto("tracks") + _TWO + """, e AS (SELECT route, c1, route = c1 AS ok FROM cov JOIN questions USING (finder_id)), k AS (SELECT route AS class FROM e UNION SELECT c1 FROM e)
 SELECT (SELECT count(*) FROM e) AS n, (SELECT round(avg(ok::INT), 6) FROM e) AS accuracy, round(avg((SELECT 2.0::DOUBLE * count(*) FILTER (ok AND route = class) / (count(*) FILTER (route = class) + count(*) FILTER (c1 = class)) FROM e)), 6) AS macro_f1 FROM k""",
    "x14_separation": upto("runs") + """, best AS (SELECT config_key FROM runs GROUP BY config_key ORDER BY round(avg(word_recall), 9) DESC, config_key LIMIT 1),
 d AS (SELECT r.config_key, round(t.word_recall - r.word_recall, 6) AS d FROM runs r JOIN runs t USING (finder_id) WHERE t.config_key = (SELECT config_key FROM best) AND r.config_key <> (SELECT config_key FROM best)),
 k AS (SELECT config_key, d, count(*) OVER (PARTITION BY config_key, abs(d)) AS t, rank() OVER (PARTITION BY config_key ORDER BY abs(d)) AS r0 FROM d WHERE d <> 0),
 w AS (SELECT config_key, count(*) AS n, sum(CASE WHEN d > 0 THEN r0 + (t - 1) / 2.0::DOUBLE ELSE 0 END)::DOUBLE AS w_plus, sum(CASE WHEN d < 0 THEN r0 + (t - 1) / 2.0::DOUBLE ELSE 0 END)::DOUBLE AS w_minus, sum(t * t - 1) AS ties FROM k GROUP BY config_key)
 SELECT config_key, n, w_plus, w_minus, round((w_plus - n * (n + 1) / 4) / nullif(sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 0), 6) AS z FROM w""",
    "m17_features": upto("runs") + r" SELECT finder_id, config_key, len(string_split_regex(trim(query), '\s+'))::INT AS query_length, len(list_distinct(regexp_extract_all(query, '\b20[12][0-9]\b'))) > 1 AS year_is_multi FROM runs",
    "u01_keywords": "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(?:^|[^a-z0-9])(?:license|copyright|email)(?:[^a-z0-9]|$)')",
    "m12_truth_chunks": upto("chunks") + _places("(SELECT * FROM chunks WHERE level = 2)", "(SELECT doc_id AS finder_id, text AS truth FROM docs1)") + " SELECT * FROM places",
    "m14_truth_alignment": upto("runs") + _places("docs1", "questions") + """, pool AS (SELECT * FROM places UNION SELECT finder_id, chunk_id FROM relevance WHERE greatest(word, num) >= 0.9), c AS (SELECT q.finder_id, count(p.chunk_id) AS n_truth FROM questions q LEFT JOIN pool p USING (finder_id) GROUP BY ALL),
 r AS (SELECT finder_id, config_key, count(p.chunk_id) AS n_found, min(CASE WHEN p.chunk_id IS NOT NULL THEN rank + 1 END)::INT AS best_rank FROM results s LEFT JOIN pool p USING (finder_id, chunk_id) GROUP BY ALL)
 SELECT finder_id, config_key, n_truth, n_found, best_rank, CASE WHEN n_truth = 0 THEN 'TRUTH_NOT_IN_CORPUS' WHEN n_found = 0 THEN 'TRUTH_NOT_RETRIEVED' ELSE '-' END AS flag FROM r JOIN c USING (finder_id)""",
    "g05_contexts": upto("results") + """, l AS (SELECT DISTINCT finder_id, string_agg(chunk_id, '|' ORDER BY rank) AS retrieved_ids FROM results GROUP BY finder_id, config_key),
 u AS (SELECT finder_id, retrieved_ids, unnest(string_split(retrieved_ids, '|')) AS chunk_id, generate_subscripts(string_split(retrieved_ids, '|'), 1) AS pos FROM l)
 SELECT finder_id, retrieved_ids, count(*)::INT AS n_sources, md5(string_agg('--- Source ' || pos || ' (Ticker: ' || upper(ticker) || ', Year: ' || year(fiscal_year_end) || ') ---' || chr(10) || text, chr(10) || chr(10) ORDER BY pos)) AS context_md5,
 string_agg(lower(ticker) || ':' || year(fiscal_year_end), ',' ORDER BY pos) AS sources FROM u JOIN docs1 USING (chunk_id) GROUP BY finder_id, retrieved_ids""",
}
