"""The sweep in DuckDB SQL, for oracles: common table expressions that build on each other."""

from __future__ import annotations

import re

from siltstone.functions.text import STOPWORDS

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def words(t: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower(coalesce({t}, '')), '[a-z][a-z\\-]{{2,}}')), lambda x: x NOT IN ({_STOP}))"


def numbers(t: str) -> str:
    return rf"list_distinct(list_transform(regexp_extract_all(coalesce({t}, ''), '-?\d[\d,]*(?:\.\d+)?'), lambda x: trim(x, ',')))"


def salient(t: str) -> str:
    return rf"list_filter({numbers(t)}, lambda x: NOT regexp_matches(x, '^(?:19|20)\d{{2}}$'))"


def share(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / len({a})::DOUBLE END"


def tokens(t: str) -> str:
    return rf"regexp_extract_all(lower(coalesce({t}, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


CHUNKS = r"""
docs1 AS (SELECT printf('d%08d', doc_id) AS chunk_id, 1 AS level, doc_id, NULL::VARCHAR AS parent_id, coalesce(source, '') AS ticker, coalesce(lang, '') AS section,
           make_date((2020 + doc_id % 5)::BIGINT, 12, 31) AS fiscal_year_end, coalesce(text, '') AS text FROM documents),
lines AS (SELECT d.*, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM docs1 d),
chunks AS (SELECT * FROM docs1 UNION ALL SELECT chunk_id || '/' || printf('%06d', pos), 2, doc_id, chunk_id, ticker, section, fiscal_year_end, line FROM lines WHERE trim(line) <> '')"""
QUESTIONS = r"""
questions AS (SELECT item_id AS finder_id, array_to_string(string_split(coalesce(text, ''), ' ')[1:12], ' ') AS query, array_to_string(string_split(coalesce(text, ''), ' ')[1:24], ' ') AS enhanced,
           coalesce(text, '') AS truth, 'c' || (item_id % 4) AS category, ['en', 'fr', 'de', 'es'][item_id % 4 + 1] AS route, ['FY2024', '2022-2023', ''][item_id % 3 + 1] AS period FROM benchmark)"""
GRID = r"""
grid AS (SELECT level, mode, enhance, alpha, 'L' || level || '_' || upper(mode) || '_' || CASE WHEN enhance = 1 THEN 'ENH' ELSE 'PLAIN' END || '_A' || alpha AS config_key,
         max(CASE WHEN mode = 'hybrid' THEN 15 ELSE 5 END) OVER (PARTITION BY enhance, level) AS prefetch
         FROM (VALUES (1), (2)) l(level), (VALUES ('dense'), ('sparse'), ('hybrid')) m(mode), (VALUES (0), (1)) e(enhance), (VALUES (0), (1)) a(alpha))"""
SPARSE = rf"""
texts AS (SELECT finder_id, route, 0 AS enhance, query AS text FROM questions UNION ALL SELECT finder_id, route, 1, enhanced FROM questions),
lists AS (SELECT chunk_id, level, section, {tokens('text')} AS w FROM chunks),
tok AS (SELECT chunk_id, level, section, len(w) AS dl, unnest(w) AS term FROM lists),
tf AS (SELECT chunk_id, level, section, dl, term, count(*) AS tf FROM tok GROUP BY ALL),
lens AS (SELECT level, count(*)::DOUBLE AS n, avg(len(w))::DOUBLE AS avgdl FROM lists GROUP BY level),
qterms AS (SELECT finder_id, enhance, route, unnest(list_distinct({tokens('text')})) AS term FROM texts),
idf AS (SELECT level, term, ln((n - df + 0.5) / (df + 0.5) + 1.0) AS idf, avgdl FROM (SELECT level, term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM qterms) GROUP BY ALL) JOIN lens USING (level)),
sparse AS (SELECT finder_id, enhance, route, tf.level, 'sparse' AS source, chunk_id, section, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
           FROM qterms JOIN tf USING (term) JOIN idf ON idf.term = tf.term AND idf.level = tf.level GROUP BY ALL)"""
DENSE = r"""
vec AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
near AS (SELECT q.finder_id, c.chunk_id, c.doc_id, c.section, round(list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))), 5) AS score
         FROM questions q JOIN vec a ON a.doc_id = q.finder_id, docs1 c JOIN vec b ON b.doc_id = c.doc_id),
dense AS (SELECT t.finder_id, t.enhance, t.route, c.level, 'dense' AS source, c.chunk_id, n.section, n.score
          FROM texts t JOIN near n ON n.finder_id = t.finder_id JOIN chunks c ON c.doc_id = n.doc_id)"""
TRACKS = r"""
every AS (SELECT * FROM sparse UNION ALL BY NAME SELECT * FROM dense),
depth AS (SELECT enhance, level, max(prefetch) AS k FROM grid GROUP BY ALL),
tb AS (SELECT *, row_number() OVER (PARTITION BY finder_id, enhance, level, source ORDER BY score DESC, chunk_id) - 1 AS rank FROM every),
ta AS (SELECT *, row_number() OVER (PARTITION BY finder_id, enhance, level, source ORDER BY score DESC, chunk_id) - 1 AS rank FROM every WHERE section = route),
tracks AS (SELECT finder_id, enhance, level, 'B' AS track, source, chunk_id, rank, score FROM tb JOIN depth USING (enhance, level) WHERE rank < least(k, 15)
           UNION ALL SELECT finder_id, enhance, level, 'A', source, chunk_id, rank, score FROM ta JOIN depth USING (enhance, level) WHERE rank < least(greatest(k // 2, 5), 15))"""


def fused(name: str, parts: list[tuple[str, float]], k: int, keys: str = "finder_id, enhance, level") -> str:
    union = " UNION ALL ".join(f"SELECT {keys}, chunk_id, {w} / (60 + rank + 1) AS s, {n} AS l, rank FROM ({src})" for n, (src, w) in enumerate(parts))
    return f"""
{name}_u AS ({union}),
{name}_s AS (SELECT {keys}, chunk_id, round(sum(s), 9) AS score, min(l * 1000 + rank) AS seen FROM {name}_u GROUP BY ALL),
{name} AS (SELECT * FROM (SELECT {keys}, chunk_id, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, seen, chunk_id) - 1 AS rank, score FROM {name}_s) WHERE rank < {k})"""


def _track(track: str, source: str) -> str:
    return f"SELECT * FROM tracks WHERE track = '{track}' AND source = '{source}'"


RESULTS = ",".join([
    fused("hb", [(_track("B", "dense"), 1.0), (_track("B", "sparse"), 1.0)], 15),
    fused("ha", [(_track("A", "dense"), 1.0), (_track("A", "sparse"), 1.0)], 15),
    fused("f_dense", [(_track("A", "dense"), 1.0), (_track("B", "dense"), 0.0)], 5),
    fused("f_sparse", [(_track("A", "sparse"), 1.0), (_track("B", "sparse"), 0.0)], 5),
    fused("f_hybrid", [("SELECT * FROM ha", 1.0), ("SELECT * FROM hb", 0.0)], 5),
]) + rf""",
final AS (
  SELECT finder_id, enhance, level, chunk_id, rank, score, 'dense' AS mode, 0 AS alpha FROM ({_track("B", "dense")}) WHERE rank < 5
  UNION ALL SELECT finder_id, enhance, level, chunk_id, rank, score, 'dense', 1 FROM f_dense
  UNION ALL SELECT finder_id, enhance, level, chunk_id, rank, score, 'sparse', 0 FROM ({_track("B", "sparse")}) WHERE rank < 5
  UNION ALL SELECT finder_id, enhance, level, chunk_id, rank, score, 'sparse', 1 FROM f_sparse
  UNION ALL SELECT finder_id, enhance, level, chunk_id, rank, score, 'hybrid', 0 FROM hb WHERE rank < 5
  UNION ALL SELECT finder_id, enhance, level, chunk_id, rank, score, 'hybrid', 1 FROM f_hybrid),
up AS (SELECT finder_id, enhance, f.level, mode, alpha, parent_id AS chunk_id, round(sum(1 / (3 + rank)), 9) AS score, min(rank) AS seen
       FROM final f JOIN chunks c USING (chunk_id) WHERE parent_id IS NOT NULL GROUP BY ALL),
done AS (SELECT finder_id, enhance, level, mode, alpha, chunk_id, row_number() OVER (PARTITION BY finder_id, enhance, level, mode, alpha ORDER BY score DESC, seen) - 1 AS rank, score FROM up
         UNION ALL SELECT finder_id, enhance, level, mode, alpha, chunk_id, rank, score FROM final WHERE level = 1),
results AS (SELECT d.finder_id, g.config_key, level, mode, enhance, alpha, d.chunk_id, d.rank, d.score FROM done d JOIN grid g USING (level, mode, enhance, alpha))"""
RUNS = rf"""
rel0 AS (SELECT DISTINCT finder_id, chunk_id FROM results),
rel1 AS (SELECT r.finder_id, r.chunk_id, ticker, section, year(fiscal_year_end) AS year, c.text, {words('q.truth')} AS ew, {words('c.text')} AS cw, {salient('q.truth')} AS en, {salient('c.text')} AS cn
         FROM rel0 r JOIN questions q USING (finder_id) JOIN docs1 c ON c.chunk_id = r.chunk_id),
relevance AS (SELECT *, {share('ew', 'cw')} AS word, CASE WHEN len(en) < 4 THEN 0.0 ELSE {share('en', 'cn')} END AS num FROM rel1),
joined AS (SELECT s.*, ticker, section, year, word, num, greatest(word, num) AS rel FROM results s JOIN relevance USING (finder_id, chunk_id)),
modal AS (SELECT finder_id, config_key, section AS top FROM (SELECT finder_id, config_key, section, row_number() OVER (PARTITION BY finder_id, config_key ORDER BY count(*) DESC, min(rank)) AS k FROM joined GROUP BY finder_id, config_key, section) WHERE k = 1),
runs AS (
  SELECT j.finder_id, j.config_key, level, mode, enhance, alpha, any_value(category) AS category, any_value(query) AS query, any_value(route) AS route, string_agg(chunk_id, '|' ORDER BY rank) AS retrieved_ids, count(*)::INT AS n_retrieved,
         round_even(max(word), 4) AS word_recall, round_even(max(num), 4) AS num_recall, max(word) >= 0.5 OR max(num) >= 0.7 AS evidence_hit,
         coalesce(round(1.0 / min(CASE WHEN rel >= 0.5 THEN rank + 1 END), 6), 0.0)::DOUBLE AS soft_mrr, max(CASE WHEN rel >= 0.5 AND rank < 3 THEN 1 ELSE 0 END)::DOUBLE AS soft_recall3,
         count(DISTINCT (j.section, j.ticker))::INT AS section_diversity, any_value(top) AS top_section, min_by(ticker, rank) AS ticker, count(CASE WHEN (period = 'FY2024' AND year <> 2024) OR (period = '2022-2023' AND year NOT IN (2022, 2023)) THEN 1 END)::INT AS wrong_year, min_by(chunk_id, rank) AS top_chunk
  FROM joined j JOIN questions USING (finder_id) JOIN modal m ON m.finder_id = j.finder_id AND m.config_key = j.config_key GROUP BY j.finder_id, j.config_key, level, mode, enhance, alpha)"""


def upto(name: str) -> str:
    """WITH clause that defines ``name`` and all that it needs."""
    order = [("chunks", CHUNKS), ("questions", QUESTIONS), ("grid", GRID), ("sparse", SPARSE), ("dense", DENSE), ("tracks", TRACKS), ("results", RESULTS), ("runs", RUNS)]
    out = []
    for key, sql in order:
        out.append(sql)
        if key == name:
            return "WITH " + re.sub(r"(?m)^(docs1|chunks|questions|grid|texts|lists|tf|sparse|near|dense|tracks|hb|ha|results|relevance|runs) AS \(", r"\1 AS MATERIALIZED (", ",".join(out))
    raise KeyError(name)
