"""Aggregate tables, overlap analysis and statistics over the judged run table.

Most are plain SQL that Spark plans like any DataFrame; the oracle runs the same definition in another engine, over
its own computation of the runs.
"""

from __future__ import annotations

from siltstone.operators import judge, stats
from siltstone.plans.sweep_sql import upto

JUDGED = f"""
base AS (SELECT finder_id, retrieved_ids AS b_ids, word_recall AS b_word, soft_mrr AS b_mrr FROM runs WHERE config_key = '{judge.BASELINE}'),
verdicts AS MATERIALIZED (SELECT r.*, CASE WHEN config_key = '{judge.BASELINE}' THEN 'is_baseline' WHEN b_ids IS NULL THEN 'no_baseline' WHEN retrieved_ids = b_ids THEN 'same_as_baseline'
            WHEN word_recall > b_word THEN 'A' WHEN word_recall < b_word THEN 'B' ELSE 'Tie' END AS relevance,
            CASE WHEN config_key = '{judge.BASELINE}' THEN 'is_baseline' WHEN b_ids IS NULL THEN 'no_baseline' WHEN retrieved_ids = b_ids THEN 'same_as_baseline'
            WHEN soft_mrr > b_mrr THEN 'A' WHEN soft_mrr < b_mrr THEN 'B' ELSE 'Tie' END AS completeness
            FROM runs r LEFT JOIN base USING (finder_id))"""
PREFIX = upto("runs") + "," + JUDGED

VALUE = "CASE {c} WHEN 'A' THEN 1e0 WHEN 'B' THEN 0e0 END"
REL, COMP = VALUE.format(c="relevance"), VALUE.format(c="completeness")
OUTCOME = "CASE WHEN {c} = 'A' THEN 'win' WHEN {c} = 'B' THEN 'loss' ELSE 'tie' END"
JOINT = f"((CASE {OUTCOME.format(c='relevance')} WHEN 'win' THEN 1e0 WHEN 'tie' THEN 0.5e0 ELSE 0e0 END) + (CASE {OUTCOME.format(c='completeness')} WHEN 'win' THEN 1e0 WHEN 'tie' THEN 0.5e0 ELSE 0e0 END)) / 2"
MEANS = "round(avg(word_recall) + 1e-10, 6) AS word_recall, round(avg(soft_mrr) + 1e-10, 6) AS soft_mrr, round(avg(soft_recall3) + 1e-10, 6) AS soft_recall3, round(avg(CASE WHEN evidence_hit THEN 1e0 ELSE 0e0 END) + 1e-10, 6) AS evidence_hit"
SIZED = "SELECT *, count(*) OVER (PARTITION BY finder_id, retrieved_ids) AS gsize FROM {runs} WHERE retrieved_ids <> ''"
AXES = "level, mode, enhance, alpha"
AX = " UNION ALL ".join(f"SELECT '{a}' AS axis, CAST({a} AS STRING) AS value, * FROM src" for a in AXES.split(", "))

#: {{runs}} is the judged run table.
PORTABLE = {
    # aggregate tables
    "a01_verdict_values": f"SELECT finder_id, config_key, CAST({REL} AS DOUBLE) AS relevance_int, CAST({COMP} AS DOUBLE) AS completeness_int FROM {{runs}}",
    "a02_config_summary": f"SELECT config_key, level, mode, enhance, alpha, count(*) AS n, {MEANS}, CAST(round(avg({REL}) + 1e-10, 6) AS DOUBLE) AS relevance_rate FROM {{runs}} GROUP BY config_key, level, mode, enhance, alpha",
    "a03_category_breakdown": f"SELECT category, config_key, count(*) AS n, {MEANS} FROM {{runs}} GROUP BY category, config_key",
    "a04_failure_analysis": "SELECT finder_id, config_key, category, relevance, completeness, word_recall FROM {runs} WHERE relevance = 'B' OR completeness = 'B'",
    "a06_dimension_summary": f"WITH src AS (SELECT * FROM {{runs}}), ax AS ({AX}) SELECT axis, value, count(*) AS n, {MEANS} FROM ax GROUP BY axis, value",
    "a06_grouping_sets": f"SELECT level, mode, enhance, alpha, count(*) AS n, {MEANS} FROM {{runs}} GROUP BY GROUPING SETS ((level), (mode), (enhance), (alpha), ())",
    "a07_baseline_delta": f"""WITH m AS (SELECT config_key, count(*) AS n, round(avg(word_recall) + 1e-10, 4) AS w, round(avg(soft_mrr) + 1e-10, 4) AS s, round(avg(soft_recall3) + 1e-10, 4) AS r, round(avg(CASE WHEN evidence_hit THEN 1e0 ELSE 0e0 END) + 1e-10, 4) AS h FROM {{runs}} GROUP BY config_key),
        b AS (SELECT w AS bw, s AS bs, r AS br, h AS bh FROM m WHERE config_key = '{judge.BASELINE}')
        SELECT config_key, n, w, s, r, h, round(w - bw, 4) AS dw, round(s - bs, 4) AS ds, round(r - br, 4) AS dr, round(h - bh, 4) AS dh, config_key = '{judge.BASELINE}' AS is_baseline FROM m CROSS JOIN b""",
    "a08_one_axis_impact": f"""WITH m AS (SELECT config_key, level, mode, enhance, alpha, round(avg(word_recall) + 1e-10, 4) AS w FROM {{runs}} GROUP BY config_key, level, mode, enhance, alpha),
        d AS (SELECT m.config_key, m.w - b.w AS dw, CASE WHEN m.level <> b.level THEN 1 ELSE 0 END AS l, CASE WHEN m.mode <> b.mode THEN 1 ELSE 0 END AS o, CASE WHEN m.enhance <> b.enhance THEN 1 ELSE 0 END AS e, CASE WHEN m.alpha <> b.alpha THEN 1 ELSE 0 END AS a
              FROM m JOIN m b ON b.config_key = '{judge.BASELINE}')
        SELECT config_key, CASE WHEN l + o + e + a = 0 THEN 'baseline' WHEN l + o + e + a > 1 THEN 'multi' WHEN l = 1 THEN 'level' WHEN o = 1 THEN 'mode' WHEN e = 1 THEN 'enhance' ELSE 'alpha' END AS bucket, round(dw, 4) AS delta FROM d""",
    "a09_delta_labels": f"""WITH m AS (SELECT config_key, round(avg(word_recall) + 1e-10, 4) AS w FROM {{runs}} GROUP BY config_key)
        SELECT m.config_key, round(m.w - b.w, 4) AS delta, CASE WHEN m.w - b.w >= 0.05 THEN 'up' WHEN m.w - b.w <= -0.05 THEN 'down' ELSE 'flat' END AS arrow,
        concat(CASE WHEN round(m.w - b.w, 4) < 0 THEN '-' ELSE '+' END, '0.', lpad(CAST(CAST(round(abs(round(m.w - b.w, 4)) * 10000, 0) AS BIGINT) AS STRING), 4, '0')) AS shown FROM m JOIN m b ON b.config_key = '{judge.BASELINE}'""",
    "a10_axis_by_category": f"""WITH src AS (SELECT * FROM {{runs}}), ax AS ({AX}),
        v AS (SELECT axis, coalesce(category, 'OVERALL') AS category, value, round(avg(word_recall) + 1e-10, 4) AS w FROM ax GROUP BY GROUPING SETS ((axis, category, value), (axis, value)))
        SELECT axis, category, count(*) AS n_values, round(max(w) - min(w), 4) AS range, CASE WHEN count(*) = 2 THEN round(max(CASE WHEN value = top THEN w END) - max(CASE WHEN value = low THEN w END), 4) END AS signed
        FROM (SELECT *, max(value) OVER (PARTITION BY axis, category) AS top, min(value) OVER (PARTITION BY axis, category) AS low FROM v) t GROUP BY axis, category""",
    "a11_sections": """WITH c AS (SELECT top_section, count(*) AS n FROM {runs} GROUP BY top_section),
        r AS (SELECT top_section, row_number() OVER (ORDER BY n DESC, top_section) AS k FROM c)
        SELECT CASE WHEN k <= 8 THEN r.top_section ELSE 'OTHER' END AS section, count(*) AS n, CAST(round(100e0 * count(*) / max(total), 1) AS DOUBLE) AS pct, round(avg(soft_recall3) + 1e-10, 3) AS recall3
        FROM {runs} x CROSS JOIN (SELECT count(*) AS total FROM {runs}) t JOIN r ON x.top_section = r.top_section GROUP BY CASE WHEN k <= 8 THEN r.top_section ELSE 'OTHER' END
        UNION ALL SELECT 'OVERALL', count(*), 100e0, round(avg(soft_recall3) + 1e-10, 3) FROM {runs}""",
    "a12_section_shift": """WITH c AS (SELECT category, alpha, top_section, count(*) AS n FROM {runs} GROUP BY category, alpha, top_section),
        m AS (SELECT category, alpha, top_section, row_number() OVER (PARTITION BY category, alpha ORDER BY n DESC, top_section) AS k FROM c),
        w AS (SELECT category, alpha, round(avg(word_recall) + 1e-10, 3) AS w, round(avg(soft_mrr) + 1e-10, 3) AS s, round(avg(soft_recall3) + 1e-10, 3) AS r FROM {runs} GROUP BY category, alpha)
        SELECT a.category, a.top_section AS section0, b.top_section AS section1, a.top_section <> b.top_section AS shifted, wa.w AS w0, wb.w AS w1, round(wb.w - wa.w, 3) AS delta, round(wb.s - wa.s, 3) AS delta_mrr, round(wb.r - wa.r, 3) AS delta_recall
        FROM m a JOIN m b ON a.category = b.category AND a.alpha = 0 AND b.alpha = 1 AND a.k = 1 AND b.k = 1 JOIN w wa ON wa.category = a.category AND wa.alpha = 0 JOIN w wb ON wb.category = a.category AND wb.alpha = 1""",
    "a13_overlapping_context": """WITH g AS (SELECT finder_id, retrieved_ids, count(*) AS n, min(config_key) AS first_key FROM {runs} WHERE retrieved_ids <> '' GROUP BY finder_id, retrieved_ids HAVING count(*) >= 2)
        SELECT finder_id, concat(CAST(finder_id AS STRING), '_g', CAST(row_number() OVER (PARTITION BY finder_id ORDER BY first_key) AS STRING)) AS group_id, n, substr(sha1(retrieved_ids), 1, 12) AS ids_hash FROM g""",
    "a14_console_summary": f"SELECT mode, count(*) AS n, CAST(sum(CASE WHEN evidence_hit THEN 1 ELSE 0 END) AS BIGINT) AS hits, CAST(sum(CASE WHEN wrong_year > 0 THEN 1 ELSE 0 END) AS BIGINT) AS cross_year, {MEANS} FROM {{runs}} GROUP BY mode",
    "a14_win_matrix": """WITH p AS (SELECT finder_id, level, enhance, alpha, max(CASE WHEN mode = 'dense' AND evidence_hit THEN 1 ELSE 0 END) AS d, max(CASE WHEN mode = 'sparse' AND evidence_hit THEN 1 ELSE 0 END) AS s FROM {runs} GROUP BY finder_id, level, enhance, alpha)
        SELECT CAST(sum(d * s) AS BIGINT) AS both_hit, CAST(sum(d * (1 - s)) AS BIGINT) AS dense_only, CAST(sum((1 - d) * s) AS BIGINT) AS sparse_only, CAST(sum((1 - d) * (1 - s)) AS BIGINT) AS neither FROM p""",
    "a15_judge_summary": "SELECT mode, count(*) AS n, round(CAST(sum(CASE WHEN relevance = 'A' THEN 1 ELSE 0 END) AS BIGINT) / count(*), 6) AS relevance_win, round(CAST(sum(CASE WHEN completeness = 'A' THEN 1 ELSE 0 END) AS BIGINT) / count(*), 6) AS completeness_win, CAST(sum(CASE WHEN relevance = 'parse_error' THEN 1 ELSE 0 END) AS BIGINT) AS errors FROM {runs} GROUP BY mode",
    "a16_ranked_configs": "SELECT *, CAST(rank() OVER (ORDER BY w DESC) AS BIGINT) AS place FROM (SELECT config_key, round(avg(word_recall) + 1e-10, 6) AS w FROM {runs} GROUP BY config_key) m",
    "a16_failure_categories": "SELECT category, n FROM (SELECT category, n, row_number() OVER (ORDER BY n DESC, category) AS k FROM (SELECT category, count(*) AS n FROM {runs} WHERE NOT evidence_hit GROUP BY category) c) t WHERE k <= 5",
    "a17_pareto": """WITH m AS (SELECT config_key, round(avg(word_recall) + 1e-10, 6) AS x, round(avg(soft_mrr) + 1e-10, 6) AS y, round(avg(soft_recall3) + 1e-10, 6) AS z FROM {runs} GROUP BY config_key)
        SELECT config_key, x, y, z FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.x >= a.x AND b.y >= a.y AND b.z >= a.z AND (b.x > a.x OR b.y > a.y OR b.z > a.z))""",
    "a18_pareto_norm": """WITH m AS (SELECT config_key, round(avg(word_recall) + 1e-10, 6) AS x, round(avg(soft_mrr) + 1e-10, 6) AS y FROM {runs} GROUP BY config_key),
        e AS (SELECT config_key, x, y FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.x >= a.x AND b.y >= a.y AND (b.x > a.x OR b.y > a.y))),
        s AS (SELECT *, min(x) OVER () AS x0, max(x) OVER () AS x1, min(y) OVER () AS y0, max(y) OVER () AS y1 FROM e)
        SELECT config_key, round(CASE WHEN x1 > x0 THEN (x - x0) / (x1 - x0) ELSE 0e0 END, 6) AS nx, round(CASE WHEN y1 > y0 THEN (y - y0) / (y1 - y0) ELSE 0e0 END, 6) AS ny,
        CAST(rank() OVER (ORDER BY round(CASE WHEN x1 > x0 THEN (x - x0) / (x1 - x0) ELSE 0e0 END + CASE WHEN y1 > y0 THEN (y - y0) / (y1 - y0) ELSE 0e0 END, 6) DESC) AS BIGINT) AS place FROM s""",
    # overlap analysis
    "o01_group_sizes": f"SELECT finder_id, config_key, gsize FROM ({SIZED}) s",
    "o02_headline": f"WITH s AS ({SIZED}), g AS (SELECT finder_id, retrieved_ids, count(*) AS n FROM {{runs}} GROUP BY finder_id, retrieved_ids) SELECT CAST(sum(CASE WHEN n >= 2 THEN 1 ELSE 0 END) AS BIGINT) AS groups, CAST(sum(CASE WHEN n >= 2 THEN n ELSE 0 END) AS BIGINT) AS runs_in_groups, CAST(sum(CASE WHEN n >= 2 THEN n - 1 ELSE 0 END) AS BIGINT) AS redundant, count(*) AS contexts FROM g",
    "o02_size_histogram": "WITH g AS (SELECT finder_id, retrieved_ids, count(*) AS n FROM {runs} GROUP BY finder_id, retrieved_ids) SELECT n AS size, count(*) AS groups FROM g GROUP BY n",
    "o03_axis_table": f"WITH src AS ({SIZED}), ax AS ({AX}) SELECT axis, value, count(*) AS n, CAST(sum(CASE WHEN gsize > 1 THEN 1 ELSE 0 END) AS BIGINT) AS collapsed FROM ax GROUP BY axis, value",
    "o03_axis_varies": f"WITH src AS ({SIZED}), ax AS ({AX}), g AS (SELECT axis, finder_id, retrieved_ids, count(DISTINCT value) AS v FROM ax WHERE gsize > 1 GROUP BY axis, finder_id, retrieved_ids) SELECT axis, count(*) AS groups, CAST(sum(CASE WHEN v > 1 THEN 1 ELSE 0 END) AS BIGINT) AS varies FROM g GROUP BY axis",
    "o04_level_composition": f"WITH s AS ({SIZED}), g AS (SELECT finder_id, retrieved_ids, count(*) AS n, min(level) AS lo, max(level) AS hi FROM s WHERE gsize > 1 GROUP BY finder_id, retrieved_ids) SELECT lo, hi, count(*) AS groups, CAST(sum(n) AS BIGINT) AS runs FROM g GROUP BY lo, hi",
    "o05_level_attribution": f"WITH s AS ({SIZED}), l AS (SELECT *, count(*) OVER (PARTITION BY finder_id, retrieved_ids, level) AS same FROM s) SELECT level, CAST(sum(CASE WHEN gsize > same THEN 1 ELSE 0 END) AS BIGINT) AS cross_level, CAST(sum(CASE WHEN same > 1 THEN 1 ELSE 0 END) AS BIGINT) AS same_level, count(*) AS n FROM l GROUP BY level",
    "o06_within_level": "WITH g AS (SELECT level, finder_id, retrieved_ids, count(*) AS n FROM {runs} GROUP BY level, finder_id, retrieved_ids) SELECT level, CAST(sum(n) AS BIGINT) AS runs, count(*) AS contexts, CAST(sum(n) AS BIGINT) - count(*) AS redundant FROM g GROUP BY level",
    "o07_drop_level": """WITH k(name, lo, hi) AS (SELECT * FROM (VALUES ('all', 1, 2), ('only1', 1, 1), ('only2', 2, 2)) v(name, lo, hi)),
        g AS (SELECT name, finder_id, retrieved_ids, count(*) AS n FROM {runs} JOIN k ON level BETWEEN lo AND hi GROUP BY name, finder_id, retrieved_ids)
        SELECT name, CAST(sum(n) AS BIGINT) AS runs, count(*) AS contexts, round(1e0 - count(*) / CAST(sum(n) AS BIGINT), 6) AS redundancy FROM g GROUP BY name""",
    "o08_cross_level": "SELECT a.mode, count(*) AS cells, CAST(sum(CASE WHEN a.retrieved_ids = b.retrieved_ids THEN 1 ELSE 0 END) AS BIGINT) AS equal FROM {runs} a JOIN {runs} b ON a.finder_id = b.finder_id AND a.mode = b.mode AND a.enhance = b.enhance AND a.alpha = b.alpha AND a.level < b.level GROUP BY a.mode",
    "o09_collapse_correlation": f"""WITH s AS ({SIZED}), p AS (SELECT CASE WHEN a.gsize > 1 THEN 1e0 ELSE 0e0 END AS x, CASE WHEN b.gsize > 1 THEN 1e0 ELSE 0e0 END AS y FROM s a JOIN s b ON a.finder_id = b.finder_id AND a.mode = b.mode AND a.enhance = b.enhance AND a.alpha = b.alpha AND a.level < b.level),
        m AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(x) AS DOUBLE) AS sx, CAST(sum(y) AS DOUBLE) AS sy, CAST(sum(x * y) AS DOUBLE) AS sxy FROM p)
        SELECT round((n * sxy - sx * sy) / nullif(sqrt((n * sx - sx * sx) * (n * sy - sy * sy)), 0e0), 6) AS phi FROM m""",
    "o10_alpha_suppresses": "WITH c AS (SELECT finder_id, level, enhance, alpha, count(DISTINCT retrieved_ids) AS k FROM {runs} GROUP BY finder_id, level, enhance, alpha) SELECT alpha, count(*) AS cells, CAST(sum(CASE WHEN k = 1 THEN 1 ELSE 0 END) AS BIGINT) AS identical FROM c GROUP BY alpha",
    "o11_enhancement_inert": "SELECT count(*) AS pairs, CAST(sum(CASE WHEN a.retrieved_ids = b.retrieved_ids THEN 1 ELSE 0 END) AS BIGINT) AS inert FROM {runs} a JOIN {runs} b ON a.finder_id = b.finder_id AND a.level = b.level AND a.mode = b.mode AND a.alpha = b.alpha AND a.enhance = 0 AND b.enhance = 1",
    "o12_category_table": f"WITH s AS ({SIZED}) SELECT category, count(*) AS runs, CAST(sum(CASE WHEN gsize > 1 THEN 1 ELSE 0 END) AS BIGINT) AS collapsed, count(DISTINCT retrieved_ids) AS contexts FROM s WHERE category IS NOT NULL GROUP BY category",
    "o13_cross_query": "SELECT retrieved_ids, count(DISTINCT finder_id) AS questions FROM {runs} WHERE retrieved_ids <> '' GROUP BY retrieved_ids HAVING count(DISTINCT finder_id) > 1",
    # statistics
    "x01_base_config": "SELECT finder_id, regexp_replace(config_key, '_A[01](_[A-Z]+)?$', '') AS base_config, alpha, soft_recall3 FROM {runs}",
    "x02_paired_alpha": "SELECT finder_id, avg(CASE WHEN alpha = 0 THEN soft_recall3 END) AS a0, avg(CASE WHEN alpha = 1 THEN soft_recall3 END) AS a1 FROM {runs} GROUP BY finder_id HAVING count(CASE WHEN alpha = 0 THEN 1 END) > 0 AND count(CASE WHEN alpha = 1 THEN 1 END) > 0",
    "x05_up_down": """WITH p AS (SELECT finder_id, regexp_replace(config_key, '_A[01]$', '') AS c, max(CASE WHEN alpha = 1 THEN word_recall END) - max(CASE WHEN alpha = 0 THEN word_recall END) AS d FROM {runs} GROUP BY finder_id, regexp_replace(config_key, '_A[01]$', ''))
        SELECT c AS base_config, CAST(sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) AS BIGINT) AS up, CAST(sum(CASE WHEN d < 0 THEN 1 ELSE 0 END) AS BIGINT) AS down, CAST(sum(CASE WHEN d = 0 THEN 1 ELSE 0 END) AS BIGINT) AS flat FROM p GROUP BY c""",
    "x08_destinations": "SELECT alpha, top_section, n FROM (SELECT alpha, top_section, count(*) AS n, row_number() OVER (PARTITION BY alpha ORDER BY count(*) DESC, top_section) AS k FROM {runs} GROUP BY alpha, top_section) t WHERE k <= 3",
    "x09_query_detail": "SELECT finder_id, round(avg(CASE WHEN alpha = 0 THEN word_recall END) + 1e-10, 6) AS a0, round(avg(CASE WHEN alpha = 1 THEN word_recall END) + 1e-10, 6) AS a1, round(avg(CASE WHEN alpha = 1 THEN word_recall END) - avg(CASE WHEN alpha = 0 THEN word_recall END) + 1e-10, 6) AS delta FROM {runs} GROUP BY finder_id",
    "x10_joint_score": f"SELECT finder_id, config_key, CAST({JOINT} AS DOUBLE) AS joint FROM {{runs}}",
    "x11_complete_matrix": "SELECT count(DISTINCT finder_id) * count(DISTINCT config_key) = count(*) AS complete, count(*) AS n FROM {runs}",
    "x12_config_scores": f"SELECT config_key, round(avg(CAST({JOINT} AS DOUBLE)) + 1e-10, 6) AS score, round(avg(CASE WHEN relevance = 'A' THEN 1e0 ELSE 0e0 END) + 1e-10, 6) AS win, round(avg(CASE WHEN relevance = 'B' THEN 1e0 ELSE 0e0 END) + 1e-10, 6) AS loss FROM {{runs}} GROUP BY config_key",
    "x13_summary_rank": f"SELECT config_key, score, CAST(rank() OVER (ORDER BY score DESC) AS BIGINT) AS place FROM (SELECT config_key, round(avg(CAST({JOINT} AS DOUBLE)) + 1e-10, 6) AS score FROM {{runs}} GROUP BY config_key) s",
    "x18_verdict_table": "SELECT relevance, completeness, count(*) AS n FROM {runs} GROUP BY relevance, completeness",
    "x18_decided": "SELECT config_key, CAST(sum(CASE WHEN relevance IN ('A', 'B') THEN 1 ELSE 0 END) AS BIGINT) AS decided, CAST(sum(CASE WHEN relevance IN ('is_baseline', 'same_as_baseline', 'no_baseline') THEN 1 ELSE 0 END) AS BIGINT) AS structural, CAST(sum(CASE WHEN relevance = 'Tie' THEN 1 ELSE 0 END) AS BIGINT) AS ties FROM {runs} GROUP BY config_key",
    "x19_mode_marginal": "WITH m AS (SELECT finder_id, mode, avg(word_recall) AS w, count(*) AS n FROM {runs} GROUP BY finder_id, mode) SELECT a.mode, count(*) AS questions, round(avg(a.w - b.w) + 1e-10, 6) AS delta, min(a.n) = max(b.n) AS balanced FROM m a JOIN m b ON a.finder_id = b.finder_id AND b.mode = 'sparse' AND a.mode <> 'sparse' GROUP BY a.mode",
    "x20_contrasts": """WITH src AS (SELECT finder_id, word_recall, level, mode, enhance, alpha FROM {runs}),
        c AS (SELECT 'level' AS contrast, finder_id, CASE WHEN level = 2 THEN 1 ELSE 0 END AS t, word_recall FROM src UNION ALL SELECT 'enhance', finder_id, enhance, word_recall FROM src UNION ALL SELECT 'alpha', finder_id, alpha, word_recall FROM src UNION ALL SELECT 'hybrid_vs_dense', finder_id, CASE WHEN mode = 'hybrid' THEN 1 ELSE 0 END, word_recall FROM src WHERE mode <> 'sparse'),
        q AS (SELECT contrast, finder_id, avg(CASE WHEN t = 1 THEN word_recall END) - avg(CASE WHEN t = 0 THEN word_recall END) AS d, count(CASE WHEN t = 1 THEN 1 END) = count(CASE WHEN t = 0 THEN 1 END) AS crossed FROM c GROUP BY contrast, finder_id)
        SELECT contrast, count(*) AS questions, round(avg(d) + 1e-10, 6) AS effect, min(CASE WHEN crossed THEN 1 ELSE 0 END) AS crossed FROM q GROUP BY contrast""",
    "x22_regime_cube": "SELECT mode, category, count(*) AS n, count(DISTINCT finder_id) AS trials FROM {runs} GROUP BY CUBE (mode, category)",
    "x23_heatmap": "SELECT mode, level, alpha, count(*) AS n, round(avg(word_recall) + 1e-10, 6) AS mean FROM {runs} GROUP BY mode, level, alpha",
    "x23_caterpillar": f"""WITH d AS (SELECT a.config_key, a.word_recall - b.word_recall AS d FROM {{runs}} a JOIN {{runs}} b ON a.finder_id = b.finder_id AND b.config_key = '{judge.BASELINE}')
        SELECT config_key, round(avg(d) + 1e-10, 6) AS mean, round(avg(d) - 1.96e0 * coalesce(stddev_samp(d), 0e0) / sqrt(CAST(count(*) AS DOUBLE)) + 1e-10, 6) AS low, round(avg(d) + 1.96e0 * coalesce(stddev_samp(d), 0e0) / sqrt(CAST(count(*) AS DOUBLE)) + 1e-10, 6) AS high FROM d GROUP BY config_key""",
    "x23_routing": "SELECT category, alpha, top_section, count(*) AS n, round(avg(soft_recall3) + 1e-10, 6) AS recall3 FROM {runs} GROUP BY category, alpha, top_section",
    "x23_divergence": f"SELECT config_key, round(avg(word_recall) + 1e-10, 6) AS recall, round(avg(CAST({JOINT} AS DOUBLE)) + 1e-10, 6) AS judged FROM {{runs}} GROUP BY config_key",
    "io23_summary_lines": "SELECT mode, concat(mode, ': ', CAST(count(*) AS STRING), ' runs, ', CAST(CAST(sum(CASE WHEN evidence_hit THEN 1 ELSE 0 END) AS BIGINT) AS STRING), ' with evidence, ', CAST(CAST(sum(CASE WHEN wrong_year > 0 THEN 1 ELSE 0 END) AS BIGINT) AS STRING), ' of a wrong year') AS line FROM {runs} GROUP BY mode",
    "x23_figure_data": "SELECT config_key, category, round(avg(soft_mrr) + 1e-10, 6) AS mean, round(min(soft_mrr), 6) AS low, round(max(soft_mrr), 6) AS high FROM {runs} GROUP BY config_key, category",
}


def portable(sql):
    return lambda spark, sf_dir: spark.sql(sql, runs=judge.judged(spark, sf_dir))


QUERIES = {name: portable(sql) for name, sql in PORTABLE.items()}
SQL = {name: PREFIX + " " + (f"SELECT * FROM ({sql})" if sql.lstrip().upper().startswith("WITH") else sql) for name, sql in ((n, s.replace("{runs}", "verdicts").replace("AS STRING", "AS VARCHAR")) for n, s in PORTABLE.items())}

QUERIES |= {
    "m25_overlap_groups": lambda s, d: judge.overlap_groups(judge.judged(s, d)),
    "judged_runs": lambda s, d: judge.judged(s, d),
    "a05_correlations": lambda s, d: stats.correlations(judge.judged(s, d), ["word_recall", "num_recall", "soft_mrr", "soft_recall3", "n_retrieved", "section_diversity", "wrong_year"]),
    "x03_mcnemar": lambda s, d: stats.mcnemar(stats.paired_hits(judge.judged(s, d))),
    "x04_wilcoxon": lambda s, d: stats.wilcoxon(stats.differences(judge.judged(s, d), judge.BASELINE), ["config_key"]),
    "x06_corrections": lambda s, d: stats.corrections(stats.mcnemar(stats.paired_hits(judge.judged(s, d))), ["family"]),
    "x17_bootstrap": lambda s, d: stats.bootstrap_best(judge.judged(s, d), 5000),
    "x04_wilcoxon_p": lambda s, d: stats.wilcoxon_p(stats.differences(judge.judged(s, d), judge.BASELINE), ["config_key"]),
}
_COLS = ["word_recall", "num_recall", "soft_mrr", "soft_recall3", "n_retrieved", "section_diversity", "wrong_year"]
_HITS = """h AS (SELECT category AS family, regexp_replace(config_key, '_A[01]$', '') AS base_config, finder_id, max(CASE WHEN alpha = 0 AND evidence_hit THEN 1 ELSE 0 END) AS h0, max(CASE WHEN alpha = 1 AND evidence_hit THEN 1 ELSE 0 END) AS h1 FROM verdicts GROUP BY ALL),
mc0 AS (SELECT family, base_config, sum((1 - h0) * h1)::BIGINT AS gains, sum(h0 * (1 - h1))::BIGINT AS losses FROM h GROUP BY ALL),
mc AS (SELECT family, base_config, gains, losses, CASE WHEN gains + losses = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(gains, losses) + 1), lambda i: exp(coalesce(list_sum(list_transform(range(1, i + 1), lambda j: ln((gains + losses - j + 1) / j))), 0) - (gains + losses) * ln(2))))) END AS raw FROM mc0)"""
_DIFF = f"""df AS (SELECT a.config_key, a.finder_id, round(a.word_recall - b.word_recall, 6) AS d FROM verdicts a JOIN verdicts b ON a.finder_id = b.finder_id AND b.config_key = '{judge.BASELINE}' AND a.config_key <> '{judge.BASELINE}'),
rk AS (SELECT config_key, d, rank() OVER (PARTITION BY config_key ORDER BY abs(d)) + (count(*) OVER (PARTITION BY config_key, abs(d)) - 1) / 2 AS r, count(*) OVER (PARTITION BY config_key, abs(d)) AS t FROM df WHERE d <> 0),
wx AS (SELECT config_key, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END)::DOUBLE AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END)::DOUBLE AS w_minus, sum(t * t - 1)::DOUBLE AS ties FROM rk GROUP BY config_key)"""
SQL |= {
    "m25_overlap_groups": PREFIX + f" SELECT finder_id, config_key, n, canonical FROM (SELECT finder_id, config_key, count(*) OVER (PARTITION BY finder_id, retrieved_ids) AS n, min_by(config_key, CASE WHEN config_key = '{judge.BASELINE}' THEN '' ELSE config_key END) OVER (PARTITION BY finder_id, retrieved_ids) AS canonical FROM verdicts WHERE retrieved_ids <> '') WHERE n >= 2",
    "judged_runs": PREFIX + " SELECT * FROM verdicts",
    "a05_correlations": PREFIX + " " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(CASE WHEN stddev_pop({a}) = 0 OR stddev_pop({b}) = 0 THEN NULL ELSE corr({a}, {b}) END, 6) + 0.0 AS r FROM verdicts" for i, a in enumerate(_COLS) for b in _COLS[i + 1 :]),
    "x03_mcnemar": PREFIX + "," + _HITS + " SELECT family, base_config, gains, losses, round(raw, 6) AS p FROM mc",
    "x04_wilcoxon": PREFIX + "," + _DIFF + " SELECT config_key, n, w_plus, w_minus, round((w_plus - n * (n + 1) / 4) / nullif(sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 0), 6) AS z FROM wx",
    "x06_corrections": PREFIX + "," + _HITS + """, o AS (SELECT *, round(raw, 6) AS p, row_number() OVER (PARTITION BY family ORDER BY round(raw, 6), base_config) AS r, count(*) OVER (PARTITION BY family) AS m FROM mc)
        SELECT family, base_config, p, round(least(1.0, max((m - r + 1) * p) OVER (PARTITION BY family ORDER BY r)), 6) AS holm, round(least(1.0, min(m * p / r) OVER (PARTITION BY family ORDER BY r DESC)), 6) AS bh FROM o""",
    "x17_bootstrap": PREFIX + """, q AS (SELECT finder_id, row_number() OVER (ORDER BY finder_id) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT finder_id FROM verdicts)),
        draw AS (SELECT b, ('0x' || substr(md5('0:' || b || ':' || q.k), 1, 8))::BIGINT % q.n AS k FROM range(5000) t(b), q),
        s AS (SELECT b, config_key, round(avg(word_recall), 9) AS m FROM draw JOIN q USING (k) JOIN verdicts v ON v.finder_id = q.finder_id GROUP BY ALL),
        w AS (SELECT b, config_key, m, row_number() OVER (PARTITION BY b ORDER BY m DESC, config_key) AS place FROM s)
        SELECT config_key, round(avg(CASE WHEN place = 1 THEN 1.0 ELSE 0.0 END), 6) AS p_best, round(quantile_cont(m, 0.025) + 1e-10, 6) AS low, round(quantile_cont(m, 0.975) + 1e-10, 6) AS high FROM w GROUP BY config_key""",
}
