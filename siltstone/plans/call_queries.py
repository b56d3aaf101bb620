"""Queries whose model is called from the tasks (stand-ins of a few lines, so that the results are known): answers, runs in groups, routing replies."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from siltstone.operators import model_calls, replies, resume, sweep, truth
from siltstone.plans import metric_queries
from siltstone.plans.store import shared
from siltstone.plans.sweep_sql import upto


def heard(prompt: str) -> str:
    """Stand-in of a model: the first five words."""
    return " ".join(prompt.split(" ")[:5])


def second_line(prompt: str) -> str:
    """Stand-in of a model: what follows the heading of the first source."""
    return prompt.split("\n")[1]


def generated(spark, sf_dir):
    """G6 by calls: one for each distinct context, the sentinel where nothing was found."""
    rows = metric_queries.answered(spark, sf_dir).drop("answer")
    return truth.answers(model_calls.answered(rows, "context", second_line, reply="said", threads=2), lambda _: F.col("said"))


def groups(spark, sf_dir):
    """Passages answered category by category into a folder of their own; a second run finds all done."""
    asked = sweep.questions(spark, sf_dir).select("finder_id", "category", "truth")
    work = lambda rows: model_calls.answered(rows, "truth", heard, threads=2).select("finder_id", "category", F.coalesce("reply", F.lit("")).alias("answer"))
    path = f"{shared(spark)}/runs-{uuid.uuid4().hex}"
    resume.run_groups(asked, "category", work, path)
    return resume.run_groups(asked, "category", work, path)


def routing_replies(spark, sf_dir):
    """doc_id, reply: ways in which a model answers, by document: with prose and nested braces, cut off, twice, outside of its candidates."""
    d = sweep.read(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("en")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    own, why = F.concat(F.lit('"'), "lang", F.lit('"')), F.concat(F.lit('"reason": "from {'), "source", F.lit('} \\"quoted\\""'))
    whole = F.concat(F.lit('{"categories": ['), own, F.lit("], "), why, F.lit("}"))
    forms = [
        F.concat(F.lit("Well {so}: "), whole, F.lit(" That is all {really}.")), F.concat(F.lit('{"categories": ["en", "FR "], "reason": 5} or rather '), whole), F.concat(F.lit("a "), F.expr("substring(w, 1, length(w) - 1)")),
        F.expr("substring(w, 1, length(w) - 9)"), F.lit('{"categories": ["zz"], "reason": "x"}'), F.lit('{"categories": []}'), F.concat(F.lit('{"answer": '), whole, F.lit("}")), F.concat(whole, F.lit(' {"categories": "none"}')), F.lit("no idea"),
    ]
    rows = d.withColumn("w", whole)
    return rows.select("doc_id", F.get(F.array(*forms), F.pmod("doc_id", F.lit(len(forms))).cast("int")).alias("reply"))


def parsed(spark, sf_dir):
    p = routing_replies(spark, sf_dir).withColumn("p", replies.parsed(F.col("reply"), F.array(*[F.lit(x) for x in ("fr", "en", "de", "es")])))
    return p.select("doc_id", F.coalesce(F.array_join("p.categories", ","), F.lit("unusable")).alias("chosen"), F.coalesce("p.reason", F.lit("none")).alias("reason"))


QUERIES = {"g06_calls": lambda s, d: generated(s, d).select("finder_id", "n_sources", F.md5("retrieved_ids").alias("ids_md5"), F.md5(truth.shown(F.col("answer"))).alias("answer_md5")), "g08_groups": groups, "t14_parsed": parsed}
SQL = {
    "g06_calls": metric_queries.SQL["g06_answers"],
    "g08_groups": upto("questions") + " SELECT finder_id, category, CASE WHEN trim(truth) = '' THEN '' ELSE array_to_string(string_split(truth, ' ')[1:5], ' ') END AS answer FROM questions",
    "t14_parsed": """WITH d AS (SELECT doc_id, doc_id % 9 AS k, coalesce(lang, 'en') AS lang, 'from {' || coalesce(source, '') || '} "quoted"' AS why FROM documents)
 SELECT doc_id, CASE WHEN k IN (4, 8) THEN 'unusable' WHEN k = 5 THEN '' ELSE lang END AS chosen, CASE WHEN k IN (4, 8) THEN 'none' WHEN k = 5 THEN '' WHEN k = 3 THEN '(reply truncated)' ELSE why END AS reason FROM d""",
}
