"""Sections cut document by document against the same by windows over lines."""

import random

from pyspark.sql import functions as F

from siltstone.operators import levels as L

PIECES = [
    "# A", "# B | Table of Contents", "## C", "## C", "### D", "#### E", "##### F", "#G", "# ", "#   ", "## **Table of Contents**", "# table of contentſ", "# TABLE OF CONTENTS\r", "# H\r", "# I\rj", "#\tT | u", "#  two ", "# x||y ", "# a ",
    "# \u0085", "", " ", "  ", "\t", "text", " text ", "# J | K", "## K", "\r", "<!-- header-only -->", " <!-- header-only -->", "| a | b |", "*run*", "#", " ", "##  ", "## C | C",
]


def test_sections_equal_those_by_windows(spark):
    rng = random.Random(3)
    docs = [(str(k), "\n".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14)))) for k in range(1500)] + [("null", None), ("empty", ""), ("gone", "# Table of Contents"), ("end", "# A\n\n\n"), ("tail", "x\n\n\n")]
    rows = spark.createDataFrame(docs, "doc_id string, md string").repartition(3)
    want = L.sections(L.join_headers(rows.select("doc_id", L.strip_running(F.col("md")).alias("md")), "doc_id", "md"), "doc_id")
    got = L.sections_of(rows, "doc_id", "md")
    key = lambda r: (r["doc_id"], r["ord"])
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == sorted(map(tuple, want.collect()), key=lambda r: r[:2])
    assert got.columns == want.columns and len({key(r) for r in got.collect()}) == got.count() > 1500


def test_sections_need_no_shuffle(spark):
    rows = spark.createDataFrame([("1", "# A\nx")], "doc_id string, md string")
    plan = L.sections_of(rows, "doc_id", "md")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


PARAGRAPHS = [
    "one two three four five six seven eight nine ten eleven", "a b", "*Americas*", " *Asia* ", "*1 note*", "*end.*", "**", "*Table of Contents*", "*x*\r", "*y*\n ", "Sales", "| a | b |\n|---|---|\n| 1 | 2 |\n", "| h |\n| --- |\n\n| 1 | 2 | 3 | 4 | 5 | 6 |\n",
    "| only |\n", "|--|\n", "\n", "\n\n", " ", "\t", "w x y\u0085z", "| r\r | c |\n|-|\n", "* a *", "*.\r*", "*q.*\r\n", "\tp q r s t u v w x y z",
]


def test_packing_equals_that_by_rows(spark):
    rng = random.Random(4)
    rows = [(k, str(k), "".join(rng.choice(PARAGRAPHS) + rng.choice(["\n", "\n\n", ""]) for _ in range(rng.randint(0, 9)))) for k in range(1200)] + [(-1, None, None)]
    chunks = spark.createDataFrame(rows, "k int, name string, text string").repartition(3)
    for budget, overlap in ((5, 1), (9, 4), (0, -1)):
        want = L.packed(chunks, ["k"], budget, overlap, count=lambda c: L.words(c)).collect()
        got = L.packed(chunks, ["k", "name"], budget, overlap)
        assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted((r["k"], r["child"], r["run_header"], r["text"]) for r in got.fillna("none").collect()) == sorted((r["k"], r["child"], r["run_header"] or "none", r["text"]) for r in want)
        assert len(want) > 900 and all(r["name"] == str(r["k"]) for r in got.collect())
