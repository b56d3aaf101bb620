"""Routing, passage lookup and chunking against values derived by hand or by plain loops."""

import datetime
import random

from pyspark.sql import functions as F

from siltstone.operators import filings as H
from siltstone.operators import routing as T
from siltstone.operators import truth


def test_headings_reset_deeper_ones(spark):
    md = "lead\n# A\na1\n## B\n### C\nc1\nc2\n# D\nd1\n**Bold head**\ne1"
    rows = H.header_chunks(spark.createDataFrame([(1, md), (2, ""), (3, None)], "k int, md string"), "k", "md").orderBy("chunk").collect()
    got = [(r.section, r.subsection, r.item, r.paragraphs) for r in rows]
    assert got == [(None, None, None, ["lead"]), ("A", None, None, ["a1"]), ("A", "B", "C", ["c1", "c2"]), ("D", None, None, ["d1"]), ("D", None, "Bold head", ["e1"])]


def test_packing_is_greedy_and_loses_no_word(spark):
    draw = random.Random(1)
    paragraphs = [" ".join(f"w{k}-{i}" for i in range(draw.choice([1, 5, 20, 90]))) for k in range(60)]
    df = spark.createDataFrame([(1, 0, paragraphs)], "k int, chunk int, paragraphs array<string>")
    got = [r.text for r in H.children(df, "k", 30, 10).orderBy("child").collect()]
    want, used = [], 0
    for p in paragraphs:
        words = p.split()
        for s in [0] if len(words) <= 30 else range(0, len(words) - 10, 20):
            piece = words[s : s + 30]
            if not want or used + len(piece) > 30:
                want.append([])
                used = 0
            want[-1].append(" ".join(piece))
            used += len(piece)
    assert got == ["\n\n".join(g) for g in want]
    assert set(" ".join(got).split()) == set(" ".join(paragraphs).split())


def test_markdown_and_titles(spark):
    html = "<html><head><title>x</title></head><body><script>var t='</p>';</script><h2 class=a> T &amp; U</h2><p>one <b>two</b><br>three<ul><li>i</li></ul></body>"
    row = spark.createDataFrame([(html, "nvda", "Risk", None)], "html string, ticker string, item string, subitem string").select(H.markdown(F.col("html")).alias("md"), H.title("ticker", "item", "subitem").alias("t")).first()
    assert row.md == "## T & U\n\none **two**\n\nthree\n\n- i" and row.t == "title: ticker: nvda, item: Risk"
    dates = spark.createDataFrame([("09-30-23",), ("09-30-2023",), ("13-40-23",), ("",), (None,)], "d string").select(H.fiscal_date(F.col("d")).alias("d")).collect()
    assert [r.d for r in dates] == [datetime.date(2023, 9, 30)] * 2 + [None] * 3


def test_thresholds_and_bands(spark):
    rows = spark.createDataFrame([(0.9, True), (0.8, True), (0.7, False), (0.6, True), (0.5, False)], "s double, ok boolean")
    assert T.lowest_threshold(rows, "s", "ok", 0.75, 2).first().tau == 0.6
    assert T.lowest_threshold(rows.where("false"), "s", "ok", 0.75, 2).first().tau == float("inf")
    shares = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.1), (2, "b", 0.5), (2, "a", 0.4), (2, "c", 0.1), (3, "a", 0.4), (3, "b", 0.3), (3, "c", 0.3)], "finder_id int, class string, p double")
    got = {r.finder_id: (r.band, r.categories, r.alpha) for r in T.decide(T.top_two(shares), 0.85, 0.85).collect()}
    assert got == {1: ("confident", ["a"], 1.0), 2: ("ambiguous", ["b", "a"], 1.0), 3: ("uncertain", [], 0.0)}


def test_replies(spark):
    texts = ['{"categories": ["b", "A "]}', '{"categories": ["z"]}', "nothing", None, '{"categories": ["b"], "reason": "cut o', '{"categories": []}']
    df = spark.createDataFrame([(t,) for t in texts], "r string").select(T.chosen_categories(F.col("r"), F.array(F.lit("a"), F.lit("b"))).alias("c"))
    assert [r.c for r in df.collect()] == [["a", "b"], None, None, None, ["b"], []]


def test_lookup_by_opening_and_numbers(spark):
    opening = "The quick brown fox jumps over the lazy dog near the river bank "
    corpus = spark.createDataFrame([("c1", opening + "X"), ("c2", opening + "and back again " * 20), ("c3", "11.5 22.5 33.5 44.5 2023"), ("c4", "11.5 22.5 99.1 98.1"), ("c5", None), ("c6", "")], "chunk_id string, text string")
    asked = spark.createDataFrame([(1, opening.upper() + " and back  again " * 20), (2, "was 11.5, 22.5, 33.5, 44.5 and 7"), (3, ""), (4, None)], "finder_id int, truth string")
    assert {(r.finder_id, r.chunk_id) for r in truth.truth_chunks(asked, corpus).collect()} == {(1, "c2"), (2, "c3")}
    assert truth.truth_chunks(asked.where("false"), corpus).count() == 0


def test_openings_are_those_of_the_normal_form(spark):
    from siltstone.functions import text as X

    nasty = ["", " ", "\n\t", None, "a", " \u00a0 B  c\td\r\n ", "ΑΣ" + "'" * 30 + "Α ΑΣ", "İİİ İstanbul " * 9, "x" * 700, "\U0001f600 " * 300, "word\x0b\x0c two " * 40, ("ab " * 3 + "\n" * 500) * 9, " " * 900 + "Late words " * 30]
    df = spark.createDataFrame([(t,) for t in nasty], "t string")
    for k in (1, 3, 50, 200):
        for r in df.select(X.opening("t", k).alias("a"), F.substring(X.normal("t"), 1, k).alias("b"), "t").collect():
            assert r.a == r.b, (k, r.t)


def test_only_openings_are_brought_to_normal_form(spark):
    """What lies behind the opening of a long text isn't gone through for its prefixes."""
    corpus = spark.createDataFrame([("c1", "Word  of " * 500), ("c2", "Words of " * 500)], "chunk_id string, text string")
    found = truth.by_prefix(corpus.limit(1).select(F.lit(1).alias("finder_id"), F.col("text").alias("truth")), corpus)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == plan.count("regexp_replace(regexp_extract(") > 0
    assert [(r.finder_id, r.chunk_id) for r in found.collect()] == [(1, "c1")]
