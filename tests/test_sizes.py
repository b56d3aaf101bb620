"""What larger tables brought up."""

import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from siltstone.operators import levels as L
from siltstone.operators import markup, router, routing
from siltstone.operators import retrieval as R
from siltstone.plans import level_queries, markup_queries, store


def test_shares_in_messages_round_halves_as_the_sql_does(spark):
    told = dict(duckdb.connect().execute("SELECT k, printf('%.2f', round_even(k / 10000.0::DOUBLE, 2)) FROM range(0, 10001) t(k)").fetchall())
    rows = spark.range(0, 10001).select("id", routing.two_digits(F.round(F.col("id") / 10000.0, 4)).alias("p")).collect()
    assert {r["id"]: r["p"] for r in rows} == told


def test_plain_pages_read_like_the_tolerant_parser_has_them():
    """Pages of plain parts don't go through the parser; whatever else is in them, both ways give the same text."""
    rng = random.Random(3)
    names = [*"p b li ul ol table tr td h1 div script nav i tbody title style noscript TD textarea plaintext br/".split(), 'td colspan="2"', 'p class="a&amp;b" id="x"', "script "]
    parts = [f"<{s}{t}>" for t in names for s in ("", "/")] + ["word", " ", "&amp;", "&", "<", ">", "|", "\n", "&lt", "&#65;", "<!-- c -->", "<!---->", "<script>if (a<b) x='</p>'</script>", "<title>a&amp;b</title>", "<style>p{}</STYLE>", "\xa0"]
    short = 0
    for k in range(6000):
        page = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14 if k % 2 else 6)))
        whole = markup.Markdown()
        whole.feed(page)
        assert markup.to_markdown(page) == whole.result()
        short += markup.Markdown().plain(page)
    assert short > 1000


def test_heading_lines_go_to_many_tasks_and_name_their_lines_once(spark):
    df = markup_queries.headed(spark, "/root/testdata/sf0.001")
    assert df.rdd.getNumPartitions() >= 4
    plan = spark.range(1).select(markup.enriched(F.lit("a").cast("string"))).columns[0]
    assert plan.count("regexp_replace(coalesce") <= 1


def test_vocabularies_are_never_broadcast(spark):
    texts = spark.createDataFrame([(i, f"word{i % 3} and word{i % 5} again") for i in range(40)], "id long, text string")
    for df in (router.vectors(texts), router.held_out(texts, texts.where("id < 5"), "id", "text")):
        assert df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert "SortMergeJoin" in plan
        assert plan.count("BroadcastHashJoin") == (df.columns == ["text", "id"])  # the second join of held_out: groups are few


def test_bm25_makes_no_row_for_a_query_and_a_chunk(spark, monkeypatch):
    """However many chunks hold a question's words, tasks yield at most k of each question."""
    kept, write = {}, store.written

    def written(df, name):
        kept[name] = write(df, name)
        return kept[name]

    monkeypatch.setattr(store, "written", written)
    rows = spark.createDataFrame([(f"c{i:05d}", f"alpha beta w{i % 7} w{i % 11}") for i in range(5000)], "chunk_id string, text string")
    asked = spark.createDataFrame([(i, f"alpha w{i % 7} w{i % 11}") for i in range(30)], "query_id int, text string")
    index, stats = R.postings(rows), R.corpus_stats(rows)
    got = R.bm25_top(asked, index, stats, 3)
    best = R.top(R.bm25(asked, index, stats), 3)
    assert sorted(map(tuple, got.select("query_id", "rank", "chunk_id").collect())) == sorted(map(tuple, best.select("query_id", "rank", "chunk_id").collect()))
    assert kept["candidates"].count() <= 3 * 30 * max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))


def test_vectors_make_no_row_for_a_text_and_a_term(spark):
    """The features are those of the definition by rows (tfidf), whatever the text, and no class's rows meet in one window to be dealt to folds."""
    odd = ["", None, "a", "Éa éA  x1_y\tZz", " wide space\x0bend", "# # ##", "İstanbul ΣΑΣ", "same words, same words", "it's a_b\n\nit's", "\U0001f600 ok ok"]
    texts = spark.createDataFrame([(i, odd[i % 10] if i < 20 else f"word{i % 3} and {odd[i % 10]} again{i % 5}", "ab"[i % 2]) for i in range(60)], "id long, text string, label string")
    df = router.vectors(texts)
    parts = router.tfidf(texts).unionByName(router.tfidf(texts, terms=router.char_terms).withColumn("term", F.concat(F.lit("#"), "term")))
    want = {}
    for r in parts.select("id", F.pmod(F.xxhash64("term"), F.lit(router.SLOTS)).alias("slot"), "weight").collect():
        want[r["id"], r["slot"]] = want.get((r["id"], r["slot"]), 0) + r["weight"]
    rows = df.collect()
    got = {(r["id"], int(i)): v for r in rows for i, v in zip(r["features"].indices, r["features"].values, strict=True)}
    assert len(rows) == 60 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert "Generate" not in df._jdf.queryExecution().executedPlan().toString()
    folds = router.dealt(texts, "label")
    assert "windowspecdefinition(label" not in folds._jdf.queryExecution().analyzed().toString()
    order = {c: sorted((r["id"] for r in texts.collect() if r["label"] == c), key=lambda i: hashlib.md5(str(i).encode()).hexdigest()) for c in "ab"}
    assert {r["id"]: r["fold"] for r in folds.collect()} == {i: k % 5 for ids in order.values() for k, i in enumerate(ids)}


def test_descriptions_are_the_third_level_and_nothing_is_written_for_them(spark, monkeypatch):
    docs = level_queries.filings(spark, "/root/testdata/sf0.001")
    full = sorted(map(tuple, L.hierarchy(docs, 30, 10, model=level_queries.model).where("level = 3").collect()), key=str)
    before = len(store._built)
    monkeypatch.setattr(store, "written", None)
    own = L.described(docs, level_queries.model, 30, 10)
    assert sorted(map(tuple, own.select("id", "level", "doc_id", "parent_id", *L.LEVELS, "run_header", "text", "description").collect()), key=str) == full and full
    assert level_queries.QUERIES["c19_descriptions"](spark, "/root/testdata/sf0.001").collect() and len(store._built) == before
    with pytest.raises(Exception, match="without document"):
        L.described(spark.createDataFrame([(None, "# A\ntext")], "doc_id string, md string"), level_queries.model).collect()
