"""Operators on small rows with values derived by hand."""

import pytest
from pyspark.sql import functions as F

from siltstone.operators import judge, levels, router, routing, stats, sweep, truth
from siltstone.operators import retrieval as R
from siltstone.operators import understanding as U
from siltstone.plans import store
from siltstone.sources import files


def values(df):
    return sorted(map(tuple, df.collect()), key=str)


def one(spark, column, **row):
    """Value of a column over one row of strings."""
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row)) if row else spark.range(1)
    return df.select(column.alias("v")).first()["v"]


def test_aliases_and_tickers(spark):
    rows = [("NVDA", "NVIDIA Corporation", "NVIDIA Corporation", 0), ("BRK-B", "Berkshire Hathaway Inc.", None, 1), ("SCHW", "Charles Schwab Corp", "The Charles Schwab Corporation", 2), ("CHS", "Charles River Group", "", 3)]
    companies = spark.createDataFrame(rows, "symbol string, shortname string, longname string, ord int")
    alias = dict(values(U.aliases(companies).select("alias", "symbol")))
    assert alias["charles schwab"] == "SCHW" and alias["schwab"] == "SCHW" and alias["charles river"] == "CHS" and "charles" not in alias and alias["berkshire"] == "BRK-B"
    asked = ["margins of (NVDA) now", "SEC rules for BRK-B and NVDA", "Berkshire Hathaway's outlook", "what about Schwab?", "Charles River and Charles Schwab", "outlook for XYZQ.", "is it FOR", "nothing", ""]
    got = dict(values(U.tickers(spark.createDataFrame(list(enumerate(asked)), "key int, query string"), companies)))
    assert [got[k] for k in range(9)] == ["nvda", "brk-b", "brk-b", "schw", "schw", "xyzq", None, None, None]


def test_refusals(spark):
    say = lambda reply: one(spark, U.without_refusal(F.col("r"), F.col("q")), r=reply, q="Apple revenue growth")
    assert say(" Apple net sales ") == "Apple net sales" and say("I cannot help with that") == "Apple revenue growth"
    assert say("Apple revenue by segment, in full. I'm sorry") == "Apple revenue by segment, in full."
    assert say("Sorry, no. However, revenue by year") == "revenue by year" and say("Sorry, no. However, nothing") == "Apple revenue growth"
    calls = []
    rows = U.enhanced(spark.createDataFrame([(1, "a"), (2, "b")], "key int, query string"), lambda q, k: (calls.append(k), F.when((F.col("key") == 1) & F.lit(k == 1), "second"))[1])
    assert values(rows.select("key", "reply")) == [(1, "second"), (2, "b")] and calls == [0, 1, 2]
    assert one(spark, U.real_references(F.array(F.lit("None. "), F.lit(None), F.lit("")))) is False and one(spark, U.real_references(F.array(F.lit("none"), F.lit("p. 4")))) is True


def test_years(spark):
    assert one(spark, U.resolved_years(F.lit("board oversight"))) == [2020, 2021, 2022, 2023, 2024] and one(spark, U.resolved_years(F.lit("FY23"))) == [2023]


def test_headers(spark):
    assert one(spark, levels.strip_running(F.lit("# Table of Contents\n## **table of contents** | Risk\ntext | x"))) == "## Risk\ntext | x"
    lines = lambda md: [r["line"] for r in levels.join_headers(spark.createDataFrame([(1, md)], "k int, md string"), "k", "md").orderBy("pos").collect()]
    assert lines("## A\n\n## B\n### C\ntext") == ["## A | B", levels.ONLY, "### C", "text"]
    assert lines("a\n\nb\n# T\n\n\n") == ["a", "", "b", "# T", levels.ONLY] and lines("#no\n##### deep") == ["#no", "##### deep"]


def test_sections_fold_headers_without_text(spark):
    md = "intro\n# A\n## B\nfirst\n## C\n### D\n#### E\nsecond\n\n# F\n## G"
    docs = spark.createDataFrame([(1, md)], "k int, md string")
    rows = levels.sections(levels.join_headers(docs, "k", "md"), "k").orderBy("ord").collect()
    assert [tuple(r)[2:] for r in rows] == [(None, None, None, None, "intro\n"), ("A", "B", None, None, "first\n"), ("A", "C", "D", "E", "second\n")]


def test_segments_and_packing(spark):
    text = "one two\n\n*Americas*\n\nthree four\nSales\n| a | b |\n|---|---|\n| 1 | 2 |\n\n*1 note.*\n"
    seg = one(spark, levels.segments(F.lit(text)))
    assert [(s["kind"], s["text"], s["caption"]) for s in seg] == [("prose", "one two", ""), ("run_header", "Americas", ""), ("prose", "three four\nSales", ""), ("table", "| a | b |\n|---|---|\n| 1 | 2 |", "Sales"), ("prose", "*1 note.*", "")]
    pack = lambda budget: [(r["child"], r["run_header"], r["text"]) for r in levels.packed(spark.createDataFrame([(1, text)], "k int, text string"), ["k"], budget, 1).orderBy("child").collect()]
    assert pack(100) == [(0, None, text)]
    table = "| a | b |\n|---|---|\n| 1 | 2 |"
    assert pack(12) == [(0, None, "one two"), (1, "Americas", "three four\nSales"), (2, "Americas", "Sales\n" + table)] + [(3, "Americas", "*1 note.*")]
    assert pack(5) == [(0, None, "one two"), (1, "Americas", "three four\nSales"), (2, "Americas", "Sales\n" + table), (3, "Americas", "*1 note.*")]
    long = spark.createDataFrame([(1, "a b c d e f g")], "k int, text string")
    assert [r["text"] for r in levels.packed(long, ["k"], 3, 1).orderBy("child").collect()] == ["a b c", "c d e", "e f g"]


def test_tables(spark):
    p = one(spark, levels.table_parts(F.lit("| h |\n| --- |\n| 1 |\n\n| 2 |\n")))
    assert p["head"] == ["| h |", "| --- |"] and p["rows"] == ["| 1 |", "| 2 |"] and one(spark, levels.table_parts(F.lit("| h |")))["rows"] == []
    rows = spark.createDataFrame([(1, "| h |\n|---|\n| 1 |\n| 2 |\n| a b c d e f g |\n| 3 |", "cap")], "k int, table string, caption string")
    assert [r["text"] for r in levels.split_table(rows, ["k"], 11).orderBy("part").collect()] == ["cap\n| h |\n|---|\n| 1 |\n| 2 |", "cap\n| h |\n|---|\n| a b c d e f g |", "cap\n| h |\n|---|\n| 3 |"]
    assert one(spark, levels.caption(F.lit("a\n Sales \n\n"))) == "Sales" and one(spark, levels.caption(F.lit("\n"))) == ""


def test_levels_have_parents(spark):
    docs = spark.createDataFrame([("d", "# A\n" + "word " * 30), ("e", "")], "doc_id string, md string")
    rows = levels.hierarchy(docs, 20, 5, model=lambda t: F.lit("<summary> s </summary>")).collect()
    ids = {r["id"] for r in rows}
    assert len(ids) == len(rows) and all(r["parent_id"] in ids for r in rows if r["level"] > 0) and [r["level"] for r in rows].count(2) == 2
    assert {r["description"] for r in rows if r["level"] == 3} == {"s", ""} and [r["level"] for r in rows if r["doc_id"] == "e"] == [0]


def test_cover_metadata(spark):
    m = lambda md: tuple(one(spark, levels.document_metadata(F.lit(md))))
    assert m("FORM 10-K/A\nfiscal year ended June 3, 2024\n**Acme Widget, Inc.**\n(Exact name") == ("10-k/a", "06-03-24", "acme widget", None)
    assert m("ANNUAL REPORT\n(Exact name\nBolt Corp. was incorporated in 1990\nsymbol “BLT”") == (None, None, "bolt", "blt") and m("") == (None,) * 4


def test_statistics_and_payload(spark):
    rows = spark.createDataFrame([("a", "S", None, None, None), ("b", "S", "T", None, ""), ("b", None, None, "I", None)], "f string, section string, subsection string, item string, subitem string")
    assert values(levels.chunk_statistics(rows, "f")) == [("a", 1, 1, 0, 0, 0, "!!"), ("b", 2, 1, 1, 1, 0, "")]
    assert values(levels.normal_payload(spark.createDataFrame([(1, " A b ")], "n int, t string"))) == [(1, "a b")]


def test_files(spark, tmp_path):
    (tmp_path / "a.html").write_bytes("é “x”".encode("cp1252"))
    (tmp_path / "b.html").write_bytes("é “x”".encode())
    assert [r["html"] for r in files.html_files(spark, str(tmp_path)).orderBy("path").collect()] == ["é “x”"] * 2
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "x.md").write_text("# A\n\nb\n")
    assert [r["md"] for r in files.markdown_files(spark, str(tmp_path / "m")).collect()] == ["# A\n\nb\n"]
    text = spark.createDataFrame([("k", '{"a": {"0": "x", "10": "z", "2": "y"}, "b": {"2": "w"}}')], "k string, json string")
    assert [tuple(r) for r in files.from_columns(text, "k", ["a", "b", "c"]).orderBy("ord").collect()] == [("k", 0, "x", None, None), ("k", 2, "y", "w", None), ("k", 10, "z", None, None)]
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id int, v string")
    path = str(tmp_path / "set")
    files.append_new(rows, path, ["id"])
    files.append_new(spark.createDataFrame([(2, "z"), (3, "d")], "id int, v string"), path, ["id"])
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [1, 2, 3]
    files.write_levels(rows.withColumn("level", F.lit(1)), None)
    assert values(files.with_ids(rows.where("v = 'a'").withColumn("id", F.lit(None).cast("string")), ["v"]))[0][0] == values(spark.sql("SELECT sha1('a')"))[0][0]


def test_move_is_verified(spark):
    src = spark.createDataFrame([(1, "s"), (2, "s"), (3, "s")], "id int, v string")
    dst = spark.createDataFrame([(2, "old"), (9, "d")], "id int, v string")
    left, there, report = files.move(src, dst, spark.createDataFrame([(1,), (2,), (7,), (1,)], "id int"), "id", "unit-move")
    assert values(left) == [(3, "s")] and values(there) == [(1, "s"), (2, "s"), (9, "d")] and values(report) == [(1, "moved"), (2, "moved"), (7, "missing")]


def test_no_folder_of_our_own_on_a_cluster():
    class Conf:
        get = staticmethod(lambda key, default=None: default)

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(RuntimeError):
        store.shared(Session)


def test_dense_keeps_the_best_of_each_group(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "query_id long, query_vector array<double>")
    v = [(f"c{k:02d}", [1.0, k / 10], "ab"[k % 2]) for k in range(30)] + [("x", None, "a"), ("y", [0.0, 0.0], "a"), ("z", [1.0, 0.0, 0.0], "a"), ("c00b", [2.0, 0.0], "a")]
    vec = spark.createDataFrame(v, "chunk_id string, vector array<double>, g string").repartition(5)
    got = {(r["query_id"], r["g"]): [] for r in R.dense(q, vec, 3, ("g",)).collect()}
    for r in R.dense(q, vec, 3, ("g",)).orderBy(F.desc("score"), "chunk_id").collect():
        got[r["query_id"], r["g"]].append(r["chunk_id"])
    assert got == {(1, "a"): ["c00", "c00b", "c02"], (1, "b"): ["c01", "c03", "c05"], (2, "a"): ["c28", "c26", "c24"], (2, "b"): ["c29", "c27", "c25"]}


def test_most_common(spark):
    assert one(spark, sweep.most_common(F.array(*[F.lit(x) for x in ("en", "fr", "fr", "en", "de")]))) == "en"
    assert one(spark, sweep.most_common(F.array(*[F.lit(x) for x in ("en", "fr", "fr", "fr")]))) == "fr"


def test_pitfalls_and_run_ids(spark):
    assert one(spark, truth.pitfalls(F.lit(2), F.lit("TRUTH_NOT_RETRIEVED"))) == "WRONG_YEAR, TRUTH_NOT_RETRIEVED" and one(spark, truth.pitfalls(F.lit(0), F.lit("-"))) == "-"
    part = lambda x: tuple(one(spark, truth.run_id_parts(F.lit(x))))
    assert part("nvda_2024_header_hybrid_3") == ("nvda", [2024], "hybrid") and part("nvda_2023-2024_header_3") == ("nvda", [2023, 2024], None) and part("None_x") == (None, [], None) and part("aapl") == ("aapl", [], None)
    assert one(spark, truth.field_values(F.lit("['a', \"b\", None]"))) == ["a", "b"] and one(spark, truth.field_values(F.lit("None"))) == [] and one(spark, truth.field_values(F.lit(" x "))) == ["x"]


def test_third_failures(spark):
    rows = [(u, k, f) for u, marks in ((1, "xx.xxxx"), (2, "xx.xx"), (3, "xxx")) for k, f in enumerate(c == "x" for c in marks)]
    got = truth.third_failures(spark.createDataFrame(rows, "u int, k int, f boolean"), ["u"], ["k"], "f")
    assert values(got) == [(1, 5), (3, 2)]


def test_answers(spark):
    rows = spark.createDataFrame([(1, "ctx"), (2, None), (3, "bad")], "finder_id int, context string")
    got = truth.answers(rows, lambda c: F.when(c != "bad", F.concat(F.lit("A: "), c)))
    assert values(got.select("finder_id", "answer")) == [(1, "A: ctx"), (2, truth.NOTHING), (3, "")] and one(spark, truth.shown(F.lit(" "))) == truth.NO_ANSWER


def test_random_chunks_are_the_same_every_time(spark):
    corpus = spark.range(200).select(F.concat(F.lit("c"), "id").alias("chunk_id"))
    draws = spark.range(2000).select(F.col("id").cast("string").alias("draw"))
    a = values(truth.random_chunks(draws, corpus, 8).select("draw", "chunk_id"))
    assert a == values(truth.random_chunks(draws.repartition(7), corpus.repartition(3), 8).select("draw", "chunk_id")) and len(a) == 2000 and len({c for _, c in a}) > 190


def test_judging_is_resumed(spark):
    rows = spark.createDataFrame([(1, "A"), (2, None)], "k int, relevance string")
    assert values(judge.resumed(rows, F.lit("B"))) == [(1, "A"), (2, "B")]
    r = judge.reply(F.lit(2.0), F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(1))
    rel, comp = judge.parse_response(r)
    assert one(spark, F.struct(judge.unswap(rel, F.lit(1)), judge.unswap(comp, F.lit(1)))) == ("A", "Tie")


def test_routes(spark):
    assert one(spark, routing.canonical_items(routing.items_of(F.lit("Financials ")))) == ["7", "7a", "8"] and one(spark, routing.items_title(F.lit("risk"))) == "Item 1a"
    assert tuple(one(spark, routing.oracle_route(F.lit("LEGAL")))) == (["legal"], 1.0, "oracle", "oracle") and one(spark, routing.oracle_route(F.lit("x")))["alpha"] == 0.0
    rows = spark.createDataFrame([(1, "confident", ["a"], 1.0, ["a", "b"]), (2, "ambiguous", ["a", "b"], 1.0, ["a", "b"]), (3, "uncertain", [], 0.0, ["a", "b"]), (4, "uncertain", [], 0.0, ["a", "b"])], "k int, band string, categories array<string>, alpha double, candidates array<string>")
    model = lambda c: F.when(F.col("k") == 2, '{"categories": ["b"]}').when(F.col("k") == 3, '{"categories": []}').otherwise("?")
    assert values(routing.routed(rows, model).select("k", "source", "categories", "alpha")) == [(1, "classifier", ["a"], 1.0), (2, "llm", ["b"], 1.0), (3, "llm", [], 0.0), (4, "fallback", [], 0.0)]
    assert [r[0] for r in values(routing.routed(rows).select("source"))] == ["classifier", "fallback", "fallback", "fallback"]
    alpha = lambda s, r, c: one(spark, routing.effective_alpha(F.lit(s), F.lit(r), F.array(*[F.lit(x) for x in c]).cast("array<string>")))
    assert (alpha(1.0, 1.0, ["a"]), alpha(1.0, 1.0, []), alpha(1.0, 0.0, ["a"]), alpha(0.5, 0.5, ["a"])) == (1.0, 0.0, 0.0, 0.25)


def test_route_guards(spark):
    q = spark.createDataFrame([(1,), (2,)], "k int")
    routes = lambda *f: spark.createDataFrame([(i + 1, x) for i, x in enumerate(f)], "k int, fingerprint string")
    assert routing.guarded(q, routes("a", "a"), "k").count() == 2
    for bad in (routes("a"), routes("a", "b")):
        with pytest.raises(Exception, match="route"):
            routing.guarded(q, bad, "k").collect()
    old = spark.createDataFrame([(1, "x", "now"), (2, "x", "old"), (3, "x", None)], "k int, band string, fingerprint string")
    new = spark.createDataFrame([(k, "y", "?") for k in (1, 2, 3)], "k int, band string, fingerprint string")
    assert values(routing.backfilled(old, new, "k", "now")) == [(1, "x", "now"), (2, "y", "now"), (3, "y", "now")]


def test_router_learns(spark):
    rows = [(i, f"what about {w} now {i % 7}", c) for i, (w, c) in enumerate([("debt and notes", "a"), ("board members", "b"), ("lawsuit claims", "c")] * 12)]
    df = router.vectors(spark.createDataFrame(rows, "id int, text string, label string")).cache()
    names = router.classes(df, "label")
    p = router.out_of_fold(df, "label", names, 3)
    best = {r["id"]: r["c"] for r in p.groupBy("id").agg(F.max_by("class", "p").alias("c")).collect()}
    assert names == ["a", "b", "c"] and sum(best[i] == c for i, _, c in rows) / len(rows) > 0.95
    model = router.fit(router.numbered(df, "label", names))
    terms = {(r["id"], r["class"]): r["terms"] for r in router.evidence(model, spark.createDataFrame([(0, "the board members met")], "id int, text string"), df.select("id", "text"), names).collect()}
    assert "board" in terms[0, "b"] and "board" not in terms.get((0, "a"), [])


def test_tests_of_ranking(spark):
    rows = [(q, c, q / 100 + {"a": 0.3, "b": 0.29 + 0.02 * (q % 2), "z": 0.0}[c]) for q in range(12) for c in "abz"]
    runs = spark.createDataFrame(rows, "finder_id int, config_key string, word_recall double")
    sep = {r["config_key"]: r for r in stats.separation(runs).collect()}
    assert sep["a"]["leading"] and sep["b"]["leading"] and not sep["z"]["leading"] and sep["z"]["place"] == 3
    vs = {r["config_key"]: r for r in stats.versus_baseline(runs, "z").collect()}
    assert set(vs) == {"a", "b"} and all(r["beats"] and abs(r["mean_delta"] - 0.3) < 1e-6 for r in vs.values())
    assert {r["arm"] for r in stats.pooled(runs, "z").collect()} == {"leader", "top3"} and {r["d"] for r in stats.pooled(runs, "z").where("arm = 'top3'").collect()} <= {0.295, 0.305}


def test_arms(spark):
    rows = [(1, m, l, e, a, 0.1 * (m == "hybrid") + 0.2 * (l > 1) + 0.05 * e) for m in ("dense", "sparse", "hybrid") for l in (1, 2, 3) for e in (0, 1) for a in (0, 1)]
    got = {r["contrast"]: (round(r["d"], 6), r["crossed"]) for r in stats.arms(spark.createDataFrame(rows, "finder_id int, mode string, level int, enhance int, alpha int, v double"), ("v",)).collect()}
    assert got == {"hybrid - sparse": (0.1, True), "dense - sparse": (0.0, True), "hybrid - dense": (0.1, True), "children - level 1": (0.2, True), "level 3 - level 2": (0.0, True), "enhanced - plain": (0.05, True), "alpha 1 - alpha 0": (0.0, True)}


def test_binomial_p_of_many(spark):
    p = lambda g, l: one(spark, stats.binomial_p(F.lit(g).cast("long"), F.lit(l).cast("long")))
    assert abs(p(8, 2) - 0.109375) < 1e-9 and p(5, 5) == 1.0 and p(0, 0) == 1.0 and abs(p(60, 30) - 0.00206027) < 1e-7 and 0 < p(10_000, 9_000) < 1e-11
