"""Pruned BM25 against the full scores."""

import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import retrieval as R


def corpus(seed, n=900):
    """Chunks of a few common and many rare words, with copies; questions of both, one of common words alone, one of a single hot word."""
    rng = random.Random(seed)
    common, rare = ["the", "of", "and", "net"], [f"w{k}" for k in range(500)]
    text = lambda n: " ".join(rng.choice(common) if rng.random() < 0.6 else rng.choice(rare) for _ in range(n))
    chunks = [(f"c{k:05d}", text(rng.randint(1, 40)), "abc"[k % 3]) for k in range(n)]
    chunks += [(f"d{k:05d}", "the same rare w7 w8 w9", "a") for k in range(60)]
    asked = [(k, text(12), rng.choice([None, "a", "b"])) for k in range(25)]
    return chunks, [*asked, (90, "the of and", None), (91, "the", "b"), (92, "w7 w8", None), (93, "nothing here", None), (94, "", None), (95, "the of w3 w3", "zz")]


@pytest.mark.parametrize("size,k", [(1024, 10), (16, 10), (8, 1), (1, 3)])
def test_best_chunks_are_those_of_all_scores(spark, monkeypatch, size, k):
    monkeypatch.setattr(R, "BLOCK_CHUNKS", size)
    chunks, asked = corpus(size + k)
    rows = spark.createDataFrame(chunks, "chunk_id string, text string, section string")
    queries = spark.createDataFrame(asked, "query_id long, text string, section string")
    index, stats = R.postings(rows, ("section",)), R.corpus_stats(rows)
    every = R.bm25(queries, index, stats, keep=("section",)).join(queries.select("query_id", F.col("section").alias("only")), "query_id")
    full = R.top(every.where("only IS NULL OR only = section").drop("only"), k).select("query_id", "chunk_id", "section", "rank", "score")
    got = R.bm25_top(queries, index, stats, k, ("section",), "section")
    want = {(r["query_id"], r["rank"]): (r["chunk_id"], r["section"], round(r["score"], 5)) for r in full.collect()}
    assert {(r["query_id"], r["rank"]): (r["chunk_id"], r["section"], round(r["score"], 5)) for r in got.collect()} == want
    free = R.bm25_top(queries.drop("section"), R.postings(rows), stats, k)
    want = {(r["query_id"], r["rank"]): r["chunk_id"] for r in R.top(R.bm25(queries, R.postings(rows), stats), k).collect()}
    assert {(r["query_id"], r["rank"]): r["chunk_id"] for r in free.collect()} == want


def test_common_words_make_no_candidates(spark, monkeypatch):
    """Chunks that share common words alone with a question are not candidates of it."""
    from siltstone.plans import store

    kept, write = {}, store.written

    def written(df, name):
        out = write(df, name)
        kept[name] = out
        return out

    monkeypatch.setattr(store, "written", written)
    rows = spark.createDataFrame([(f"c{k}", "the of and " * (1 + k % 3) + (f"w{k % 100}" if k % 4 else ""), "a") for k in range(800)], "chunk_id string, text string, section string")
    asked = spark.createDataFrame([(1, "the of and w1 w2 w3")], "query_id long, text string")
    assert R.bm25_top(asked, R.postings(rows), R.corpus_stats(rows), 5).count() == 5
    assert kept["candidates"].count() <= 24 and kept["weighted-postings"].count() > 2400


@pytest.mark.parametrize("size,k,texts", [(16384, 10, 2048), (16, 10, 4), (8, 1, 2048), (1, 3, 7)])
def test_best_chunks_from_the_texts_are_those_of_all_scores(spark, monkeypatch, size, k, texts):
    monkeypatch.setattr(R, "ROW_BLOCK", size)
    monkeypatch.setattr(R, "TEXT_BLOCK", texts)
    chunks, asked = corpus(size + k)
    chunks += [("e1", None, "a"), ("e2", "THE É-W7 ß9\tİx Σ.w8 w9", "b"), ("e3", "", None), ("e4", "w3 w3 w3", None)]
    rows = spark.createDataFrame(chunks, "chunk_id string, text string, section string").repartition(3)
    queries = spark.createDataFrame([*asked, (96, "the É ß9 İX", None), (97, "the of and", "a")], "query_id long, text string, section string")
    every = R.bm25(queries, R.postings(rows, ("section",)), R.corpus_stats(rows), keep=("section",)).join(queries.select("query_id", F.col("section").alias("only")), "query_id")
    full = R.top(every.where("only IS NULL OR only = section").drop("only"), k)
    want = {(r["query_id"], r["rank"]): (r["chunk_id"], r["section"], round(r["score"], 5)) for r in full.collect()}
    got = R.bm25_texts(queries, rows, k, ("section",), "section").collect()
    assert {(r["query_id"], r["rank"]): (r["chunk_id"], r["section"], round(r["score"], 5)) for r in got} == want and len(got) == len(want)


def test_no_posting_is_a_row(spark, monkeypatch):
    """A chunk is one row, however many words of questions it holds, and what tasks yield are at most k rows of a query."""
    from siltstone.plans import store

    kept, write = {}, store.written
    monkeypatch.setattr(store, "written", lambda df, name: kept.setdefault(name, write(df, name)))
    rows = spark.createDataFrame([(f"c{k}", "the of and net " * (1 + k % 3) + f"w{k % 100}") for k in range(800)], "chunk_id string, text string").repartition(4)
    asked = spark.createDataFrame([(q, "the of and net w1 w2 w3") for q in range(6)], "query_id long, text string")
    assert R.bm25_texts(asked, rows, 5).count() == 30
    assert kept["words-held"].count() == 800 and kept["candidates"].count() <= 4 * 5 * 6 and "postings" not in kept


@pytest.mark.parametrize("size,k,texts", [(16384, 10, 2048), (8, 1, 5)])
def test_texts_and_their_lines_from_one_pass(spark, monkeypatch, size, k, texts):
    """Lines of a text are scored as chunks of their own, from the same rows of counts as the texts."""
    from siltstone.plans import store

    kept, write = [], store.written
    monkeypatch.setattr(store, "written", lambda df, name: kept.append(name) or write(df, name))
    monkeypatch.setattr(R, "TEXT_ROWS", 7)
    monkeypatch.setattr(R, "ROW_BLOCK", size)
    monkeypatch.setattr(R, "TEXT_BLOCK", texts)
    chunks, asked = corpus(size + k)
    docs = [(f"d{k:08d}", "\n".join(c[1] for c in chunks[k : k + k % 9]), "abc"[k % 3]) for k in range(0, len(chunks), 9)]
    docs += [("e1", None, "a"), ("e2", "", "b"), ("e3", "\n the É-W7\n\n  \n\t\n..\nw8 ΑΣ\nΑΣ' w9\n", "b"), ("e4", "w3\rw3\x0bof\n", None), ("e5", "the of\r\nİx w7", "a")]
    rows = spark.createDataFrame(docs, "chunk_id string, text string, section string").repartition(3)
    queries = spark.createDataFrame([*asked, (96, "the É ας İX", None)], "query_id long, text string, section string")
    lines = rows.select("chunk_id", "section", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "text")).where(F.trim("text") != "")
    lines = lines.withColumn("chunk_id", F.concat("chunk_id", F.format_string("/%06d", "pos")))
    got = R.bm25_texts_and_lines(queries, rows, k, ("section",), "section")
    assert kept.count("words-held") == (1 if texts == 2048 else max(kept.count("candidates") // 2, 2))
    for own, found in zip((rows, lines), got, strict=True):
        every = R.bm25(queries, R.postings(own, ("section",)), R.corpus_stats(own), keep=("section",)).join(queries.select("query_id", F.col("section").alias("only")), "query_id")
        full = R.top(every.where("only IS NULL OR only = section").drop("only"), k)
        want = {(r["query_id"], r["rank"]): (r["chunk_id"], r["section"], round(r["score"], 5)) for r in full.collect()}
        assert {(r["query_id"], r["rank"]): (r["chunk_id"], r["section"], round(r["score"], 5)) for r in found.collect()} == want


def test_the_sweep_cuts_texts_into_words_once(spark, monkeypatch):
    """Documents and lines are scored from one table of counts."""
    from siltstone.operators import sweep
    from siltstone.plans import store

    kept, write = [], store.written
    monkeypatch.setattr(store, "written", lambda df, name: kept.append(name) or write(df, name))
    sweep._tracks(spark, "/root/testdata/sf0.001")
    assert kept.count("words-held") == 1


def test_only_texts_that_were_found_are_shuffled(spark, monkeypatch):
    from siltstone.operators import sweep

    found = spark.createDataFrame([(0, "d00000001"), (0, "d00000002"), (1, "d00000001"), (2, "d00000003/000000")], "finder_id long, chunk_id string")
    monkeypatch.setattr(sweep, "results", lambda *_: found)
    rows = sweep._relevance(spark, "/root/testdata/sf0.001")
    assert "LeftSemi" in rows._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.finder_id, r.chunk_id) for r in rows.collect()} == {(0, "d00000001"), (0, "d00000002"), (1, "d00000001")}


@pytest.mark.parametrize("lines", [False, True])
def test_some_bytes_of_texts_are_cut_at_once(monkeypatch, lines):
    """Words, lines and counts are those of cutting text by text; rows come from at most ``TEXT_BYTES`` bytes, or one text."""
    import collections
    import re

    import pyarrow as pa

    monkeypatch.setattr(R, "TEXT_BYTES", 60)
    rng = random.Random(5)
    pieces = ["w1", "w2", "the", "é9", "İx".lower(), " ", "  ", "\n", "\n\n", "\t", "\r", ".", "--", "\x00", "\x7f", "zz"]
    texts = ["", "\n", " ", "..", "w1", "w1\n", "\nw2 w1\n \n\t\nw1w2 the", "the " * 40, *("".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(200))]
    code = {w.encode(): i for i, w in enumerate(["the", "w1", "w2", "é9"], 1)}
    batch = pa.record_batch({"chunk_id": [f"c{k}" for k in range(len(texts))], "section": ["abc"[k % 3] for k in range(len(texts))], "text": pa.array([t.encode() for t in texts], pa.binary())})
    got = list(R._words_held(code, ("section",), lines)(iter([batch.slice(0, 9), batch.slice(9, 0), batch.slice(9)])))

    def row(level, name, section, text):
        words = [w.encode() for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", text) if w]
        held = sorted(collections.Counter(code[w] for w in words if w in code).items())
        return {"__level": level, "chunk_id": name, "section": section, "dl": len(words), "terms": [t for t, _ in held], "counts": [c for _, c in held]}

    rows = [(f"c{k}", "abc"[k % 3], t) for k, t in enumerate(texts)]
    assert [r for b in got for r in b.to_pylist() if r["__level"] == 1] == [row(1, *r) for r in rows]
    inner = [row(2, f"{n}/{pos:06d}", s, line) for n, s, t in rows for pos, line in enumerate(t.split("\n")) if line.strip(" ")]
    assert [r for b in got for r in b.to_pylist() if r["__level"] == 2] == (inner if lines else [])
    size = {n: len(t.encode()) for n, _, t in rows}
    cut = [[size[n] for n in b.column("chunk_id").to_pylist()] for b in got if b.column("__level")[0].as_py() == 1]
    assert max(sum(x) for x in cut if len(x) > 1) <= 60 and sum(map(len, cut)) == len(texts)
