"""Manifest, language identification and ranked search against brute force in plain Python, and odd inputs."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import langid, lexical, merkle

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves, fanout):
    """Root, and the siblings (left, right) of each leaf by level."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        runs = [level[k : k + fanout] for k in range(0, len(level), fanout)]
        for leaf, node in enumerate(at):
            run, slot = runs[node // fanout], node % fanout
            paths[leaf].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
            at[leaf] = node // fanout
        level = [digest(*run) for run in runs]
    return level[0] if level else None, paths


def manifest_of(rows, fanout):
    """(doc_id, leaf) -> (subroot, root, proof, folded, verified) in plain Python; rows are (doc_id, text, lang, source, n_chars)."""
    show = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, t, g, s, n: digest(*map(show, (d, s, g, n, t)))
    by = {}
    for d, t, g, s, n in rows:
        bad = d is not None and n is not None and zlib.crc32(str(d).encode()) % 7 == 0
        by.setdefault(g, []).append((-1 if d is None else d, leaf(d, t, g, s, n), leaf(d, t, g, s, n + 1) if bad else None, d))
    order = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    found = {g: tree([x[1] for x in sorted(by[g], key=lambda x: x[:2])], fanout) for g in order}
    root, over = tree([found[g][0] for g in order], fanout)
    out = []
    for k, g in enumerate(order):
        for (_, own, checked, d), path in zip(sorted(by[g], key=lambda x: x[:2]), found[g][1], strict=True):
            whole, node = path + over[k], checked or own
            for left, right in whole:
                node = digest(left, node, right)
            out.append((d, own, found[g][0], root, digest(*[a + b for a, b in whole]), node, node == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("fanout,block", [(2, 512), (2, 4), (3, 9)])
def test_manifest_is_the_tree(spark, monkeypatch, fanout, block):
    monkeypatch.setattr(merkle, "BLOCK", block)
    rng = random.Random(fanout * block)
    rows = [(d, rng.choice([None, "", "text é😀 " * rng.randint(1, 4)]), g, rng.choice([None, "", "s"]), rng.choice([None, 0, 12])) for g, n in (("en", 150), ("fr", 8), (None, 5), ("", 1), ("é", 27), ("z", 2)) for d in rng.sample(range(10_000), n)]
    rows += [(None, "a", "en", "s", 1), (None, "b", "en", "s", 1), (77, "same", "de", None, 3), (77, "same", "de", None, 3), (77, "other", "de", None, 3)]
    docs = spark.createDataFrame(rows, DOCUMENTS).withColumns({c: F.lit(1) for c in ("tree", "place", "hash", "block", "row")}).repartition(5)
    got = merkle.manifest(docs, fanout).collect()
    assert sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in got), key=str) == manifest_of(rows, fanout)


def test_manifest_of_no_rows_and_of_one(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCUMENTS)).count() == 0
    one = merkle.manifest(spark.createDataFrame([(3, "x", "en", "s", 1)], DOCUMENTS)).first()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] == digest("1:3", "1:s", "2:en", "1:1", "1:x") and one["verified"] and one["proof_sha256"] == digest()


# --- ranked search


def ranking(docs, items, k=10):
    term = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    bags = [(d, Counter(term(t))) for d, t in docs]
    n_docs, n_words = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(term(t))
    out = []
    for i, words in asked.items():
        scored = []
        for d, b in bags:
            m = 10 + (90 * sum(b.values()) * n_docs) // max(n_words, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 8 * m)) for t in words if t in b)
            if s > 0:
                scored.append((-s, d is None, d))
        out += [(i, r, d, -s) for r, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def test_search_is_the_full_ranking(spark, monkeypatch):
    rng = random.Random(5)
    words = ["The", "the", "über", "x1", "日本", "naïve", "of", "é", *[f"w{k}" for k in range(30)]]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", "_", ", ", "\n", "--"]) for _ in range(n))
    docs = [(d, text(rng.randint(0, 25))) for d in rng.sample(range(5000), 300)]
    docs += [(9000 + k, "the same words w1 w2") for k in range(40)] + [(None, "the same words w1 w2"), (None, text(9)), (17000, None), (17001, ""), (17002, "!!!")]
    docs += [(20000, "w3 w4"), (20000, "w3 w4"), (20000, "w3 w5 w5"), (20001, "w7 " * 30_000)]
    items = [(k, text(6)) for k in range(25)] + [(None, "w1 w2 absent"), (90, None), (91, "absent words"), (92, "w1"), (92, "w2 the"), (93, "w7")]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit("x"), "item_id": F.lit(1), "class": F.lit(2), "n": F.lit(3)}).repartition(6)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns({"term": F.lit("t"), "rank": F.lit(0)})
    for terms, cells in ((lexical.BLOCK_TERMS, lexical.CELLS), (7, 50)):
        monkeypatch.setattr(lexical, "BLOCK_TERMS", terms)
        monkeypatch.setattr(lexical, "CELLS", cells)
        got = [tuple(r) for r in lexical.search(table, asked).collect()]
        assert sorted(got, key=str) == ranking(docs, items)
    assert lexical.search(table.limit(0), asked).count() == 0 and lexical.search(table, asked.limit(0)).count() == 0


def test_scores_are_added_in_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    pairs = np.unique(rng.integers(0, 20, (150, 2)), axis=0)
    one = lexical.Postings(pairs, rng.integers(0, 20_000, 20), 20)
    row, ids = np.repeat(np.arange(30), 4), rng.integers(0, 20, 120)
    tfs, m = rng.integers(1, 2_000_000, 120), np.repeat(rng.integers(10, 10_000, 30), 4)
    whole = one.scores(row, ids, tfs, m, 30)
    monkeypatch.setattr(lexical, "PIECE", 3)
    assert (one.scores(row, ids, tfs, m, 30) == whole).all() and whole.max() > 0
    want = np.zeros((30, 20))
    for a, b, c, d in zip(row, ids, tfs, m, strict=True):
        for i, t in pairs:
            if t == b:
                want[a, i] += int(one.weights[b]) * ((10**9 * int(c)) // (1000 * int(c) + 8 * int(d)))
    assert (whole == want).all()


# --- language


def test_gradients_are_differences():
    rng = np.random.default_rng(0)
    net = langid.fresh(["a", "b", "c"], 4, 1)
    net = langid.Network(net.languages, *[p.astype(np.float64) for p in net.arrays()])
    windows, labels = rng.integers(0, 256, (6, 11)).astype(np.int16), np.array([0, 1, 2, 0, 1, 2])
    windows[2, 5:] = langid.PAD
    found = langid.gradients(net, windows, labels)[1]
    for p, g in zip(net.arrays(), found, strict=True):
        for at in itertools.islice(zip(*np.unravel_index(np.argsort(-np.abs(g), axis=None), g.shape), strict=True), 3):
            was, ends = p[at], []
            for step in (1e-3, -1e-3):
                p[at] = was + step
                ends.append(langid.gradients(net, windows, labels)[0])
            p[at] = was
            assert abs((ends[0] - ends[1]) / 2e-3 - g[at]) < 1e-4 + 0.01 * abs(g[at])


def test_reader_is_the_network():
    rng = np.random.default_rng(2)
    net = langid.fresh(["a", "b", "c"], 5, 3)
    windows = rng.integers(0, 257, (40, 13)).astype(np.int16)
    logs = langid.log_softmax(langid.forward(net, windows) @ net.out + net.base) * (windows.T != langid.PAD)[..., None]
    assert np.abs(logs.sum(axis=0) - langid.Reader(net).sums(windows)).max() < 1e-3


def test_every_byte_is_read_once(monkeypatch):
    """Long texts in pieces give what whole ones give."""
    reader = langid.Reader(langid.fresh(["a", "b"], 3, 4))
    texts = ["abc é " * 500, None, "", "12 34", "x", "yz " * 900, "ü" * 700]
    whole = langid.document_scores(reader, texts, 2)
    monkeypatch.setattr(langid, "GATHERED", 300)
    monkeypatch.setattr(langid, "TOGETHER", 3)
    pieces = langid.document_scores(reader, texts, 2)
    assert whole[0] == pieces[0] and np.allclose(whole[1], pieces[1], atol=1e-5) and whole[0][1:4] == [-1, -1, -1] and whole[1][1:4] == [0.0, 0.0, 0.0]


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(4)
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    held = docs.where(langid.held_out()).select("doc_id", "lang").collect()
    assert len(got) == 1000 and sum(r["held_out"] for r in got.values()) == len(held) and all(0 <= r["score"] <= 1 for r in got.values())
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) >= 0.99 * len(held)


def test_language_odd_rows(spark):
    schema = "doc_id long, text string, lang string, score string, held_out string, h int"
    rows = [(k, "only words of one language", "en", "s", "x", 1) for k in range(8)] + [(None, "words", "en", "", "", 0), (9, None, "en", "", "", 0), (10, "", None, "", "", 0), (11, "12 !?", "en", "", "", 0), (12, "日本", None, "", "", 0)]
    got = langid.identify(spark.createDataFrame(rows, schema)).collect()
    assert [(r["doc_id"], r["lang_pred"], round(r["score"], 3)) for r in got if r["doc_id"] in (None, 9, 10, 11, 12)] == [(None, "en", 1), (9, "und", 0), (10, "und", 0), (11, "und", 0), (12, "en", 1)]
    unlearnt = langid.identify(spark.createDataFrame([(1, "some words", None), (2, None, "en")], "doc_id long, text string, lang string")).collect()
    assert [(r["lang_pred"], r["score"]) for r in unlearnt] == [("und", 0.0)] * 2
    assert langid.identify(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_tables_of_a_session_are_cleared(spark):
    import os

    from siltstone.llm import common

    kept = common.table(spark.range(5), "kept")
    dropped = common.table(spark.range(5), "dropped")
    path = kept._siltstone_path.removeprefix("file:")
    common.drop(dropped)
    assert os.path.exists(path) and not os.path.exists(dropped._siltstone_path.removeprefix("file:"))
    common.clear(spark)
    assert not os.path.exists(path)
