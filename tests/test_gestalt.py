"""Fuzzy lookup of passages against the standard library's ratio on every pair."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest

from siltstone.operators import gestalt, truth

WORDS = "revenue grew by net the of income tax rate ended margin über naïve 12.5 % decline segment operating cash".split()


def corpus_and_passages(seed, n=260):
    """Chunks of random words; passages are edited copies, cut copies, and strangers."""
    rng = random.Random(seed)
    chunks = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 110))) for _ in range(n)]
    passages = []
    for t in rng.sample(chunks, 60):
        words = t.split()
        for _ in range(int(len(words) * rng.choice([0.0, 0.05, 0.15, 0.3, 0.5]))):
            at = rng.randrange(len(words) or 1)
            words[at : at + rng.randint(0, 1)] = [rng.choice(WORDS)] * rng.randint(0, 1)
        passages.append(" ".join(words)[rng.choice([0, 0, 9]) :].upper())
    return [(f"c{k:04d}", t) for k, t in enumerate(chunks)], list(enumerate([*passages, "", "x", None]))


@pytest.mark.parametrize("block", [2048, 7])
def test_first_alike_is_the_first_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(gestalt, "BLOCK", block)
    chunks, passages = corpus_and_passages(block)
    chunks += [("c9998", None), ("c9999", "   ")]
    normal = lambda t: " ".join((t or "").split()).lower()[:500]
    want = {}
    for i, p in passages:
        for c, t in chunks:
            if SequenceMatcher(None, normal(p), normal(t)).ratio() >= 0.8:
                want[i] = c
                break
    got = gestalt.first_alike(spark.createDataFrame(passages, "finder_id long, truth string"), spark.createDataFrame(chunks, "chunk_id string, text string").repartition(3))
    assert {r["finder_id"]: r["chunk_id"] for r in got.collect()} == want and 20 < len(want) < len(passages)


def test_bounds_lose_nothing():
    """Every pair of the least ratio passes the bounds, at several ratios, with characters that share a counter."""
    rng = random.Random(11)
    text = lambda: "".join(rng.choice("abcdéšáaab ") for _ in range(rng.randint(0, 60)))
    for least in (0.5, 0.8, 0.95):
        texts = [text() for _ in range(60)]
        texts += [t[: len(t) // 2] + rng.choice("xyz") + t[len(t) // 2 :] for t in texts]
        block = gestalt.Passages(list(range(len(texts))), texts, least)
        for other in texts[::3]:
            passed = set(block.candidates(other, np.arange(len(texts))))
            assert {k for k, t in enumerate(texts) if gestalt.ratio(t, other) >= least} <= passed


def test_common_subsequence():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in "ab")
        rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
        block = gestalt.Passages([0], [a], 0.8)
        assert gestalt.common_subsequence(block.places_of(0), len(a), b) == rows[-1][-1]


def test_only_what_is_left_is_looked_up(spark):
    """A passage that a step before finds doesn't get its like text too."""
    body = "net income was 1,234 and 5,678 and 9,012 and 3,456 in the quarter that ended " + "with growth of several kinds " * 4
    chunks = spark.createDataFrame([("a", body[:40] + "slightly " + body[40:]), ("b", body), ("c", "something else altogether")], "chunk_id string, text string")
    asked = spark.createDataFrame([(1, body), (2, "something else altogethr"), (3, "nothing like it")], "finder_id long, truth string")
    got = {(r["finder_id"], r["chunk_id"], r["step"]) for r in truth.truth_lookup(asked, chunks).collect()}
    assert got == {(1, "a", "exact"), (1, "b", "exact"), (2, "c", "fuzzy")}
