"""Fuzzy lookup of passages by the gestalt-match ratio: twice the characters of common blocks (the longest, then what is left and right of it, and so on) over both lengths.

The ratio itself is costly, so bounds stand before it that lose no match.  A ratio of t needs matching characters of at
least t / 2 of both lengths, they stand in the same order in both texts, and all but a few neighbours of theirs are
neighbours in both.  So, cheapest first: the shorter text is long enough; the counts of single characters share enough;
the counts of pairs share enough (at least thrice the matching characters less both lengths and one); the longest common
subsequence is long enough.
"""

from __future__ import annotations

import math
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.plans import store

#: Least ratio, and characters that are compared.
FUZZY, LENGTH = 0.8, 500
#: Passages that go to the tasks at once, about a megabyte of text and eight of counts.
BLOCK = 2048
#: Counters for single characters and for pairs; characters that share one only loosen the bounds.
ONES, PAIRS = 128, 1024


def common_subsequence(places: dict[str, int], length: int, other: str) -> int:
    """Length of the longest common subsequence of ``other`` and a text of ``length`` characters; ``places``: a bit for each place of a character in that text."""
    every = (1 << length) - 1
    open_ = every
    for c in other:
        hit = open_ & places.get(c, 0)
        open_ = (open_ + hit | open_ - hit) & every
    return length - open_.bit_count()


def ratio(a: str, b: str) -> float:
    """Gestalt-match ratio, by the standard library (which leaves out characters that are common in a long ``b``)."""
    return SequenceMatcher(None, a, b).ratio()


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Counts of single characters and of pairs."""
    codes = np.fromiter(map(ord, text), dtype=np.int64, count=len(text))
    return np.bincount(codes % ONES, minlength=ONES), np.bincount((codes[:-1] * 31 + codes[1:]) % PAIRS, minlength=PAIRS)


class Passages:
    """A block of passages with what the bounds need."""

    def __init__(self, ids: list, texts: list[str], least: float):
        self.ids, self.texts, self.least = ids, texts, least
        self.lengths = np.array([len(t) for t in texts], dtype=np.int64)
        both = [counts(t) for t in texts]
        self.ones = np.array([o for o, _ in both], dtype=np.int16).reshape(-1, ONES).T.copy()
        self.pairs = np.array([p for _, p in both], dtype=np.int16).reshape(-1, PAIRS).T.copy()
        self.places: list[dict[str, int] | None] = [None] * len(texts)

    def places_of(self, k: int) -> dict[str, int]:
        if self.places[k] is None:
            found: dict[str, int] = {}
            for at, c in enumerate(self.texts[k]):
                found[c] = found.get(c, 0) | 1 << at
            self.places[k] = found
        return self.places[k]

    def candidates(self, text: str, open_: np.ndarray) -> list[int]:
        """Passages among ``open_`` (numbers) whose bounds allow the least ratio with ``text``."""
        n = len(text)
        need = np.ceil(self.least * (self.lengths[open_] + n) / 2 - 1e-9).astype(np.int64)
        fits = np.minimum(self.lengths[open_], n) >= need
        some, need = open_[fits], need[fits]
        ones, pairs = counts(text)
        for table, own, enough in ((self.ones, ones, lambda: need), (self.pairs, pairs, lambda: 3 * need - self.lengths[some] - n - 1)):
            if not len(some):
                return []
            at = np.flatnonzero(own)
            shared = np.minimum(table[np.ix_(at, some)], own[at, None]).sum(axis=0)
            fits = shared >= enough()
            some, need = some[fits], need[fits]
        return [int(k) for k, least in zip(some, need, strict=True) if common_subsequence(self.places_of(k), int(self.lengths[k]), text) >= least]


def first_alike(passages: DataFrame, corpus: DataFrame, least: float = FUZZY, length: int = LENGTH) -> DataFrame:
    """finder_id, chunk_id: of each of ``passages`` (finder_id, truth) the first of ``corpus`` (chunk_id, text) in order of chunk_id whose ratio is ``least`` or more.

    Both in their normal form, the first ``length`` characters.  Passages are the bounded side: blocks of ``BLOCK`` go to
    the tasks, one block after the other, and each scans the corpus once; a task keeps its first match of a passage, so
    at most passages x tasks rows are shuffled.  Null texts are empty; two empty texts are alike; rows of one finder_id are looked up each.
    """
    opening = lambda c: F.substring(X.normal(F.coalesce(F.col(c), F.lit(""))), 1, length)
    asked = store.written(passages.select("finder_id", opening("truth").alias("opening")).distinct(), "openings")
    chunks = corpus.select("chunk_id", opening("text").alias("opening"))
    kind, found = asked.schema["finder_id"].dataType.simpleString(), []
    schema = f"finder_id {kind}, chunk_id string"
    n = math.ceil(asked.count() * 1.2 / BLOCK)  # blocks by hash are a little uneven
    for b in range(n):
        rows = asked.where(F.pmod(F.xxhash64("opening", F.col("finder_id")), F.lit(n)) == b).collect()
        if rows:
            found.append(store.written(alike_in(chunks, Passages([r["finder_id"] for r in rows], [r["opening"] for r in rows], least), schema, kind), "alike"))
    out = asked.select("finder_id", F.lit(None).cast("string").alias("chunk_id")).where("false")
    for part in found:
        out = out.unionByName(part)
    return out.groupBy("finder_id").agg(F.min("chunk_id").alias("chunk_id"))


def alike_in(chunks: DataFrame, block: Passages, schema: str, kind: str) -> DataFrame:
    """finder_id, chunk_id: each task's first match of each passage of ``block``."""

    def run(batches):
        first: list[str | None] = [None] * len(block.ids)
        for batch in batches:
            for chunk, text in sorted(zip(batch.column("chunk_id").to_pylist(), batch.column("opening").to_pylist(), strict=True)):
                open_ = np.array([k for k, c in enumerate(first) if c is None or chunk < c], dtype=np.int64)
                for k in block.candidates(text, open_):
                    if ratio(block.texts[k], text) >= block.least:
                        first[k] = chunk
        hits = [k for k, c in enumerate(first) if c is not None]
        yield pa.RecordBatch.from_arrays([pa.array([block.ids[k] for k in hits], pa_type(kind)), pa.array([first[k] for k in hits], pa.string())], names=["finder_id", "chunk_id"])

    return chunks.where("chunk_id IS NOT NULL").mapInArrow(run, schema)


def pa_type(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
