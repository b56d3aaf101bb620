"""Ranked lexical search with bag deduplication.

Documents are restricted to the words of the items that are asked.  What a document scores depends on its counts of these
words and on its length class m alone, so documents that agree in both are one class: classes are found by a hash of the
whole bag and verified on the bag itself, each is scored once, and a class's documents come back in order of doc_id.  A
ranking of ``k`` needs the first ``k`` members of a class at most, and the best ``k`` classes.

Items are taken in blocks whose words fit a bound, since a block's words, weights and postings go to every task.  Scores
are integers; their sums stay below 2 ** 53, so that sums of doubles are exact (checked for each block).
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.llm.common import ascii_lower, table

#: What separates terms.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Distinct words, and items, of a block: what goes to every task is some tens of megabytes at most.
BLOCK_TERMS, BLOCK_ITEMS = 200_000, 20_000
#: Scores that a task adds at a time, and cells of its table of scores.
PIECE, CELLS = 2_000_000, 1_000_000
#: Rows that are Python strings at a time.
SLICE = 500

_letters = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Terms of a text in UTF-8: letters and digits of ASCII and all that is beyond it, A-Z lower-cased."""
    return (text or "").encode("utf-8", "replace").translate(_letters).split()


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, item (a number), term: the distinct terms of each item_id, whose rows count as one item."""
    words = F.filter(F.split(ascii_lower(F.coalesce("text", F.lit(""))), BETWEEN), lambda w: w != "")
    rows = table(items.select("item_id", F.explode(words).alias("term")).distinct(), "item-terms")
    own = rows.select("item_id").distinct().withColumn("item", F.monotonically_increasing_id())
    own = table(own, "items")
    return rows.join(own, rows.item_id.eqNullSafe(own.item_id)).select(own.item_id, "item", "term")


def bags(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms of the document), ids and tfs (its terms in ``vocabulary``, ascending, and their counts)."""

    def run(batches):
        known = vocabulary.get
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                rows = batch.slice(at, SLICE)
                n, sizes, ids, tfs = [], [0], [], []
                for text in rows.column("text").to_pylist():
                    words = terms_of(text)
                    own = Counter(map(known, words))
                    own.pop(None, None)
                    order = sorted(own)
                    n.append(len(words))
                    sizes.append(len(order))
                    ids += order
                    tfs += map(own.__getitem__, order)
                offsets = pa.array(np.cumsum(sizes, dtype=np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x, t)) for x, t in ((ids, pa.int32()), (tfs, pa.int64()))]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "ids", "tfs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n bigint, ids array<int>, tfs array<bigint>")


def classes(found: DataFrame, n_docs: int, n_words: int, k: int) -> DataFrame:
    """class, doc_id, r, and in the class's first row m, ids and tfs: the first ``k`` documents of each class of equal bags and m."""
    m = F.expr(f"100 - 90 + ((90L * n * {n_docs}L) div {max(n_words, 1)}L)")
    rows = found.where(F.size("ids") > 0).withColumn("m", m).withColumn("bag", F.xxhash64("m", "ids", "tfs"))
    order = W.partitionBy("bag", "m", "ids", "tfs").orderBy(F.col("doc_id").asc_nulls_last(), "row").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("r", F.row_number().over(order)).withColumn("class", F.first("row").over(order)).withColumn("lead", F.first("doc_id").over(order)).where(F.col("r") <= k)
    first = F.col("r") == 1
    return rows.select("class", "doc_id", "r", *[F.when(first, F.col(c)).alias(c) for c in ("lead", "m", "ids", "tfs")])


class Postings:
    """Items of a block by term: starts[t] to starts[t + 1] in ``items``, and the terms' weights."""

    def __init__(self, pairs: np.ndarray, weights: np.ndarray, n_items: int):
        order = np.lexsort((pairs[:, 0], pairs[:, 1]))
        self.items, self.weights, self.n_items = pairs[order, 0], weights, n_items
        self.starts = np.searchsorted(pairs[order, 1], np.arange(len(weights) + 1))

    def scores(self, row: np.ndarray, ids: np.ndarray, tfs: np.ndarray, m: np.ndarray, n_rows: int) -> np.ndarray:
        """Scores (n_rows x n_items) of the classes whose entries are (row, term, count, m)."""
        value = self.weights[ids] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m))
        width = self.starts[ids + 1] - self.starts[ids]
        ends = np.cumsum(width)
        total, at, cells = np.zeros(n_rows * self.n_items), 0, n_rows * self.n_items
        while at < len(ids):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, side="right")))
            w = width[at:stop]
            inside = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
            item = self.items[np.repeat(self.starts[ids[at:stop]], w) + inside]
            total += np.bincount(np.repeat(row[at:stop], w) * self.n_items + item, weights=np.repeat(value[at:stop], w).astype(np.float64), minlength=cells)
            at = stop
        return total.reshape(n_rows, self.n_items)


def best_classes(rows: DataFrame, postings: Postings, k: int) -> DataFrame:
    """item, class, lead, score: each task's best ``k`` classes of every item, equal scores by the class's first doc_id, null last."""

    def run(batches):
        best = [np.zeros(0, dtype=np.int64)] * 5  # item, score, whether lead is null, lead, class
        least = np.ones(postings.n_items)
        most = max(1, CELLS // postings.n_items)
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                ids, tfs = (part.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("ids", "tfs"))
                sizes = part.column("ids").value_lengths().to_numpy(zero_copy_only=False)
                m = part.column("m").to_numpy(zero_copy_only=False)
                found = postings.scores(np.repeat(np.arange(len(sizes)), sizes), ids.astype(np.int64), tfs, np.repeat(m, sizes), len(sizes))
                row, item = np.nonzero(found >= least[None, :])
                lead = part.column("lead")
                new = (item, found[row, item].astype(np.int64), np.asarray(lead.is_null())[row], lead.fill_null(0).to_numpy(zero_copy_only=False)[row], part.column("class").to_numpy()[row])
                best = [np.concatenate(x) for x in zip(best, new, strict=True)]
                order = np.lexsort((best[4], best[3], best[2], -best[1], best[0]))
                place = np.arange(len(order)) - np.searchsorted(best[0][order], best[0][order], side="left")
                best = [x[order[place < k]] for x in best]
                full = place[place < k] == k - 1
                least[best[0][full]] = best[1][full]
        item, score, null, lead, number = best
        yield pa.RecordBatch.from_arrays(
            [pa.array(item, pa.int64()), pa.array(number.astype(np.int64)), pa.array(lead.astype(np.int64), mask=null.astype(bool)), pa.array(score, pa.int64())], names=["item", "class", "lead", "score"]
        )

    return rows.mapInArrow(run, "item bigint, class bigint, lead bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``k`` best rows of ``docs`` (doc_id bigint, text) for each item of ``items`` (item_id, text).

    Only scores above 0 rank; equal scores by ascending doc_id, null last; repeated rows rank each.  Null and empty
    texts have no terms; an item without terms has no rows; rows of one item_id are one item.  Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    asked = table(item_terms(items), "asked")
    n_terms, n_items = asked.agg(F.count_distinct("term"), F.count_distinct("item")).first()
    blocks = max(1, -(-n_terms // BLOCK_TERMS), -(-n_items // BLOCK_ITEMS))
    out = []
    for b in range(blocks):
        # Items of a block by hash; twice the bound is never met unless one item alone has so many words.
        own = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b) if blocks > 1 else asked
        rows = own.select("item", "term").toArrow()
        names = sorted({t.encode("utf-8") for t in rows.column("term").to_pylist()})
        numbers = sorted(set(rows.column("item").to_pylist()))
        if not names:
            continue
        vocabulary, place = {t: i for i, t in enumerate(names)}, {x: i for i, x in enumerate(numbers)}
        pairs = np.array([(place[x], vocabulary[t.encode("utf-8")]) for x, t in zip(rows.column("item").to_pylist(), rows.column("term").to_pylist(), strict=True)], dtype=np.int64)
        found = table(bags(docs, vocabulary).withColumn("row", F.monotonically_increasing_id()), "bags")
        n_docs, n_words = found.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(names), dtype=np.int64)
        counted = found.select(F.explode("ids").alias("t")).groupBy("t").agg(F.count("*").alias("n")).toArrow()
        df[counted.column("t").to_numpy()] = counted.column("n").to_numpy()
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], dtype=np.int64)
        if int(weights.max()) * 1_000_000 * int(np.bincount(pairs[:, 0]).max()) >= 2**53:
            raise ValueError("an item has more terms than exact scores allow")
        members = table(classes(found, n_docs, n_words, k), "classes")
        best = best_classes(members.where("r = 1").select("class", "lead", "m", "ids", "tfs"), Postings(pairs, weights, len(numbers)), k)
        order = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("lead").asc_nulls_last(), "class")
        best = best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
        names_of = docs.sparkSession.createDataFrame([(i, x) for x, i in place.items()], "item long, number long")
        ranked = best.join(members.select("class", "doc_id", "r"), "class")
        order = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "class", "r")
        ranked = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        out.append(ranked.join(names_of, "item").select(F.col("number").alias("item"), "rank", "doc_id", "score"))
    ids = asked.select("item", "item_id").distinct()
    if not out:
        return ids.select("item_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false")
    union = out[0]
    for x in out[1:]:
        union = union.unionByName(x)
    return union.join(ids, "item").select("item_id", "rank", "doc_id", "score")


def search_sql(k: int = 10) -> str:
    """Every document against every item in DuckDB."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, {words} AS w FROM documents),
g AS (SELECT count(*) FILTER (len(w) > 0)::BIGINT AS docs, sum(len(w))::BIGINT AS words FROM d),
q AS (SELECT DISTINCT item_id, unnest({words}) AS term FROM benchmark),
t AS (SELECT id, term, count(*)::BIGINT AS tf FROM (SELECT id, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * df + 1)))::BIGINT AS w FROM f, g),
m AS (SELECT id, doc_id, 10 + (90 * len(d.w)::BIGINT * docs) // words AS m FROM d, g WHERE len(d.w) > 0),
s AS (SELECT item_id, m.id, m.doc_id, sum(w.w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM q JOIN t USING (term) JOIN w USING (term) JOIN m ON m.id = t.id GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= {k}
"""
