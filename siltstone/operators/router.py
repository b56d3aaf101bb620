"""The router's model: TF-IDF of word and character n-grams, multinomial logistic regression, held-out probabilities, evidence terms."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from siltstone.plans import store

#: Slots of hashed terms, and texts of a block, which looks its terms up together.
SLOTS, BLOCK = 1 << 16, 8192


def word_terms(text):
    """Words of two letters or more and pairs of neighbours, with repeats."""
    w = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\w{2,}"), F.lit(0))
    pairs = F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)))).otherwise(F.array().cast("array<string>"))
    return F.concat(w, pairs)


def char_terms(text, low: int = 2, high: int = 5):
    """Runs of ``low`` to ``high`` characters of each word, which has a space on either side."""
    w = F.transform(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda x: x != ""), lambda x: F.concat(F.lit(" "), x, F.lit(" ")))
    of = lambda x, n: F.when(F.length(x) >= n, F.transform(F.sequence(F.lit(1), F.length(x) - n + 1), lambda i: F.substring(x, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(w, lambda x: F.concat(*[of(x, n) for n in range(low, high + 1)])))


#: ``word_terms`` and ``char_terms`` in Python, of a text in lower case: Java's \\w and \\s are ASCII.
_WORD, _SPACE = re.compile(r"[A-Za-z0-9_]{2,}"), re.compile(r"[ \t\n\x0b\f\r]+")


def _terms(text: str, runs: dict[str, list[str]]) -> list[str]:
    """Word terms, and character terms behind a #, with repeats.  ``runs``: those of words that came before."""
    w = _WORD.findall(text)
    out = w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
    for x in _SPACE.split(text):
        if x:
            if (known := runs.get(x)) is None:
                if len(runs) > 20_000:
                    runs.clear()
                y = f" {x} "
                known = runs[x] = ["#" + y[i : i + n] for n in range(2, 6) for i in range(len(y) - n + 1)]
            out += known
    return out


def _in_blocks(texts: DataFrame) -> DataFrame:
    """``texts`` with __block and __lower, a block in one partition, so that a block's texts meet without further shuffles."""
    n = texts.count()
    n = max(min(3 * texts.sparkSession.sparkContext.defaultParallelism, n // 512 + 1), n // BLOCK + 1)
    return texts.select("*", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("__block"), F.lower(F.coalesce("text", F.lit(""))).alias("__lower")).repartition(n, "__block")


def vocabulary(texts: DataFrame, min_df: int = 2) -> DataFrame:
    """term, idf of the word and character terms (these behind a #) that ``min_df`` of ``texts`` have: ln((1 + n) / (1 + df)) + 1.

    Tasks count the terms of a batch of texts, so a text and a term make no row.
    """

    def count(batches):
        runs: dict[str, list[str]] = {}
        for batch in batches:
            n: Counter = Counter()
            for text in batch.column(0).to_pylist():
                n.update(set(_terms(text, runs)))
            yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], names=["term", "n"])

    df = _in_blocks(texts).select("__lower").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("df")).where(F.col("df") >= min_df)
    n = texts.agg(F.count("*").alias("n"))  # one row
    return df.join(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf(texts: DataFrame, corpus: DataFrame | None = None, terms=word_terms, min_df: int = 2, known: DataFrame | None = None) -> DataFrame:
    """id, term, weight of ``texts`` (id, text): (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), rows of length 1.

    Document frequencies are those of ``corpus`` (by default the texts themselves), or ``known`` is a ``vocabulary``; terms of fewer than ``min_df`` of its
    rows don't count.  Terms are joined by their text, always by a shuffle: no vocabulary comes to the driver, not even to be broadcast.
    A text and a term are a row, so this is for few texts; ``vectors`` is for many.
    """
    counted = lambda df: df.select("id", F.explode(terms(F.col("text"))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    own = counted(texts)
    if known is None:
        df = (own if corpus is None else counted(corpus)).groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
        n = (texts if corpus is None else corpus).agg(F.count("*").alias("n"))  # one row
        known = df.join(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    rows = own.join(known.hint("merge"), "term").select("id", "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("id")))
    return rows.select("id", "term", (F.col("w") / length).alias("weight"))


def _weighted(texts: list[str], at: dict[str, int], idf: np.ndarray, slot: np.ndarray, chars: np.ndarray, runs: dict[str, list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets (one more than texts), slots and weights of some texts; ``at``: numbers of the terms that count."""
    codes, ends = [], [0]
    for text in texts:
        codes += [k for t in _terms(text, runs) if (k := at.get(t)) is not None]
        ends.append(len(codes))
    rows = np.repeat(np.arange(len(texts)), np.diff(ends))
    pairs, tf = np.unique(rows * max(len(at), 1) + np.array(codes, np.int64), return_counts=True)
    rows, codes = np.divmod(pairs, max(len(at), 1))
    w = (1 + np.log(tf)) * idf[codes]
    half = rows * 2 + chars[codes]  # words and characters have length 1 each
    w /= np.sqrt(np.bincount(half, w * w, 2 * len(texts)))[half]
    keys, place = np.unique(rows * SLOTS + slot[codes], return_inverse=True)
    return np.searchsorted(keys, np.arange(len(texts) + 1) * SLOTS), keys % SLOTS, np.bincount(place, w, len(keys))


def vectors(texts: DataFrame, corpus: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """``texts`` (id, text and others) with features: word and character TF-IDF, hashed to ``SLOTS`` slots (a sparse vector; texts without terms have an empty one).

    ``known``: the ``vocabulary`` (by default that of ``corpus``, or of the texts).  A block of texts looks up each of its terms once; its vectors are made in one task.
    """
    known = vocabulary(texts if corpus is None else corpus) if known is None else known
    blocks = _in_blocks(texts)

    def listed(batches):
        runs: dict[str, list[str]] = {}
        found: dict[int, set[str]] = {}
        for batch in batches:
            for block, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.setdefault(block, set()).update(_terms(text, runs))
        for block, terms in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(terms), pa.int32()), pa.array(terms, pa.string())], names=["__block", "term"])

    needed = blocks.select("__block", "__lower").mapInArrow(listed, "__block int, term string").join(known.hint("merge"), "term")
    needed = needed.select("__block", "term", "idf", F.pmod(F.xxhash64("term"), F.lit(SLOTS)).cast("int").alias("slot"), F.startswith("term", F.lit("#")).alias("chars"))

    full = lambda kind: pa.list_(pa.field("element", kind, False))
    sparse = [pa.field("type", pa.int8(), False), pa.field("size", pa.int32()), pa.field("indices", full(pa.int32())), pa.field("values", full(pa.float64()))]  # of VectorUDT

    def made(docs: pa.Table, terms: pa.Table) -> pa.Table:
        at, runs = {t: k for k, t in enumerate(terms.column("term").to_pylist())}, {}
        idf, slot, chars = (terms.column(c).to_numpy(zero_copy_only=False) for c in ("idf", "slot", "chars"))
        idf, slot, chars = idf.astype(np.float64), slot.astype(np.int64), chars.astype(np.int64)
        found, lower = [], docs.column("__lower")
        for k in range(0, len(docs), 1024):  # some texts at a time
            offsets, slots, weights = _weighted(lower.slice(k, 1024).to_pylist(), at, idf, slot, chars, runs)
            offsets, n = pa.array(offsets, pa.int32()), len(offsets) - 1
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, f.type.value_type), type=f.type) for x, f in zip((slots, weights), sparse[2:], strict=True)]
            found.append(pa.StructArray.from_arrays([pa.array([0] * n, pa.int8()), pa.array([SLOTS] * n, pa.int32()), *lists], fields=sparse))
        return docs.drop_columns(["__block", "__lower"]).append_column("features", pa.chunked_array(found))

    schema = StructType([*texts.schema.fields, StructField("features", VectorUDT())])
    many = blocks.groupBy("__block").cogroup(needed.repartition(blocks.rdd.getNumPartitions(), "__block").groupBy("__block"))
    return many.applyInArrow(made, schema)


def fit(rows: DataFrame, c: float = 5.0, iterations: int = 40) -> LogisticRegressionModel:
    """Multinomial regression of ``rows`` (features, y: class number), penalty 1 / (c * n).

    Each task sends a gradient of all classes' slots in every iteration, so there are no more tasks than cores, or one for 100,000 rows.
    """
    n = max(rows.count(), 1)
    few = rows.select("features", "y").coalesce(min(n // 4096 + 1, max(rows.sparkSession.sparkContext.defaultParallelism, n // 100_000)))
    return LogisticRegression(family="multinomial", labelCol="y", regParam=1 / (c * n), standardization=False, maxIter=iterations).fit(few)


def classes(rows: DataFrame, label: str) -> list[str]:
    """Class names in order: as many as there are categories."""
    return [r[0] for r in rows.select(label).where(F.col(label).isNotNull()).distinct().orderBy(label).collect()]


def numbered(rows: DataFrame, label: str, names: list[str]) -> DataFrame:
    return rows.where(F.col(label).isin(*names)).withColumn("y", (F.array_position(F.array(*[F.lit(n) for n in names]), F.col(label)) - 1).cast("double"))


def probabilities(model: LogisticRegressionModel, rows: DataFrame, names: list[str]) -> DataFrame:
    """id, class, p (4 digits) of each row and class."""
    p = model.transform(rows).select("id", vector_to_array("probability").alias("p"))
    return p.select("id", F.posexplode("p").alias("k", "p")).select("id", F.get(F.array(*[F.lit(n) for n in names]), F.col("k")).alias("class"), F.round("p", 4).alias("p"))


def dealt(rows: DataFrame, label: str, folds: int = 5) -> DataFrame:
    """``rows`` with fold, which holds equal shares of each class: places in the class by the hash of the id, from a sort by range, so no class meets in one task."""
    placed = store.numbered(rows.withColumn("__md5", F.md5(F.col("id").cast("string"))), label, "__md5")
    first = placed.groupBy(F.col(label).alias("__label")).agg(F.min("__k").alias("__first"))  # a row for each class
    return placed.join(F.broadcast(first), F.col(label).eqNullSafe(F.col("__label"))).select(*rows.columns, ((F.col("__k") - F.col("__first")) % folds).cast("int").alias("fold"))


def out_of_fold(rows: DataFrame, label: str, names: list[str], folds: int = 5) -> DataFrame:
    """id, class, p: each row's probabilities by a model that hasn't seen its fold.  Rows without fold are ``dealt`` first."""
    dealt_rows = numbered(rows if "fold" in rows.columns else dealt(rows, label, folds), label, names)
    out = None
    for k in range(folds):
        part = probabilities(fit(dealt_rows.where(F.col("fold") != k)), dealt_rows.where(F.col("fold") == k), names)
        out = part if out is None else out.unionByName(part)
    return out


def held_out(rows: DataFrame, evaluated: DataFrame, key: str, group: str) -> DataFrame:
    """Rows for training: neither an evaluated key nor a group (ticker) of an evaluated row."""
    return rows.join(evaluated.select(key).distinct().hint("merge"), key, "left_anti").join(evaluated.select(group).where(F.col(group).isNotNull()).distinct(), group, "left_anti")


def evidence(model: LogisticRegressionModel, texts: DataFrame, corpus: DataFrame | None, names: list[str], k: int = 4, known: DataFrame | None = None) -> DataFrame:
    """id, class, terms: the ``k`` word terms of each text that speak most for each class (weight times coefficient, above 0).  ``known``: the ``vocabulary`` of the corpus."""
    spark = texts.sparkSession
    matrix = model.coefficientMatrix.toArray()  # classes x SLOTS
    table = spark.createDataFrame([(s, matrix[:, s].tolist()) for s in range(SLOTS) if matrix[:, s].any()], "slot int, coefficients array<double>")
    rows = tfidf(texts, known=vocabulary(corpus) if known is None else known).withColumn("slot", F.pmod(F.xxhash64("term"), F.lit(SLOTS)).cast("int")).join(table, "slot")
    rows = rows.select("id", "term", F.posexplode("coefficients").alias("c", "v"), "weight").withColumn("gain", F.col("weight") * F.col("v")).where("gain > 0")
    best = rows.withColumn("r", F.row_number().over(W.partitionBy("id", "c").orderBy(F.desc("gain"), "term"))).where(F.col("r") <= k)
    made = best.groupBy("id", "c").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda s: s["term"]).alias("terms"))
    return made.select("id", F.get(F.array(*[F.lit(n) for n in names]), F.col("c")).alias("class"), "terms")
