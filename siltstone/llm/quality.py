"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each text gives a fixed vector of statistics.  Sums and sums of products by class (one pass, a row for each partition
and class) give class means and covariances, which are shrunk towards their diagonal and get a ridge in units of the
pooled variances; the score comes from the difference of the classes' Mahalanobis log-densities, with the Cholesky factors
computed once and kept in the model.  A monotone calibration turns the difference into a probability.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import table

FEATURES = ("chars", "words", "word_length", "spread", "distinct", "repeats", "top_share", "upper", "digits", "stops", "shouts", "bars", "symbols", "brackets", "lines", "line_repeats", "line_length", "short_words")
#: A text whose words are looked at in pieces of so many, for the share of distinct words (which otherwise falls with length).
SPAN = 200
_symbols = np.frombuffer(b"#$%&*@^~_=+", dtype=np.uint8)
_brackets = np.frombuffer(b"<>{}[]()\\/\"", dtype=np.uint8)


def statistics(text: str | None) -> list[float]:
    """The statistics of one text, each transformed to a bounded or logarithmic scale; an empty text gives zeros."""
    text = text or ""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8), minlength=256)
    n, m, lines = len(text), len(words), text.split("\n")
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=m)
    spans = [words[k : k + SPAN] for k in range(0, m, SPAN)]
    distinct = sum(len(set(s)) for s in spans) / m
    counts = [Counter(s) for s in spans]
    top = sum(max(c.values()) for c in counts) / m
    ratio = lambda k: float(np.sqrt(k / n))
    return [
        float(np.log1p(n)), float(np.log1p(m)), float(np.log1p(lengths.mean())), float(np.log1p(lengths.std())),
        distinct, float(np.sqrt(sum(map(eq, words, words[1:])) / m)), float(np.sqrt(top)),
        ratio(raw[65:91].sum()), ratio(raw[48:58].sum()), float(np.sqrt((raw[46] + raw[44] + raw[58] + raw[59]) / m)), ratio(raw[33] + raw[63]), ratio(raw[124]),
        ratio(raw[_symbols].sum()), ratio(raw[_brackets].sum()), float(np.log1p(len(lines))), float(np.sqrt(1 - len(set(lines)) / len(lines))),
        float(np.log1p(m / len(lines))), float((lengths <= 3).mean()),
    ]


def features(docs: DataFrame) -> DataFrame:
    """doc_id and features (array<double>) of each row of ``docs`` (doc_id, text)."""

    def run(batches):
        for batch in batches:
            rows = [statistics(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "features"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, features array<double>")


@dataclass
class Model:
    """Means, inverse Cholesky factors and log-determinants by class, and the calibration (slope, offset)."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    constants: list[float]
    slope: float = 1.0
    offset: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log-density of class 1 less that of class 0, compressed far from the boundary."""
        logs = [c - 0.5 * np.square((x - m) @ f.T).sum(axis=1) for m, f, c in zip(self.means, self.factors, self.constants, strict=True)]
        return np.arcsinh(logs[1] - logs[0])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(x) + self.offset, -40, 40)))


def fit(labelled: DataFrame, shrink: float = 0.1, ridge: float = 0.02) -> Model:
    """Fit to rows of features (array<double>) and label (0 or 1).

    ``shrink``: weight of the diagonal in each class covariance; ``ridge``: added to it, in units of the pooled variance
    of each feature.  A class without rows takes the other's moments (scores are then constant).  The driver gets sums
    only: a row for each partition and class, then 400 bins of the log-density difference.
    """
    d = len(FEATURES)

    def sums(batches):
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x = np.array(batch.column("features").to_pylist(), dtype=np.float64).reshape(-1, d)
            y = batch.column("label").to_numpy(zero_copy_only=False)
            for k in (0, 1):
                own = x[y == k]
                total[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["label", "sums"])

    gathered = labelled.select("features", "label").mapInArrow(sums, "label int, sums array<double>").select("label", F.posexplode("sums").alias("at", "v"))
    total = np.zeros((2, 1 + d + d * d))
    for r in gathered.groupBy("label", "at").agg(F.sum("v").alias("v")).collect():
        total[r["label"], r["at"]] = r["v"]
    n = np.maximum(total[:, 0], 1e-9)
    pooled = total.sum(axis=0)
    centre = pooled[1 : 1 + d] / max(pooled[0], 1)
    unit = np.maximum(np.diag(pooled[1 + d :].reshape(d, d)) / max(pooled[0], 1) - centre**2, 1e-6)
    model = Model([], [], [])
    for k in (0, 1):
        own = total[k] if total[k, 0] > 1 else pooled
        m = max(own[0], 1)
        mean = own[1 : 1 + d] / m
        cov = own[1 + d :].reshape(d, d) / m - np.outer(mean, mean)
        cov = (1 - shrink) * cov + shrink * np.diag(np.diag(cov)) + ridge * np.diag(unit)
        lower = np.linalg.cholesky(cov)
        model.means.append(mean)
        model.factors.append(np.linalg.inv(lower))
        model.constants.append(float(-np.log(np.diag(lower)).sum() + np.log(n[k] / n.sum() + 1e-12)))

    def bins(batches):
        for batch in batches:
            x = np.array(batch.column("features").to_pylist(), dtype=np.float64).reshape(-1, d)
            at = np.clip(np.rint(model.difference(x) * 20), -200, 200).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("label")], names=["at", "label"])

    kind = labelled.schema["label"].dataType.simpleString()
    rows = labelled.select("features", "label").mapInArrow(bins, f"at int, label {kind}").groupBy("at").agg(F.sum("label").alias("ones"), F.count("*").alias("n")).collect()
    x, ones, count = (np.array([r[c] for r in rows], dtype=np.float64) for c in ("at", "ones", "n"))
    x, w = x / 20, np.array([1.0, 0.0])
    for _ in range(50 if len(x) else 0):  # Newton's method for the calibration, with a small penalty
        p = 1 / (1 + np.exp(-np.clip(w[0] * x + w[1], -40, 40)))
        g = np.array([((p * count - ones) * x).sum(), (p * count - ones).sum()]) + 1e-3 * (w - [1.0, 0.0])
        h = count * p * (1 - p)
        hess = np.array([[(h * x * x).sum(), (h * x).sum()], [(h * x).sum(), h.sum()]]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, g)
        w = w - step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
    model.slope, model.offset = float(max(w[0], 1e-3)), float(w[1])
    return model


def apply(rows: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``rows`` with ``name`` (0 to 1, higher: class 1 likelier) in place of ``features``."""
    keep = [f for f in rows.schema.fields if f.name not in ("features", name)]

    def run(batches):
        for batch in batches:
            x = np.array(batch.column("features").to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), pa.array(model.score(x))], names=[*(f.name for f in keep), name])

    from pyspark.sql import types as T

    return rows.mapInArrow(run, T.StructType([*keep, T.StructField(name, T.DoubleType())]))


def filter_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Rows of ``docs`` (columns as they are) whose score is at least ``threshold``; the model learns as in ``classify``.

    Texts are scored where they are read, so rows are not moved.
    """
    model = learn(docs, labels)[0]

    def run(batches):
        for batch in batches:
            x = np.array([statistics(t) for t in batch.column("text").to_pylist()], dtype=np.float64).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def held_out():
    """crc32 of doc_id as text is a multiple of 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and the statistics of every row."""
    rows = table(features(docs), "quality-features")
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    return fit(table(rows.where(~held_out()).join(known, "doc_id").select("features", "label"), "quality-labelled")), rows


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs`` (doc_id, text).

    Learns ``labels`` (doc_id, quality) of rows that aren't held out; a doc_id with several labels has their smallest,
    null labels are ignored, and without any labels every score is 0.5 or so.  Null and empty texts have the statistics
    of an empty text.  Rows whose doc_id is null are scored but never learnt from.
    """
    model, rows = learn(docs, labels)
    scored = apply(rows, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
