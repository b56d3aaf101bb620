"""Dense search on inverted lists, exact by distance bounds.

Vectors of length 1 lie on a sphere.  Each belongs to the list of its nearest centre, and a list knows the largest angle between its
centre and its vectors.  By the triangle inequality of angles no vector of a list is nearer to a question than the
angle to the centre less that largest angle, so lists whose bound is beyond a question's k-th best so far are skipped.
The centres come from a bounded sample; every vector is in a list, and what is skipped can't be among the best k.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.retrieval import top, unit_rows
from siltstone.plans import store

#: Vectors that centres are fitted to at most (about), centres at most, questions that go to the tasks at once.
SAMPLE, LISTS, BLOCK = 20_000, 1024, 2048
#: What rounding to 5 digits, and angles in double precision, can hide.
SLACK = 3e-5
#: Digits of a score.
DIGITS = 5


@dataclass
class Lists:
    """The index: ``rows`` (list, chunk_id, vector of length 1, other columns) as a table, and by list its centre, largest angle and size."""

    rows: DataFrame
    centres: np.ndarray
    radius: np.ndarray
    sizes: np.ndarray


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Angles between rows of length 1."""
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def nearest(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """``rows`` with list (the nearest centre) and angle (to it); their vectors get length 1.  Rows without a direction or of another size are left out."""
    from pyspark.sql import types as T

    keep = [f for f in rows.schema.fields if f.name not in ("vector", "list", "angle")]
    added = [T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("list", T.IntegerType()), T.StructField("angle", T.DoubleType())]
    d = centres.shape[1]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                vs = part.column("vector").to_pylist()
                good = np.array([bool(v) and len(v) == d and None not in v for v in vs], dtype=bool)
                if good.any():
                    x = np.array([v for v, g in zip(vs, good, strict=True) if g], dtype=np.float64)
                    with np.errstate(over="ignore"):
                        x = unit_rows(x / np.maximum(np.abs(x).max(axis=1, keepdims=True), np.finfo(float).tiny))
                    fine = np.isfinite(x).all(axis=1)
                    good[good] = fine
                    x = x[fine]
                    a = angles(x, centres)
                    own = a.argmin(axis=1).astype(np.int32)
                    kept = part.filter(pa.array(good))
                    columns = [pa.array(list(x), pa.list_(pa.float64())), pa.array(own), pa.array(a[np.arange(len(x)), own])]
                    yield pa.RecordBatch.from_arrays([*(kept.column(f.name) for f in keep), *columns], names=[*(f.name for f in keep), "vector", "list", "angle"])

    return rows.mapInArrow(run, T.StructType([*keep, *added]))


def inverted_lists(vectors: DataFrame, dimensions: int, sample: int = SAMPLE, lists: int = LISTS, seed: int = 1) -> Lists:
    """Index of ``vectors`` (chunk_id string, vector, other columns to filter by).

    Vectors of another number of dimensions, null, zero, or with null or non-finite components have no cosine and are in
    no list.  Centres: about the root of the number of vectors, ``lists`` at most, by k-means on about ``sample`` vectors, drawn by a hash.
    """
    rows = vectors.withColumn("vector", F.col("vector").cast("array<double>"))
    known = rows.where((F.size("vector") == dimensions) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0))
    n = known.count()
    drawn = known.where(F.pmod(F.xxhash64("vector"), F.lit(1 << 20)) < F.lit(int(min(1.0, 1.2 * sample / max(n, 1)) * (1 << 20)) + 1)).limit(2 * sample)
    k = int(max(1, min(lists, n**0.5)))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    points = store.written(drawn.select(F.transform("vector", lambda x: x / norm).alias("v")), "sampled-vectors")
    if k > 1:
        model = KMeans(k=k, seed=seed, maxIter=6, initMode="random", featuresCol="features").fit(points.select(array_to_vector("v").alias("features")))
        centres = unit_rows(np.array(model.clusterCenters()))
        centres = centres[np.isfinite(centres).all(axis=1)]
    else:
        centres = np.zeros((0, dimensions))
    centres = centres if len(centres) else np.eye(1, dimensions)  # any will do
    # Parts of a list lie together, so that row groups of other lists are skipped; a large list is several parts.
    placed = nearest(rows, centres).repartitionByRange("list", F.xxhash64("chunk_id")).sortWithinPartitions("list")
    placed = store.written(placed, "inverted-lists")
    radius, sizes = np.zeros(len(centres)), np.zeros(len(centres), dtype=np.int64)
    for r in placed.groupBy("list").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect():  # a row for each list
        radius[r["list"]], sizes[r["list"]] = r["radius"], r["n"]
    return Lists(placed.drop("angle"), centres, radius, sizes)


def scored(rows: DataFrame, ids: np.ndarray, asked: np.ndarray, wanted: np.ndarray, k: int) -> DataFrame:
    """query_id, chunk_id, score: each task's best ``k`` of ``rows`` for each question, of the lists that it wants (``wanted``: questions x lists)."""
    lists = [int(x) for x in np.flatnonzero(wanted.any(axis=0))]
    packed, width = np.packbits(wanted, axis=1), wanted.shape[1]

    def run(batches):
        want = np.unpackbits(packed, axis=1, count=width).astype(bool)
        best = (np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=object))
        for batch in batches:
            lists_ = batch.column("list").to_numpy()
            for own in np.unique(lists_):
                part = batch.filter(pa.array(lists_ == own))
                who = np.flatnonzero(want[:, own])
                for at in range(0, part.num_rows if len(who) else 0, 4096):
                    some = part.slice(at, 4096)
                    s = np.round(asked[who] @ np.array(some.column("vector").to_pylist()).T, DIGITS)
                    least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
                    q, c = np.nonzero(s >= least[:, None])
                    names = np.array(some.column("chunk_id").to_pylist(), dtype=object)[c]
                    q, s, names = (np.concatenate(x) for x in zip(best, (who[q], s[q, c], names), strict=True))
                    order = np.lexsort((np.unique(names.astype(str), return_inverse=True)[1], -s, q))
                    q, s, names = q[order], s[order], names[order]
                    kept = np.arange(len(q)) - np.searchsorted(q, q, side="left") < k
                    best = (q[kept], s[kept], names[kept])
        q, s, names = best
        yield pa.RecordBatch.from_arrays([pa.array(ids[q], pa.int64()), pa.array(names.tolist(), pa.string()), pa.array(s, pa.float64())], names=["query_id", "chunk_id", "score"])

    return rows.where(F.col("list").isin(lists)).select("list", "chunk_id", "vector").mapInArrow(run, "query_id bigint, chunk_id string, score double")


def search(queries: DataFrame, index: Lists, k: int, where: Column | None = None) -> tuple[DataFrame, float]:
    """Best ``k`` chunks of each question, and the share of (question, vector) pairs that were compared.

    ``queries`` (query_id bigint, query_vector); result: query_id, chunk_id, rank (from 0), score (cosine, 5 digits; ties by
    chunk_id), the same as comparing everything.  ``where``: a condition on the index's columns, for instance a year.  Questions go to
    the tasks in blocks of about ``BLOCK``, and a block's result is written before the next begins.

    A question first reads its nearest lists, until they hold 2k vectors; the k-th score there is its floor, and then the lists whose bound reaches it.
    """
    rows = index.rows.where(where) if where is not None else index.rows
    asked = queries.select("query_id", F.col("query_vector").cast("array<double>").alias("query_vector"))
    n, done, compared, pairs = asked.count(), [], 0, 0
    blocks = max(1, -(-n // BLOCK))
    for b in range(blocks):
        ids, vs = [], []
        for r in asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect():
            if r["query_vector"] and len(r["query_vector"]) == index.centres.shape[1] and None not in r["query_vector"]:
                ids.append(r["query_id"])
                vs.append(r["query_vector"])
        x = unit_rows(np.array(vs, dtype=np.float64).reshape(-1, index.centres.shape[1]))
        fine = np.isfinite(x).all(axis=1)
        ids, x = np.array(ids, dtype=np.int64)[fine], x[fine]
        if not len(ids):
            continue
        away = angles(x, index.centres)
        order = away.argsort(axis=1)
        before = np.cumsum(index.sizes[order], axis=1) - index.sizes[order]
        first = np.zeros(away.shape, dtype=bool)
        np.put_along_axis(first, order, before < 2 * k, axis=1)
        seeds = store.written(scored(rows, ids, x, first, k), "dense-seeds")
        place, floor = {int(i): at for at, i in enumerate(ids)}, np.full(len(ids), -2.0)
        for r in top(seeds, k).where(F.col("rank") == k - 1).select("query_id", "score").collect():  # a row for each question of the block
            floor[place[r["query_id"]]] = r["score"]
        reach = np.cos(np.maximum(away - index.radius, 0.0))
        rest = (reach >= floor[:, None] - SLACK) & ~first & (index.sizes > 0)
        found = seeds.unionByName(scored(rows, ids, x, rest, k)) if rest.any() else seeds
        done.append(store.written(top(found, k).select("query_id", "chunk_id", "rank", "score"), "dense-found"))
        compared += int(((first | rest) * index.sizes).sum())
        pairs += len(ids) * int(index.sizes.sum())
    out = queries.sparkSession.createDataFrame([], "query_id bigint, chunk_id string, rank int, score double")
    for part in done:
        out = out.unionByName(part)
    return out, compared / max(pairs, 1)
