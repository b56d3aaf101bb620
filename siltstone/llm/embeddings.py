"""Embedding near-dedup by PCA-ordered tiled comparison.

Unit vectors are rotated to the eigenvectors of their second moments, largest first, which leaves cosines as they are.
Vectors with cosine >= t are at most sqrt(2 - 2t) apart in any direction, so a grid of that width over the first
``GRID`` coordinates leaves only neighbouring cells to compare; cells are dealt into tiles of a bounded number of bytes,
one row each.  Tiles whose bounding boxes over the leading dimensions are further apart than that aren't paired.  In a
pair of tiles the leading dimensions are accumulated first; the rest of a product is bounded by the norms of the two
suffixes, and pairs that cannot reach t stop there.  What remains is confirmed on the vectors as given.

A pair of tiles returns counts and a spanning forest of its links, never the links, so a group of n copies of a vector
or of vectors near it costs rows in proportion to n.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.llm.common import drop, table
from siltstone.llm.graph import components

#: Dimensions accumulated at a time.
LEAD = 8
#: Coordinates of the grid.
GRID = 3
#: Pairs confirmed at a time.
PAIRS = 20_000
#: Bytes of vectors in a tile.
TILE_BYTES = 1 << 20
#: Rows of a tile that are compared at a time.
ROWS = 512
#: Parts that a hot cell's vectors are dealt into on their way.
SALTS = 16


def prepared(vectors: DataFrame) -> DataFrame:
    """vec_id, label, cls, raw (float64 bytes) of each row; cls and raw are null where the vector can't link."""
    label = vectors.schema["label"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            cls, raw = [], []
            for label, values in zip(batch.column("label").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
                one = None
                if label is not None and values and None not in values:
                    x = np.array(values, dtype=np.float64) + 0.0  # -0 becomes 0
                    if np.isfinite(x).all() and x.any():
                        one = x.tobytes()
                raw.append(one)
                cls.append(None if one is None else int.from_bytes(hashlib.blake2b(repr(label).encode() + b"/" + one, digest_size=8).digest(), "little", signed=True))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(cls, pa.int64()), pa.array(raw, pa.binary())], names=["vec_id", "label", "cls", "raw"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").mapInArrow(run, f"vec_id bigint, label {label}, cls bigint, raw binary")


def scaled(raw) -> np.ndarray:
    """Vectors as given but for a power of two of each, so that products of extreme numbers stay finite and cosines as they are."""
    x = np.stack([np.frombuffer(r, dtype=np.float64) for r in raw])
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.square(x).sum(axis=1, keepdims=True))


def axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """Rotation by number of dimensions: eigenvectors of the second moments, which are all that comes to the driver."""

    def moments(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            by: dict[int, list[bytes]] = {}
            for r in batch.column("raw").to_pylist():
                by.setdefault(len(r) // 8, []).append(r)
            for d, own in by.items():
                x = unit(scaled(own))
                total[d] = total.get(d, 0) + (x.T @ x).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([m.tolist() for m in total.values()], pa.list_(pa.float64()))], names=["d", "m"])

    sums = classes.select("raw").mapInArrow(moments, "d int, m array<double>").select("d", F.posexplode("m").alias("at", "v")).groupBy("d", "at").agg(F.sum("v").alias("v")).collect()
    out = {r["d"]: np.zeros(r["d"] ** 2) for r in sums}
    for r in sums:
        out[r["d"]][r["at"]] = r["v"]
    return {d: np.linalg.eigh(m.reshape(d, d))[1][:, ::-1].copy() for d, m in out.items()}


def compare_rows(a: np.ndarray, b: np.ndarray, raw_a: np.ndarray, raw_b: np.ndarray, first: int | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of linked pairs of rows of two tiles (``a``, ``b``: rotated unit vectors; ``raw_*``: as given); with ``first`` only those of b behind first + i."""
    slack, d = 1e-9, a.shape[1]
    product = a[:, :LEAD] @ b[:, :LEAD].T
    rest_a, rest_b = np.sqrt(np.square(a[:, LEAD:]).sum(axis=1)), np.sqrt(np.square(b[:, LEAD:]).sum(axis=1))
    alive = product + np.outer(rest_a, rest_b) >= threshold - slack
    if first is not None:
        alive = np.triu(alive, first + 1)
    i, j = np.nonzero(alive)
    value = product[i, j]
    for at in range(LEAD, d, LEAD):
        if not len(i):
            break
        to = min(at + LEAD, d)
        step = np.concatenate([np.einsum("ij,ij->i", a[i[k : k + PAIRS], at:to], b[j[k : k + PAIRS], at:to]) for k in range(0, len(i), PAIRS)])
        value = value + step
        rest_a, rest_b = np.sqrt(np.square(a[:, to:]).sum(axis=1)), np.sqrt(np.square(b[:, to:]).sum(axis=1))
        stays = value + rest_a[i] * rest_b[j] >= threshold - slack
        i, j, value = i[stays], j[stays], value[stays]
    sure = []
    norm_a, norm_b = np.sqrt(np.square(raw_a).sum(axis=1)), np.sqrt(np.square(raw_b).sum(axis=1))
    for k in range(0, len(i), PAIRS):
        p, q = i[k : k + PAIRS], j[k : k + PAIRS]
        sure.append(np.einsum("ij,ij->i", raw_a[p], raw_b[q]) / (norm_a[p] * norm_b[q]) >= threshold)
    keep = np.concatenate(sure) if sure else np.zeros(0, dtype=bool)
    return i[keep], j[keep]


def compare(a: np.ndarray, b: np.ndarray, raw_a: np.ndarray, raw_b: np.ndarray, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of linked pairs of two tiles, each pair once if ``same``; ``ROWS`` rows at a time."""
    found = []
    for k in range(0, len(a), ROWS):
        i, j = compare_rows(a[k : k + ROWS], b, raw_a[k : k + ROWS], raw_b, k if same else None, threshold)
        found.append((i + k, j))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index that each of ``n`` nodes reaches by the links (i, j)."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            return root


def near_vectors(vectors: DataFrame, threshold: float = 0.93, tile: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of ``vectors`` (vec_id, label, embedding).

    Links join rows of equal label (and number of dimensions) whose cosine is at least ``threshold`` (above 0), each row
    with every other; n_links counts rows.  Vectors that are null, empty, zero or hold null or non-finite numbers, and
    rows whose label is null, link with nothing.  Rows of one vec_id are one vertex of the components.  A row whose
    vec_id is null has a null component_id and is kept.  Other columns are ignored.  ``tile``: vectors in a tile, by
    default as many as ``TILE_BYTES`` hold.
    """
    rows = table(prepared(vectors), "vectors")
    fit = rows.where("raw IS NOT NULL AND vec_id IS NOT NULL")
    classes = table(fit.groupBy("cls").agg(F.min("vec_id").alias("vertex"), F.count("*").alias("copies"), F.first("raw").alias("raw"), F.first("label").alias("label")), "classes")
    turn = axes(classes)
    width = float(np.sqrt(2 - 2 * threshold)) + 1e-9
    label = vectors.schema["label"].dataType.simpleString()

    def place(batches):
        for batch in batches:
            raw = batch.column("raw").to_pylist()
            d = [len(r) // 8 for r in raw]
            lead = np.zeros((len(raw), LEAD))
            for n in set(d):
                own = [k for k, x in enumerate(d) if x == n]
                at = unit(scaled([raw[k] for k in own])) @ turn[n][:, :LEAD]
                lead[own, : at.shape[1]] = at
            cell = np.floor(lead[:, :GRID] / width).astype(np.int32)
            names = ["cls", "vertex", "copies", "raw", "label"]
            places = pa.FixedSizeListArray.from_arrays(pa.array(cell.ravel()), GRID).cast(pa.list_(pa.int32()))
            leads = pa.FixedSizeListArray.from_arrays(pa.array(lead.ravel()), LEAD).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(d, pa.int32()), places, leads], names=[*names, "d", "cell", "lead"])

    placed = table(classes.mapInArrow(place, f"cls bigint, vertex bigint, copies bigint, raw binary, label {label}, d int, cell array<int>, lead array<double>"), "placed")
    at = ["label", "d", "cell"]
    # A label's vectors are told apart by as many coordinates as its size asks for: none in one tile, all beyond 256.
    most = F.lit(tile) if tile else F.greatest(F.floor(F.lit(TILE_BYTES) / (F.col("d") * 8)), F.lit(1))
    sizes = placed.groupBy("label", "d", F.col("cell").alias("own")).agg(F.count("*").alias("n")).withColumn("all", F.sum("n").over(W.partitionBy("label", "d")))
    used = F.when(F.col("all") <= most, 0).when(F.col("all") <= 16 * most, 1).when(F.col("all") <= 256 * most, 2).otherwise(GRID)
    sizes = sizes.withColumn("cell", F.transform("own", lambda x, i: F.when(i < used, x).otherwise(0)))
    sizes = sizes.withColumn("tiles", F.ceil(F.sum("n").over(W.partitionBy(*at)) / most).cast("int"))
    sizes = sizes.select(*at, "own", "tiles", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = placed.withColumnRenamed("cell", "own").withColumn("salt", F.pmod(F.xxhash64(F.lit("s"), "cls"), F.lit(SALTS)).cast("int"))
    dealt = dealt.join(sizes, ["label", "d", "own", "salt"]).withColumn("tile", F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int"))
    boxes = [F.struct(F.min(F.get("lead", k)).alias("lo"), F.max(F.get("lead", k)).alias("hi")) for k in range(LEAD)]
    members = F.array_sort(F.collect_list(F.struct("cls", "vertex", "copies", "raw")))
    tiles = table(
        dealt.groupBy(*at, "tile").agg(F.array(*boxes).alias("box"), members.alias("m"))
        .select(F.xxhash64(*at, "tile").alias("id"), "label", "d", "cell", "box", "m.cls", "m.vertex", "m.copies", "m.raw"),
        "tiles",
    )
    # Each cell with itself and half of its neighbours; of a cell's own tiles each pair once.
    steps = [s for s in itertools.product((-1, 0, 1), repeat=GRID) if s >= (0,) * GRID]
    thin = tiles.select("id", "label", "d", "cell", "box")
    moved = thin.select(F.col("id").alias("a"), "label", "d", F.col("box").alias("box_a"), F.explode(F.array(*[F.struct(F.lit(any(s)).alias("other"), F.array(*[F.get("cell", k) + v for k, v in enumerate(s)]).alias("cell")) for s in steps])).alias("s"))
    moved = moved.select("a", "label", "d", "box_a", "s.other", "s.cell")
    apart = F.aggregate(F.zip_with("box_a", "box", lambda p, q: F.greatest(p["lo"] - q["hi"], q["lo"] - p["hi"], F.lit(0.0))), F.lit(0.0), lambda s, x: s + x * x)
    both = moved.join(thin.withColumnRenamed("id", "b"), ["label", "d", "cell"]).where((F.col("other") | (F.col("a") <= F.col("b"))) & (apart <= width * width))
    both = table(both.select("a", "b"), "tile-pairs")
    columns = ["d", "cls", "vertex", "copies", "raw"]
    side = lambda k: tiles.select(F.col("id").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in columns])
    pairs = both.join(side("a"), "a").join(side("b").drop("d_b"), "b")

    def run(batches):
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                r = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                same, v = r["a"] == r["b"], turn[r["d_a"]]
                raw_a = scaled(r["raw_a"])
                raw_b = raw_a if same else scaled(r["raw_b"])
                i, j = compare(unit(raw_a) @ v, unit(raw_b) @ v, raw_a, raw_b, same, threshold)
                if not len(i):
                    continue
                more = [] if same else [r["cls_b"], r["vertex_b"], r["copies_b"]]
                cls, vertex, copies = (np.array(x + (more[k] if more else []), dtype=np.int64) for k, x in enumerate((r["cls_a"], r["vertex_a"], r["copies_a"])))
                j = j if same else j + len(raw_a)
                links = (np.bincount(i, copies[j], len(cls)) + np.bincount(j, copies[i], len(cls))).astype(np.int64)
                root, some = vertex[forest(len(cls), i, j)], links > 0
                out.append((cls[some], vertex[some], links[some], root[some]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["cls", "vertex", "links", "root"])

    linked = table(pairs.mapInArrow(run, "cls bigint, vertex bigint, links bigint, root bigint"), "linked")
    twins = fit.join(classes.select("cls", "vertex"), "cls").where("vec_id <> vertex").select("vec_id", "vertex").distinct()
    several = twins.groupBy("vec_id").agg(F.collect_set("vertex").alias("v"))
    also = fit.join(classes.select("cls", "vertex"), ["cls"]).where("vec_id = vertex").select(F.col("vec_id").alias("own")).distinct()
    joined = several.join(also, several.vec_id == also.own, "left").where("size(v) > 1 OR own IS NOT NULL")
    joined = joined.select(F.col("vec_id").alias("a"), F.explode("v").alias("b"))
    whole = components(linked.select(F.col("vertex").alias("a"), F.col("root").alias("b")).union(joined))
    counts = linked.groupBy("cls").agg(F.sum("links").alias("links"))
    known = table(
        classes.select("cls", "vertex", "copies").join(counts, "cls", "left").join(whole.withColumnRenamed("id", "vertex"), "vertex", "left")
        .select("cls", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "vertex").alias("component_id")),
        "known",
    )
    for old in (placed, tiles, both, linked, classes):
        drop(old)
    out = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("cls")).alias("cls")).join(known, "cls", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def near_vectors_sql() -> str:
    """Brute force in DuckDB."""
    return r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
r(id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id WHERE r.root < l.b)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id)::BIGINT AS n_links, c.root AS component_id, e.vec_id = c.root AS kept
FROM embeddings e JOIN (SELECT id, min(root) AS root FROM r GROUP BY id) c ON c.id = e.vec_id
"""
