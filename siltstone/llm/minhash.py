"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped candidate edges.

A set's shingle hashes fall into ``BINS`` bins by their top bits and each bin keeps its smallest; an empty bin borrows
from bins in an order of its own until one has a value.  Sets of up to ``SMALL`` shingles, whose bins would be mostly
borrowed, get each bin from a permutation of its own instead; sets near the border have both, so that any two sets that
can be alike share a kind.  Bands of ``ROWS`` bins are the buckets.

Documents with equal sets are one vertex.  In a bucket every vertex is a candidate of the smallest one only (a star),
so candidates are as many as bucket entries, however large the bucket.  Candidates are confirmed on their full sets.
Where a bucket then still holds vertices of several components, an exact set-similarity join settles whether any two of
these are linked: shingles in order of frequency, rarest first; alike sets share one of their first few (prefix filter)
with enough left after it on both sides (positional filter).  Edited copies start with the shingles of their own edits,
so few pairs pass.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.llm.common import drop, table
from siltstone.llm.graph import components

BINS, ROWS = 128, 4
#: Above LARGE shingles a set has one-permutation bands; up to SMALL, bands of single permutations.
LARGE, SMALL = 192, 256
#: Bits of a shingle that choose its slot in the table of frequencies, for few and for many texts (1 to 4 megabytes).
SLOT_BITS, MOST_SLOT_BITS = 20, 22
#: Links of a hub that are confirmed together: a hub with more is copied.
HUB_LINKS = 256
#: Texts of a batch that are Python strings at a time.
SLICE = 500
#: Words whose hashes a worker keeps.
WORDS = 500_000

_mix = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _mix[1]
    x = (x ^ (x >> np.uint64(27))) * _mix[2]
    return x ^ (x >> np.uint64(31))


_seeds = scramble(np.arange(1, BINS + 1, dtype=np.uint64) * _mix[0])
_odd = scramble(np.arange(1001, BINS + 1001, dtype=np.uint64) * _mix[0]) | np.uint64(1)
_starts = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)
#: Bins from which each empty bin borrows, in order.
_donors = (scramble(np.arange(BINS, dtype=np.uint64)[:, None] * np.uint64(1 << 20) + np.arange(1, 513, dtype=np.uint64)[None, :] * _mix[0]) % np.uint64(BINS)).astype(np.int64)


class Shingles:
    """Sets of hashed word shingles."""

    def __init__(self, k: int = 5):
        self.k, self.words = k, {}

    def of(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the shingles of ``k`` words; the whole sequence as one where there are fewer; none without words."""
        words = (text or "").encode("utf-8", "replace").lower().split()  # of bytes: A-Z, and the white space of the contract
        if not words:
            return np.empty(0, dtype=np.uint64)
        known = self.words
        if len(known) > WORDS:
            known.clear()
        try:
            h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        k = min(self.k, len(h))
        out = np.full(len(h) - k + 1, k, dtype=np.uint64)
        for i in range(k):
            out = out * _mix[0] + h[i : len(h) - k + 1 + i]
        return np.unique(scramble(out))


def one_permutation(s: np.ndarray) -> np.ndarray:
    """``BINS`` values of a sorted set, empty bins filled by optimal densification."""
    at = np.searchsorted(s, _starts)
    ends = np.append(at[1:], len(s))
    full = at < ends
    values = np.where(full, s[np.minimum(at, len(s) - 1)] << np.uint64(BINS.bit_length() - 1), np.uint64(0))
    empty = np.flatnonzero(~full)
    for turn in range(_donors.shape[1]):
        if not len(empty):
            break
        donor = _donors[empty, turn]
        good = full[donor]
        values[empty[good]] = values[donor[good]] + np.uint64(turn + 1)
        empty = empty[~good]
    return values


def permutations(s: np.ndarray) -> np.ndarray:
    """``BINS`` values of a set, each the smallest under a permutation of its own."""
    x = (s[:, None] ^ _seeds[None, :]) * _odd[None, :]
    x ^= x >> np.uint64(32)
    x *= _mix[1]
    return x.min(axis=0)


def bands(s: np.ndarray) -> np.ndarray:
    """Bucket keys of a set."""
    found = []
    for kind, wanted, make in ((1, len(s) >= LARGE, one_permutation), (2, 0 < len(s) <= SMALL, permutations)):
        if wanted:
            rows = make(s).reshape(-1, ROWS)
            key = np.arange(len(rows), dtype=np.uint64) * np.uint64(2) + np.uint64(kind)
            for r in range(ROWS):
                key = scramble(key * _mix[0] + rows[:, r])
            found.append(key)
    return np.concatenate(found).view(np.int64) if found else np.empty(0, dtype=np.int64)


def sketches(docs: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, n_shingles, digest (of the set; null for the empty set), bands of each row of ``docs`` (doc_id, text)."""

    def run(batches):
        shingles = Shingles(k)
        for batch in batches:
            n, digest, keys = [], [], []
            for at in range(0, batch.num_rows, SLICE):
                for text in batch.slice(at, SLICE).column("text").to_pylist():
                    s = shingles.of(text)
                    n.append(len(s))
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    keys.append(bands(s))
            offsets = pa.array(np.cumsum([0, *map(len, keys)], dtype=np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(keys) if keys else np.empty(0, dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), lists], names=["doc_id", "n_shingles", "digest", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>")


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int, k: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets have 100 * intersection >= percent * union.

    A hub's text is shipped once for every ``HUB_LINKS`` of its links and stands before the texts that it is compared
    with, so no row holds two texts and a task keeps one hub's sets.
    """
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    hubs = pairs.groupBy("b").agg(F.ceil(F.count("*") / HUB_LINKS).cast("int").alias("salts"))
    salted = pairs.join(hubs, "b").select("b", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"), "a")
    linked = salted.join(texts.withColumnRenamed("id", "a"), "a").select("b", "salt", "a", "text")
    copies = texts.withColumnRenamed("id", "b").join(hubs, "b").select("b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("a"), "text")
    rows = linked.unionByName(copies).repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("a").asc_nulls_first())

    def run(batches):
        shingles, hub, theirs = Shingles(k), None, []
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                rows = batch.slice(at, SLICE)
                keep = []
                for a, b, text in zip(rows.column("a").to_pylist(), rows.column("b").to_pylist(), rows.column("text").to_pylist(), strict=True):
                    own = shingles.of(text)
                    if a is None:
                        theirs = [*(theirs if b == hub else []), own]
                        hub = b
                        keep.append(False)
                        continue
                    alike = False
                    for its in theirs:
                        shared = len(np.intersect1d(own, its, assume_unique=True))
                        alike |= bool(len(own)) and 100 * shared >= percent * (len(own) + len(its) - shared)
                    keep.append(alike)
                yield pa.RecordBatch.from_arrays([rows.column("a"), rows.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, "a bigint, b bigint").distinct()


def frequency_levels(texts: DataFrame, k: int) -> np.ndarray:
    """Logarithmic frequency of shingles by slot (their low bits), one byte each: the only thing that comes to the driver.

    There are 8 slots for each text, within the two bounds.
    """
    bits = min(MOST_SLOT_BITS, max(SLOT_BITS, (8 * texts.count()).bit_length()))

    def count(batches):
        shingles, total = Shingles(k), np.zeros(1 << bits, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                found = np.concatenate([shingles.of(text) for text in batch.slice(at, 1000).column("text").to_pylist()])
                total += np.bincount((found & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits)
        at = np.flatnonzero(total)
        for c in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[c : c + 100_000]), pa.array(total[at[c : c + 100_000]])], names=["slot", "n"])

    found = texts.select("text").mapInArrow(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    found = found.select("slot", F.least(F.floor(F.log2("n") * 4), F.lit(255)).cast("int").alias("level")).toArrow()
    levels = np.zeros(1 << bits, dtype=np.uint8)
    levels[found.column("slot").to_numpy()] = found.column("level").to_numpy()
    return levels


def prefixes(texts: DataFrame, levels: np.ndarray, percent: int, k: int) -> DataFrame:
    """token, place, n, vertex, part: the rarest shingles of each set, one of which any set that is alike must share."""

    def run(batches):
        shingles = Shingles(k)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = batch.slice(at, 500)
                tokens, places, sizes, take = [], [], [], []
                for row, text in enumerate(rows.column("text").to_pylist()):
                    s = shingles.of(text)
                    first = len(s) + (percent * len(s)) // -100 + 1 if len(s) else 0  # n - ceil(t * n) + 1
                    order = np.lexsort((s, levels[(s & np.uint64(len(levels) - 1)).astype(np.int64)]))[:first]
                    tokens.append(s[order].view(np.int64))
                    places.append(np.arange(first, dtype=np.int32))
                    sizes.append(np.full(first, len(s), dtype=np.int32))
                    take.append(np.full(first, row))
                take = pa.array(np.concatenate(take).astype(np.int64))
                columns = [pa.array(np.concatenate(tokens)), pa.array(np.concatenate(places)), pa.array(np.concatenate(sizes)), rows.column("vertex").take(take), rows.column("part").take(take)]
                yield pa.RecordBatch.from_arrays(columns, names=["token", "place", "n", "vertex", "part"])

    return texts.select("vertex", "part", "text").mapInArrow(run, "token bigint, place int, n int, vertex bigint, part bigint")


def near_duplicates(docs: DataFrame, percent: int = 75, k: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of ``docs`` (doc_id, text).

    Words are lower-cased (A-Z) and separated by white space.  A vertex is a doc_id: rows of one doc_id, equal or not,
    share its links.  Null and empty texts have no shingles and link with nothing.  A row whose doc_id is null links
    with nothing, has a null component_id and is kept.  Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = table(sketches(docs, k), "sketches")
    some = sketched.where("doc_id IS NOT NULL")
    sets = table(some.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("vertex")), "sets")
    placed = some.select("doc_id", "n_shingles", "digest").join(sets, "digest", "left").select("doc_id", "n_shingles", F.coalesce("vertex", "doc_id").alias("vertex"))
    placed = table(placed, "placed")
    repeated = placed.groupBy("doc_id").agg(F.collect_set("vertex").alias("v")).where("size(v) > 1 OR v[0] > doc_id")
    repeated = repeated.select(F.col("doc_id").alias("b"), F.explode("v").alias("a")).where("a <> b")

    entries = some.join(sets.withColumnRenamed("vertex", "doc_id"), ["digest", "doc_id"], "left_semi")
    entries = entries.select(F.col("doc_id").alias("vertex"), F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))
    buckets = table(entries.groupBy("band").agg(F.min(F.struct("vertex", "n")).alias("hub"), F.count("*").alias("size")).where("size > 1"), "buckets")
    shared = table(entries.join(buckets, "band"), "shared")

    star = shared.where((F.col("vertex") != F.col("hub.vertex")) & (F.least("n", "hub.n") * 100 >= F.greatest("n", "hub.n") * percent))
    star = table(star.select(F.col("vertex").alias("a"), F.col("hub.vertex").alias("b")).distinct(), "star")
    texts = table(docs.join(shared.select(F.col("vertex").alias("doc_id")).distinct(), "doc_id", "left_semi"), "texts")
    links = table(confirmed(star, texts, percent, k), "star-links")
    parts = components(links.union(repeated.select("a", "b")))

    members = shared.select("band", "vertex").join(parts.withColumnRenamed("id", "vertex"), "vertex", "left")
    members = table(members.select("band", "vertex", F.coalesce("component_id", "vertex").alias("part")), "members")
    mixed = table(members.groupBy("band").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("band"), "mixed")
    left = table(members.join(mixed, "band").select("vertex", "part").distinct(), "left")
    rest = table(texts.withColumnRenamed("doc_id", "vertex").join(left, "vertex"), "rest")
    first = table(prefixes(rest, frequency_levels(rest, k), percent, k), "prefixes")
    met = table(first.groupBy("token").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("token"), "met")
    first = table(first.join(met, "token"), "met-prefixes")
    other = first.select(*[F.col(c).alias(f"{c}_b") for c in ("token", "place", "n", "vertex", "part")])
    # Sets that are alike have at least t / (1 + t) of the sum of their sizes in common.
    enough = F.least(F.col("n") - F.col("place"), F.col("n_b") - F.col("place_b")) * (100 + percent) >= (F.col("n") + F.col("n_b")) * percent
    pairs = first.join(other, (F.col("token") == F.col("token_b")) & (F.col("part") < F.col("part_b")) & enough)
    pairs = pairs.select(F.greatest("vertex", "vertex_b").alias("a"), F.least("vertex", "vertex_b").alias("b")).distinct()
    pairs = table(pairs.join(star, ["a", "b"], "left_anti"), "pairs")
    more = table(confirmed(pairs, texts, percent, k), "more-links")
    whole = components(links.union(more).union(repeated.select("a", "b")))
    for old in (sets, buckets, shared, star, texts, members, mixed, left, rest, first, met, pairs):
        drop(old)
    out = placed.join(whole.withColumnRenamed("id", "vertex"), "vertex", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "vertex").alias("component_id"))
    lone = sketched.where("doc_id IS NULL").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return out.union(lone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, percent: int = 75, k: int = 5) -> DataFrame:
    """``docs`` (columns as they are) with one row of each near-duplicate group: that of the smallest doc_id.

    Of several rows of that doc_id one of each distinct text stays, by a hash of the row.  Rows whose doc_id is null stay.
    """
    found = table(near_duplicates(docs, percent, k), "near-duplicates")
    out = docs.join(found.where("NOT kept").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
    repeated = found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if repeated.limit(1).count():
        own = W.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.xxhash64(*docs.columns))
        several = out.where("doc_id IS NOT NULL").withColumn("__k", F.row_number().over(own)).where("__k = 1").drop("__k")
        out = several.union(out.where("doc_id IS NULL"))
    return out


def near_duplicates_sql() -> str:
    """Brute force in DuckDB: pairs of documents by shared shingles, and the transitive closure."""
    return r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
r(id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id WHERE r.root < e.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.root::BIGINT AS component_id, d.doc_id = c.root AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT id, min(root) AS root FROM r GROUP BY id) c ON c.id = d.doc_id
"""
