"""Merkle dataset manifest by lag and lead windows.

Every row is a leaf.  Leaves of one tree lie in order in blocks of a fixed number of places; inside a block all levels are
built in place: at level l the nodes are the rows whose place is a multiple of fanout ** l (a node's first leaf stands for
it), so siblings stand at fixed offsets and are lag and lead columns, masked by the node's slot and by where the run
ends.  First-child rows hash the parent.  The tops of the blocks are the nodes of the next table, until a tree has one
node; then the trees' roots are the leaves of one more tree.  No task holds a tree: windows are blocks, places come from a
range sort and counts by partition, and what one level hands to the next shrinks by the size of a block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.llm.common import drop, parts, table

#: Places of a block, at most: the largest power of the fanout up to here.
BLOCK = 512


def sha(*columns):
    return F.sha2(F.concat(*columns), 256)


def field(value):
    """``-`` for null, else UTF-8 byte count, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(doc_id, source, lang, n_chars, text):
    return sha(*map(field, (doc_id, source, lang, n_chars, text)))


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` (tree, and what ``order`` names) with place (from 0, in its tree) and size (of the tree), as a table.

    Rows are sorted by range over all trees; a row's place is its number inside its partition and the counts of the
    partitions before.  ``order`` must end in a column that tells rows apart.
    """
    spark = rows.sparkSession
    keys = ["tree", *[F.col(c).asc_nulls_first() for c in order]]
    numbered = rows.repartitionByRange(parts(spark), *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    done = table(numbered, "merkle-sorted")
    part = F.shiftright("at", 33)
    runs = done.groupBy(part.alias("part"), "tree").agg(F.min("at").alias("low"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("tree").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = table(runs.select("part", "tree", "low", before.alias("before"), F.sum("n").over(W.partitionBy("tree")).alias("size")), "merkle-runs")
    out = done.withColumn("part", part).join(runs, ["part", "tree"])
    return out.withColumn("place", F.col("at") - F.col("low") + F.col("before")).drop("part", "at", "low", "before")


def within_blocks(nodes: DataFrame, levels, most: int, fanout: int) -> tuple[DataFrame, int]:
    """``nodes`` (tree, place, hash; ``levels``: still to build for the row's tree) with block, path, top; and the levels of a block.

    path: array<struct<left, right>> of the siblings' concatenated hashes, level by level up to the block's top, which
    stands in the block's first row (else null).  ``most``: the largest of ``levels``.
    """
    height = 1
    while fanout ** (height + 1) <= BLOCK:
        height += 1
    size = fanout**height
    rows = nodes.withColumn("block", F.expr(f"place div {size}")).withColumn("inside", (F.col("place") % size).cast("int")).withColumn("rest", levels).withColumn("node", F.col("hash"))
    block = W.partitionBy("tree", "block").orderBy("place")
    count = min(height, most)
    for level in range(count):
        step = fanout**level
        slot = F.expr(f"inside div {step}") % fanout
        live = (F.col("inside") % step == 0) & (F.col("rest") > level)
        # A node's j-th neighbours: before it if its slot is at least j, behind it if the run goes on so far.
        left = [F.when(slot >= j, F.lag("node", j * step).over(block)) for j in range(fanout - 1, 0, -1)]
        right = [F.when(slot + j < fanout, F.lead("node", j * step).over(block)) for j in range(1, fanout)]
        both = F.struct(*[F.concat(*[F.coalesce(c, F.lit("")) for c in side]).alias(name) for name, side in (("left", left), ("right", right))])
        rows = rows.withColumn(f"near{level}", F.when(live, both))
        parent = sha("node", F.col(f"near{level}.right"))
        rows = rows.withColumn("node", F.when(live & (F.col("inside") % (step * fanout) == 0), parent).when(F.col("rest") <= level, F.col("node")))
    # A leaf's siblings at a level stand in the row of its node, the last one at or before it that has any.
    upto = block.rowsBetween(W.unboundedPreceding, W.currentRow)
    path = F.array_compact(F.array(*[F.last(f"near{level}", ignorenulls=True).over(upto) for level in range(count)]))
    if not count:
        path = F.array().cast("array<struct<left:string,right:string>>")
    out = rows.withColumn("path", path).withColumn("top", F.when(F.col("inside") == 0, F.col("node")))
    return out.drop("inside", "rest", "node", *[f"near{level}" for level in range(count)]), height


def levels_of(size, fanout: int):
    """Levels above ``size`` leaves: the least l with fanout ** l >= size (at most 62)."""
    powers = F.array(*[F.lit(fanout**k).cast("long") for k in range(1, 63) if fanout**k < 2**62])
    return F.size(F.filter(powers, lambda p: p < size)) + F.when(size > 1, 1).otherwise(0)


def build(leaves: DataFrame, fanout: int) -> tuple[DataFrame, DataFrame]:
    """Trees over ``leaves`` (tree, place, size, hash, …).

    Gives ``leaves`` with path, and tops: tree, block, root, over (the path from a block's top to the root), a row for
    each block.  The tops are a table; ``leaves`` with their paths are not, so they are joined where they are made.
    """
    most = leaves.agg(F.max(levels_of(F.col("size"), fanout))).first()[0] or 0
    first, height = within_blocks(leaves, levels_of(F.col("size"), fanout), most, fanout)
    rounds, done, nodes = [], height, first
    tops = lambda df, levels: df.where("top IS NOT NULL").select("tree", F.col("block").alias("place"), levels.alias("levels"), F.col("top").alias("hash"))
    nodes = table(tops(first, levels_of(F.col("size"), fanout)), "merkle-tops")
    while done < most:
        found = within_blocks(nodes, F.col("levels") - done, most - done, fanout)[0]
        found = table(found.select("tree", "place", "levels", "block", "path", "top"), "merkle-level")
        rounds.append(found)
        drop(nodes)
        nodes = table(tops(found, F.col("levels")), "merkle-tops")
        done += height
    none = F.array().cast("array<struct<left:string,right:string>>")
    over = nodes.select("tree", F.col("place").alias("block"), F.col("hash").alias("root"), none.alias("over"))
    for found in reversed(rounds):
        over = found.join(over, ["tree", "block"]).select("tree", F.col("place").alias("block"), "root", F.concat("path", "over").alias("over"))
    over = table(over, "merkle-over")
    for old in [nodes, *rounds]:
        drop(old)
    return first.drop("top", "size"), over


def folded(start, path):
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda acc, s: sha(s["left"], acc, s["right"]))


def proof(path):
    """Digest of the siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(docs: DataFrame, fanout: int = 2, every: int = 7) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, n_siblings of each row of ``docs`` (doc_id, source, lang, n_chars, text).

    Trees by lang (null is a tree of its own), then one tree over their roots, null first, else by UTF-8 bytes.  Leaves
    ascend by doc_id, null first; rows of one doc_id by their hash, and rows that are equal altogether are
    interchangeable.  ``folded_root`` is recomputed from the leaf and its siblings; rows whose crc32 of doc_id ``every``
    divides are checked with n_chars one larger (a null n_chars or doc_id is left alone), and so fail.  An empty table
    gives no rows; other columns are ignored.
    """
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    checked = F.when(tampered, leaf_hash(*[c + 1 if k == 3 else c for k, c in enumerate(columns)]))
    # "" for null comes before every other tree, whose names start with a colon.
    tree = F.coalesce(F.concat(F.lit(":"), F.col("lang").cast("string")), F.lit(""))
    rows = docs.select("doc_id", tree.alias("tree"), leaf_hash(*columns).alias("hash"), checked.alias("checked"))
    hashed = table(rows.withColumn("row", F.monotonically_increasing_id()), "merkle-leaves")
    leaves, over = build(placed(hashed, "doc_id", "hash", "row"), fanout)

    roots = over.where("block = 0").select(F.col("tree").alias("name"), F.lit("").alias("tree"), F.col("root").alias("hash"))
    upper, above = build(placed(roots, "name"), fanout)
    upper = upper.join(above.withColumnRenamed("root", "whole"), ["tree", "block"]).select(F.col("name").alias("tree"), "whole", F.concat("path", "over").alias("last"))
    over = table(over.join(upper, "tree").select("tree", "block", "root", "whole", F.concat("over", "last").alias("over")), "merkle-paths")

    out = leaves.join(over, ["tree", "block"]).withColumn("path", F.concat("path", "over"))
    out = out.withColumn("folded_root", folded(F.coalesce("checked", "hash"), F.col("path")))
    return out.select(
        "doc_id", F.col("hash").alias("leaf"), F.col("root").alias("subroot"), F.col("whole").alias("root"), proof(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("whole")).alias("verified"), F.aggregate("path", F.lit(0), lambda n, s: n + ((F.length(s["left"]) + F.length(s["right"])) / 64).cast("int")).alias("n_siblings"),
    )


def manifest_sql() -> str:
    """The same in DuckDB: levels by recursion, siblings by their numbers, crc32 bit by bit."""
    part = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda chars: "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", chars, "text")) + ")"
    bit = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"
    return rf"""
WITH RECURSIVE bits AS (SELECT i, i::BIGINT AS x, 0 AS k FROM range(256) r(i) UNION ALL SELECT i, {bit}, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(x ORDER BY i) AS tab FROM bits WHERE k = 8),
d AS (SELECT doc_id, coalesce(':' || lang, '') AS tree, {leaf('n_chars')} AS leaf,
             CASE WHEN doc_id IS NOT NULL AND n_chars IS NOT NULL AND {crc} % 7 = 0 THEN {leaf('(n_chars + 1)')} END AS checked FROM documents, crc),
p AS (SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS size FROM d),
n(lvl, tree, place, h, size) AS (
  SELECT 0, tree, place, leaf, size FROM p
  UNION ALL SELECT lvl + 1, tree, place // 2, sha256(string_agg(h, '' ORDER BY place)), (size + 1) // 2 FROM n WHERE size > 1 GROUP BY lvl, tree, place // 2, size),
r AS (SELECT tree, h, lvl, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS size FROM n WHERE size = 1),
u(lvl, place, h, size) AS (
  SELECT 0, place, h, size FROM r
  UNION ALL SELECT lvl + 1, place // 2, sha256(string_agg(h, '' ORDER BY place)), (size + 1) // 2 FROM u WHERE size > 1 GROUP BY lvl, place // 2, size),
-- every leaf's siblings: inside its tree, then among the roots
s AS (
  SELECT p.id, n.lvl, n.h, n.place < (p.place >> n.lvl) AS before FROM p JOIN n ON n.tree = p.tree AND n.place = xor(p.place >> n.lvl, 1::BIGINT)
  UNION ALL SELECT p.id, r.lvl + u.lvl, u.h, u.place < (r.place >> u.lvl) FROM p JOIN r ON r.tree = p.tree JOIN u ON u.place = xor(r.place >> u.lvl, 1::BIGINT)),
f(id, lvl, h, height) AS (
  SELECT p.id, 0, coalesce(checked, leaf), r.lvl + (SELECT max(lvl) FROM u) FROM p JOIN r ON r.tree = p.tree
  UNION ALL SELECT f.id, f.lvl + 1, sha256(CASE WHEN s.before THEN s.h || f.h ELSE f.h || coalesce(s.h, '') END), height FROM f LEFT JOIN s ON s.id = f.id AND s.lvl = f.lvl WHERE f.lvl < f.height),
q AS (SELECT id, string_agg(h, '' ORDER BY lvl) AS proof, count(*) AS n FROM s GROUP BY id),
whole AS (SELECT h FROM u WHERE size = 1)
SELECT p.doc_id, p.leaf, r.h AS subroot, whole.h AS root, sha256(coalesce(q.proof, '')) AS proof_sha256, f.h AS folded_root, f.h = whole.h AS verified, coalesce(q.n, 0)::INT AS n_siblings
FROM p JOIN r ON r.tree = p.tree CROSS JOIN whole LEFT JOIN q ON q.id = p.id JOIN f ON f.id = p.id AND f.lvl = f.height
"""
