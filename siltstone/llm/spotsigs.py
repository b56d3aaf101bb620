"""Document fingerprints by SpotSigs.

A signature is a common word (anchor) with the next two content words after it.  A fingerprint is the set of a text's
signatures, hashed, in order; two fingerprints are compared by Jaccard, after the ratio of their sizes, which bounds it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.llm.common import parts

#: Common words of English, French, German and Spanish, at which chains start.
ANCHORS = (
    "a an and are as at be but by for from had has have he her his in is it of on or she that the they this to was were which with you "
    "au avec dans de des du elle en est et il je la le les leur mais ne nous ou par pas pour que qui sur un une "
    "aber als auch auf aus bei das dem den der die ein eine er es für ich im ist mit nach nicht sich sie sind und von war wie zu zum "
    "al como con del el ella era los más me muy no para pero por se sin su sus una uno y yo las"
).split()
#: Words that chains pass over besides anchors: none, every common word is an anchor.
COMMON: list[str] = []
#: What stands between words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def signatures(text, anchors=ANCHORS, common=COMMON, chain: int = 2, reach: int = 8):
    """Sorted distinct hashes of the chains of ``chain`` content words among the ``reach`` words after each anchor.

    A text that has words but no chain has one signature, of all its words; a text without words has none.
    """
    tokens = F.split(F.trim(F.regexp_replace(F.lower(text), GAP, " ")), " ")

    def of(t):
        spots = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: F.get(t, i).isin(*anchors))
        content = lambda i: F.slice(F.filter(F.slice(t, i + 2, reach), lambda w: ~w.isin(*anchors, *common)), 1, chain)
        chains = F.filter(F.transform(spots, lambda i: F.concat(F.array(F.get(t, i)), content(i))), lambda c: F.size(c) == chain + 1)
        whole = F.when(F.get(t, F.lit(0)) == "", F.array().cast("array<array<string>>")).otherwise(F.array(t))
        named = F.transform(F.array(chains), lambda c: F.when(F.size(c) > 0, c).otherwise(whole))
        return F.transform(F.element_at(named, 1), lambda c: F.substring(F.md5(F.array_join(c, " ")), 1, 8))

    return F.array_sort(F.array_distinct(F.element_at(F.transform(F.array(tokens), of), 1)))


def likeness(a, b, floor: float = 0.0):
    """Jaccard of two fingerprints (arrays).  Pairs whose size ratio is below ``floor`` give 0 uncompared.  Two empty ones are alike (1)."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b))
    return (
        F.when(large == 0, 1.0).when((small == 0) | (small < floor * large), 0.0).otherwise(shared / (F.size(a) + F.size(b) - shared)).cast("double")
    )


def with_next(docs: DataFrame, per_partition: int = 4) -> DataFrame:
    """doc_id, text, signatures (own), and the next row's text and signatures (next_text, next_own), in order of doc_id (null last; equal ids by a hash of the text); the last row's next is the first.

    Rows are dealt into ranges of doc_id, ``per_partition`` for each shuffle partition, at quantiles of the ids; a row's
    next stands in its own range or is the first of the range after it.  Only texts are moved; signatures are made where
    they arrive, once for each text.
    """
    n = parts(docs.sparkSession) * per_partition
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("h"))
    cuts = docs.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 20 * n).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))  # at most n - 1 numbers
    lists = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<bigint>")
    place = F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(F.size(F.filter(lists, lambda c: c < F.col("doc_id")))) if len(cuts) <= 64 else None
    if place is None:  # many cuts: nested lists, so that each row looks through two short ones
        width = int(len(cuts) ** 0.5) + 1
        heads = F.array(*[F.lit(cuts[k]) for k in range(0, len(cuts), width)])
        group = F.size(F.filter(heads, lambda c: c < F.col("doc_id"))) - 1
        rest = F.slice(lists, F.greatest(group, F.lit(0)) * width + 1, F.lit(width))
        place = F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(F.greatest(group, F.lit(0)) * width + F.size(F.filter(rest, lambda c: c < F.col("doc_id"))))
    dealt = docs.withColumn("range", place.cast("int")).withColumn("end", F.lit(0))
    order = [F.col("doc_id").asc_nulls_last(), F.col("h").asc()]
    # The first row of each range stands at the end of the range before it, too: as many rows as there are ranges.
    heads = dealt.groupBy("range").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(0)).alias("i"), "h")).alias("head"))
    turn = W.orderBy(F.col("range"))
    heads = heads.select(F.col("range").alias("r"), "head", F.coalesce(F.lag("range").over(turn), F.max("range").over(W.partitionBy())).alias("before"))
    first = dealt.join(F.broadcast(heads), (F.col("range") == F.col("r")) & (F.coalesce("doc_id", F.lit(0)) == F.col("head.i")) & (F.col("h") == F.col("head.h")))
    first = first.dropDuplicates(["range"]).select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "text", "h", F.col("before").alias("range"), F.lit(1).alias("end"))
    inside = W.partitionBy("range").orderBy("end", *order)
    moved = dealt.unionByName(first).repartition("range").withColumn("own", signatures(F.col("text")))
    rows = moved.withColumn("next_text", F.lead("text").over(inside)).withColumn("next_own", F.lead("own").over(inside))
    return rows.where("end = 0").select("doc_id", "text", "own", "next_text", "next_own")


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row of ``docs`` (doc_id, text).

    A row's edited text has its last floor(n_chars / 4) code points replaced by as many (or all) of the first of the next
    row's text.  Null texts are empty; an empty text has an empty fingerprint, like only another empty one.  Repeated
    rows each give a row; a table of one row follows itself.  Other columns are ignored.
    """
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    tail = F.expr("CAST(n_chars DIV 4 AS INT)")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - tail), F.substring(F.col("next_text"), F.lit(1), tail))
    rows = rows.select("doc_id", "n_chars", "own", "next_own", edited.alias("edited"))
    rows = rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        "own", signatures(F.col("edited")).alias("changed"), F.col("next_own").alias("following"),
    )
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", F.array_join("own", "").alias("fingerprint"), F.array_join("changed", "").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"),
    )


def fingerprint_sql() -> str:
    anchors = ", ".join(f"'{a}'" for a in ANCHORS)
    common = ", ".join(f"'{a}'" for a in ANCHORS + COMMON)
    sigs = lambda t: rf"""
      SELECT id, list_filter(regexp_extract_all(lower({t}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda v: v <> '') AS w FROM e"""  # noqa: E731
    one = lambda name, t: rf"""
{name}_w AS ({sigs(t)}),
{name}_i AS (SELECT id, w, unnest(list_filter(range(1, len(w) + 1), lambda k: list_contains([{anchors}], w[k]))) AS i FROM {name}_w),
{name}_c AS (SELECT id, w[i] AS anchor, list_filter(w[i + 1 : i + 8], lambda x: NOT list_contains([{common}], x))[1:2] AS c FROM {name}_i),
{name}_s AS (SELECT id, list_sort(list(DISTINCT substr(md5(anchor || ' ' || c[1] || ' ' || c[2]), 1, 8))) AS s FROM {name}_c WHERE len(c) = 2 GROUP BY id),
{name} AS (SELECT x.id, CASE WHEN len(w) = 0 THEN [] WHEN s IS NOT NULL THEN s ELSE [substr(md5(array_to_string(w, ' ')), 1, 8)] END AS s
           FROM {name}_w x LEFT JOIN {name}_s y ON x.id = y.id)"""  # noqa: E731
    like = lambda a, b: f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b})))::DOUBLE END"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id) AS id FROM documents),
n AS (SELECT id, doc_id, text, coalesce(lead(text) OVER (ORDER BY id), first_value(text) OVER (ORDER BY id)) AS next_text FROM d),
e AS (SELECT *, length(text)::BIGINT AS n_chars, text[1 : length(text) - length(text) // 4] || next_text[1 : length(text) // 4] AS edited FROM n),
{one("own", "text")},
{one("changed", "edited")},
{one("following", "next_text")}
SELECT e.doc_id, n_chars, sha256(edited) AS edited_sha256, array_to_string(own.s, '') AS fingerprint, array_to_string(changed.s, '') AS edited_fingerprint,
       {like("own.s", "changed.s")} AS near_edited, {like("own.s", "following.s")} AS near_next
FROM e JOIN own ON e.id = own.id JOIN changed ON e.id = changed.id JOIN following ON e.id = following.id
"""
