"""License scans: base phrases, and an exact set-similarity join of text blocks with license templates.

A block is a window of ``SPAN`` words, and windows overlap by half, so that a notice is found whole wherever its lines are
broken; a template is a sentence of a license notice.  Both are sets of words, of which only those that occur in some
template count.  Tokens are ordered by their global frequency, rarest first.  A block that holds at least ``containment``
of a template's tokens must share one of the template's first tokens (prefix filter), hold enough tokens (length filter),
and have enough left after the shared one on both sides (positional filter); what passes is verified on the whole sets,
so the join finds every such block and no other.  A bag of words isn't a notice: each template has a few words, its
license's name where it has one, that must stand consecutively somewhere in the document.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import ascii_lower, null_safe, table

#: Phrases whose words stand consecutively, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Words of a block, at least; twice the longest template, so that any template stands whole in some block (blocks start at every half).
SPAN = 52
#: Sentences of common license notices, their labels, and words that must stand consecutively in the document.
TEMPLATES = [
    ("gpl", "This work is licensed under the GNU General Public License, version 3", "GNU General Public License"),
    ("gpl", "it under the terms of the GNU General Public License as published by the Free Software Foundation", "GNU General Public License"),
    ("gpl", "either version 2 of the License, or (at your option) any later version", "any later version"),
    ("lgpl", "licensed under the GNU Lesser General Public License", "GNU Lesser General Public License"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "GNU Lesser General Public License"),
    ("agpl", "licensed under the GNU Affero General Public License", "GNU Affero General Public License"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "GNU Affero General Public License"),
    ("gfdl", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License", "GNU Free Documentation License"),
    ("apache", "Licensed under the Apache License, Version 2.0", "Apache License"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS", "AS IS BASIS"),
    ("mit", "Released under the MIT License", "MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "free of charge"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "substantial portions"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistribution and use"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "Redistributions of source code"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "endorse or promote"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "without fee"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Mozilla Public License"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License", "Eclipse Public License"),
    ("cddl", "subject to the terms of the Common Development and Distribution License", "Development and Distribution License"),
    ("boost", "Distributed under the Boost Software License, Version 1.0", "Boost Software License"),
    ("zlib", "In no event will the authors be held liable for any damages arising from the use of this software", "authors be held liable"),
    ("ofl", "This Font Software is licensed under the SIL Open Font License, Version 1.1", "SIL Open Font License"),
    ("artistic", "under the terms of the Artistic License 2.0", "Artistic License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Attribution-ShareAlike"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", "CC BY-SA"),
    ("cc-by-nd", "licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", "Attribution-NoDerivatives"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0", "CC BY-ND"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", "CC BY-NC"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Attribution-NonCommercial"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0", "waived all copyright"),
    ("unlicense", "This is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("reserved", "All rights reserved", "rights reserved"),
    ("reserved", "No part of this publication may be reproduced without prior written permission", "be reproduced"),
]
#: Words too common to be template tokens.
COMMON = frozenset("a all and any are as at be by for from has have in into is it may no not of on or part that the this to use was with without work under".split())
#: What stands between words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> list[str]:
    """Words of a template, by the rule that holds for documents."""
    import re

    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return [w for w in re.split(GAP, lowered) if w]


def span_of(templates, span: int = SPAN) -> int:
    """Words of a block."""
    return max(span, 2 * max(len(words_of(text)) for _, text, _ in templates))


def template_sets(templates, containment: float) -> list[tuple[int, str, list[str], int, str]]:
    """(number, label, distinct tokens, how many of them a block must hold, words that must stand in the document) of each template."""
    sets = [(label, sorted(set(words_of(text)) - COMMON), " ".join(words_of(must))) for label, text, must in templates]
    return [(k, label, tokens, math.ceil(containment * len(tokens) - 1e-9), must) for k, (label, tokens, must) in enumerate(sets)]


def normal(text):
    """Words joined and surrounded by single spaces; one space for no words."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(ascii_lower(text), GAP, " ")), F.lit(" "))


def count_spaces(text):
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def array_of(values) -> F.Column:
    return F.array(*[F.lit(v) for v in values])


def license_scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates=TEMPLATES, containment: float = 0.8, span: int = SPAN) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row of ``docs`` (doc_id, text).

    Labels are those of phrases found and of templates of which some block holds ``containment`` of the tokens and whose
    consecutive words the document holds; score is
    1 where a phrase is found, else the largest containment found, else 0.  Null and empty texts have no words, null
    positions, empty labels and score 0.  Repeated rows each give a row; other columns are ignored.  ``templates`` is a
    parameter of at most some thousand sentences; only it and its tokens' frequencies are broadcast.
    """
    spark = docs.sparkSession
    sets, span = template_sets(templates, containment), span_of(templates, span)
    vocabulary = sorted({t for _, _, tokens, _, _ in sets for t in tokens})
    least = min(need for _, _, _, need, _ in sets)
    of_template = array_of(vocabulary)
    text = F.coalesce(F.col("text"), F.lit(""))

    rows = docs.select("doc_id", text.alias("text"), F.xxhash64("text").alias("text_hash")).withColumn("n", normal(F.col("text")))
    rows = rows.withColumn("n_words", F.when(F.col("n") == "  ", 0).otherwise(count_spaces(F.col("n")) - 1).cast("long"))
    words, step = F.split(F.trim("n"), " "), span // 2
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n_words") / step) - 2, F.lit(0)).cast("int"))
    blocks = lambda w: F.filter(F.transform(starts, lambda k: F.array_intersect(F.slice(w, k * step + 1, F.lit(span)), of_template)), lambda b: F.size(b) >= least)
    promising = F.size(F.array_intersect(words, of_template)) >= least
    rows = rows.withColumn("blocks", F.when(promising, F.element_at(F.transform(F.array(words), blocks), 1)))
    # The templates' consecutive words that the document holds.
    named = F.array_compact(F.array(*[F.when(F.col("n").contains(f" {must} "), F.lit(must)) for must in sorted({must for *_, must in sets})]))
    rows = rows.withColumn("named", F.when(F.size("blocks") > 0, named))
    found, firsts, lasts, labels = [], [], [], []
    for phrase, label in phrases.items():
        pieces = F.split(F.col("n"), f" {phrase}(?= )")
        has = F.col("n").contains(f" {phrase} ")
        found.append(F.when(has, F.size(pieces) - 1).otherwise(0))
        firsts.append(F.when(has, count_spaces(F.element_at(pieces, 1))))
        lasts.append(F.when(has, F.col("n_words") - (count_spaces(F.element_at(pieces, -1)) - 1) - len(phrase.split(" "))))
        labels.append(F.when(has, F.lit(label)))
    many = len(phrases) > 1
    rows = rows.select(
        "doc_id", "text_hash", "n_words",
        sum(found[1:], found[0]).cast("long").alias("n_base"),
        (F.least(*firsts) if many else firsts[0]).cast("long").alias("first_word"),
        (F.greatest(*lasts) if many else lasts[0]).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))).alias("base"),
        "blocks", "named",
    )
    rows = table(rows, "license-rows")

    blocks = rows.where("size(blocks) > 0 AND size(named) > 0").select("doc_id", "text_hash", "named", F.explode(F.array_distinct("blocks")).alias("tokens"))
    # A few hundred counts at most: one for each token of a template.
    seen = {r["t"]: r["n"] for r in blocks.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}
    rank = {t: k for k, t in enumerate(sorted(vocabulary, key=lambda t: (seen.get(t, 0), t)))}
    ordered = [(label, sorted(tokens, key=rank.__getitem__), need, must) for _, label, tokens, need, must in sets]
    entries = [
        F.struct(F.lit(t).alias("token"), F.lit(place).alias("place"), F.lit(label).alias("label"), array_of(tokens).alias("template_tokens"), F.lit(need).alias("need"), F.lit(must).alias("must"))
        for label, tokens, need, must in ordered
        for place, t in enumerate(tokens[: len(tokens) - need + 1])
    ]
    index = spark.range(1).select(F.inline(F.array(*entries)))
    ranks = F.create_map(*[F.lit(x) for t, k in rank.items() for x in (t, k)])
    by_rank = F.transform(F.array_sort(F.transform("tokens", lambda t: F.struct(ranks[t].alias("k"), t.alias("t")))), lambda s: s["t"])
    blocks = blocks.where(F.size("tokens") >= least).withColumn("tokens", by_rank)
    prefix = F.slice("tokens", F.lit(1), F.size("tokens") - least + 1)
    probes = blocks.select("doc_id", "text_hash", "named", "tokens", F.posexplode(prefix).alias("at", "token"))
    enough = F.least(F.size("tokens") - F.col("at"), F.size("template_tokens") - F.col("place")) >= F.col("need")
    overlap = F.size(F.array_intersect("tokens", "template_tokens"))
    pairs = probes.join(F.broadcast(index), "token").where((F.size("tokens") >= F.col("need")) & enough).where((overlap >= F.col("need")) & F.array_contains("named", F.col("must")))
    hits = pairs.groupBy("doc_id", "text_hash").agg(F.collect_set("label").alias("own"), F.max(overlap / F.size("template_tokens")).alias("share"))
    out = null_safe(rows.drop("blocks", "named"), hits, ["doc_id", "text_hash"], "left")
    every = F.array_sort(F.array_union("base", F.coalesce("own", F.array().cast("array<string>"))))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).cast("double").alias("score"),
    )


def license_sql(phrases: dict[str, str] = PHRASES, templates=TEMPLATES, containment: float = 0.8, span: int = SPAN) -> str:
    """The same by brute force in DuckDB: every block against every template, every place against every phrase."""
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    span = span_of(templates, span)
    sets = ", ".join(f"('{label}', {tokens!r}, {need}, '{must}')" for _, label, tokens, need, must in template_sets(templates, containment))
    bases = ", ".join(f"('{label}', {phrase.split(' ')!r})" for phrase, label in phrases.items())
    return rf"""
WITH d AS (SELECT doc_id, hash(text) AS h, row_number() OVER () AS id, {low} AS t FROM documents),
w AS (SELECT id, doc_id, t, regexp_extract_all(t, {word}) AS words FROM d),
p(label, phrase) AS (VALUES {bases}),
b AS (SELECT id, label, phrase, unnest(list_filter(range(len(words)), lambda i: words[i + 1 : i + len(phrase)] = phrase)) AS pos FROM w, p),
bs AS (SELECT id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_sort(list_distinct(list(label))) AS base FROM b GROUP BY id),
l AS (SELECT id, ' ' || array_to_string(words, ' ') || ' ' AS n, list_distinct(words[k * {span // 2} + 1 : k * {span // 2} + {span}]) AS words
      FROM (SELECT id, words, unnest(range(greatest(ceil(len(words) / {span // 2}.0)::BIGINT - 1, 1))) AS k FROM w)),
s(label, tokens, need, must) AS (VALUES {sets}),
m AS (SELECT id, label, len(list_intersect(words, tokens)) / len(tokens)::DOUBLE AS share FROM l, s
      WHERE len(list_intersect(words, tokens)) >= need AND contains(n, ' ' || must || ' ')),
ms AS (SELECT id, list(DISTINCT label) AS own, max(share) AS share FROM m GROUP BY id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(array_to_string(base, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(own, [])))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN bs ON w.id = bs.id LEFT JOIN ms ON w.id = ms.id
"""
