"""Personal data: candidate spans, boosted trees over format and context features, calibrated threshold.

Base kinds (email, ip, card, phone) are patterns with a check, and what passes is always found.  High-recall generators
propose more spans that may overlap these: long runs of digits with separators, long mixed tokens, spelled-out addresses.
Each candidate has a few discrete features of its format and its context (a cue, such as "phone" or "token" before it or
the known prefix of an access key, is one of them); candidates with equal features form a cell, and cells with their counts are all that training
sees, so trees are fitted to every candidate in the data though the table of cells has a fixed bound.

Labels come from two places.  Weak ones from the corpus: a candidate that overlaps a checked span is positive; one that
overlaps none and has no cue is negative, but for spelled-out addresses and numbers grouped like a phone's, which stay
unlabelled like whatever has a cue.  What a base pattern goes by is no feature (the @ of an address is masked, a phone's + and country code,
check digits, the dots of an address), so that trees learn what base spans look like without their base format.  And
labelled examples, made by rule (``examples``) or given: they hold a fixed share of the training weight at every size of
the corpus, and so both classes are there for each kind, whatever the corpus holds.  Trees learn from three quarters of
the texts.  On the rest scores are calibrated, kind by kind, to shares of positives that don't rise as scores fall; a
kind's threshold is the lowest score with the wanted share.  The scores alone choose what is added to the base spans.

Everything runs inside the rows (no shuffle but that of cell counts); the trees are MLlib's.  Work is in proportion to a
text's length and the number of its candidates: contexts come from the pieces between matches, overlaps from one merged
order of spans, and texts are rebuilt in blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import drop, table

KINDS = ("email", "ip", "card", "phone")
#: Base patterns, written so that no match is tried twice from inside a run, and what a text needs for one.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Candidate generators.
NUMBER = r"(?<![0-9A-Za-z])[(+]?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+"
#: Groupings of numbers that a phone or a document has: without cue they are neither positive nor negative.
GROUPED = r"^(?:\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4})$"
TOKEN = r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}+"
SPELLED = r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,64}\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z]{2,24}"
CUES = r"(?i)(?<![A-Za-z])(?:tel|phone|call|fax|mobile|e?-?mail|contact|card|visa|account|iban|ssn|passport|ip|host|addr\w*)(?:\x20?(?:no|nr|number))?\W{0,4}$"
SECRET_CUES = r"(?i)(?:token|key|secret|passw\w*|auth|bearer)[\"']?\W{0,4}$"
#: Public prefixes of access keys and tokens; a token's own prefix counts as its cue.
PREFIX = r"^(?:AKIA|ASIA|AIza|gh[opsu]_|glpat-|sk_live_|sk_test_|xox[abp]-)"
#: A phone's base format.
PLUS = r"^\+(?:[0-9]{1,3}[\x20.-]+)?"
FEATURES = ("kind", "digits", "separators", "left", "right", "case", "cue")
#: Forms of labelled examples: 1 or 0, and a span in which # is a digit, ~ a hexadecimal digit, ^ a letter or digit and * a capital or digit.
FORMS = {
    "number": (
        [(1, f) for f in ("(###) ###-####", "###-###-####", "### ### ####", "###.###.####", "###-##-####")]
        + [(0, f) for f in ("#######", "##########", "#############", "################", "####-##-## ##", "####-####", "###-#-##-######-#", "#.########", "## ### ###")]
    ),
    "secret": [(1, f) for f in ("~" * 18, "~" * 32, "~" * 40, "^" * 24, "sk_live_" + "^" * 24, "AKIA" + "*" * 16)] + [(0, f) for f in ("chapter-##-of-the-long-story", "release_notes_draft_v#_final", "img_####_large_thumbnail_small", "section-#-paragraph-##")],
    "contact": [(1, f) for f in ("mary.hill [at] host# [dot] example", "mary(at)host#.example", "jo## (at) mail (dot) example")] + [(0, f) for f in ("us [at] noon. Then", "people (at) dawn. They")],
}
#: Contexts of examples: before, behind, and whether a cue word is before (then plain numbers and tokens are positive too).
CONTEXTS = {
    "number": [("we saw ", " there", False), ("we saw ", ", there", False), ("my phone ", " there", True), ("account no ", ". There", True)],
    "secret": [("we saw ", " there", False), ("value = \"", "\" there", False), ("token = \"", "\" there", True), ("a password=", " there", True)],
    "contact": [("we saw ", " there", False), ("we saw ", ", there", False), ("contact: ", " there", True)],
}
#: Share of the training weight that examples hold.
SHARE = 0.25
#: Code points that a text is rebuilt in.
BLOCK = 4096


def let(value, use):
    """``use(value)``, with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values, zero, merge, block: int = 64):
    """Array of folds of all values before each; two levels, so that n values cost n * (block + n / block**2)."""

    def body(v):
        steps = F.sequence(F.lit(0), F.ceil(F.size(v) / block).cast("int") - 1)
        sums = F.transform(steps, lambda b: F.aggregate(F.slice(v, b * block + 1, F.lit(block)), zero, merge))
        before = lambda s: F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda b: F.aggregate(F.slice(s, F.lit(1), b), zero, merge))
        at = F.sequence(F.lit(0), F.size(v) - 1)
        own = lambda p: F.transform(at, lambda i: F.aggregate(F.slice(v, i - i % block + 1, i % block), F.get(p, F.floor(i / block).cast("int")), merge))
        return let(let(sums, before), own)

    return let(values, lambda v: F.when(F.size(v) > 0, body(v)))


def matches(text, pattern: str, possible, context: bool = False):
    """array<struct<m, start>> of a pattern's matches (start in code points from 0), with the 16 characters to the left
    and the one to the right if ``context``; empty where not ``possible``."""

    def place(m):
        def both(pieces):
            steps = F.zip_with(m, F.slice(pieces, F.lit(1), F.size(m)), lambda a, b: (F.length(a) + F.length(b)).cast("long"))
            starts = running(steps, F.lit(0).cast("long"), lambda a, b: a + b)

            def one(s):
                def at(i):
                    fields = [F.get(m, i).alias("m"), (F.get(s, i) + F.length(F.get(pieces, i))).alias("start")]
                    if context:
                        fields.append(F.right(F.concat(F.coalesce(F.get(m, i - 1), F.lit("")), F.get(pieces, i)), F.lit(16)).alias("left"))
                        fields.append(F.left(F.concat(F.get(pieces, i + 1), F.coalesce(F.left(F.get(m, i + 1), F.lit(1)), F.lit(""))), F.lit(1)).alias("right"))
                    return F.struct(*fields)

                return F.transform(F.sequence(F.lit(0), F.size(m) - 1), at)

            return let(starts, one)

        return F.when(F.size(m) > 0, let(F.split(text, pattern, -1), both))

    found = F.when(possible, let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place))
    more = ",left:string,right:string" if context else ""
    return F.coalesce(found, F.array().cast(f"array<struct<m:string,start:bigint{more}>>"))


def digits(m):
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number):
    """Check digit of a string of digits."""

    def value(i):
        d = F.substring(number, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when((F.length(number) - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def luhn_ok(m):
    return let(digits(m), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False))


def ip_ok(m):
    part = lambda p: let(F.regexp_replace(p, "^0+(?=.)", ""), lambda q: F.when(F.length(q) <= 3, q.cast("int") <= 255).otherwise(False))
    return F.forall(F.split(m, "\\."), part)


def base_spans(text):
    """array<struct<start, kind (number), end>> of checked spans, in order."""
    digit = text.rlike("[0-9]")
    found = [
        (matches(text, EMAIL, text.contains("@")), lambda m: F.lit(True)),
        (matches(text, IP, digit & text.contains(".")), ip_ok),
        (matches(text, CARD, digit), luhn_ok),
        (matches(text, PHONE, text.contains("+") & digit), lambda m: F.length(digits(m)).between(10, 15)),
    ]
    span = lambda k: lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), (s["start"] + F.length(s["m"])).alias("end"))
    passing = lambda ok: lambda s: ok(s["m"])
    arrays = [F.transform(F.filter(a, passing(ok)), span(k)) for k, (a, ok) in enumerate(found)]
    return F.array_sort(F.concat(*arrays))


def candidates(text):
    """array<struct<start, kind, end, cell, open>>: proposed spans with their features, joined, in ``cell``, and whether they are unlabelled unless they overlap a base span."""
    lists = [
        ("number", F.filter(matches(text, NUMBER, text.rlike("[0-9]"), True), lambda s: ~s["right"].rlike("[0-9A-Za-z]"))),
        ("secret", F.filter(matches(text, TOKEN, text.rlike("[A-Za-z0-9_-]{16}"), True), lambda s: s["m"].rlike(PREFIX) | (s["m"].rlike("[0-9]") & s["m"].rlike("[A-Za-z]")))),
        ("contact", F.concat(matches(text, SPELLED, text.rlike(r"[\[(]at[\])]"), True), matches(text, EMAIL, text.contains("@"), True))),
    ]

    def one(kind):
        def make(s):
            m, start, left, right = s["m"], s["start"], s["left"], s["right"]
            flag = lambda c: F.when(c, 1).otherwise(0)
            # Of an address only a full stop with a space behind it stays: the end of a sentence.
            shape = m if kind == "secret" else F.regexp_replace(m, PLUS, "") if kind == "number" else F.regexp_replace(F.regexp_replace(m, r"\.\x20", "("), r"[^0-9A-Za-z(]", "")
            cue = left.rlike(SECRET_CUES) | m.rlike(PREFIX) if kind == "secret" else left.rlike(CUES) & ~right.rlike("[0-9A-Za-z]")
            values = let(
                shape,
                lambda v: F.concat_ws(
                    "|", F.lit(str(("number", "secret", "contact").index(kind))),
                    F.least(F.floor(F.length(digits(v)) / 3), F.lit(7)), F.least(F.length(F.regexp_replace(v, r"[^ ().-]", "")), F.lit(5)),
                    F.when(left.rlike(r"(?:^|\s)$"), 0).when(left.rlike(r"[\"'=:(<]$"), 1).otherwise(2), F.when(right.rlike(r"^(?:$|\s)"), 0).when(right.rlike(r"[\"'),.;>]"), 1).otherwise(2),
                    F.when(~v.rlike("[A-Z]"), 0).when(v.rlike("[a-z]"), 1).otherwise(2), flag(cue),
                ),
            )
            unknown = {"number": m.rlike(GROUPED), "secret": F.lit(False), "contact": F.lit(True)}[kind]
            return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(m)).alias("end"), values.alias("cell"), (cue | unknown).alias("open"))

        return make

    return F.concat(*[F.transform(a, one(kind)) for kind, a in lists])


def flagged(base, proposed):
    """``proposed`` in order of start, each with hit: whether it overlaps a span of ``base``.

    In one order of all spans, a base span that overlaps either starts before and ends behind the start, or starts
    behind and before the end.
    """
    none = [F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("cell"), F.lit(None).cast("boolean").alias("open")]
    every = F.array_sort(F.concat(
        F.transform(base, lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("rank"), s["end"].alias("end"), *none)),
        F.transform(proposed, lambda s: F.struct(s["start"].alias("start"), F.lit(1).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["cell"].alias("cell"), s["open"].alias("open"))),
    ))
    far = F.lit(2**62)
    ends = lambda a: running(F.transform(a, lambda x: F.when(x["rank"] == 0, x["end"]).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda p, q: F.greatest(p, q))
    begins = lambda a: F.reverse(running(F.reverse(F.transform(a, lambda x: F.when(x["rank"] == 0, x["start"]).otherwise(far))), far, lambda p, q: F.least(p, q)))
    hit = lambda x, i, e, b: (F.get(e, i) > x["start"]) | (F.get(b, i) < x["end"])
    mark = lambda a, e, b: F.transform(a, lambda x, i: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["cell"].alias("cell"), x["open"].alias("open"), hit(x, i, e, b).alias("hit")))
    merged = let(every, lambda a: let(ends(a), lambda e: let(begins(a), lambda b: mark(a, e, b))))
    alone = F.transform(proposed, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["cell"].alias("cell"), s["open"].alias("open"), F.lit(False).alias("hit")))
    return F.when((F.size(base) > 0) & (F.size(proposed) > 0), F.filter(merged, lambda x: x["kind"].isNotNull())).otherwise(F.array_sort(alone))


def examples(spark: SparkSession, each: int = 8) -> DataFrame:
    """text, label of labelled spans, one candidate each, made by rule: ``each`` of every form in every context.

    A number without separators is personal with a cue word before it and not without; a token is a secret where it has a
    known prefix or a cue word or a quotation mark is before it, else it may be a checksum; forms labelled 0 otherwise stay 0.
    """

    def label(kind, positive, form, before, cue):
        if kind == "number":
            return float(positive or (cue and set(form) == {"#"} and len(form) >= 10))
        return float(positive and (kind == "contact" or cue or before.endswith('"') or form.startswith(("AKIA", "sk_live_"))))

    made = [
        F.struct(F.lit(before).alias("before"), F.lit(form).alias("form"), F.lit(after).alias("after"), F.lit(label(kind, positive, form, before, cue)).alias("label"))
        for kind, forms in FORMS.items() for positive, form in forms for before, after, cue in CONTEXTS[kind]
    ]
    rows = spark.range(0, each, 1, 1).select("id", F.posexplode(F.array(*made)).alias("place", "e"))
    signs = {"#": "0123456789", "~": "0123456789abcdef", "^": "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "*": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"}

    def filled(c, i):
        draw = lambda n: F.pmod(F.xxhash64("id", "place", i), F.lit(n)).cast("int") + 1
        out = c
        for sign, letters in signs.items():
            out = F.when(c == sign, F.substring(F.lit(letters), draw(len(letters)), F.lit(1))).otherwise(out)
        return out

    span = F.array_join(F.transform(F.split("e.form", ""), filled), "")
    return rows.select(F.concat("e.before", span, "e.after").alias("text"), F.col("e.label").alias("label"))


def accepted_cells(rows: DataFrame, precision: float, labelled: DataFrame | None = None) -> list[str]:
    """Cells whose candidates are added.  ``rows``: proposed spans of each document, and held: whether it calibrates.

    ``labelled``: text, label of examples, every candidate in a text of that label (default: ``examples``).  Where these
    and the corpus together hold labels of one class only, there is nothing to tell apart and no cell is accepted.
    """
    label = lambda c: F.when(c["hit"], 1.0).when(~c["open"], 0.0)
    own = rows.select("held", F.explode(F.transform("proposed", lambda c: F.struct(c["cell"].alias("cell"), label(c).alias("label")))).alias("c"), F.lit(False).alias("made"))
    given = propose((examples(rows.sparkSession) if labelled is None else labelled).select("text", F.col("label").cast("double").alias("label")))
    given = given.select("held", F.explode(F.transform("proposed", lambda c: F.struct(c["cell"].alias("cell"), F.col("label").alias("label")))).alias("c"), F.lit(True).alias("made"))
    cells = own.unionByName(given).groupBy("c.cell", "c.label", "held", "made").agg(F.count("*").cast("double").alias("weight"))
    values = F.split("cell", r"\|")
    cells = table(cells.select("cell", "label", "held", "made", "weight", *[F.get(values, k).cast("double").alias(f) for k, f in enumerate(FEATURES)]), "pii-cells")
    learnt = cells.where("NOT held AND label IS NOT NULL")
    sums = learnt.agg(F.countDistinct("label").alias("classes"), F.sum(F.when(F.col("made"), F.col("weight"))).alias("made"), F.sum(F.when(~F.col("made"), F.col("weight"))).alias("own")).first()
    if sums["classes"] < 2:
        drop(cells)
        return []
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    scale = max(1.0, SHARE / (1 - SHARE) * (sums["own"] or 0.0) / sums["made"]) if sums["made"] else 1.0
    learnt = learnt.withColumn("weight", F.when(F.col("made"), F.col("weight") * scale).otherwise(F.col("weight")))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    model = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=10, maxDepth=4, stepSize=0.3, seed=7).fit(vectors.transform(learnt.orderBy("cell", "label", "made").coalesce(1)))
    known = F.when(F.col("held") & F.col("label").isNotNull(), F.col("weight")).otherwise(0.0)
    scored = model.transform(vectors.transform(cells)).groupBy("cell", "kind").agg(
        F.first(F.element_at(vector_to_array("probability"), 2)).alias("p"), F.sum(known).alias("n"), F.sum(known * F.coalesce("label", F.lit(0.0))).alias("ones")
    )
    found = scored.orderBy(F.desc("p"), "cell").collect()  # as many rows as there are cells
    drop(cells)
    threshold = {k: lowest_score([(r["p"], r["n"], r["ones"]) for r in found if r["kind"] == k], precision) for k in {r["kind"] for r in found}}
    return [r["cell"] for r in found if r["p"] >= threshold[r["kind"]]]


def lowest_score(scored: list[tuple[float, float, float]], precision: float) -> float:
    """Lowest score whose calibrated share is ``precision`` at least (infinity for none).  ``scored``: score, labelled, positive, by falling score.

    Shares are calibrated by pooling neighbours until they fall with the score, so many good cells don't carry bad ones.
    """
    pools: list[tuple[float, float, float]] = []
    for p, n, ones in scored:
        if n == 0:
            continue
        pools.append((p, n, ones))
        while len(pools) > 1 and (pools[-1][0] == pools[-2][0] or pools[-1][2] * pools[-2][1] > pools[-2][2] * pools[-1][1]):
            last, before = pools.pop(), pools.pop()
            pools.append((last[0], before[1] + last[1], before[2] + last[2]))
    return min((p for p, n, ones in pools if ones >= precision * n), default=float("inf"))


def chosen(rows: DataFrame, cells: list[str]):
    """Of the proposed spans those of accepted cells that overlap no checked span."""
    wanted = lambda s: s["cell"].isin(*cells) if cells else F.lit(False)
    picked = F.filter("proposed", lambda s: ~s["hit"] & wanted(s))
    return rows.withColumn("added", F.transform(picked, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))).drop("proposed")


def propose(docs: DataFrame) -> DataFrame:
    """``docs`` with base and proposed spans, and held: whether the text calibrates (one in four, equal texts alike); null texts have no spans."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.withColumns({"base": base_spans(text), "proposed": candidates(text), "held": F.pmod(F.xxhash64("text"), F.lit(4)) == 0})
    return found.withColumn("proposed", flagged(F.col("base"), F.col("proposed")))


def find(docs: DataFrame, precision: float = 0.9, labelled: DataFrame | None = None) -> DataFrame:
    """doc_id with base (checked spans) and added (chosen candidates) of each row of ``docs`` (doc_id, text).

    Null and empty texts have no spans.  Repeated rows each give a row; texts of any length are searched whole; other
    columns are ignored.  ``precision``: share of positives that added cells hold.  ``labelled``: see ``accepted_cells``.
    """
    rows = table(propose(docs.select("doc_id", "text")).drop("text"), "pii-spans")
    return chosen(rows, accepted_cells(rows, precision, labelled))


def named(spans):
    """Spans with kinds as words."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.get(names, s["kind"]).alias("kind"), s["end"].alias("end")))


def report(docs: DataFrame, precision: float = 0.9, labelled: DataFrame | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of each row of ``docs`` (doc_id, text); see ``find``."""
    spans = find(docs, precision, labelled)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    order = F.array(*[F.lit(k) for k in (*KINDS, "number", "secret", "contact")])
    ranked = lambda a: F.transform(a, lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    every = F.array_sort(F.concat(ranked(named(F.col("base"))), ranked(F.col("added"))))
    return spans.select("doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)], F.sha2(joined(named(F.col("base"))), 256).alias("base_sha256"), joined(every).alias("spans"))


def rebuilt(text, spans):
    """``text`` with each span of ``spans`` (in order of start) replaced by its kind in brackets, spans that overlap by the first's."""
    block = F.lit(BLOCK).cast("long")

    def parts_of(ends):
        """Spans that start behind all before them, each with the end of whatever overlaps it."""
        first = F.filter(F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), F.get(ends, i).alias("before"))), lambda s: s["start"] >= s["before"])
        last = F.greatest(F.element_at(ends, -1), F.element_at(spans, -1)["end"])
        return let(first, lambda f: F.transform(f, lambda s, i: F.struct(s["start"].alias("start"), F.coalesce(F.get(f, i + 1)["before"], last).alias("stop"), s["kind"].alias("kind"))))

    def over(cuts):
        """Rebuild block by block; cuts stand in groups of 64, so that a block looks at few of them."""
        some = F.transform(F.sequence(F.lit(0), F.floor((F.size(cuts) - 1) / 64).cast("int")), lambda g: F.slice(cuts, g * 64 + 1, F.lit(64)))
        groups = F.transform(some, lambda g: F.struct(F.get(g, F.lit(0))["start"].alias("start"), F.element_at(g, -1)["stop"].alias("stop"), g.alias("cuts")))

        def one(gs):
            def piece(b, i):
                off = i.cast("long") * block
                meets = lambda s: (s["start"] < off + block) & (s["stop"] > off)
                own = F.filter(F.flatten(F.transform(F.filter(gs, meets), lambda g: g["cuts"])), meets)
                step = lambda a, c: F.struct(
                    F.concat(
                        a["out"], F.substring(b, a["at"] + 1, F.greatest((c["start"] - off).cast("int") - a["at"], F.lit(0))),
                        F.when(c["start"] >= off, F.concat(F.lit("["), F.upper(c["kind"]), F.lit("]"))).otherwise(""),
                    ).alias("out"),
                    F.least(c["stop"] - off, block).cast("int").alias("at"),
                )
                return F.aggregate(own, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda a: F.concat(a["out"], F.substring(b, a["at"] + 1, F.lit(BLOCK))))

            return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), piece), "")

        return let(groups, one)

    ends = running(F.transform(spans, lambda x: x["end"]), F.lit(0).cast("long"), lambda p, q: F.greatest(p, q))
    return let(let(ends, parts_of), over)


def redact(docs: DataFrame, precision: float = 0.9, labelled: DataFrame | None = None) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in brackets, overlapping spans by the first's; n_chars, where present, follows.

    The texts are searched a second time where they are read, so that they are not moved.
    """
    cols = docs.columns
    spans = table(propose(docs.select("text")).select("held", "proposed").where("size(proposed) > 0"), "pii-spans")
    cells = accepted_cells(spans, precision, labelled)
    drop(spans)
    work = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), "text")
    rows = chosen(propose(work), cells)
    every = F.array_sort(F.concat(named(F.col("base")), F.col("added")))
    some = F.size("base") + F.size("added") > 0
    rows = rows.withColumn("text", F.when(some, let(every, lambda s: rebuilt(F.col("text"), s))).otherwise(F.col("text")))
    own = {"text": F.col("text"), "n_chars": F.when(some, F.length("text").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in cols else None}
    return rows.select(*[own.get(c, F.col(f"row.`{c}`")).alias(c) for c in cols])
