"""Markdown of filings to levels of chunks: header clean-up, sections, segments, packing, tables, document metadata.

Rows of one document meet in one window or array; a document is one row of text to begin with, so its size bounds them.
"""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.plans import store

LEVELS = ("section", "subsection", "item", "subitem")
#: Header lines, the running header, the mark of a header without text, tables, run headers.
HEADER, RUNNING = r"^(#{1,4})\s+(.*)$", r"(?i)^\*{0,2}\s*table of contents\s*\*{0,2}$"
ONLY = "<!-- header-only -->"
TABLE = r"(?:\|.+\|\n)+\|[-| :]+\|\n(?:\|.+\|\n|\n)*"
SEPARATOR, RUN_HEADER = r"^\|[-| :]+\|$", r"^\*[^\n*]{1,80}\*$"
#: Words below which a chunk isn't enriched.
MIN_WORDS = 20


def words(text: Column) -> Column:
    """Default token counter: runs that aren't white space.  Every operator here takes another counter in its place."""
    return F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)))


def strip_running(md: Column) -> Column:
    """Header lines lose segments that are the running header; a line without any other segment goes."""
    titles = lambda x: F.filter(F.transform(F.split(F.regexp_extract(x, HEADER, 2), r"\|"), lambda s: F.trim(s)), lambda s: ~s.rlike(RUNNING))
    line = lambda x: F.when(~x.rlike(HEADER), x).when(F.size(titles(x)) > 0, F.concat(F.regexp_extract(x, HEADER, 1), F.lit(" "), F.array_join(titles(x), " | ")))
    return F.array_join(F.array_compact(F.transform(F.split(md, "\n"), line)), "\n")


def join_headers(docs: DataFrame, key: str, md: str) -> DataFrame:
    """key, pos, line: lines of each document; neighbouring headers of one level are one line, and a header that no text follows gets a mark.

    Blank lines after a header go.  Null documents have no lines.
    """
    rows = docs.select(key, F.posexplode(F.split(md, "\n")).alias("pos", "line"))
    rows = rows.withColumn("level", F.length(F.regexp_extract("line", r"^(#{1,4}) .", 1))).withColumn("blank", F.trim("line") == "")
    order = W.partitionBy(key).orderBy("pos")
    last = F.last(F.when(~F.col("blank"), F.col("level")), True)
    rows = rows.withColumn("before", F.coalesce(last.over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.where(~(F.col("blank") & (F.col("before") > 0)))  # blank lines behind a header
    rows = rows.withColumn("run", F.sum(F.when((F.col("level") > 0) & (F.col("before") == F.col("level")), 0).otherwise(1)).over(order))
    one = rows.groupBy(key, "run").agg(F.min("pos").alias("pos"), F.max("level").alias("level"), F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    title = F.array_join(F.transform("l", lambda s: F.regexp_replace(s["line"], "^#{1,4} ", "")), " | ")
    one = one.select(key, "pos", "level", F.when(F.col("level") > 0, F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), title)).otherwise(F.get("l", F.lit(0))["line"]).alias("line"))
    after = F.lead("level").over(order)  # nothing blank follows a header, so the next line is its text
    mark = F.when((F.col("level") > 0) & (F.col("after").isNull() | (F.col("after") > 0)), F.array("line", F.lit(ONLY))).otherwise(F.array("line"))
    return one.withColumn("after", after).select(key, "pos", F.posexplode(mark).alias("__k", "line")).select(key, (F.col("pos") * 2 + F.col("__k")).alias("pos"), "line")


def sections(lines: DataFrame, key: str) -> DataFrame:
    """key, ord, section, subsection, item, subitem, text: what stands below each header, with the headers above it.

    A header-only chunk gives its titles on to the next chunk with text (joined by a bar where they differ); at the end of
    a document there is none, and it goes.  Texts end with a line break.
    """
    rows = lines.withColumn("level", F.length(F.regexp_extract("line", r"^(#{1,4}) .", 1)))
    rows = rows.withColumn("n", F.sum((F.col("level") > 0).cast("int")).over(W.partitionBy(key).orderBy("pos")))
    scope = [key]
    for k, name in enumerate(LEVELS, 1):
        w = W.partitionBy(*scope).orderBy("pos")
        rows = rows.withColumn(name, F.last(F.when(F.col("level") == k, F.regexp_replace("line", "^#{1,4} ", "")), True).over(w))
        rows = rows.withColumn(f"above{k}", F.sum(F.when(F.col("level").between(1, k), 1).otherwise(0)).over(w))
        scope.append(f"above{k}")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda s: s["line"]), "\n")
    found = rows.where("level = 0").groupBy(key, "n", *LEVELS).agg(F.concat(F.regexp_replace(body, r"\n+\z", ""), F.lit("\n")).alias("text")).where(F.trim(F.regexp_replace("text", "\n", "")) != "")
    only = F.trim(F.regexp_replace("text", "\n", "")) == ONLY
    found = found.withColumn("only", only).withColumn("run", F.coalesce(F.sum((~F.col("only")).cast("int")).over(W.partitionBy(key).orderBy("n").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    fold = lambda field: F.aggregate(
        F.transform("c", lambda s: s[field]), F.lit(None).cast("string"), lambda a, v: F.when(a.isNull(), v).when(v.isNull() | (a == v), a).otherwise(F.concat(a, F.lit(" | "), v))
    )
    whole = found.groupBy(key, "run").agg(F.array_sort(F.collect_list(F.struct("n", *LEVELS, "only", "text"))).alias("c"))
    real = F.element_at("c", -1)
    whole = whole.where(~real["only"]).select(key, "run", *[fold(f).alias(f) for f in LEVELS], real["text"].alias("text"))
    return whole.select(key, F.col("run").cast("int").alias("ord"), *LEVELS, "text")


#: The patterns above in Python: line ends that a dot doesn't match and that may stand behind the end, ASCII white space and case.
_EOL = "\n\r\u0085\u2028\u2029"
_END = rf"(?=(?:\r\n|[{_EOL}])?\Z)"
_TITLED = re.compile(rf"(#{{1,4}})[ \t\n\x0b\f\r]+([^{_EOL}]*){_END}")
_HEADER, _RUNNING = re.compile(rf"(#{{1,4}}) [^{_EOL}]"), re.compile(RUNNING.replace("$", _END), re.ASCII)
_BLANKS = re.compile(r"(?: *\n)*")


def _title(line: str) -> tuple[int, str | None]:
    """Level and title of a line that begins with #, without running headers; level 0 and the line for text, or None where nothing stays of it."""
    if found := _TITLED.match(line):
        titles = [t for t in (t.strip(" ") for t in found[2].split("|")) if not _RUNNING.match(t)]
        if not titles:
            return 0, None
        line = f"{found[1]} {' | '.join(titles)}"
    found = _HEADER.match(line)
    return (len(found[1]), line[len(found[1]) + 1 :]) if found else (0, line)


def _cut(md: str, titles: dict[str, tuple]) -> list[tuple]:
    """(section, subsection, item, subitem, text) of a document: its lines without running headers, neighbouring headers joined, what stands below each.  ``titles``: lines that ``_title`` has read."""
    parts: list[tuple[int, list[str]]] = [(0, [])]  # a header's level and titles, or (0, runs of lines)
    for k, piece in enumerate(("\n" + md).split("\n#")):
        level, more = 0, piece[1:] if piece else None
        if k:
            head, ended, more = ("#" + piece).partition("\n")
            if not ended:
                more = None
            if (known := titles.get(head)) is None:
                if len(titles) > 10_000:
                    titles.clear()
                known = titles[head] = _title(head)
            level, title = known
            if level:
                if parts[-1][0] == level:
                    parts[-1][1].append(title)
                else:
                    parts.append((level, [title]))
            elif title is not None:
                if parts[-1][0]:
                    parts.append((0, []))
                parts[-1][1].append(title)
        if more is not None:
            if parts[-1][0]:  # blank lines behind a header go
                if more[:1] in " \n":
                    more = more[_BLANKS.match(more).end() :]
                    if not more.strip(" "):
                        continue
                parts.append((0, []))
            parts[-1][1].append(more)
    above: list = [None] * len(LEVELS)
    given, out, last = None, [], len(parts) - 1
    for k, (level, lines) in enumerate(parts):
        if level:
            above = above[: level - 1] + [" | ".join(lines)] + [None] * (len(LEVELS) - level)
            if k < last and not parts[k + 1][0]:
                continue
            bare = ONLY
        else:
            text = "\n".join(lines).rstrip("\n")
            bare = text.replace("\n", "").strip(" ")
        if bare:
            given = above if given is None else [a if v is None or a == v else v if a is None else f"{a} | {v}" for a, v in zip(given, above, strict=True)]
            if bare != ONLY:
                out.append((*given, text + "\n"))
                given = None
    return out


def sections_of(docs: DataFrame, key: str, md: str) -> DataFrame:
    """``sections`` of the joined lines of ``docs`` without running headers, cut document by document in the tasks: no line is a row, nothing is shuffled."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        titles: dict[str, tuple] = {}
        for batch in batches:
            at, ords, rows = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if text is not None:
                    found = _cut(text, titles)
                    at.extend([i] * len(found))
                    ords.extend(range(len(found)))
                    rows.extend(found)
            columns = [pa.array(c, pa.string()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.string())] * (len(LEVELS) + 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(ords, pa.int32()), *columns], names=[key, "ord", *LEVELS, "text"])

    return docs.select(key, md).mapInArrow(run, f"`{key}` {kind}, ord int, " + ", ".join(f"{c} string" for c in (*LEVELS, "text")))


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(text, r"\A\n+|\n+\z", ""), r"\n{2,}"), lambda p: F.trim(F.regexp_replace(p, "\n", "")) != "")


def is_run_header(line: Column) -> Column:
    label = F.trim(F.regexp_replace(line, r"^\*|\*$", ""))
    return line.rlike(RUN_HEADER) & (label != "") & ~label.rlike("^[0-9]") & ~label.rlike(r"\.$") & ~label.rlike(RUNNING)


def caption(text: Column) -> Column:
    """The last line that isn't blank."""
    return F.coalesce(F.trim(F.try_element_at(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), F.lit(-1))), F.lit(""))


def segments(text: Column) -> Column:
    """array<struct<kind, text, caption>> of a chunk's paragraphs (prose), tables (with the line before them) and run headers, in order."""
    tables, prose = F.regexp_extract_all(text, F.lit(TABLE), F.lit(0)), F.split(text, TABLE, -1)
    struct = lambda kind, t, c: F.struct(kind.alias("kind"), t.alias("text"), c.alias("caption"))
    para = lambda p: struct(F.when(is_run_header(F.trim(p)), "run_header").otherwise("prose"), F.when(is_run_header(F.trim(p)), F.trim(F.regexp_replace(F.trim(p), r"^\*|\*$", ""))).otherwise(p), F.lit(""))
    table = lambda t, p: F.when(t.isNotNull(), F.array(struct(F.lit("table"), F.regexp_replace(t, r"\n+\z", ""), caption(p)))).otherwise(F.array().cast("array<struct<kind:string,text:string,caption:string>>"))
    return F.flatten(F.zip_with(prose, tables, lambda p, t: F.concat(F.transform(paragraphs(p), para), table(t, p))))


def windows(text: Column, budget: int, overlap: int) -> Column:
    """Runs of ``budget`` words, each ``overlap`` words into the one before."""
    w = F.split(F.trim(text), r"\s+")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - overlap), F.lit(budget - overlap)), lambda s: F.array_join(F.slice(w, s, budget), " "))


def _place(kinds, sizes, captioned, most: int) -> list[tuple[int, bool]]:
    """Chunk number and whether its caption goes with it, for each segment (run headers: -1)."""
    at, used, found = -1, None, []  # used: tokens of the open chunk, None where the next segment opens one
    for kind, n, c in zip(kinds, sizes, captioned, strict=True):
        if kind == "run_header":
            used = None
            found.append((-1, False))
        elif n > most or kind == "part":
            at, used = at + 1, None
            found.append((at, kind == "table" and c > n))
        elif used is not None and used + n <= most:
            used += n
            found.append((at, False))
        else:
            at += 1
            with_caption = kind == "table" and n < c <= most
            used = c if with_caption else n
            found.append((at, with_caption))
    return found


def _places(kinds: pd.Series, sizes: pd.Series, captioned: pd.Series, budget: pd.Series) -> pd.Series:
    """``_place`` for each row."""
    return pd.Series([[{"chunk": at, "captioned": c} for at, c in _place(*row)] for row in zip(kinds, sizes, captioned, budget, strict=True)])


#: The patterns of tables and run headers in Python, as above.
_TABLE, _PARAGRAPHS, _SPACE = re.compile(TABLE.replace(".", f"[^{_EOL}]")), re.compile(r"\n{2,}"), re.compile(r"[ \t\n\x0b\f\r]+")
_RUN_HEADER, _STARS, _NO_LABEL = re.compile(RUN_HEADER.replace("$", _END)), re.compile(rf"\A\*|\*{_END}"), re.compile(rf"\A[0-9]|\.{_END}")


def _words(text: str) -> int:
    """``words`` of one text."""
    return len(text.encode().split())


def _segments(text: str) -> list[tuple[str, str, str]]:
    """``segments`` of one text: (kind, text, caption)."""
    out, at, tables = [], 0, _TABLE.finditer(text) if "|" in text else ()
    for table in (*tables, None):
        prose = text[at : table.start()] if table else text[at:]
        for p in _PARAGRAPHS.split(prose.strip("\n")):
            line = p.strip(" ")
            if line[:1] == "*" and _RUN_HEADER.match(line):
                label = _STARS.sub("", line).strip(" ")
                run_header = label and not _NO_LABEL.search(label) and not _RUNNING.match(label)
                out.append(("run_header", label, "") if run_header else ("prose", p, ""))
            elif line and (line[0] != "\n" or p.replace("\n", "").strip(" ")):
                out.append(("prose", p, ""))
        if table:
            at = table.end()
            out.append(("table", table[0].rstrip("\n"), next((x.strip(" ") for x in reversed(prose.split("\n")) if x.strip(" ")), "")))
    return out


def _packed(text: str, budget: int, overlap: int) -> list[tuple]:
    """(child, run_header, text) of one chunk above the budget."""
    segs, sizes, captioned = [], [], []
    for kind, t, caption in _segments(text):
        n = _words(t)
        if kind == "prose" and n > budget:
            w = _SPACE.split(t.strip(" "))
            cut = [" ".join(w[i : i + budget]) for i in range(0, max(1, len(w) - overlap), budget - overlap)]
            segs += [("part", x, "") for x in cut]
            counts = [_words(x) for x in cut]
            sizes += counts
            captioned += counts
        else:
            segs.append((kind, t, caption))
            sizes.append(n)
            captioned.append(n + _words(caption) if caption else n)
    out, label, last = [], None, -1
    for (kind, t, caption), (at, with_caption) in zip(segs, _place([x[0] for x in segs], sizes, captioned, budget), strict=True):
        if kind == "run_header":
            label = t
            continue
        shown = f"{caption}\n{t}" if with_caption and caption else t
        if at != last:
            out.append((at, label, [shown]))
            last = at
        else:
            out[-1][2].append(shown)
    return [(at, header, "\n\n".join(texts)) for at, header, texts in out]


def _packed_in_tasks(chunks: DataFrame, keys: list[str], budget: int, overlap: int) -> DataFrame:
    """``packed`` by ``words``, chunk by chunk: no segment is a row, nothing is shuffled."""

    def run(batches):
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(len(keys)).to_pylist()):
                if text is not None:
                    found = [(0, None, text)] if _words(text) <= budget else _packed(text, budget, overlap)
                    at.extend([i] * len(found))
                    rows.extend(found)
            columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
            own = [batch.column(k).take(pa.array(at, pa.int32())) for k in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.string()), strict=True))], names=[*keys, "child", "run_header", "text"])

    kinds = ", ".join(f"`{k}` {chunks.schema[k].dataType.simpleString()}" for k in keys)
    return chunks.select(*keys, "text").mapInArrow(run, f"{kinds}, child int, run_header string, text string")


def packed(chunks: DataFrame, keys: list[str], budget: int = 200, overlap: int = 40, count=words) -> DataFrame:
    """keys, child, run_header, text: a chunk's segments in chunks of up to ``budget`` tokens.

    A chunk within the budget stays whole.  A run header opens a chunk and labels what follows it.  A table is never cut
    and takes its caption where it opens a chunk; longer prose is cut into windows, each a chunk.  ``count``: token counter;
    by another than ``words`` the segments of a chunk are rows that meet again.
    """
    if count is words:
        return _packed_in_tasks(chunks, keys, budget, overlap)
    places = F.pandas_udf(_places, "array<struct<chunk:int,captioned:boolean>>")
    seg = F.flatten(F.transform(segments(F.col("text")), lambda s: F.when(
        (s["kind"] == "prose") & (count(s["text"]) > budget), F.transform(windows(s["text"], budget, overlap), lambda t: F.struct(F.lit("part").alias("kind"), t.alias("text"), F.lit("").alias("caption")))
    ).otherwise(F.array(s))))
    own = chunks.select(*keys, "text", count(F.col("text")).alias("n"))
    whole = own.where(F.col("n") <= budget).select(*keys, F.lit(0).alias("child"), F.lit(None).cast("string").alias("run_header"), "text")
    rows = own.where(F.col("n") > budget).select(*keys, seg.alias("s"))
    with_caption = lambda s: F.when(s["caption"] == "", s["text"]).otherwise(F.concat(s["caption"], F.lit("\n"), s["text"]))
    rows = rows.withColumn("p", places(F.col("s.kind"), F.transform("s", lambda s: count(s["text"])), F.transform("s", lambda s: count(with_caption(s))), F.lit(budget)))
    parts = rows.select(*keys, F.posexplode(F.arrays_zip("s", "p")).alias("pos", "x"))
    label = F.last(F.when(F.col("x.s.kind") == "run_header", F.col("x.s.text")), True).over(W.partitionBy(*keys).orderBy("pos"))
    text = F.when(F.col("x.p.captioned"), with_caption(F.col("x.s"))).otherwise(F.col("x.s.text"))
    parts = parts.select(*keys, "pos", F.col("x.p.chunk").alias("child"), label.alias("run_header"), text.alias("t")).where("child >= 0")
    made = parts.groupBy(*keys, "child").agg(F.first("run_header").alias("run_header"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda s: s["t"]), "\n\n").alias("text"))
    return whole.unionByName(made)


def table_parts(table: Column) -> Column:
    """struct<head, rows> of a table's lines: those up to the separator, and the rest; a table without one is all head."""
    lines = F.filter(F.split(F.trim(table), "\n"), lambda x: F.trim(x) != "")
    at = F.array_position(F.transform(lines, lambda x: F.trim(x).rlike(SEPARATOR)), True).cast("int")
    n = F.when(at > 0, at).otherwise(F.size(lines))
    return F.struct(F.slice(lines, F.lit(1), n).alias("head"), F.slice(lines, n + 1, F.size(lines)).alias("rows"))


def split_table(tables: DataFrame, keys: list[str], budget: int = 200, count=words) -> DataFrame:
    """keys, part, text: ``tables`` (keys, table, caption) cut between rows to the budget, each part with caption and head; a row too long for any part stands alone."""
    places = F.pandas_udf(_places, "array<struct<chunk:int,captioned:boolean>>")
    rows = tables.select(*keys, "caption", table_parts(F.col("table")).alias("t"))
    head = F.concat(F.when(F.col("caption") != "", F.concat("caption", F.lit("\n"))).otherwise(""), F.array_join("t.head", "\n"))
    rows = rows.select(*keys, head.alias("head"), F.col("t.rows").alias("rows")).withColumn("room", F.greatest(F.lit(budget) - count(F.col("head")), F.lit(0)))
    sizes = F.transform("rows", lambda r: count(r))
    rows = rows.withColumn("p", places(F.transform("rows", lambda r: F.lit("row")), sizes, sizes, F.col("room")))
    parts = rows.select(*keys, "head", F.posexplode(F.arrays_zip("rows", "p")).alias("pos", "x"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("x.rows").alias("r")))), lambda s: s["r"]), "\n")
    return parts.groupBy(*keys, F.col("x.p.chunk").alias("part")).agg(F.concat(F.first("head"), F.lit("\n"), joined).alias("text"))


def chunk_id(*parts) -> Column:
    """A name that follows from where a chunk stands."""
    return F.sha1(F.concat_ws("/", *[p if isinstance(p, Column) else F.col(p) for p in parts]))


def _level_one(docs: DataFrame) -> DataFrame:
    cut = sections_of(docs, "doc_id", "md")
    return cut.select(chunk_id("doc_id", F.lit("1"), "ord").alias("id"), F.lit(1).alias("level"), "doc_id", chunk_id("doc_id", F.lit("0")).alias("parent_id"), *LEVELS, F.lit(None).cast("string").alias("run_header"), "text")


def _level_two(one: DataFrame, budget: int, overlap: int, count) -> DataFrame:
    two = packed(one.select(F.col("id").alias("parent_id"), "doc_id", *LEVELS, "text"), ["parent_id", "doc_id", *LEVELS], budget, overlap, count)
    sure = F.when(F.col("doc_id").isNull(), F.raise_error(F.lit("a child without document"))).otherwise(F.col("doc_id"))
    return two.select(chunk_id("parent_id", F.lit("2"), "child").alias("id"), F.lit(2).alias("level"), sure.alias("doc_id"), "parent_id", *LEVELS, "run_header", "text")


def _level_three(two: DataFrame, model, count) -> DataFrame:
    return two.withColumn("level", F.lit(3)).withColumn("id", chunk_id("id", F.lit("3"))).withColumn("description", description(F.col("text"), model, count))


def described(docs: DataFrame, model, budget: int = 200, overlap: int = 40, count=words) -> DataFrame:
    """Level 3 of ``hierarchy`` alone, which is made in one pass over ``docs``: no level is written."""
    return _level_three(_level_two(_level_one(docs), budget, overlap, count), model, count)


def hierarchy(docs: DataFrame, budget: int = 200, overlap: int = 40, count=words, model=None) -> DataFrame:
    """id, level, doc_id, parent_id, section, subsection, item, subitem, run_header, description, text of all levels of ``docs`` (doc_id, md).

    Level 0: documents; 1: sections; 2: their packed children; 3: the same children with a description, where ``model``
    (a function of the text column) is given.  A child without parent stops the job.
    """
    empty = [F.lit(None).cast("string").alias(c) for c in (*LEVELS, "run_header")]
    zero = docs.select(chunk_id("doc_id", F.lit("0")).alias("id"), F.lit(0).alias("level"), "doc_id", F.lit(None).cast("string").alias("parent_id"), *empty, F.col("md").alias("text"))
    one = store.written(_level_one(docs), "sections")  # every level below reads it
    two = store.written(_level_two(one, budget, overlap, count), "children")
    out = zero.unionByName(one).unionByName(two).withColumn("description", F.lit(None).cast("string"))
    return out if model is None else out.unionByName(_level_three(two, model, count))


def description(text: Column, model, count=words) -> Column:
    """What ``model`` says of a text of ``MIN_WORDS`` tokens or more: between its summary tags, or all of it; "" for shorter texts."""
    reply = F.coalesce(model(text), F.lit(""))
    tagged = F.trim(F.regexp_extract(reply, r"(?s)<summary>(.*?)</summary>", 1))
    return F.when(count(text) < MIN_WORDS, "").when(reply.rlike(r"(?s)<summary>.*</summary>"), tagged).otherwise(reply)


#: Where a filing names its form, year end, company and symbol, in order of trust.
FORM = r"(?i)FORM\s+(10-K(?:/A)?)"
YEAR_END = r"(?i)fiscal year[- ]ende?d?(?:\s+of)?\s+([A-Za-z]+)\s+(\d{1,2})\s*,\s*(\d{4})"
NAME = r"(?i)([^\n#*]{3,100})\s*(?:\*\*|###)?\s*\n+(?:\*\*|###)?\s*(?:\(?Exact name|State of Incorporation|I\.R\.S\.)"
VETO = ("REPORT", "PURSUANT", "SECTION", "ACT OF", "FORM")
INCORPORATED = r"([^\n#*]{3,100}?)\s+(?:was )?incorporated in\s+\d{4}"
SYMBOLS = (r"(?i)Trading Symbol[^\n]+\n\|(?:\s*:?---:?\s*\|)+\n\|[^|]+\|\s*([A-Za-z0-9]+)\s*\|", r"(?i)ticker symbol is\s+([A-Z0-9]+)", "(?i)(?:under the\\s+)?symbol\\s+[“\"]?([A-Z0-9]+)[”\"]?")
ENDINGS = r"(?i)\b(?:INC|CORP|CORPORATION|LIMITED|LTD|HOLDINGS|SYSTEMS|INCORPORATED|LLC|LP|PLC|COMPANY)\b.*"
MONTHS = "january february march april may june july august september october november december".split()


def document_metadata(md: Column, most: int = 200_000) -> Column:
    """struct<form_type, fiscal_year_end (MM-DD-YY), company_name, ticker> of a filing's first ``most`` characters, lower case; null where it doesn't say."""
    text = F.substring(md, 1, most)
    get = lambda pattern, group=1: F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(get(YEAR_END)))
    ends = F.when(month > 0, F.concat_ws("-", F.lpad(month.cast("string"), 2, "0"), F.lpad(get(YEAR_END, 2), 2, "0"), F.substring(get(YEAR_END, 3), 3, 2)))
    first = F.trim(get(NAME))
    vetoed = F.lit(False)
    for word in VETO:
        vetoed = vetoed | F.upper(first).contains(word)
    name = F.coalesce(F.when(~vetoed, first), F.trim(get(INCORPORATED)))
    name = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"[,./]+", " "), ENDINGS, ""), r"\s+", " "))
    return F.struct(F.lower(get(FORM)).alias("form_type"), ends.alias("fiscal_year_end"), F.lower(name).alias("company_name"), F.lower(F.coalesce(*[get(p) for p in SYMBOLS])).alias("ticker"))


def merged_metadata(chunk: dict[str, Column], doc: dict[str, Column]) -> dict[str, Column]:
    """Fields of a document, over which a chunk's own stand."""
    return {k: F.coalesce(chunk[k], doc[k]) if k in chunk and k in doc else chunk.get(k, doc.get(k)) for k in {**doc, **chunk}}


def normal_payload(rows: DataFrame) -> DataFrame:
    """``rows`` with every text column trimmed and in lower case."""
    return rows.select(*[F.lower(F.trim(F.col(f"`{f.name}`"))).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f"`{f.name}`") for f in rows.schema])


def chunk_statistics(chunks: DataFrame, key: str) -> DataFrame:
    """key, n, n_section, n_subsection, n_item, n_subitem, flag ("!!" for a document that fell into one chunk or none)."""
    counts = [F.count_if(F.coalesce(F.col(c), F.lit("")) != "").alias(f"n_{c}") for c in LEVELS]
    return chunks.groupBy(key).agg(F.count("*").alias("n"), *counts).withColumn("flag", F.when(F.col("n") <= 1, "!!").otherwise(""))
