"""HTML to markdown with a stack of open elements, and lines of markdown that are headings without being marked so."""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements whose content isn't text of the page; elements that stand on lines of their own.
SKIPPED = frozenset("script style head nav footer template noscript ix:header".split())
BLOCKS = frozenset("p div section article main header aside blockquote figure form fieldset address dl dt dd hr body html caption".split())
MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*"}
#: An opening element (key) ends an open element of these, up to the next of the others.
IMPLIED = {
    **dict.fromkeys([*"ul ol table h1 h2 h3 h4 h5 h6".split(), *(BLOCKS - {"body", "html", "caption"})], (("p",), ("td", "th", "li", "div", "table", "section", "article"))),
    "li": (("li", "p"), ("ul", "ol")), "tr": (("tr", "td", "th", "p"), ("table",)), "td": (("td", "th", "p"), ("tr", "table")), "th": (("td", "th", "p"), ("tr", "table")),
}
VOID = frozenset("br hr img input meta link col area base embed source track wbr".split())
HEADS = {f"h{n}": "#" * n + " " for n in range(1, 7)}
OUTSIDE = frozenset("tr table tbody thead td th".split())
WHITES = re.compile(r"[ \t\r\n\f\v\xa0]+")
#: What stands in plain pages, one after the other: text, comments, scripts and styles, ends, starts with quoted attributes.  Any reader of HTML takes these alike.
PLAIN = re.compile(
    r"""([^<]+)|<!--[^<>-]+-->|<(script|style)>(?:[^<]|<(?!/\s*\2))*</\2>|</([a-zA-Z][a-zA-Z0-9]*)>|<(?!(?:script|style|textarea|title|xmp|iframe|noembed|noframes|plaintext|noscript)\b)([a-zA-Z][a-zA-Z0-9]*)((?:\ [a-zA-Z][a-zA-Z0-9-]*="[^"<>]*")*)>|<(title|noscript)>[^<&]*</\6>""", re.IGNORECASE,
)
QUOTED = re.compile(r' ([^=]+)="([^"]*)"')


class Markdown(HTMLParser):
    """Markdown of one page, in time linear in it.

    ``out`` are finished lines ("" parts blocks), ``line`` the pieces of the open one.  A table gathers its cells and is
    written when it ends; a table inside a cell is text of that cell.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.line: list[str] = []
        self.stack: list[str] = []
        self.skipped = 0
        self.lists: list[list] = []  # [kind, items so far]
        self.tables = 0
        self.rows: list[list[str]] = []
        self.cell: list[str] | None = None
        self.span = 1
        self.marks: list[tuple[str, int]] = []  # open mark, and how many pieces the line had
        self.prefix = ""

    # --- lines

    def flush(self) -> None:
        """Close the open line: white space collapsed, marks that are open closed and opened again behind."""
        if not self.line and not self.marks:
            return
        text = WHITES.sub(" ", "".join(self.line)).strip(" ")
        self.line = []
        open_ = "".join(m for m, _ in self.marks)
        if open_ and text.strip("* "):
            text += open_[::-1]
        if text.strip("* "):
            self.out.append(self.prefix + text)
            self.prefix = " " * len(self.prefix)  # further lines of an item stand under it
        self.marks = [(m, 0) for m, _ in self.marks]
        self.line = [open_] if open_ else []

    def part(self) -> None:
        """Close the open line and the block."""
        if self.cell is not None:
            self.cell.append(" ")
            return
        self.flush()
        if self.out and self.out[-1] != "":
            self.out.append("")

    # --- elements

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skipped += tag not in VOID
            self.stack.append(tag)
            return
        if tag in IMPLIED:
            ended, within = IMPLIED[tag]
            at = len(self.stack) - 1
            while at >= 0 and self.stack[at] not in within:
                if self.stack[at] in ended:
                    self.shut(at)
                at -= 1
        if tag not in VOID:
            self.stack.append(tag)
        if self.skipped:
            return
        if tag == "br":
            if self.cell is not None:
                self.cell.append(" ")
            else:
                self.flush()
        elif tag in HEADS:
            self.part()
            if self.cell is None:
                self.prefix = HEADS[tag]
        elif tag in MARKS:
            self.mark(MARKS[tag])
        elif tag in ("ul", "ol"):
            if self.lists and self.cell is None:
                self.flush()
            else:
                self.part()
            self.lists.append([tag, 0])
        elif tag == "li":
            if self.cell is not None:
                self.cell.append(" ")
            else:
                self.flush()
                kind = self.lists[-1] if self.lists else ["ul", 0]
                kind[1] += 1
                self.prefix = "  " * max(0, len(self.lists) - 1) + (f"{kind[1]}. " if kind[0] == "ol" else "- ")
        elif tag == "table":
            if self.tables == 0:
                self.part()
                self.rows = []
            self.tables += 1
        elif tag == "tr" and self.tables == 1:
            self.rows.append([])
        elif tag in ("td", "th") and self.tables == 1:
            if not self.rows:
                self.rows.append([])
            span = dict(attrs).get("colspan") or "1"
            self.span = min(int(span), 50) if span.isdigit() and int(span) else 1
            self.cell = []
        elif tag in BLOCKS and not (tag == "p" and self.lists):
            self.part()

    def handle_endtag(self, tag):
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at] == tag:
                self.shut(at)
                return
            if self.stack[at] in ("td", "th", "table") and tag not in OUTSIDE:
                return  # an end that belongs outside of the open cell

    def shut(self, at: int) -> None:
        """End the element ``at`` of the stack and all that is open in it."""
        while len(self.stack) > at:
            self.end(self.stack.pop())

    def end(self, tag: str) -> None:
        if tag in SKIPPED:
            self.skipped -= 1
        elif self.skipped:
            return
        elif tag in MARKS:
            self.unmark(MARKS[tag])
        elif tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            if self.lists and self.cell is None:
                self.flush()
            else:
                self.prefix = ""
                self.part()
        elif tag == "li" and self.cell is None:
            self.flush()
            self.prefix = ""
        elif tag in ("td", "th") and self.tables == 1 and self.cell is not None:
            text = WHITES.sub(" ", "".join(self.cell)).strip(" ")
            self.rows[-1] += [text.replace("|", "\\|"), *[""] * (self.span - 1)]
            self.cell = None
        elif tag == "table":
            self.tables -= 1
            if self.tables == 0:
                self.table()
        elif tag in HEADS or (tag in BLOCKS and not (tag == "p" and self.lists)):
            self.part()
            if tag in HEADS:
                self.prefix = ""

    def mark(self, sign: str) -> None:
        own = self.cell if self.cell is not None else self.line
        self.marks.append((sign, len(own)))
        own.append(sign)

    def unmark(self, sign: str) -> None:
        own = self.cell if self.cell is not None else self.line
        for k in range(len(self.marks) - 1, -1, -1):
            if self.marks[k][0] == sign:
                at = self.marks[k][1]
                inner = "".join(own[at + 1 :])
                body = inner.strip(" \t\r\n")
                if body:  # white space moves outside of the marks
                    lead, tail = inner[: len(inner) - len(inner.lstrip(" \t\r\n"))], inner[len(inner.rstrip(" \t\r\n")) :]
                    own[at:] = [lead, sign + body + sign, tail]
                else:
                    own[at:] = [inner]
                del self.marks[k]
                return

    def table(self) -> None:
        """Write the rows: pipes, a row of dashes below the first, all as wide as the widest."""
        rows = [r for r in self.rows if any(r)]
        width = max(map(len, rows), default=0)
        for k, row in enumerate(rows):
            self.out.append("| " + " | ".join(row + [""] * (width - len(row))) + " |")
            if k == 0:
                self.out.append("|" + "---|" * width)
        if rows:
            self.out.append("")
        self.rows, self.cell = [], None

    def handle_data(self, data):
        if not self.skipped:
            (self.cell if self.cell is not None else self.line).append(data)

    def plain(self, html: str) -> bool:
        """Read a page that consists of ``PLAIN`` parts; else False, and what was read is void."""
        at, begin, end = 0, self.handle_starttag, self.handle_endtag
        for m in PLAIN.finditer(html):
            if m.start() != at:
                return False
            at, kind = m.end(), m.lastindex
            if kind == 1:
                if not self.skipped:
                    text = m[1]
                    (self.line if self.cell is None else self.cell).append(unescape(text) if "&" in text else text)
            elif kind == 3:
                end(m[3].lower())
            elif kind == 5:
                begin(m[4].lower(), [(k.lower(), unescape(v)) for k, v in QUOTED.findall(m[5])] if m[5] else ())
            elif kind is not None:
                tag = m[kind].lower()
                begin(tag, ())
                if kind == 6 and not self.skipped:
                    self.handle_data(m[0][len(tag) + 2 : -len(tag) - 3])
                end(tag)
        return at == len(html)

    def result(self) -> str:
        self.goahead(True)  # what looked like the start of an element to the end is text
        self.shut(0)
        self.part()
        return "\n".join(self.out).strip("\n")


def to_markdown(html: str | None) -> str:
    """Markdown of a page; null and empty pages give an empty text.  Plain pages are cut by one pattern, all others by the tolerant parser."""
    page = Markdown()
    if not page.plain(html or ""):
        page = Markdown()
        page.feed(html)
    return page.result()


def markdown_pages(pages: DataFrame, html: str = "html", md: str = "md") -> DataFrame:
    """``pages`` with ``md`` in place of ``html``: headings, paragraphs, nested lists, bold and italic runs, pipe tables with a row of dashes; character references are resolved."""
    keep = [f for f in pages.schema.fields if f.name not in (html, md)]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = batch.slice(at, 500)
                done = pa.array([to_markdown(x) for x in rows.column(html).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*(rows.column(f.name) for f in keep), done], names=[*(f.name for f in keep), md])

    return pages.mapInArrow(run, T.StructType([*keep, T.StructField(md, T.StringType())]))


#: What a heading without a mark looks like (of a trimmed line), and the names of a table of contents.
PART, ITEM = r"(PART\s+(?:I|II|III|IV))\b", r"(ITEM\s+\d+[A-Z]?)"
TABLE_PART, TABLE_ITEM = rf"(?i)^\|\s*{PART}\s*\|\s*([^|]*?)\s*(?:\||$)", rf"(?i)^\|\s*{ITEM}(?:\.|\b)\s*\|\s*([^|]*?)\s*(?:\||$)"
LINE_PART, LINE_ITEM = rf"(?i)^(?:\*\*)?\s*{PART}\s*(.*?)(?:\*\*)?\s*$", rf"(?i)^(?:\*\*)?\s*{ITEM}(?:\.|\b)\s*(.*?)(?:\*\*)?\s*$"
TRIPLE, DOUBLE = r"^\*\*\*\s*(.+?)\s*\*\*\*\s*$", r"^\*\*\s*(.+?)\s*\*\*\s*$"
RUN_IN = r"^\*\*\s*([^.*]{3,60}?)\.?\s*\*\*\s+(.+)$"
CONTENTS = ("table of contents", "contents")
#: Characters of a bold heading, bounds of a floating title, share of its words with a capital.
BOLD_BELOW, TITLE_ABOVE, TITLE_BELOW, CAPITALS = 100, 3, 80, 0.6
WHITE = " \t\n\x0b\f\r"


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def floating_title(line: Column, before: Column, after: Column) -> Column:
    """A line between blank ones that reads like a title: capital first, no full stop, most of its purely alphabetic words with a capital."""
    words = F.filter(F.split(line, r"\s+"), lambda w: w.rlike(r"^\p{L}+$"))
    capital = lambda w: F.size(F.filter(w, lambda x: x.rlike(r"^\p{Lu}")))
    long = F.length(line)
    return before & after & (long > TITLE_ABOVE) & (long < TITLE_BELOW) & line.rlike(r"^\p{Lu}") & ~line.endswith(".") & let(words, lambda w: (F.size(w) > 0) & (capital(w) / F.size(w) > CAPITALS))


def heading_lines(line: Column, before: Column, after: Column) -> Column:
    """array<string>: what stands for a line; ``before`` and ``after``: whether the neighbouring lines are blank (or none).

    The first rule that fits: headings stay; parts and items in a table row; on a line of their own; bold italic; bold of less
    than 100 characters; a bold head that runs into its text, which becomes a heading of level 4, a blank line and the text; a floating title.
    """
    return let(F.btrim(line, F.lit(WHITE)), lambda plain: _heading(line, plain, before, after))


def _heading(line: Column, plain: Column, before: Column, after: Column) -> Column:
    group = lambda pattern, k: F.regexp_extract(plain, f"(?d){pattern}", k)
    fits = lambda pattern: plain.rlike(f"(?d){pattern}")
    named = lambda mark, pattern: F.array(F.concat(F.lit(mark), F.upper(group(pattern, 1)), F.lit(" "), F.btrim(group(pattern, 2), F.lit(WHITE))))
    out = F.when((plain == "") | plain.startswith("#"), F.array(line))
    for pattern, mark in ((TABLE_PART, "# "), (TABLE_ITEM, "## "), (LINE_PART, "# "), (LINE_ITEM, "## ")):
        out = out.when(fits(pattern), named(mark, pattern))
    out = out.when(fits(TRIPLE), F.array(F.concat(F.lit("### "), group(TRIPLE, 1))))
    out = out.when(fits(DOUBLE) & (F.length(group(DOUBLE, 1)) < BOLD_BELOW), F.array(F.concat(F.lit("### "), group(DOUBLE, 1))))
    out = out.when(fits(RUN_IN), F.array(F.concat(F.lit("#### "), group(RUN_IN, 1)), F.lit(""), group(RUN_IN, 2)))
    return out.when(floating_title(plain, before, after), F.array(F.concat(F.lit("### "), plain))).otherwise(F.array(line))


def enriched(md: Column) -> Column:
    """Markdown in which lines that head what follows are marked as headings; null is empty.

    Lines end in \\n, \\r\\n or \\r; white space is ASCII's.  What stands up to a line "contents" or "table of contents", and
    the blank lines behind it, stays as it is.  At most one blank line is left between others.
    """
    text = F.regexp_replace(F.coalesce(md, F.lit("")), r"\r\n?", "\n")
    text = F.regexp_replace(text, r"\n\z", "")
    rows = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("x"), F.btrim(x, F.lit(WHITE)).alias("t")))
    return let(rows, _enriched)


def _enriched(rows: Column) -> Column:
    # Place of the contents line (0: none), and of the first line that isn't blank behind it.
    contents = F.array_position(F.transform(rows, lambda s: F.lower(s["t"]).isin(*CONTENTS)), True)
    first = lambda c: F.array_position(F.transform(rows, lambda s, i: (i >= c) & (s["t"] != "")), True)
    start = let(contents, lambda c: F.when(c == 0, 1).otherwise(let(first(c), lambda f: F.when(f == 0, F.size(rows) + 1).otherwise(f)))).cast("int")
    return let(start, lambda at: _from(rows, at))


def _from(rows: Column, start: Column) -> Column:
    """The text of ``rows``, those from ``start`` on as headings where they are."""

    def made(body):
        # There is no line, so a blank one, beyond the ends.
        blank = lambda i: F.coalesce(F.get(body, i)["t"] == "", F.lit(True))
        return F.flatten(F.transform(body, lambda s, i: heading_lines(s["x"], blank(i - 1), blank(i + 1))))

    kept = F.transform(F.slice(rows, F.lit(1), start - 1), lambda s: s["x"])
    return F.regexp_replace(F.array_join(F.concat(kept, let(F.slice(rows, start, F.size(rows)), made)), "\n"), r"\n{3,}", "\n\n")
