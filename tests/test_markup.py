"""HTML conversion, heading lines and splitting by hand and by brute force."""

import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import levels, markup, splitter

PAGES = [
    ("<p>a<p>b", "a\n\nb"),
    ("<ul><li>a<ul><li>b<ol><li>c</ol></ul><li>d</ul>", "- a\n  - b\n    1. c\n- d"),
    ("x &lt;b&gt; &#x41;&#66; &nbsp; &copy; &unknown; & y", "x <b> AB © &unknown; & y"),
    ("<p><b> bold </b>text<i></i><strong><em>both</em></strong></p>", "**bold** text***both***"),
    ("<h2>Head<br>two</h2>text<h7>no</h7>", "## Head\n   two\n\ntextno"),
    ("<table><tr><td>a<td>b<tr><td colspan=2>c</table>", "| a | b |\n|---|---|\n| c |  |"),
    ("<table><tr><td><table><tr><td>in</td></tr></table></td><td>x|y</td></tr></table>z", "| in | x\\|y |\n|---|---|\n\nz"),
    ("<table><tr><td><ul><li>a<li>b</ul></td><td><p>c</p><p>d</p></td></tr></table>", "| a b | c d |\n|---|---|"),
    ("<table></table><table><tr></tr></table>", ""),
    ("a<script>if (a < b) document.write('<p>')</script><style>p{}</style><!-- <p>no --><nav>no<p>no</nav>b", "ab"),
    ("</p></b></td>stray<td>cell", "straycell"),
    ("<div>one<div>two</div>three</div>", "one\n\ntwo\n\nthree"),
    ("<b>left open<p>next", "**left open**\n\n**next**"),
    ("tail <b", "tail <b"),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize("html,md", PAGES)
def test_pages_by_hand(html, md):
    assert markup.to_markdown(html) == md


def test_wild_pages_end():
    """Whatever is open, closed or cut, there is a text, in time linear in the page."""
    rng = random.Random(2)
    parts = [f"<{s}{t}>" for t in ("p", "b", "li", "ul", "ol", "table", "tr", "td", "h1", "div", "script", "nav", "br/", "i", "tbody") for s in ("", "/")] + ["word", " ", "&amp;", "&", "<", ">", "|", "\n"]
    for _ in range(300):
        page = "".join(rng.choice(parts) for _ in range(rng.randint(0, 80)))
        md = markup.to_markdown(page)
        assert "\n\n\n" not in md and md == md.strip("\n")
    assert markup.to_markdown("<ul><li>" * 3000 + "x").endswith("- x") and markup.to_markdown("<b>" * 3000 + "x").strip("*") == "x"


def test_tables_reach_the_segmenter(spark):
    html = "<p>Lines of the order<table><tr><th>part<th>n<tr><td>1<td>2<tr><td>3<td>4</table><p>end"
    pages = spark.createDataFrame([(1, html, "kept"), (2, None, "kept")], "page_id int, html string, other string")
    md = markup.markdown_pages(pages)
    assert md.columns == ["page_id", "other", "md"] and md.count() == 2
    (s,) = md.select(F.explode(levels.segments(F.col("md"))).alias("s")).where("s.kind = 'table'").collect()
    assert s["s"]["caption"] == "Lines of the order" and s["s"]["text"] == "| part | n |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |"


ENRICHED = [
    ("PART I\nItem 1. Business\ntext", "# PART I \n## ITEM 1 Business\ntext"),
    ("part iii: Other", "# PART III : Other"),
    ("**Item 7a. Risk**", "## ITEM 7A Risk"),
    ("| PART II | |\n| Item 5. | Market | 12 |", "# PART II \n## ITEM 5 Market"),
    ("***Both***\n**One**", "### Both\n### One"),
    ("**" + "x" * 100 + "**", "**" + "x" * 100 + "**"),
    ("**" + "x" * 99 + "**", "### " + "x" * 99),
    ("**Head.** then text", "#### Head\n\nthen text"),
    ("**He.** short head", "**He.** short head"),
    ("a\n\nNet Sales by Region\n\nb", "a\n\n### Net Sales by Region\n\nb"),
    ("a\nNet Sales\n\nb", "a\nNet Sales\n\nb"),
    ("Net Sales.", "Net Sales."),
    ("Net sales by region\n", "Net sales by region"),
    ("2024 Net Sales", "2024 Net Sales"),
    ("PART I\nContents\n\n  \nPART I\nx", "PART I\nContents\n\n  \n# PART I \nx"),
    ("Table of contents", "Table of contents"),
    ("# PART I\n\n\n\n\ny", "# PART I\n\ny"),
    ("a\r\nPART IV\rb", "a\n# PART IV \nb"),
    ("PARTY I\nItemised 3\nItem x", "PARTY I\nItemised 3\nItem x"),
    ("", ""),
    (None, ""),
]


def test_heading_lines_by_hand(spark):
    df = spark.createDataFrame([(k, a) for k, (a, _) in enumerate(ENRICHED)], "k int, md string")
    got = {r["k"]: r["e"] for r in df.select("k", markup.enriched(F.col("md")).alias("e")).collect()}
    for k, (md, want) in enumerate(ENRICHED):
        assert got[k] == want, md


def by_rules(text, budget, overlap, ladder, count):
    """The rules of ``splitter.split`` with whole lists and strings at every step."""
    rung = 0
    while rung < len(ladder) - 1 and ladder[rung] and ladder[rung] not in text:
        rung += 1
    sep = ladder[rung]
    pieces = list(text) if not sep else [p if k == 0 else sep + p for k, p in enumerate(text.split(sep))]
    out, group = [], []

    def close():
        run = []
        for p in group:
            if sum(map(count, run)) + count(p) > budget and run:
                out.append("".join(run))
                while run and (sum(map(count, run)) > overlap or sum(map(count, run)) + count(p) > budget):
                    run = run[1:]
            run = [*run, p]
        if run:
            out.append("".join(run))
        group.clear()

    for p in pieces:
        if p and count(p) < budget:
            group.append(p)
        elif p:
            close()
            out.extend(by_rules(p, budget, overlap, ladder[rung + 1 :], count) if ladder[rung + 1 :] else [p])
    close()
    return [c.strip() for c in out if c.strip()]


def test_splitter_is_its_rules(spark):
    rng = random.Random(7)
    parts = ["word", "w", "longer-words", " ", " ", " ", "\n", "\n\n", "，", "。", "é😀", "x" * 30]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 120))) for _ in range(250)] + ["", " ", "x" * 500, "\n\n\n"]
    for budget, overlap, count in ((40, 8, len), (12, 12, len), (5, 2, lambda t: len(t.split())), (200, 40, len), (1, 0, len)):
        for t in texts:
            assert splitter.split(t, budget, overlap, count=count) == by_rules(t, budget, overlap, splitter.LADDER, count), (budget, t)
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None])], "k int, t string").repartition(3)
    got = {r["k"]: list(r["c"]) for r in df.select("k", splitter.chunks(F.col("t"), 40, 8).alias("c")).collect()}
    assert got == {k: splitter.split(t, 40, 8) for k, t in enumerate([*texts, None])} and got[len(texts)] == []


def test_splitter_keeps_all_words_within_the_budget():
    text = " ".join(f"w{k}" for k in range(3000))
    found = splitter.split(text, 50, 10)
    assert all(len(c) <= 50 for c in found) and {w for c in found for w in c.split()} == set(text.split())
    assert all(set(a.split()) & set(b.split()) for a, b in zip(found, found[1:]))
