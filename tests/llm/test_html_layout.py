"""Rendered pages, case by case."""

from __future__ import annotations

import random
import time

import pytest

from granary.llm.html_layout import DEPTH, extracted, layout

CASES = [
    ("<p>One<p>Two <b>bold</b>  x<br>y", "One\n\nTwo bold x\ny"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
    ("<ol start=3><li>x<li value=9>y<li>z</ol>", "3. x\n9. y\n10. z"),
    ("<table><tr><th>Name<th>N<tr><td>Ab<td>12</table>", "Name | N\nAb   | 12"),
    ("<table><tr><td rowspan=2>r<td>1<tr><td>2</table>", "r | 1\n  | 2"),
    ("<table><tr><td>a<br>b</td><td>c</td></tr></table>", "a | c\nb"),
    ("<table><tr><td colspan=2>wide one<tr><td>x<td>y</table>", "wide one\nx | y"),
    ("<div hidden>no</div>yes<p style='display: NONE'>no</p>", "yes"),
    ("<span style='visibility:hidden'>no <b style='visibility:visible'>yes</b></span>", "yes"),
    ("<head><title>t</title></head><style>p{}</style><script>var a='</p>'</script>x", "x"),
    ("<pre>a  b\n  c</pre>d", "a  b\n  c\n\nd"),
    ("<div>a</div>b<section>c</section>", "a\nb\nc"),
    ("a &lt; b &amp;amp; c&nbsp;d", "a < b &amp; c d"),
    ("a < b <i>c</i>", "a < b c"),
    ("<!-- x <p>no --><![CDATA[raw]]>y", "rawy"),
    ("<dl><dt>t<dd>d</dl>", "t\n  d"),
    ("x</p></div></b>y", "x\n\ny"),
    ("<a title='a>b'>t</a>", "t"),
    ("", ""),
    ("   \n ", ""),
    (None, None),
]


@pytest.mark.parametrize(("html", "text"), CASES)
def test_layout(html, text):
    assert layout(html) == text


def test_deep_long_and_broken_pages_keep_their_text():
    assert "deep" in layout("<div>" * 5000 + "deep" + "</div>" * 5000)
    assert layout("<li>" * 3000 + "x").endswith("x")
    assert "x" in layout("<table><tr><td>" * 400 + "x")
    assert layout("<p>" + "word " * 200_000).count("word") == 200_000
    assert layout("<p>unclosed <a href='x").startswith("unclosed")


def test_beyond_the_depth_hidden_stays_hidden_and_blocks_break():
    deep = "<i>" * (DEPTH + 50)
    page = f"{deep}a<div hidden>no<p>no</div>b<div>c</div>d<b style='display:none'>no<script>x</script></b>e<p>f"
    assert layout(page) == "a\nb\nc\nde\nf"
    assert layout(f"<div>{deep}a</div>b") == "a\nb"


@pytest.mark.parametrize("page", ["<a " * 350_000, '<a href="' * 120_000, "<a href='" * 120_000 + ">", "<" * 1_000_000, "<!--" * 250_000, '<a "><b \'>' * 100_000, "</p" * 300_000, "<b>" * 150_000 + "</i>" * 150_000, "<i><table>" + "<b>" * 190 + "</i>" * 250_000, "<table>" + "<tr><td rowspan=65534>x" * 45_000, "<table>" + "<tr><td rowspan=2>x<td>y" * 40_000, "<li>" * 250_000, "<p><b>" * 170_000, "<table><tr>" + "<td>x" * 200_000, "<ul>" * 250_000 + "x"])
def test_hostile_pages_take_no_second_look(page):
    began = time.perf_counter()
    layout(page)
    assert time.perf_counter() - began < 3


def test_padding_stays_in_proportion():
    page = "<table>" + "<tr><td>a<td>b" * 3000 + "<tr><td>" + "x" * 30_000 + "<td>c</table>"
    assert len(layout(page)) < 2 * len(page) and "x" * 30_000 in layout(page)
    wide = "<table>" + "<tr><td colspan=1000 rowspan=60000>a<td>b" * 800 + "</table>"
    began = time.perf_counter()
    assert layout(wide).count("a") == 800 and time.perf_counter() - began < 5


def test_wide_cells_widen_their_column_and_hostile_tables_are_set_unaligned():
    long = "w" * 450
    assert layout(f"<table><tr><td>{long}<td>b<tr><td>a<td>c</table>") == f"{long} | b\n{'a'.ljust(450)} | c"
    page = "<table>" + "<tr><td rowspan=65534>x" * 3000 + "</table>"
    text = layout(page)
    assert text.count("x") == 3000 and len(text) < len(page)
    assert layout("<table><tr><td rowspan=3>a<td>b<tr><td>c<tr><td>d</table>") == "a | b\n  | c\n  | d"


class Plain:
    """A plain reference: random pages, written beside the text that they must give, without parsing anything."""

    def __init__(self, seed):
        self.rng = random.Random(seed)

    def words(self):
        return [self.rng.choice(["wide", "a", "Ünï", "x<y", "R&D", "12"]) for _ in range(self.rng.randint(1, 5))]

    def inline(self):
        words, out = self.words(), []
        for w in words:
            w = w.replace("&", "&amp;").replace("<", "&lt;")
            kind = self.rng.randrange(6)
            out.append([w, f"<b>{w}</b>", f"<i class='a>b'>{w}</i>", f"<!-- no -->{w}<span hidden>no</span>", f"{w}<script>no</script>", f"<span style='display:none'>no</span>{w}"][kind])
        return self.rng.choice([" ", "\n ", " \t "]).join(out), " ".join(words)

    def items(self, depth, ordered):
        html, lines, number = "", [], self.rng.randint(1, 9)
        html += f"<ol start={number}>" if ordered else "<ul>"
        for _ in range(self.rng.randint(1, 3)):
            inner, text = self.inline()
            mark = f"{number}. " if ordered else "- "
            number += 1
            lines.append(mark + text)
            html += f"<li>{inner}"
            if depth and self.rng.random() < 0.4:
                below, under = self.items(depth - 1, self.rng.random() < 0.5)
                html, lines = html + below, lines + [" " * len(mark) + x for x in under]
            html += self.rng.choice(["</li>", "", "\n"])
        return html + ("</ol>" if ordered else "</ul>"), lines

    def table(self):
        rows = [[self.inline() for _ in range(self.rng.randint(2, 4))] for _ in range(self.rng.randint(1, 4))]
        n = max(map(len, rows))
        widths = [max(len(r[c][1]) for r in rows if len(r) > c) for c in range(n)]
        html = "<table>" + "".join(self.rng.choice(["<tr>", "<tbody><tr>"]) + "".join(self.rng.choice(["<td>", "<th>"]) + cell[0] for cell in r) for r in rows) + "</table>"
        return html, [" | ".join(cell[1].ljust(widths[c]) for c, cell in enumerate(r)).rstrip() for r in rows]

    def page(self):
        html, blocks = "", []
        for _ in range(self.rng.randint(1, 8)):
            kind = self.rng.randrange(6)
            if kind == 0:
                inner, text = self.inline()
                html, blocks = html + f"<p>{inner}" + self.rng.choice(["</p>", ""]), [*blocks, text]
            elif kind == 1:
                inner, lines = self.items(2, self.rng.random() < 0.5)
                html, blocks = html + inner, [*blocks, "\n".join(lines)]
            elif kind == 2:
                inner, lines = self.table()
                html, blocks = html + inner, [*blocks, "\n".join(lines)]
            elif kind == 3:
                html += self.rng.choice(["<p hidden>no</p>", "<div style='display: none'><p>no<table><tr><td>no</table></div>", "<style>no</style>", "<template><p>no</template>"])
            elif kind == 4:
                lines = [" ".join(self.words()) for _ in range(2)]
                raw = "\n".join(x.replace("&", "&amp;").replace("<", "&lt;").replace(" ", "  ") for x in lines)
                html, blocks = html + f"<pre>{raw}</pre>", [*blocks, "\n".join(x.replace(" ", "  ") for x in lines)]
            else:
                parts = [self.inline() for _ in range(2)]
                html += "<h2>" + "<br>".join(x for x, _ in parts) + "</h2>"
                blocks.append("\n".join(x for _, x in parts))
        return html, "\n\n".join(blocks)


def test_equals_the_plain_reference():
    for seed in range(800):
        html, text = Plain(seed).page()
        assert layout(html) == text, html


def test_rows(spark):
    df = spark.createDataFrame([(1, "<p>a", 5), (2, None, 5), (None, "b", 5), (2, None, 5)], "page_id long, html string, n_chars int")
    rows = sorted(((r.page_id or 0), r.text, r.n_chars) for r in extracted(df).na.fill("", ["text"]).na.fill(0).collect())
    assert rows == [(0, "b", 1), (1, "a", 1), (2, "", 0), (2, "", 0)]
    assert extracted(df.limit(0)).count() == 0
