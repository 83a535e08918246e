"""Rendering: hand-made pages, and all visible words of real pages against a plain parser."""

from html.parser import HTMLParser

import pytest

from ordersight.llm.html import MAX_PAD, extract, text_of

CASES = [
    ("", ""),
    ("plain  text\n here", "plain text here"),
    ("<p>one<p>two <b>bold</b>!</p>three", "one\n\ntwo bold!\n\nthree"),
    ("<div>a</div><div>b<br>c</div>", "a\nb\nc"),
    ("<h1>T</h1><p>x", "T\n\nx"),
    ("<head><title>no</title><style>p{}</style><p>shown", "shown"),
    ("<html><head><title>no</title></head><body>x<script>var a='<p>no</p>';</script>y</body></html>", "xy"),
    ("a<!-- no <b> -->b &amp; &copy;&#233;", "ab & ©é"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", "- a\n- b\n  - c\n- d\n\ne"),
    ("<ol start=3><li>a<li value=7>b<li>c</ol>", "3. a\n7. b\n8. c"),
    ("<ol><li>a<br>more<p>para</ol>", "1. a\n   more\n\n   para"),
    ("<table><tr><th>Name<th>N<tr><td>ab<td>1<tr><td>abcdef<td>22</table>", "Name    N\nab      1\nabcdef  22"),
    ("<table><tr><td colspan=2>wide<td>x<tr><td>a<td>b<td>c</table>", "wide     x\na     b  c"),
    ("<table><tr><td rowspan=2>r<td>1<tr><td>2</table>", "r  1\n   2"),
    ("<table><tr><td>a<br>b<td>c</table>", "a  c\nb"),
    ("<table>stray<tr><td>in</table>", "stray\n\nin"),
    ("<table><tr><td><table><tr><td>x<td>y</table><td>z</table>", "x  y  z"),
    ("<table><caption>Cap</caption><tr><td>a</table>", "Cap\na"),
    ("<p hidden>no<p style='color:red; display: none'>no<p>yes", "yes"),
    ("<div style='visibility:hidden'>no <b style='visibility:visible'>yes</b></div>", "yes"),
    ("<details><summary>s</summary>no</details><details open><summary>t</summary>u</details>", "s\nt\nu"),
    ("<select><option>a<option selected>b</select>", "b"),
    ("<pre>\n a  b\n\n  c</pre>", " a  b\n\n  c"),
    ("<textarea>a\n  b</textarea>", "a\n  b"),
    ("1 < 2 <3", "1 < 2 <3"),
    ("a <b", "a"),
    ("<a href='x>y' title=\"<p>\">link</a>", "link"),
    ("<p>a</div>b", "a b".replace(" ", "")),
    ("</p>x", "x"),
    ("<td>no table</td>", "no table"),
    ("x<template>no</template><noscript>yes</noscript>", "xyes"),
    ("a\x00b", "ab"),
    ("<a b='c>open quote</a> d", "open quote d"),
]


@pytest.mark.parametrize(("page", "text"), CASES)
def test_cases(page, text):
    assert text_of(page) == text


def test_deep_long_and_wide_pages_are_linear():
    assert text_of("<div>" * 100_000 + "x") == "x"
    assert text_of("<b>" * 50_000 + "x" + "</b>" * 50_000 + "y") == "xy"
    assert text_of("<a \"" * 50_000) == ""
    wide = "w" * 5000
    out = text_of("<table>" + f"<tr><td>{wide}<td>b<tr><td>a<td>b" * 1000 + "</table>")
    assert len(out) < 1000 * (5000 + 3 + MAX_PAD + 6)
    assert text_of("<ul>" + "<li>x" * 20_000).count("- x") == 20_000


class Visible(HTMLParser):
    """Words outside scripts, styles and the head, in order, as a plain parser sees them."""

    def __init__(self):
        super().__init__()
        self.off, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style", "head")
        if tag not in ("b", "i", "a", "span", "em", "strong", "u"):
            self.words.append(" ")

    def handle_endtag(self, tag):
        self.off -= tag in ("script", "style", "head") and self.off > 0
        if tag not in ("b", "i", "a", "span", "em", "strong", "u"):
            self.words.append(" ")

    def handle_data(self, data):
        if not self.off:
            self.words.append(data)


def test_all_visible_words_of_real_pages(spark):
    from ordersight.llm.queries import op10_html
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = op10_html(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        v = Visible()
        v.feed(pages[r.page_id] or "")
        v.close()
        want = [w for w in "".join(v.words).split() if w != "-"]
        got = [w for line in r.text.split("\n") for w in line.split() if w != "-"]
        assert got == want, r.page_id


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (None, "<p>x"), (3, "<li>a"), (3, "<li>a"), (4, "<p>" + "y " * 200_000)]
    df = spark.createDataFrame([(i, h, "t") for i, h in rows], "page_id long, html string, text string")
    got = sorted(((r.page_id, r.text) for r in extract(df).collect()), key=repr)
    want = [(1, ""), (2, ""), (None, "x"), (3, "- a"), (3, "- a"), (4, ("y " * 200_000).strip())]
    assert got == sorted(want, key=repr)
    assert extract(df.limit(0)).count() == 0
