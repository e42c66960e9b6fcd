"""Paragraphs of pages against the standard library's parser."""

import os
import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from sextant.functions import html

DATA = os.environ.get("ORACLE_DATA", "/root/testdata/sf0.001")


class Tree(HTMLParser):
    """Paragraphs from the events of the standard parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.found, self.hidden = [], [], None

    def handle_starttag(self, tag, attrs):
        self.hidden = tag if tag in html.HIDDEN else None
        if tag not in html.VOID:
            self.open.append((tag, len(self.found) if tag == "p" else -1))
            if tag == "p":
                self.found.append([])

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.hidden = None
        if tag in [t for t, _ in self.open]:
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not self.hidden:
            for _, number in self.open:
                if number >= 0:
                    self.found[number].append(data)


def standard(page):
    tree = Tree()
    tree.feed(page)
    tree.close()
    return ["".join(x) for x in tree.found]


PAGES = [
    "", "no paragraph", "<p>a</p>", "<P CLASS=x>a<br>b</P >c", "<p>a<p>b</p>c</p>d", "<div><p>a</div>b<p>c", "<p>a</b>b</p>", "<p><b>a</p>b</b>", "<p title='a > b' x=\"<p>\">in</p>", "<p x=a>b</p>", "<p x = 'y'z>b</p>",
    "<p>1 < 2 && 3 > 2</p>", "<p>&lt;&amp;&copy;&eacute &#233;&#xe9;&notit; &nope; &amp</p>", "<p>a<!-- <p>no</p> -->b</p>", "<script>var t='<p>x</p>';</script><p>y</p>", "<p>a<script>b</script>c<style>p{}</style>d</p>",
    "<p>a<?php echo '>' ?>b</p>", "<!DOCTYPE html><p>a", "<p>a</>b</p>", "<p/>x</p>", "<p>a<br/>b<img src=x>c</p>", "<p>\n a\t\r\n</p>", "<table><tr><td><p>a<td><p>b</table>c", "<p>a<3b</p>", "<p>tail<", "<p>😀é<b>ü</b></p>", "<pre><p>x</pre><px>y</px>",
    "<p>" * 50 + "deep", "<p a='unclosed>b</p>", "</p></div><p>a", "<p>a</p\n>b", "<title>t</title><p>x</p>", "<p><a href=/x/>l</a>m</p>",
]


@pytest.mark.parametrize("page", PAGES)
def test_paragraphs_are_those_of_the_standard_parser(page):
    assert html.paragraphs(page) == standard(page)


def test_text_only_elements():
    assert html.paragraphs("<p>a<textarea><p>&lt;</textarea>b<xmp>&lt;</xmp></p>") == ["a<p><b&lt;"]
    assert html.paragraphs("<script>if (a</script b) {}</script><p>x") == ["x"]
    assert html.paragraphs("<p>a<script>never closed <p>b") == ["a"]
    assert html.paragraphs("<p>a<!-->b--></p>") == html.paragraphs("<p>a<!--->b--></p>") == ["ab-->"]  # comments end there by the language's standard
    assert html.paragraphs("<p>a<b") == ["a"] and html.paragraphs("<p>a--!><!-- x --!>b") == ["a--!>b"]


def test_mixed_pieces():
    rng = random.Random(4)
    parts = ["<p>", "</p>", "<div>", "</div>", "text ", "<b x='1'>", "</b>", "<br>", "&amp;", "&#65;", " < ", "<!-- c -->", "<script>s</script>", "<p id=\"a>b\">", "</i>", "<li>", "é"]
    for _ in range(3000):
        page = "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))
        assert html.paragraphs(page) == standard(page), page


def test_long_pages_take_linear_time():
    for page in ("<p" * 200_000, "<" * 500_000, "<p>" + "<b>" * 200_000 + "x", "</b>" * 300_000, "<p " + "a " * 300_000, "<!" * 200_000 + "-", "&" * 300_000, "<div>" * 100_000 + "</b>" * 100_000):
        html.paragraphs(page)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_pages_on_spark(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "html").union(spark.createDataFrame([(-1, None), (-2, "")], "page_id bigint, html string"))
    got = {r["page_id"]: r["p"] for r in pages.select("page_id", html.paragraph_texts(F.col("html")).alias("p")).collect()}
    assert got == {r["page_id"]: None if r["html"] is None else standard(r["html"]) for r in pages.collect()}


def test_pages_are_taken_apart_in_pieces(monkeypatch):
    import pyarrow as pa

    from sextant.functions import html

    pages = [None, "", *(f"<p>a{i}<p>" + "b" * (i % 700) for i in range(3000)), "<p>" + "c" * (2 * html.PIECE), None]
    held, built = [], pa.array
    monkeypatch.setattr(html.pa, "array", lambda rows, kind: held.append(len(rows)) or built(rows, kind))
    got = html._found(built(pages, pa.string()).slice(1))
    assert got.to_pylist() == [None if p is None else html.paragraphs(p) for p in pages[1:]]
    assert len(held) > 3 and max(held) < 1500
    assert html._found(built([], pa.string())).to_pylist() == []
