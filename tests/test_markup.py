"""The page scanner on nested, odd and broken markup."""

import random
import time

import pytest
from pyspark.sql import functions as F

from recordweave.functions import markup, prospects


@pytest.mark.parametrize(
    ("html", "title", "text", "anchors"),
    [
        ("<title> A &amp; B </title><h1>H</h1>x", "A & B", "A & B H x", []),
        ("<title></title><h1>One <b>two</b></h1><h1>three</h1>", "One two", "One two three", []),
        ("<TITLE>x</TITLE><title>y</title>", "x", "x y", []),
        ("a<!-- b <a href=x> -->c<script>var t = '</p><a href=y>'</script>d<style>p{}</style>e", "", "a c d e", []),
        ("a<svg><g><text>t</text></g></svg>b<noscript>n<b>m</b></noscript>c<svg/>d", "", "a b c d", []),
        ("<a class=b href='/k'><article>Contact <i>us</i></article></a><p>x", "", "Contact us x", [("/k", "contact us")]),
        ("<a href=/k>" + "<i>" * 90 + "Contact" + "</i>" * 90 + "</a>", "", "Contact", [("/k", "contact")]),
        ("<a href=/a>one<a href=/b>two</a>three<a>four</a><a name=x href = \"/c?x=1&amp;y=2\">f&uuml;nf", "", "one two three four fünf", [("/a", "one"), ("/b", "two"), ("/c?x=1&y=2", "fünf")]),
        ("<a data-href=/no>x</a><abbr href=/no>y</abbr><area href=/no><A HREF=/yes\n>z</A >", "", "x y z", [("/yes", "z")]),
        ("<a title='>' href='/q'>a > b</a> 1 < 2 &lt;b&gt; &#228; &nbsp; &unknown;", "", "a > b 1 < 2 <b> ä &unknown;", [("/q", "a > b")]),
        ("<!DOCTYPE html><?xml x?><p", "", "<p", []), ("a <b", "", "a <b", []), ("<script>never ends", "", "", []), ("x<!-- never ends", "", "x", []), ("<a href=\"/x>broken</a><p>'more", "", "broken 'more", []), ("", "", "", []),
    ],
)
def test_pages(html, title, text, anchors):
    scan = markup.Scan(html)
    assert (scan.title, markup._space(scan.text), scan.anchors) == (title, text, anchors)


def test_no_page_costs_a_second_pass():
    rng = random.Random(1)
    began = time.time()
    for html in ("<" * 1_000_000, "<a " * 300_000, "<a href='" * 100_000, "<a href=x>" * 100_000, "<svg>" * 200_000, "<!--" * 250_000, "<script>" * 100_000, "&amp" * 250_000, "<a href=" + " " * 1_000_000, "".join(rng.choice("<>a/'\"=! h-") for _ in range(1_000_000))):
        markup.Scan(html)
    assert time.time() - began < 20


def test_columns(spark):
    rows = [(1, "<a href='c/d'>C</a>", "https://x.example/a/b"), (2, None, None), (3, "<a href='http://[bad'>B</a>", "https://x.example"), (4, "<a href='../e?q#f'>E</a>", "https://x.example/a/b/")]
    d = spark.createDataFrame(rows, "i int, html string, url string")
    got = {r.i: r.p for r in d.select("i", markup.page(F.col("html"), F.col("url")).alias("p")).collect()}
    assert [[tuple(a) for a in got[i].anchors] for i in (1, 2, 3, 4)] == [[("https://x.example/a/c/d", "c")], [], [("http://[bad", "b")], [("https://x.example/a/e?q#f", "e")]]
    assert got[2].title == got[2].text == ""


def test_percent_signs_cost_one_pass(spark):
    d = spark.createDataFrame([("%" * 400_000 + "@",), ("%41" * 100_000 + "@x",), ("%%a@b.example %c@d.example",)], "t string")
    assert [list(r[0]) for r in d.select(prospects.addresses(F.col("t"))).collect()] == [[], [], ["%%a@b.example", "%c@d.example"]]
