import re
from html import unescape

import pytest

from postflow.llm import html_text, queries
from postflow.llm.common import read
from postflow.llm.html_text import main_text

PROSE = "A sentence of some length, with commas, and with enough words to count as prose in an article."


def page(body):
    return f"<html><head><title>t</title></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    "body, expected",
    [
        ("", ""),
        ("<article></article>", ""),
        ("just text, no elements", "just text, no elements"),
        (f"<article><h1>T</h1><p>{PROSE}<p>{PROSE}</article>", f"T\n{PROSE}\n{PROSE}"),
        (f"<article><h1>T</h1><p><b>{PROSE}<br><p>short</article>", f"T\n{PROSE}\nshort"),
        (f"<nav><a href=x>{PROSE}</a></nav><div><p>{PROSE}</p><p>b</p></div><footer>{PROSE}</footer>", f"{PROSE}\nb"),
        (f"<div class='ad'>{PROSE} {PROSE}</div><article><p>x &amp; y&nbsp;z &#233;</p></article>", "x & y z é"),
        (f"<main><section><h2>A</h2><p>{PROSE}</p></section><section><h2>B</h2><p>b, c</p></section></main>", f"A\n{PROSE}\nB\nb, c"),
        (f"<div id=content><p>{PROSE}</p></div><div class='sidebar'><p>{PROSE}</p></div><section id='comments'><p>{PROSE}</p></section>", PROSE),
        (f"<header><h1>Site</h1></header><article><header><h1>T</h1></header><p>{PROSE}</p></article>", f"T\n{PROSE}"),
        (f"<div class=cookie-notice><p>{PROSE}</p></div><div><p>{PROSE}</p><form><p>{PROSE}</p></form></div>", PROSE),
        (f"<script>var t='</p>';</script><article><p>a\n  b\t c</p><script>x</script><style>p{{}}</style></article>", "a b c"),
        (f"<ul><li><a href=1>{PROSE}</a><li><a href=2>{PROSE}</a></ul><p>{PROSE}</p>", PROSE),
        ("<article><ul><li>one<li>two</ul><p>three<br>four</p></article>", "one\ntwo\nthree four"),
        ("<article><p>a <!-- no --> b<p>c <b>d</b>e</article", "a b\nc de"),
    ],
)
def test_pages(body, expected):
    assert main_text(page(body)) == expected


@pytest.mark.parametrize("html", ["<", "<<p>", "</", "<p", "<p class='x", "<!--", "a < b", "<script>", "<p></b></p></div>", "\x00", "<a" * 2000])
def test_broken_pages_are_read(html):
    assert isinstance(main_text(html), str)


def test_deep_and_long_pages():
    assert main_text("<div>" * 5000 + PROSE) == PROSE
    assert len(main_text("<article>" + f"<p>{PROSE}</p>" * 20000)) == 20000 * (len(PROSE) + 1) - 1


def test_the_table_against_its_articles(spark):
    """In the given pages the article is an element; a plain pattern finds its blocks."""
    rows = queries.op8_html_text(spark, "/root/testdata/sf0.01").collect()
    pages = {r.page_id: r.html for r in read(spark, "/root/testdata/sf0.01", "pages").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)(</article>|\Z)", pages[r.page_id], re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", re.sub("<br>", " ", b))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)


def test_edge_rows(spark):
    pages = spark.createDataFrame([(1, None, "old"), (1, None, "old"), (None, "", None)], "page_id BIGINT, html STRING, text STRING")
    assert [(r.text, r.n_chars) for r in html_text.extract(pages).collect()] == [("", 0)] * 3
    assert html_text.extract(pages.where("false")).collect() == []
