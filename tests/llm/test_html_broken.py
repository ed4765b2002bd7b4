"""Pages with tags left out, odd attributes, forms around everything and very deep trees."""

import time

import pytest
from test_html_text import PROSE, page

from postflow.llm.html_text import main_text

ARTICLE = f"<article><p>{PROSE}</p></article>"
DIV = f"<div><p>{PROSE}</p><p>{PROSE}</p></div>"
MENU = "<ul><li><a href=1>Home</a></li><li><a href=2>News</a></li></ul>"


@pytest.mark.parametrize(
    "html",
    [
        f"<html><head><title>t</title><body>{ARTICLE}</body></html>",
        f"<head><meta charset=utf-8><style>p{{}}</style>{ARTICLE}",
        f"<head><title>t</title><noscript><link href=a></noscript><h1></h1>{ARTICLE}",
        f"<title>t</title>{ARTICLE}<head><p>x</p>",
    ],
)
def test_a_head_needs_no_end_tag(html):
    assert main_text(html).split("\n")[0] == PROSE


@pytest.mark.parametrize(
    "tag",
    ["<p data-t=it's>", "<p title='a > b' data-t=\"it's\">", "<p a=\"b>c\" 'd>", "<p data-id=comments>", "<p title='x id=comments'>", "<p data-class = 'sidebar'>"],
)
def test_attributes(tag):
    assert main_text(page(f"<article>{tag}{PROSE}</p><p>{PROSE}</p></article>")) == f"{PROSE}\n{PROSE}"


@pytest.mark.parametrize("tag", ["nav", "header", "form", "aside", "footer"])
def test_unclosed_and_surrounding(tag):
    assert main_text(page(f"<{tag}>{MENU}{ARTICLE}")) == PROSE
    assert main_text(page(f"<h1>Site</h1><{tag}>{MENU}{DIV}")) == f"{PROSE}\n{PROSE}"
    assert main_text(page(f"<{tag}><nav>{MENU}</nav><aside><p>{PROSE[:60]}</p></aside>{DIV}<footer>end</footer></{tag}>")) == f"{PROSE}\n{PROSE}"


@pytest.mark.parametrize("tag", ["nav", "header", "form", "aside", "footer"])
def test_dropped_beside_an_article(tag):
    assert main_text(page(f"<{tag}><p>{PROSE} {PROSE}</p></{tag}>{ARTICLE}")) == PROSE
    assert main_text(page(f"{DIV}<{tag}><article><p>teaser</p></article></{tag}>")) == f"{PROSE}\n{PROSE}"
    assert main_text(page(f"{DIV}<{tag}><p>{PROSE} {PROSE} {PROSE}</p></{tag}>")) == f"{PROSE}\n{PROSE}"
    assert main_text(page(f"<{tag}><label>Name</label><p>short</p></{tag}>")) == ""


def test_deep_trees_take_linear_time():
    started = time.monotonic()
    assert main_text("<div>" * 20_000 + f"<p>{PROSE}</p>" + "</x></div>" * 20_000) == PROSE
    assert main_text("<li><ul>" + "<div>" * 20_000 + "<li>a</li>" * 5_000).count("a") == 5_000
    assert main_text("<a b=\"" * 20_000) == ""
    assert time.monotonic() - started < 20
