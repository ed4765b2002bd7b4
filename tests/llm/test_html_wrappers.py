"""Pages whose wrapper has a name of boilerplate, and lists and short paragraphs of articles."""

import pytest
from test_html_text import PROSE, page

from postflow.llm.html_text import main_text

ARTICLE = f"<article><p>{PROSE}</p></article>"
DIV = f"<div><p>{PROSE}</p><p>{PROSE}</p></div>"
LINKS = "<ul><li><a href=1>First source</a></li><li><a href=2>Second source</a></li></ul>"


@pytest.mark.parametrize(
    "name", ["page has-sidebar", "layout-with-sidebar", "no-comments", "ad-free", "hasSidebar", "widget", "page sidebar social"]
)
def test_wrappers(name):
    assert main_text(page(f"<div class='{name}'>{ARTICLE}</div>")) == PROSE
    assert main_text(page(f"<div id='{name}'>{DIV}</div><p>a</p>")).startswith(f"{PROSE}\n{PROSE}")
    assert main_text(page(f"<div class=widget><div class='{name}'>{ARTICLE}</div></div>")) == PROSE


@pytest.mark.parametrize(
    "body",
    [
        f"<div class=widget><div class=sidebar><p>{PROSE}x</p></div>{ARTICLE}<div class=related><article>{PROSE}y</article></div></div>",
        f"<div class=related><article>t</article></div><div class=widget>{ARTICLE}</div>",
        f"<div class=sidebar><article>{PROSE} {PROSE}</article></div>{ARTICLE}",
        f"<div id=text><p>{PROSE}</p></div><div class=comments><article>{PROSE}</article><p>{PROSE * 9}</p></div>",
        f"<div class=page-widget><p>{PROSE}</p></div><div class=comments><p>{PROSE * 9}</p></div>",
        f"<article><div class=widget><p>{PROSE}</p></div><div class=share>x</div></article>",
    ],
)
def test_what_is_no_wrapper_is_dropped(body):
    assert main_text(page(body)) == PROSE


def test_link_lists_and_short_paragraphs_stay():
    sources = "First source\nSecond source"
    assert main_text(page(f"<article><p>{PROSE}</p>{LINKS}</article>")) == f"{PROSE}\n{sources}"
    assert main_text(page(f"<div><p>{PROSE}</p>{LINKS}</div>")) == f"{PROSE}\n{sources}"
    assert main_text(page(f"<div><div><p>{PROSE}</p><p>{PROSE}</p></div><p>short</p></div>")) == f"{PROSE}\n{PROSE}\nshort"
