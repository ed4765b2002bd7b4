"""Main text of web pages by scoring the element tree.

A page is read into a tree as forgivingly as browsers do it: missing end tags, stray end tags, raw text elements, a page
that ends within a tag. Parts that are no article by their kind or by their name (menus, headers, footers, sidebars,
notices, adverts, forms, reader comments) are left out. A name says nothing if it is negated or about the layout
("no-comments", "with-sidebar"), and a wrapper stays whatever its name: an element that has all of the page's articles in
it or, without an article elsewhere, most of the text that is not in links. Reader comments are no wrapper. A menu, header,
footer, sidebar or form is one only if little would be left without it: a form around the page, or a menu without its end.

Every block with text of its own is a paragraph. It has a point, one more for each comma and one more for every hundred
characters, three at most; its parent gets them all, the grandparent half, ancestors beyond that a share that shrinks with
the distance. What an element has got counts as far as its text is not in links. The best element is the container. Its
siblings are kept with it if they score a fifth of it, or if they are paragraphs of prose, short ones too. All lists in
a container are kept; only if the page as a whole is the container, lists of links are menus and left out.

Each page is one row, and its text one narrow pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from postflow.llm.common import bound_batches, text_of

# Kinds of elements in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes iframe noembed".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
#: Elements that never hold article text.
DROPPED = frozenset(
    "head script style noscript template title button input select textarea iframe object embed "
    "svg canvas audio video dialog menu noembed noframes map".split()
)
#: Elements that hold none either, if they are no wrapper.
KINDS = frozenset("nav header footer aside form".split())
#: What a head can hold; everything else ends it.
IN_HEAD = frozenset("base basefont bgsound link meta title style script noscript template noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
#: Elements that are menus if most of their text is in links and no container is around them.
LINK_LISTS = frozenset("ul ol dl div section table".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLE = frozenset(("article", "main"))
#: A start tag ends these open elements, up to the nearest of the second group.
ENDED_BY = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "tr": (frozenset(("tr", "td", "th")), frozenset(("table",))),
    "td": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "th": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "option": (frozenset(("option",)), frozenset(("select",))),
}
#: Words in a class or id that say that an element is no article.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adbox adslot banner breadcrumb breadcrumbs byline comment comments commentlist "
    "consent cookie cookies copyright disqus footer footnav gdpr login masthead menu menus modal nav navbar navigation "
    "newsletter notice notices notification overlay pager pagination paywall popup promo promos promotion promoted recommend "
    "recommended related reply replies respond rss share sharing shares sidebar sidenav signup skip social sponsor "
    "sponsored subscribe subscription tags teaser toolbar topbar widget widgets".split()
)
#: Those of reader comments.
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
#: Words before a name, in one class or id, and behind it, that say it is absent or a property of the layout.
BEFORE, BEHIND = frozenset("has have with no non not without hide".split()), frozenset(("free", "less"))
#: Elements deeper than this become siblings, as in browsers.
MAX_DEPTH = 512
# End of fixed values.

#: A menu, header, footer, sidebar or form is a wrapper if it has this many times the text that is left without it, and
#: an article or a paragraph of this many characters.
WRAPPED, PARAGRAPH = 3, 50

# A quote starts a value only behind "="; elsewhere it is a character like others.
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)(?:>|\Z)"
    r"|<[a-zA-Z/][^>]*+\Z",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>]++)(?:\s*+=\s*+(\"[^\"]*\"|'[^']*'|[^\s>]*+))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Element:
    __slots__ = ("tag", "children", "parent", "dropped", "names", "score", "length", "linked")

    def __init__(self, tag: str, parent: Element | None, dropped: bool = False, names: frozenset[str] = frozenset()):
        self.tag, self.parent, self.dropped, self.names = tag, parent, dropped, names
        self.children: list[Element | str] = []
        self.score = 0.0
        self.length = self.linked = 0

    def points(self) -> float:
        """The score, as far as the text isn't in links."""
        return self.score * (1 - self.linked / self.length) if self.length else 0.0


def _dropped(tag: str, attributes: str) -> bool:
    if tag in DROPPED:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    for match in _ATTRIBUTE.finditer(attributes):
        name, value = match[1].lower(), (match[2] or "").strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name == "role" and value.lower() in ROLES:
            return True
    return False


def _names(tag: str, attributes: str, stack: list[Element]) -> frozenset[str]:
    """What says that an element is no article: its kind, and words in its class and id."""
    found = set()
    # an article may have a header for its title
    if tag in KINDS and not (tag == "header" and any(e.tag in ARTICLE for e in stack)):
        found.add(tag)
    if attributes and tag not in ARTICLE:
        for match in _ATTRIBUTE.finditer(attributes):
            if match[1].lower() in ("class", "id"):
                for name in (match[2] or "").strip("\"'").split():
                    words = [w.lower() for w in _NAME.findall(name)]
                    found.update(
                        w for i, w in enumerate(words) if w in NAMES and BEFORE.isdisjoint(words[:i]) and BEHIND.isdisjoint(words[i + 1 : i + 2])
                    )
    return frozenset(found)


def _drop_named(root: Element) -> None:
    """Drops the elements that are no article by their name, but for wrappers."""
    order, links = [root], {}
    for element in order:  # parents before children
        links[id(element)] = element.tag == "a" or element.parent is not None and links[id(element.parent)]
        order += [c for c in element.children if isinstance(c, Element) and not c.dropped]
    if not any(e.names for e in order):
        return
    weight, plain, holds, prose = dict.fromkeys(map(id, order), 0), dict.fromkeys(map(id, order), 0), set(), set()
    for element in reversed(order):
        key = id(element)
        if not links[key]:
            own = sum(len(" ".join(c.split())) for c in element.children if isinstance(c, str))
            weight[key] += own
            plain[key] += own
        if element.tag in ARTICLE:
            holds.add(key)
        if element.tag == "p" and weight[key] >= PARAGRAPH:
            prose.add(key)
        if element.parent is not None and not element.names & COMMENTS:
            above = id(element.parent)
            weight[above] += weight[key]
            if not element.names:
                plain[above] += plain[key]
            holds.update({above} if key in holds else ())
            prose.update({above} if key in prose else ())
    # the text that stays if no other named element does
    left = plain[id(root)]
    article, reached = False, [(root, False)]
    while reached:
        named: list[tuple[Element, bool]] = []
        for element, inside in reached:
            inside = inside or element.tag in ARTICLE
            article = article or inside
            for child in element.children:
                if isinstance(child, Element) and not child.dropped:
                    (named if child.names else reached).append((child, inside))
        reached = []
        for element, inside in sorted(named, key=lambda e: -weight[id(e[0])]):
            key = id(element)
            most = 2 * weight[key] > weight[id(root)] and (inside or not article)
            all_articles = key in holds and not article
            wraps = most or all_articles
            if element.tag in KINDS:
                wraps = wraps and WRAPPED * left < weight[key] and (key in holds or key in prose)
            if wraps and not element.names & COMMENTS:
                reached.append((element, inside))
                left += plain[key]
            else:
                element.dropped = True


def parse(html: str) -> Element:
    """The tree of a page."""
    root = Element("html", None)
    stack, at, end, headed = [root], 0, len(html), False

    def close_to(k: int) -> None:
        del stack[k:]

    while at < end:
        match = _TAG.search(html, at)
        text = html[at : match.start() if match else end]
        if text:
            if stack[-1].tag == "head" and not text.isspace():
                close_to(1)
            stack[-1].children.append(unescape(text))
        if match is None:
            break
        at = match.end()
        if match[2] is None:
            continue
        tag = match[2].lower()
        if match[1]:
            if tag == "br":
                stack[-1].children.append(Element("br", stack[-1]))
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close_to(k)
                    break
                # an inline end tag doesn't end the block it stands in
                if tag in INLINE and stack[k].tag not in INLINE:
                    break
            continue
        if tag in ("html", "body", "head"):
            if len(stack) > 1 and stack[1].tag == "head":
                close_to(1)
            if tag != "head" or headed or len(stack) > 1:
                continue
            headed = True
        elif stack[-1].tag == "head" and tag not in IN_HEAD:
            close_to(1)
        if tag not in INLINE:  # a block ends an open paragraph and what is open in it
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close_to(k)
                    break
                if stack[k].tag not in INLINE:
                    break
        if tag in ENDED_BY:
            ended, scope = ENDED_BY[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ended:
                    close_to(k)
                elif stack[k].tag in scope:
                    break
        close_to(MAX_DEPTH)
        element = Element(tag, stack[-1], _dropped(tag, match[3]), _names(tag, match[3], stack))
        stack[-1].children.append(element)
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(html, at)
            at = close.end() if close else end
        elif tag not in VOID and not (match[3].endswith("/") and (element.dropped or element.names)):
            stack.append(element)
    _drop_named(root)
    return root


def _score(root: Element) -> list[Element]:
    """Scores the tree; all elements that got points."""
    scored: dict[int, Element] = {}
    order: list[tuple[Element, bool]] = []
    todo = [(root, False)]
    while todo:  # parents before children
        element, linked = todo.pop()
        order.append((element, linked))
        todo += [(c, linked or c.tag == "a") for c in element.children if isinstance(c, Element) and not c.dropped]
    own: dict[int, list] = {}
    for element, linked in reversed(order):
        texts = [" ".join(c.split()) for c in element.children if isinstance(c, str)]
        length, commas = sum(map(len, texts)), sum(t.count(",") + t.count("，") + t.count("、") for t in texts)
        element.length += length
        element.linked += length if linked else 0
        if element.parent is not None:
            element.parent.length += element.length
            element.parent.linked += element.linked
        inside = own.pop(id(element), [0, 0])
        length, commas = length + inside[0], commas + inside[1]
        if element.tag in INLINE and element.parent is not None:  # its text belongs to the block around it
            block = own.setdefault(id(element.parent), [0, 0])
            block[0] += length
            block[1] += commas
        elif length and element.tag not in HEADINGS:
            points = (1 + commas + min(length // 100, 3)) * (1 - element.linked / element.length)
            share, ancestor = 1.0, element.parent if element.tag in ("p", "pre", "blockquote", "li", "td", "dd") else element
            depth = 0
            while ancestor is not None:
                ancestor.score += points * share
                scored[id(ancestor)] = ancestor
                depth += 1
                share, ancestor = 1 / (2 * depth), ancestor.parent
    return list(scored.values())


def _kept(root: Element) -> list[Element]:
    """The container and the siblings that are kept with it, in page order."""
    scored = _score(root)
    if not scored:
        return []
    best = max(scored, key=Element.points)
    # parts of one article lie side by side in it
    inside = [a for a in _ancestors(best) if a.tag in ARTICLE]
    if inside:
        best = inside[-1] if inside[-1].tag == "article" else next((a for a in inside if a.tag == "article"), inside[0])
    if best.parent is None or best.tag in ARTICLE and not _similar(best, scored):
        return [best]
    least = best.points() / 5
    kept = []
    for sibling in best.parent.children:
        if isinstance(sibling, str) or sibling.dropped:
            continue
        prose = sibling.tag == "p" and sibling.linked < sibling.length / 4
        if sibling is best or prose or (sibling.tag not in INLINE and sibling.points() >= max(least, 1)) or sibling.tag in HEADINGS:
            kept.append(sibling)
    return kept


def _ancestors(element: Element) -> Iterator[Element]:
    while element is not None:
        yield element
        element = element.parent


def _similar(best: Element, scored: list[Element]) -> bool:
    return any(e is not best and e.parent is best.parent and e.points() >= best.points() / 5 for e in scored)


def _blocks(elements: list[Element]) -> list[str]:
    """The text of each block, in page order."""
    whole = any(e.parent is None for e in elements)
    blocks: list[list[str]] = [[]]
    todo: list[Element | str | None] = list(reversed(elements))
    while todo:
        item = todo.pop()
        if item is None:
            blocks.append([])
        elif isinstance(item, str):
            blocks[-1].append(item)
        elif item.tag in ("br", "hr") or item.tag in VOID:
            blocks[-1].append(" ") if item.tag != "hr" else blocks.append([])
        elif not item.dropped and not (whole and item.tag in LINK_LISTS and item.linked > 0.6 * item.length):
            edge = [] if item.tag in INLINE else [None]
            todo += [*edge, *reversed(item.children), *edge]
    texts = (" ".join("".join(parts).split()) for parts in blocks)
    return [text for text in texts if text]


def main_text(html: str) -> str:
    """The main text of a page, a line for each block; empty if there is none."""
    return "\n".join(_blocks(_kept(parse(html))))


@F.pandas_udf(StringType())
def _main_texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for pages in batches:
        yield pages.map(main_text)


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (its code points) in place of ``html``.

    **Defined cases.** Null or empty html, and pages without an article, give an empty text. Rows are read one by one,
    so repeated rows and ids stay. Other columns are kept; ones named ``text`` or ``n_chars`` are replaced. An empty
    table gives an empty table. Pages are read whole, whatever their length.
    """
    bound_batches(pages.sparkSession)
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in ("html", "text", "n_chars")]
    texts = pages.select(*kept, _main_texts(text_of("html")).alias("text"))
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))
