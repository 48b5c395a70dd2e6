"""Main text of web pages: flat blocks and a decision tree.

A page is cut into blocks of text at its block-level tags. Structure does two things only. It bounds the blocks, and it leaves out what
is no article by its own tag or name: navigation, page headers, footers, asides, forms and controls, adverts, consent,
subscription and sharing boxes, and reader comments. A decision tree (Gini, grown here) decides on all other blocks by their shallow features: words,
link density (share of words in links), both of the block before and of the block after, whether the block is a heading, stands in an
article, in an element with a name that may be furniture's (notice, sidebar, related ...), or is worded like a copyright line or consent
notice, or has no letter or digit. It learns from a small labelled table of blocks in page order, of pages of several kinds. The kept blocks' texts, white
space collapsed, are joined by newlines.

A name counts as a whole: 'sidebar' or 'site-nav', not 'content-sidebar-wrap'. An article or main element is free of what lies
around it, and an element outside of articles that holds one is no furniture; nor is a form that holds parts of a page or long text.
Comments stay comments, also where they are articles by themselves. Long text with few links outweighs a name of the weaker kind.

Nulls: a null or empty page has an empty text. Text is never cut: pages are judged one at a time, so memory follows the
longest. Scripts, styles, titles, templates, drawings, fallback content and hidden elements give no blocks; formulas are text. An element
like these without an end tag ahead hides nothing. Repeated rows get equal texts; an empty table gives no
rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.dom.tokenizer import END, START, TEXT, attributes, tokens

from .common import bounded_batches

INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtext "
    "munder munderover semantics annotation annotation-xml".split()
)
#: Inline, with a space before.
SPACED = frozenset({"br", "mtr", "mtd", "annotation", "annotation-xml"})
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style title template noscript iframe svg canvas object audio video datalist noframes noembed".split())
#: These end an svg that isn't closed, except in its HTML parts.
BREAKS = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 hr i img li listing menu nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
SVG_HTML = frozenset({"foreignobject", "desc", "title"})

FURNITURE = frozenset("nav aside footer form menu dialog button select textarea option".split())
#: Furniture in a form; elsewhere their text is text.
FORM_PARTS = frozenset({"fieldset", "label"})
COMMENTS = frozenset("comment comments reply replies respond disqus reviews kommentar kommentare commentaire commentaires comentario comentarios".split())
#: Names of what is never article text.
FIRM = COMMENTS | frozenset(
    "ad ads advert advertisement adverts sponsor sponsored anzeige werbung publicite publicidad cookie cookies consent gdpr newsletter subscribe subscription signup login "
    "share sharing menu nav navigation navbar breadcrumb breadcrumbs pagination pager contentinfo sidebar complementary widget toolbar promo promotion popup modal overlay "
    "related recommended recommendations".split()
)
#: Names that long text with few links outweighs.
HINTS = FIRM | frozenset(
    "banner notice notices alert social discussion search dialog hidden".split()
)
#: Often in names of what is around a whole page; with an h1 in it, an element of such a name isn't furniture.
WRAPS = frozenset("sidebar widget popup modal overlay".split())
#: These name page furniture outside an article only.
OUTER_HINTS = frozenset({"header", "footer", "masthead"})
#: May stand beside a hint in a name of several words; any other word makes it a name of something else.
BESIDE = frozenset(
    "site main global top bottom left right primary secondary reader user facebook social post posts articles block box bar area list links link button buttons "
    "item items section container wrapper inner form body icons panel title side sticky footer header thread count meta".split()
)
#: Ids of sections, and all in an article, are often made from a heading; only these don't name a subject.
PLAIN_IDS = COMMENTS - {"comment", "reply"} | frozenset("ad ads adverts newsletter subscribe share sharing sidebar nav navbar breadcrumb breadcrumbs widget toolbar pagination pager modal popup".split())
HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})
ARTICLE = frozenset({"article", "main"})
#: A form with one of these is the page's.
PAGE_PARTS = ARTICLE | {"nav", "header", "footer", "aside", "h1"}
#: Words and link density of text that makes a form the page's.
LONG_WORDS, FEW_LINKS = 80, 0.25
CLOSERS = {"li": "li", "p": "p", "dt": "dt", "dd": "dd", "td": "td", "th": "td", "tr": "tr", "option": "option"}

#: Of a block by itself; the first two also of its neighbours.
OWN = ("words", "link_density", "heading", "article", "hinted", "legal")
FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "heading", "in_article", "hinted", "legal")

_SPACE = re.compile(r"\s+")
_TOKEN = re.compile(r"[a-z]+")
_LEGAL = re.compile(
    r"^[\W_]*$|^\W*(?:©|\(c\)|copyright\b)|all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados|"
    r"\b(?:we|site|website) uses? cookies\b|\bverwende[nt] (?:wir )?cookies\b|\b(?:utilise|utilisons|utiliza|utilizamos) (?:des )?cookies\b",
    re.I,
)


class Mark:
    """What an element says of the blocks in it, until something in it speaks against that."""

    __slots__ = ("name", "inner", "furniture", "hinted", "comments", "wraps")

    def __init__(self, name: str, inner: bool, furniture: bool, hinted: bool, comments: bool = False, wraps: bool = False):
        self.name, self.inner, self.furniture, self.hinted, self.comments, self.wraps = name, inner, furniture, hinted, comments, wraps

    def release(self) -> None:
        self.furniture = self.hinted = False


class Block:
    __slots__ = ("text", "words", "linked", "heading", "article", "marks", "legal")

    def __init__(self, text: str, linked: int, heading: bool, article: bool, marks: tuple[Mark, ...]):
        self.text, self.words, self.linked = text, text.count(" ") + 1, linked
        self.heading, self.article, self.marks = heading, article, marks
        self.legal = not article and bool(_LEGAL.search(text))

    @property
    def furniture(self) -> bool:
        return any(m.furniture for m in self.marks)

    @property
    def own(self) -> tuple[float, ...]:
        """The features `OWN`."""
        return self.words, min(1.0, self.linked / self.words), self.heading, self.article, any(m.hinted for m in self.marks), self.legal


def _hidden(own: dict[str, str]) -> bool:
    return "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in own.get("style", "").replace(" ", "").lower()


def _named(token: str, hints: frozenset[str]) -> bool:
    """Whether a class, id or role is one of the hints, or a compound of hints and words beside them."""
    if token.lower() in hints:
        return True
    # separators divide a name into words, and capitals may
    words = _TOKEN.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", token).lower())
    return not hints.isdisjoint(words) and all(w in hints or w in BESIDE for w in words)


def _hits(name: str, own: dict[str, str], inner: bool, hints: frozenset[str]) -> bool:
    """Whether classes, roles or the id of an element name one of the hints."""
    outer = hints if inner else hints | OUTER_HINTS
    if any(_named(token, outer) for key in ("class", "role") for token in own.get(key, "").split()):
        return True
    if name in HEADINGS or not (token := own.get("id", "").strip()):
        return False
    return _named(token, hints & PLAIN_IDS if inner or name == "section" else outer)


def blocks(html: str) -> list[Block]:
    """The page's blocks in order."""
    out: list[Block] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool, tuple[Mark, ...]]] = []  # open block-level elements: name, article, hidden, marks
    silent = links = linked = 0
    article = hidden = False
    marks: tuple[Mark, ...] = ()

    def flush() -> None:
        nonlocal linked
        if parts:
            if not hidden and (text := _SPACE.sub(" ", "".join(parts)).strip()):
                out.append(b := Block(text, linked, bool(stack) and stack[-1][0] in HEADINGS, article, marks))
                if marks and b.words >= LONG_WORDS and linked <= FEW_LINKS * b.words:
                    release(("form",))
            parts.clear()
        linked = 0

    def state() -> None:
        nonlocal article, hidden, marks
        _, article, hidden, marks = stack[-1] if stack else ("", False, False, ())

    def release(names: tuple[str, ...] = ()) -> None:
        for m in marks:
            if m.name in names or not names and not m.inner and not m.comments:
                m.release()

    silenced, parted = "", 0
    page = [*tokens(html, foreign=True)]
    last = {name: i for i, (kind, name, _) in enumerate(page) if kind == END and name in SILENT}
    for i, (kind, name, raw) in enumerate(page):
        if silent:
            if silenced == "svg" and kind != TEXT and name in SVG_HTML and not raw.endswith("/"):
                parted = max(0, parted + (1 if kind == START else -1))
            if silenced == "svg" and kind == START and name in BREAKS and not parted:
                silent = 0
            else:
                if name == silenced and kind == END:
                    silent = silent - 1 if i < last[name] else 0
                elif name == silenced and kind == START and not (name == "svg" and raw.endswith("/")):
                    silent += 1
                continue
        if kind == TEXT:
            parts.append(name)
            if links:
                linked += len(name.split())
        elif kind == START:
            if name in SILENT:
                if last.get(name, -1) > i and not (name == "svg" and raw.endswith("/")):
                    silent, silenced, parted = 1, name, 0
            elif name in SPACED:
                parts.append(" ")
            elif name == "a":
                links = len(stack) + 1
            elif name not in INLINE:
                flush()
                if name in VOID:
                    continue
                if (closer := CLOSERS.get(name)) and stack and stack[-1][0] in (name, closer):
                    stack.pop()
                    state()
                    if links > len(stack) + 1:
                        links = 0
                if name in PAGE_PARTS and marks:
                    release(("form",))
                    for m in marks:
                        if name == "h1" and m.wraps and not m.inner:
                            m.release()
                own = attributes(raw)
                if name in ARTICLE:
                    if any(m.comments for m in marks) or any(_named(token, COMMENTS) for token in own.get("class", "").split()):
                        stack.append((name, True, hidden, (*marks, Mark(name, True, True, True, True))))
                    else:
                        release()
                        stack.append((name, True, False, ()))
                elif name in ("html", "body"):
                    stack.append((name, article, hidden, marks))
                else:
                    hinted = bool(own) and _hits(name, own, article, HINTS)
                    firm = hinted and _hits(name, own, article, FIRM)
                    apart = name in FURNITURE or name == "header" and not article or name in FORM_PARTS and any(x[0] == "form" for x in stack)
                    mark = Mark(name, article, apart or firm, hinted, firm and _hits(name, own, article, COMMENTS), firm and not apart and _hits(name, own, article, WRAPS))
                    stack.append((name, article, hidden or bool(own) and _hidden(own), (*marks, mark) if mark.furniture or mark.hinted else marks))
                state()
        elif kind == END:
            if name == "a":
                links = 0
            elif name not in INLINE and name not in VOID and name not in SILENT and name not in SPACED:
                flush()
                for j in range(len(stack) - 1, -1, -1):
                    if stack[j][0] == name:
                        del stack[j:]
                        state()
                        if links > j + 1:  # opened in what ends here
                            links = 0
                        break
                    if stack[j][0] in ARTICLE | FURNITURE and name not in ARTICLE | FURNITURE | {"body", "html", "div", "section"}:
                        break
    flush()
    return out


def features(own: np.ndarray) -> np.ndarray:
    """Rows of `FEATURES` for the rows of `OWN` of one page's blocks."""
    before, after = np.zeros((len(own), 2)), np.zeros((len(own), 2))
    before[1:], after[:-1] = own[:-1, :2], own[1:, :2]
    return np.concatenate([own[:, :2], before, after, own[:, 2:]], 1)


#: The labelled table: the blocks of a page in order, each with its `OWN` features and 1 for main text.
LABELLED = [
    # a news page without an article element: logo, menu, headline, byline, text, a list of other stories, copyright line
    [
        (2, 0.0, 0, 0, 0, 0, 0), (1, 1.0, 0, 0, 0, 0, 0), (1, 1.0, 0, 0, 0, 0, 0), (2, 1.0, 0, 0, 0, 0, 0), (1, 1.0, 0, 0, 0, 0, 0), (7, 0.0, 1, 0, 0, 0, 1), (5, 0.2, 0, 0, 0, 0, 1), (45, 0.0, 0, 0, 0, 0, 1),
        (60, 0.05, 0, 0, 0, 0, 1), (12, 0.0, 0, 0, 0, 0, 1), (90, 0.1, 0, 0, 0, 0, 1), (18, 0.0, 0, 0, 0, 0, 1), (3, 0.0, 1, 0, 0, 0, 0), (6, 1.0, 0, 0, 0, 0, 0), (8, 1.0, 0, 0, 0, 0, 0), (5, 1.0, 0, 0, 0, 0, 0), (14, 0.0, 0, 0, 0, 1, 0),
    ],
    # a blog in plain blocks, with a menu below
    [
        (3, 0.0, 1, 0, 0, 0, 1), (2, 0.0, 1, 0, 0, 0, 1), (2, 0.0, 0, 0, 0, 0, 1), (30, 0.0, 0, 0, 0, 0, 1), (1, 0.0, 0, 0, 0, 0, 1), (2, 0.0, 1, 0, 0, 0, 1), (3, 0.0, 0, 0, 0, 0, 1), (4, 1.0, 0, 0, 0, 0, 1), (25, 0.2, 0, 0, 0, 0, 1),
        (8, 0.6, 0, 0, 0, 0, 1), (40, 0.0, 0, 0, 0, 0, 1), (1, 1.0, 0, 0, 0, 0, 0), (2, 1.0, 0, 0, 0, 0, 0), (1, 1.0, 0, 0, 0, 0, 0), (2, 0.0, 0, 0, 0, 0, 0), (1, 1.0, 0, 0, 0, 0, 0), (30, 0.1, 0, 0, 0, 1, 0),
    ],
    # an article between a menu and an advert, with short paragraphs, link lines of its own and a list of nothing but links
    [
        (1, 1.0, 0, 0, 0, 0, 0), (1, 1.0, 0, 0, 0, 0, 0), (6, 0.0, 0, 0, 1, 0, 0), (5, 1.0, 1, 1, 0, 0, 1), (1, 0.0, 0, 1, 0, 0, 1), (1, 0.0, 0, 1, 0, 0, 1), (120, 0.0, 0, 1, 0, 0, 1), (6, 1.0, 0, 1, 0, 0, 1), (3, 0.0, 1, 1, 0, 0, 1),
        (40, 0.3, 0, 1, 0, 0, 1), (2, 1.0, 0, 1, 0, 0, 1), (12, 0.6, 0, 1, 0, 0, 1), (2, 0.0, 1, 1, 0, 0, 1), (25, 0.8, 0, 1, 0, 0, 1), (9, 0.0, 0, 1, 0, 0, 1), (3, 1.0, 0, 1, 0, 0, 0), (2, 1.0, 0, 1, 0, 0, 0), (1, 1.0, 0, 1, 0, 0, 0), (4, 1.0, 0, 1, 0, 0, 0),
        (2, 1.0, 0, 1, 0, 0, 0), (3, 1.0, 0, 1, 0, 0, 0), (2, 0.0, 0, 1, 0, 0, 1),
    ],
    [
        (2, 1.0, 0, 0, 0, 0, 0), (8, 1.0, 1, 1, 0, 0, 1), (9, 1.0, 0, 1, 0, 0, 1), (30, 0.1, 0, 1, 0, 0, 1), (1, 1.0, 0, 1, 0, 0, 1), (55, 0.0, 0, 1, 0, 0, 1), (30, 0.9, 0, 1, 0, 0, 1), (20, 0.4, 0, 1, 0, 0, 1), (3, 0.7, 0, 1, 0, 0, 1),
        (70, 0.2, 0, 1, 0, 0, 1), (8, 1.0, 0, 1, 0, 0, 0), (7, 1.0, 0, 1, 0, 0, 0), (9, 1.0, 0, 1, 0, 0, 0), (4, 0.0, 1, 1, 0, 0, 1), (4, 0.9, 0, 1, 0, 0, 1), (15, 0.0, 0, 1, 0, 0, 1), (1, 1.0, 0, 0, 0, 0, 0), (2, 1.0, 0, 0, 0, 0, 0),
    ],
    # articles of few words between menus
    [(1, 1.0, 0, 0, 0, 0, 0), (2, 1.0, 0, 0, 0, 0, 0), (1, 0.0, 0, 1, 0, 0, 1), (1, 1.0, 0, 0, 0, 0, 0), (3, 0.0, 0, 0, 0, 0, 0), (2, 1.0, 0, 0, 0, 0, 0)],
    [(1, 1.0, 0, 0, 0, 0, 0), (2, 1.0, 1, 1, 0, 0, 1), (6, 0.0, 1, 1, 0, 0, 1), (9, 0.0, 0, 1, 0, 0, 1), (1, 1.0, 0, 0, 0, 0, 0)],
    # a start page: links with headings and counts between them
    [
        (2, 0.0, 0, 0, 0, 0, 0), (1, 1.0, 0, 0, 0, 0, 0), (2, 1.0, 0, 0, 0, 0, 0), (2, 0.0, 1, 0, 0, 0, 0), (25, 0.9, 0, 0, 0, 0, 0), (20, 0.9, 0, 0, 0, 0, 0), (3, 0.0, 0, 0, 0, 0, 0), (30, 0.7, 0, 0, 0, 0, 0), (5, 1.0, 0, 0, 0, 0, 0),
        (4, 0.5, 0, 0, 0, 0, 0), (6, 1.0, 0, 0, 0, 0, 0), (120, 1.0, 0, 0, 0, 0, 0), (3, 0.8, 0, 0, 0, 0, 0), (2, 1.0, 0, 0, 0, 0, 0),
    ],
    # documentation: boxes whose names may be furniture's, long texts among them
    [
        (1, 1.0, 0, 0, 0, 0, 0), (2, 1.0, 0, 0, 0, 0, 0), (4, 0.0, 1, 0, 0, 0, 1), (70, 0.0, 0, 0, 0, 0, 1), (9, 0.0, 0, 0, 1, 0, 0), (55, 0.0, 0, 0, 1, 0, 0), (110, 0.05, 0, 0, 1, 0, 1), (90, 0.0, 0, 0, 1, 0, 1), (30, 0.0, 0, 0, 0, 0, 1),
        (70, 0.0, 0, 0, 1, 0, 0), (120, 0.4, 0, 0, 1, 0, 0), (3, 1.0, 0, 0, 1, 0, 0), (22, 0.0, 0, 0, 0, 0, 1), (140, 0.02, 0, 0, 1, 0, 1),
    ],
    [
        (6, 0.0, 1, 1, 0, 0, 1), (80, 0.0, 0, 1, 0, 0, 1), (4, 0.0, 1, 1, 1, 0, 0), (20, 0.5, 0, 1, 1, 0, 0), (40, 0.0, 0, 1, 1, 0, 0), (95, 0.0, 0, 1, 1, 0, 1), (130, 0.1, 0, 1, 1, 0, 1), (100, 0.9, 0, 1, 1, 0, 0), (15, 0.0, 0, 1, 0, 0, 1),
        (60, 0.0, 0, 1, 1, 0, 0), (3, 0.0, 0, 1, 1, 0, 0),
    ],
    # an essay in plain blocks, with link lines in it
    [
        (1, 1.0, 0, 0, 0, 0, 0), (3, 1.0, 0, 0, 0, 0, 0), (8, 0.0, 1, 0, 0, 0, 1), (40, 0.0, 0, 0, 0, 0, 1), (5, 1.0, 0, 0, 0, 0, 1), (35, 0.0, 0, 0, 0, 0, 1), (3, 1.0, 0, 0, 0, 0, 1), (60, 0.0, 0, 0, 0, 0, 1), (2, 0.0, 1, 0, 0, 0, 1),
        (9, 1.0, 0, 0, 0, 0, 1), (50, 0.1, 0, 0, 0, 0, 1), (4, 0.0, 1, 0, 0, 0, 0), (7, 1.0, 0, 0, 0, 0, 0), (6, 1.0, 0, 0, 0, 0, 0), (2, 0.0, 0, 0, 0, 0, 0), (1, 1.0, 0, 0, 0, 0, 0),
    ],
    # articles with single link lines, linked headings, and runs of links
    [
        (3, 0.0, 0, 1, 0, 0, 1), (2, 1.0, 0, 1, 0, 0, 1), (5, 0.0, 0, 1, 0, 0, 1), (9, 1.0, 0, 1, 0, 0, 1), (90, 0.0, 0, 1, 0, 0, 1), (3, 1.0, 0, 1, 0, 0, 1), (4, 0.0, 0, 1, 0, 0, 1), (12, 1.0, 0, 1, 0, 0, 1), (120, 0.0, 0, 1, 0, 0, 1), (1, 1.0, 0, 1, 0, 0, 1),
        (15, 0.0, 0, 1, 0, 0, 1), (30, 1.0, 0, 1, 0, 0, 1), (8, 0.0, 0, 1, 0, 0, 1), (1, 1.0, 0, 1, 0, 0, 1), (1, 0.0, 0, 1, 0, 0, 1), (40, 1.0, 0, 1, 0, 0, 1), (2, 0.0, 0, 1, 0, 0, 1), (6, 1.0, 0, 1, 0, 0, 1), (60, 0.2, 0, 1, 0, 0, 1), (2, 0.9, 0, 1, 0, 0, 1),
        (25, 0.4, 0, 1, 0, 0, 1),
    ],
    [
        (110, 0.0, 0, 1, 0, 0, 1), (4, 1.0, 0, 1, 0, 0, 0), (6, 1.0, 0, 1, 0, 0, 0), (2, 1.0, 0, 1, 0, 0, 0), (95, 0.0, 0, 1, 0, 0, 1), (12, 1.0, 0, 1, 0, 0, 0), (30, 1.0, 0, 1, 0, 0, 0), (9, 1.0, 0, 1, 0, 0, 0), (3, 0.0, 0, 1, 0, 0, 1), (1, 1.0, 0, 1, 0, 0, 0),
        (1, 1.0, 0, 1, 0, 0, 0), (7, 0.0, 1, 1, 0, 0, 1), (15, 1.0, 0, 1, 0, 0, 0), (22, 1.0, 0, 1, 0, 0, 0), (18, 1.0, 0, 1, 0, 0, 0), (16, 0.1, 0, 1, 0, 0, 1), (60, 1.0, 0, 1, 0, 0, 0), (50, 1.0, 0, 1, 0, 0, 0), (28, 0.0, 0, 1, 0, 0, 1),
    ],
    [
        (3, 1.0, 0, 0, 0, 0, 0), (2, 1.0, 0, 0, 0, 0, 0), (5, 1.0, 1, 1, 0, 0, 1), (6, 0.0, 0, 1, 0, 0, 1), (4, 1.0, 1, 1, 0, 0, 1), (70, 0.0, 0, 1, 0, 0, 1), (2, 1.0, 1, 1, 0, 0, 1), (3, 1.0, 1, 1, 0, 0, 1), (20, 0.0, 0, 1, 0, 0, 1), (8, 1.0, 1, 1, 0, 0, 1),
        (1, 1.0, 0, 0, 0, 0, 0), (4, 1.0, 0, 0, 0, 0, 0),
    ],
    # long lists of links under names that may be furniture's
    [(90, 0.0, 0, 0, 1, 0, 1), (100, 1.0, 0, 0, 1, 0, 0), (110, 0.95, 0, 0, 1, 0, 0), (85, 0.1, 0, 0, 1, 0, 1), (4, 1.0, 0, 0, 1, 0, 0), (30, 1.0, 0, 0, 1, 0, 0), (90, 0.0, 0, 1, 1, 0, 1), (100, 1.0, 0, 1, 1, 0, 0), (110, 0.95, 0, 1, 1, 0, 0), (85, 0.1, 0, 1, 1, 0, 1), (4, 1.0, 0, 1, 1, 0, 0), (30, 1.0, 0, 1, 1, 0, 0)],
    # nothing but links
    [(30, 1.0, 0, 0, 0, 0, 0), (28, 1.0, 0, 0, 0, 0, 0), (100, 1.0, 0, 0, 0, 0, 0), (2, 1.0, 0, 0, 0, 0, 0), (40, 1.0, 0, 0, 0, 0, 0), (4, 1.0, 0, 0, 0, 0, 0), (9, 0.9, 0, 0, 0, 0, 0), (26, 1.0, 0, 0, 0, 0, 0), (1, 1.0, 0, 0, 0, 0, 0), (90, 1.0, 0, 0, 0, 0, 0)],
    # one block, few blocks
    [(25, 0.0, 0, 0, 0, 0, 1)], [(2, 0.0, 0, 0, 0, 0, 1)], [(4, 0.0, 0, 0, 0, 0, 1), (2, 0.0, 0, 0, 0, 0, 1)], [(3, 1.0, 0, 0, 0, 0, 0), (2, 1.0, 0, 0, 0, 0, 0)], [(6, 0.0, 1, 0, 0, 0, 1), (12, 0.0, 0, 0, 0, 1, 0)],
    [(60, 0.0, 0, 0, 1, 0, 0), (12, 0.0, 0, 0, 0, 0, 1)], [(150, 0.02, 0, 0, 0, 0, 1), (80, 0.0, 0, 0, 0, 1, 0)], [(30, 1.0, 0, 0, 0, 0, 0)], [(30, 1.0, 0, 1, 0, 0, 1)], [(9, 0.0, 0, 0, 0, 0, 1), (1, 1.0, 0, 0, 0, 0, 0), (1, 1.0, 0, 0, 0, 0, 0)],
]


def table() -> tuple[np.ndarray, np.ndarray]:
    """(features, labels) of the labelled blocks."""
    pages = [np.array(page, float) for page in LABELLED]
    return np.concatenate([features(page[:, :-1]) for page in pages]), np.concatenate([page[:, -1] for page in pages])


class Tree:
    """A binary decision tree; splits lower the Gini impurity most, the first feature and threshold win ties."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 12):
        self.label = bool(y.mean() >= 0.5)
        self.feature = None
        if not depth or y.min() == y.max():
            return
        best = (len(y) * 2 * y.mean() * (1 - y.mean()) - 1e-9, -1, 0.0)
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for t in (values[1:] + values[:-1]) / 2:
                left = x[:, f] <= t
                cost = sum(2 * len(p) * p.mean() * (1 - p.mean()) for p in (y[left], y[~left]))
                if cost < best[0] - 1e-9:
                    best = (cost, f, t)
        if best[1] >= 0:
            _, self.feature, self.at = best
            left = x[:, self.feature] <= self.at
            self.sides = (Tree(x[left], y[left], depth - 1), Tree(x[~left], y[~left], depth - 1))

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature is None:
            return np.full(len(x), self.label)
        out, left = np.empty(len(x), bool), x[:, self.feature] <= self.at
        out[left], out[~left] = self.sides[0].predict(x[left]), self.sides[1].predict(x[~left])
        return out


@functools.cache
def trained() -> Tree:
    return Tree(*table())


def main_text(html: str | None) -> str:
    page = blocks(html or "")
    if not page:
        return ""
    kept = trained().predict(features(np.array([b.own for b in page], float)))
    return "\n".join(b.text for b, keep in zip(page, kept, strict=True) if keep and not b.furniture)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    bounded_batches(pages.sparkSession)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(h.as_py()) for h in part.column(2)]
                sizes = pa.array([len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])

    slim = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    schema = slim.select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema
    return slim.mapInArrow(step, schema)
