"""Title, anchors and element counts from the tokens of a page, where no tree is needed to know them.

Building the tree can move, copy or drop elements. It does none of that to anchors and to the elements in `COUNTED` on a page
whose anchors hold plain inline content and are closed, and that has nothing of `UNSURE`. `read` returns None for all other pages; these are parsed.
"""

from __future__ import annotations

from collections import Counter

from .tokenizer import END, START, TEXT, attributes, tokens

#: With one of these the tree may differ from the order of tags.
UNSURE = frozenset("table caption colgroup col tbody thead tfoot tr td th select option optgroup template frameset frame svg math noscript plaintext image textarea applet marquee object".split())
#: May stand in an anchor; the second need no end tag.
INLINE = frozenset("b i em strong span code small sub sup u s font mark abbr cite time q kbd var samp".split())
ALONE = frozenset("br img wbr".split())
#: Elements that are as many as their start tags.
COUNTED = frozenset("a li ul ol h1 h2 h3 h4 h5 h6 nav article section aside header footer main div img br hr script style meta link".split())


class Flat:
    __slots__ = ("title", "hrefs", "counts")

    def __init__(self) -> None:
        self.title: str | None = None
        self.hrefs: list[str] = []
        self.counts: Counter[str] = Counter()


def read(html: str) -> Flat | None:
    """What the tokens tell; None where only the tree does."""
    if "\0" in html:
        return None
    out = Flat()
    inside: list[str] | None = None  # open inline elements of the open anchor
    titled = False
    for kind, name, raw in tokens(html.replace("\r\n", "\n").replace("\r", "\n") if "\r" in html else html):
        if kind == START:
            if name in UNSURE:
                return None
            out.counts[name] += 1
            if inside is not None:
                if name in INLINE:
                    inside.append(name)
                elif name not in ALONE:
                    return None
            elif name == "a":
                inside = []
                own = attributes(raw)
                if "href" in own:
                    out.hrefs.append(own["href"])
            elif name == "title" and out.title is None:
                out.title, titled = "", True
        elif kind == END:
            titled = False
            if name == "br":
                return None
            if inside is not None:
                if name == "a" and not inside:
                    inside = None
                elif inside and inside[-1] == name:
                    inside.pop()
                else:
                    return None
        elif kind == TEXT and titled:
            out.title += name
    return out if inside is None else None
