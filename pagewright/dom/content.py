"""Content views of a page: reading text, Markdown, links, the navigation record."""

from __future__ import annotations

import re

from pagewright.functions.urls import is_http, resolve, resolve_all

from .selectors import select, select_first
from .tree import ELEMENT, TEXT_NODE, Node, outer_html

# Tags left out, and tags that break lines.
TEXT_SKIP = frozenset("script style noscript template head meta link title svg".split())
TEXT_BLOCK = frozenset(
    "address article aside blockquote dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header li main nav ol p section table tbody tfoot thead tr ul".split()
)
MARKDOWN_SKIP = frozenset("script style noscript template svg nav footer aside".split())
INLINE_MARKS = {"strong": "**", "b": "**", "em": "*", "i": "*", "code": "`"}

_ASCII_SPACE = re.compile(r"[ \t\r\n]+")
_SPACE = re.compile(r"\s+")


def collapse(text: str) -> str:
    """Words with one space between, after Unicode white space."""
    return " ".join(text.split())


def reading_text(root: Node) -> str:
    """The text of the body (or of the element), one line a block."""
    start = root if root.kind == ELEMENT else select_first(root, "body") or root
    lines: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        line = _ASCII_SPACE.sub(" ", "".join(parts)).strip(" \t\r\n\f\v")
        parts.clear()
        if line:
            lines.append(line)

    # what to do is kept on a stack of nodes and of closing actions
    todo: list[Node | str] = [start]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            flush() if item == "line" else parts.append(item)
        elif item.kind == TEXT_NODE:
            parts.append(item.value)
        elif item.tag in TEXT_SKIP:
            continue
        elif item.tag in ("br", "hr"):
            flush()
        elif item.tag == "pre":
            flush()
            if kept := item.text().rstrip():
                lines.append(kept)
        else:
            if item.tag in TEXT_BLOCK:
                flush()
                todo.append("line")
            elif item.tag in ("td", "th"):
                todo.append("\t")
            todo.extend(reversed(item.children))
    flush()
    return "\n".join(lines)


class Markdown:
    """Renders blocks; inline markup counts inside paragraphs, headings, items, quotes and cells only."""

    def __init__(self, base: str):
        self.base = base

    def inline(self, node: Node) -> str:
        return "".join([self._inline(c) for c in node.children])

    def _inline(self, node: Node) -> str:
        if node.kind == TEXT_NODE:
            return _SPACE.sub(" ", node.value)
        if node.kind != ELEMENT or node.tag in MARKDOWN_SKIP:
            return ""
        if node.tag == "br":
            return "\n"
        inner = self.inline(node)
        if node.tag == "a":
            target = resolve(self.base, node.attrs.get("href"))
            return inner if target is None else f"[{inner}]({target})"
        mark = INLINE_MARKS.get(node.tag)
        if mark is None:
            return inner
        return mark + inner + mark if inner.strip() else ""

    def blocks(self, node: Node) -> list[str]:
        out: list[str] = []
        for child in node.children:
            if child.kind == TEXT_NODE:
                found = [collapse(child.value)]
            elif child.kind != ELEMENT or child.tag in MARKDOWN_SKIP:
                continue
            else:
                found = getattr(self, f"_{child.tag}", self.blocks)(child) if child.tag in self.BLOCKS else self.blocks(child)
            out += [b for b in found if b]
        return out

    BLOCKS = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre ul ol hr table".split())

    def _prefixed(self, prefix: str, node: Node) -> list[str]:
        inner = self.inline(node).strip()
        return [prefix + inner] if inner else []

    def _p(self, node: Node) -> list[str]:
        return self._prefixed("", node)

    def _blockquote(self, node: Node) -> list[str]:
        return self._prefixed("> ", node)

    def _heading(self, node: Node) -> list[str]:
        return self._prefixed("#" * int(node.tag[1]) + " ", node)

    _h1 = _h2 = _h3 = _h4 = _h5 = _h6 = _heading

    def _hr(self, node: Node) -> list[str]:
        return ["---"]

    def _pre(self, node: Node) -> list[str]:
        code = node.text().rstrip("\n")
        return [f"```\n{code}\n```"] if code.strip() else []

    def _items(self, node: Node) -> list[str]:
        texts = (self.inline(c).strip() for c in node.children if c.tag == "li")
        return [t for t in texts if t]

    def _ul(self, node: Node) -> list[str]:
        return ["\n".join(f"- {t}" for t in self._items(node))]

    def _ol(self, node: Node) -> list[str]:
        return ["\n".join(f"{n}. {t}" for n, t in enumerate(self._items(node), 1))]

    def _table(self, node: Node) -> list[str]:
        rows = []
        for tr in (e for e in node.elements() if e.tag == "tr"):
            if cells := [self.inline(c).strip().replace("|", r"\|") for c in tr.elements() if c.tag in ("td", "th")]:
                rows.append(cells)
        if not rows:
            return []
        rows.insert(1, ["---"] * len(rows[0]))
        return ["\n".join("| " + " | ".join(r) + " |" for r in rows)]


def markdown(document: Node, base: str = "") -> str:
    """The main element, else the body, as Markdown."""
    start = select_first(document, "main") or select_first(document, "body") or document
    return "\n\n".join(Markdown(base).blocks(start)).strip()


def title(document: Node) -> str:
    found = select_first(document, "title")
    return found.text().strip() if found is not None else ""


def resolved_anchors(document: Node, base: str) -> list[str]:
    """Every anchor's target that resolves, repeated and of any scheme."""
    return resolved(base, [a.attrs.get("href") for a in select(document, "a[href]")])


def resolved(base: str, hrefs: list[str | None]) -> list[str]:
    """The hrefs that resolve against base."""
    return [t for t in resolve_all(base, hrefs) if t is not None]


def links(document: Node, base: str) -> list[str]:
    """Distinct http(s) targets in order of first occurrence."""
    return distinct_http(resolved_anchors(document, base))


def distinct_http(targets: list[str]) -> list[str]:
    return [t for t in dict.fromkeys(targets) if is_http(t)]


def matched(nodes: list[Node]) -> list[dict]:
    """Query matches as records."""
    return [{"node": n.id, "html": outer_html(n), "text": reading_text(n)} for n in nodes]
