"""HTML trees after the WHATWG construction rules, numbered in document order."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from html import unescape

from .tokenizer import COMMENT, DOCTYPE, END, ESCAPABLE_RAW_TEXT, RAW_TEXT, START, TEXT, attributes, tokens

# Trees may be as deep as a page has tags, and Python frames don't use the C stack.
sys.setrecursionlimit(max(sys.getrecursionlimit(), 200_000))

ELEMENT, TEXT_NODE, COMMENT_NODE, DOCUMENT = 1, 3, 8, 9

VOID = frozenset("area base br col embed hr img input link meta param source track wbr basefont bgsound frame keygen".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_IN_HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template".split())
_FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu nav ol p search section summary ul pre listing "
    "form table hr xmp plaintext li dd dt".split()
) | _HEADING
_BLOCK_ENDS = _CLOSES_P - {"p", "hr", "xmp", "plaintext", "table", "li", "dd", "dt"} - _HEADING | {"button"}
_SPECIAL = (
    frozenset(
        "address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup dd details dir div dl dt embed fieldset figcaption figure "
        "footer form frame frameset head header hgroup hr html iframe img input li link listing main marquee menu meta nav noembed noframes noscript object ol p param plaintext "
        "pre script search section select source style summary table tbody td template textarea tfoot th thead title tr track ul wbr xmp".split()
    )
    | _HEADING
)
_IMPLIED_END = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
_SCOPE = frozenset("applet caption html table td th marquee object template".split())
_TABLE_SCOPE = frozenset("html table template".split())
_TABLE_PARTS = frozenset("table tbody thead tfoot tr".split())
_IN_TABLE = frozenset("caption colgroup col tbody thead tfoot tr td th".split())
_MARKER = None


class Node:
    """One node: tag in lower case for elements, value for text and comments; id and end number it and its last descendant."""

    __slots__ = ("kind", "tag", "attrs", "value", "children", "parent", "id", "end")

    def __init__(self, kind: int, tag: str = "", attrs: dict[str, str] | None = None, value: str = ""):
        self.kind, self.tag, self.attrs, self.value = kind, tag, attrs if attrs is not None else {}, value
        self.children: list[Node] = []
        self.parent: Node | None = None
        self.id = self.end = 0

    def walk(self) -> Iterator[Node]:
        """This node and its descendants in document order."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(reversed(node.children))

    def elements(self) -> Iterator[Node]:
        """Descendant elements in document order."""
        return (n for n in self.walk() if n.kind == ELEMENT and n is not self)

    def text(self) -> str:
        """All text below, as it is."""
        return "".join(n.value for n in self.walk() if n.kind == TEXT_NODE)

    def ancestors(self, itself: bool = False) -> Iterator[Node]:
        node = self if itself else self.parent
        while node is not None:
            yield node
            node = node.parent

    def append(self, child: Node) -> None:
        if child.parent is not None:
            child.parent.children.remove(child)
        child.parent = self
        self.children.append(child)

    def insert_before(self, child: Node, before: Node) -> None:
        if child.parent is not None:
            child.parent.children.remove(child)
        child.parent = self
        self.children.insert(self.children.index(before), child)


class _Builder:
    def __init__(self) -> None:
        self.document = Node(DOCUMENT)
        self.open: list[Node] = []
        self.formatting: list[Node | None] = []
        self.html = self.head = self.body = self.form = None
        self.foster = False

    # --- where to insert

    def place(self) -> tuple[Node, Node | None]:
        """(parent, node to stand before); content that a table can't hold goes before the table."""
        target = self.open[-1]
        if self.foster and target.tag in _TABLE_PARTS:
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag == "table":
                    table = self.open[i]
                    return (table.parent, table) if table.parent is not None else (self.open[i - 1], None)
        return target, None

    def put(self, node: Node) -> None:
        parent, before = self.place()
        if before is None:
            parent.append(node)
        else:
            parent.insert_before(node, before)

    def element(self, tag: str, attrs: dict[str, str], stay: bool = True) -> Node:
        node = Node(ELEMENT, tag, attrs)
        self.put(node)
        if stay:
            self.open.append(node)
        return node

    def text(self, value: str) -> None:
        parent, before = self.place()
        siblings = parent.children
        at = len(siblings) if before is None else siblings.index(before)
        if at and siblings[at - 1].kind == TEXT_NODE:
            siblings[at - 1].value += value
        else:
            self.put(Node(TEXT_NODE, value=value))

    # --- the stack

    def in_scope(self, tags, extra=frozenset(), scope=_SCOPE) -> bool:
        for node in reversed(self.open):
            if node.tag in tags:
                return True
            if node.tag in scope or node.tag in extra:
                return False
        return False

    def pop_until(self, tags) -> None:
        while self.open:
            if self.open.pop().tag in tags:
                return

    def implied_ends(self, but: str = "") -> None:
        while self.open[-1].tag in _IMPLIED_END and self.open[-1].tag != but:
            self.open.pop()

    def close_p(self) -> None:
        if self.in_scope({"p"}, {"button"}):
            self.implied_ends("p")
            self.pop_until({"p"})

    # --- active formatting elements

    def reconstruct(self) -> None:
        entries = self.formatting
        at = len(entries)
        while at and entries[at - 1] is not _MARKER and entries[at - 1] not in self.open:
            at -= 1
        for i in range(at, len(entries)):
            old = entries[i]
            entries[i] = self.element(old.tag, dict(old.attrs))

    def remember(self, node: Node) -> None:
        """At most three equal entries since the last marker."""
        same = []
        for i in range(len(self.formatting) - 1, -1, -1):
            entry = self.formatting[i]
            if entry is _MARKER:
                break
            if entry.tag == node.tag and entry.attrs == node.attrs:
                same.append(i)
        if len(same) >= 3:
            del self.formatting[same[-1]]
        self.formatting.append(node)

    def to_marker(self) -> None:
        while self.formatting and self.formatting.pop() is not _MARKER:
            pass

    def adopt(self, tag: str) -> None:
        """The adoption agency: close a formatting element that blocks were opened in."""
        current = self.open[-1]
        if current.tag == tag and current not in self.formatting:
            self.open.pop()
            return
        for _ in range(8):
            target = None
            for entry in reversed(self.formatting):
                if entry is _MARKER:
                    break
                if entry.tag == tag:
                    target = entry
                    break
            if target is None:
                self.other_end(tag)
                return
            if target not in self.open:
                self.formatting.remove(target)
                return
            if not self.in_scope({tag}):
                return
            at = self.open.index(target)
            furthest = next((n for n in self.open[at + 1 :] if n.tag in _SPECIAL), None)
            if furthest is None:
                del self.open[at:]
                self.formatting.remove(target)
                return
            above = self.open[at - 1]
            mark = self.formatting.index(target)
            last, i = furthest, self.open.index(furthest)
            count = 0
            while True:
                i -= 1
                node = self.open[i]
                if node is target:
                    break
                count += 1
                if count > 3 and node in self.formatting:
                    gone = self.formatting.index(node)
                    del self.formatting[gone]
                    mark -= gone < mark
                if node not in self.formatting:
                    del self.open[i]
                    continue
                copy = Node(ELEMENT, node.tag, dict(node.attrs))
                self.formatting[self.formatting.index(node)] = copy
                self.open[i] = copy
                if last is furthest:
                    mark = self.formatting.index(copy) + 1
                copy.append(last)
                last = copy
            if above.tag in _TABLE_PARTS:
                table = next((n for n in reversed(self.open) if n.tag == "table"), None)
                if table is not None and table.parent is not None:
                    table.parent.insert_before(last, table)
                else:
                    above.append(last)
            else:
                above.append(last)
            copy = Node(ELEMENT, target.tag, dict(target.attrs))
            for child in [*furthest.children]:
                copy.append(child)
            furthest.append(copy)
            was = self.formatting.index(target)
            del self.formatting[was]
            self.formatting.insert(mark - (was < mark), copy)
            self.open.remove(target)
            self.open.insert(self.open.index(furthest) + 1, copy)

    # --- skeleton

    def need_html(self, attrs=None) -> None:
        if self.html is None:
            self.html = Node(ELEMENT, "html", attrs or {})
            self.document.append(self.html)
            self.open.append(self.html)

    def need_head(self, attrs=None) -> None:
        self.need_html()
        if self.head is None:
            self.head = self.element("head", attrs or {})

    def need_body(self, attrs=None) -> None:
        self.need_head()
        if self.body is None:
            if self.head in self.open:
                self.open = self.open[: self.open.index(self.head)]
            self.body = self.element("body", attrs or {})

    # --- tokens

    def start(self, tag: str, raw: str) -> None:
        attrs = attributes(raw)
        if tag == "html":
            self.need_html(attrs)
            self.html.attrs = attrs | self.html.attrs
            return
        if tag == "head":
            if self.head is None:
                self.need_head(attrs)
            return
        if tag in ("body", "frameset"):
            if self.body is None:
                self.need_body(attrs)
            else:
                self.body.attrs = attrs | self.body.attrs
            return
        if self.body is None:
            if tag in _IN_HEAD:
                self.need_head()
                if self.head not in self.open:
                    self.open.append(self.head)
                self.element(tag, attrs, stay=tag not in VOID)
                return
            if not (len(self.open) > 2 and self.open[-1].tag in ("noscript", "template")):
                self.need_body()
        self.foster = False
        top = self.open[-1].tag
        if top in _TABLE_PARTS and tag not in _IN_TABLE and tag not in ("style", "script", "template", "table") and not (tag == "input" and attrs.get("type", "").lower() == "hidden"):
            self.foster = True
        if tag in _IN_TABLE:
            if not self.in_scope({"table"}, scope=_TABLE_SCOPE):
                return
            self.table_part(tag, attrs)
            return
        if tag in _CLOSES_P:
            self.close_p()
        if tag in _HEADING:
            if self.open[-1].tag in _HEADING:
                self.open.pop()
        elif tag == "li":
            self.close_item({"li"})
        elif tag in ("dd", "dt"):
            self.close_item({"dd", "dt"})
        elif tag == "button":
            if self.in_scope({"button"}):
                self.implied_ends()
                self.pop_until({"button"})
            self.reconstruct()
        elif tag == "form":
            if self.form is not None:
                return
            self.form = self.element(tag, attrs)
            return
        elif tag == "table":
            if self.open[-1].tag in _TABLE_PARTS:
                self.pop_until({"table"})
        elif tag == "a":
            for entry in reversed(self.formatting):
                if entry is _MARKER:
                    break
                if entry.tag == "a":
                    self.adopt("a")
                    if entry in self.formatting:
                        self.formatting.remove(entry)
                    if entry in self.open:
                        self.open.remove(entry)
                    break
        elif tag == "nobr" and self.in_scope({"nobr"}):
            self.adopt("nobr")
        elif tag in ("option", "optgroup"):
            if self.open[-1].tag == "option":
                self.open.pop()
            if tag == "optgroup" and self.open[-1].tag == "optgroup":
                self.open.pop()
        elif tag in ("rb", "rtc", "rt", "rp") and self.in_scope({"ruby"}):
            self.implied_ends("rtc" if tag in ("rt", "rp") else "")
        if tag in _FORMATTING:
            self.reconstruct()
            self.remember(self.element(tag, attrs))
        elif tag in VOID:
            if tag not in ("hr", "param", "source", "track"):
                self.reconstruct()
            self.element(tag, attrs, stay=False)
        elif tag in ("applet", "marquee", "object"):
            self.reconstruct()
            self.element(tag, attrs)
            self.formatting.append(_MARKER)
        else:
            if tag not in _CLOSES_P and tag not in _IN_HEAD and tag not in RAW_TEXT:
                self.reconstruct()
            # only foreign elements can close themselves
            foreign = any(n.tag in ("svg", "math") for n in self.open) or tag in ("svg", "math")
            self.element(tag, attrs, stay=not (foreign and raw.rstrip().endswith("/")))

    def close_item(self, tags) -> None:
        for node in reversed(self.open):
            if node.tag in tags:
                self.implied_ends(node.tag)
                self.pop_until({node.tag})
                break
            if node.tag in _SPECIAL and node.tag not in ("address", "div", "p"):
                break
        self.close_p()

    def table_part(self, tag: str, attrs: dict[str, str]) -> None:
        to = {
            "caption": {"table"},
            "colgroup": {"table"},
            "col": {"table", "colgroup"},
            "tbody": {"table"},
            "thead": {"table"},
            "tfoot": {"table"},
            "tr": {"table", "tbody", "thead", "tfoot"},
            "td": {"table", "tbody", "thead", "tfoot", "tr"},
            "th": {"table", "tbody", "thead", "tfoot", "tr"},
        }[tag]
        while self.open[-1].tag not in to and self.open[-1].tag not in ("html", "template"):
            if self.open.pop().tag in ("td", "th", "caption"):
                self.to_marker()
        if tag == "col" and self.open[-1].tag == "table":
            self.element("colgroup", {})
        if tag in ("tr", "td", "th") and self.open[-1].tag == "table":
            self.element("tbody", {})
        if tag in ("td", "th") and self.open[-1].tag != "tr":
            self.element("tr", {})
        self.element(tag, attrs, stay=tag != "col")
        if tag in ("td", "th", "caption"):
            self.formatting.append(_MARKER)

    def end(self, tag: str) -> None:
        if self.body is None:
            if tag in ("head", "html", "body", "br"):
                self.need_head()
                if tag == "head":
                    if self.head in self.open:
                        self.open = self.open[: self.open.index(self.head)]
                    return
                self.need_body()
            elif self.open and self.open[-1].tag == tag and tag != "html":
                self.open.pop()
                return
            else:
                return
        self.foster = False
        if tag in ("body", "html", "head"):
            return
        if tag == "p":
            if not self.in_scope({"p"}, {"button"}):
                self.element("p", {})
            self.close_p()
        elif tag in _BLOCK_ENDS:
            if tag == "form":
                self.form = None
            if self.in_scope({tag}):
                self.implied_ends()
                self.pop_until({tag})
        elif tag in ("li", "dd", "dt"):
            if self.in_scope({tag}, {"ol", "ul"} if tag == "li" else frozenset()):
                self.implied_ends(tag)
                self.pop_until({tag})
        elif tag in _HEADING:
            if self.in_scope(_HEADING):
                self.implied_ends()
                self.pop_until(_HEADING)
        elif tag in _FORMATTING:
            self.adopt(tag)
        elif tag in ("applet", "marquee", "object"):
            if self.in_scope({tag}):
                self.implied_ends()
                self.pop_until({tag})
                self.to_marker()
        elif tag == "table" or tag in _IN_TABLE:
            if self.in_scope({tag}, scope=_TABLE_SCOPE):
                while (gone := self.open.pop().tag) != tag:
                    if gone in ("td", "th", "caption"):
                        self.to_marker()
                if tag in ("td", "th", "caption"):
                    self.to_marker()
        elif tag == "br":
            self.start("br", "")
        else:
            self.other_end(tag)

    def other_end(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            node = self.open[i]
            if node.tag == tag:
                self.implied_ends(tag)
                del self.open[i:]
                return
            if node.tag in _SPECIAL:
                return

    def characters(self, value: str) -> None:
        blank = not value.strip(" \t\n\r\f")
        if self.body is None:
            raw = self.open and (self.open[-1].tag in RAW_TEXT or self.open[-1].tag in ESCAPABLE_RAW_TEXT or self.open[-1].tag in ("noscript", "template"))
            if not raw:
                if blank:
                    if self.head is not None and self.open and self.open[-1] is self.head:
                        self.text(value)
                    return
                self.need_body()
                value = value.lstrip(" \t\n\r\f")
            else:
                self.text(value)
                return
        top = self.open[-1].tag
        self.foster = top in _TABLE_PARTS and not blank
        if top not in RAW_TEXT and top not in ESCAPABLE_RAW_TEXT and (top not in _TABLE_PARTS or self.foster):
            self.reconstruct()
        self.text(value)

    def comment(self, value: str) -> None:
        node = Node(COMMENT_NODE, value=value)
        (self.open[-1] if self.open else self.document).append(node)


def parse(html: str, decode: Callable[[str], str] = unescape) -> Node:
    """The document of a page, its text decoded by `decode`; every node is numbered in document order."""
    b = _Builder()
    drop_newline = False
    for kind, value, raw in tokens(html.replace("\r\n", "\n").replace("\r", "\n") if "\r" in html else html, decode=decode):
        if kind == TEXT:
            if drop_newline and value[:1] == "\n":
                value = value[1:]
            if value:
                b.characters(value)
        elif kind == START:
            b.start(value, raw)
        elif kind == END:
            b.end(value)
        elif kind == COMMENT:
            b.comment(value)
        elif kind == DOCTYPE:
            pass
        drop_newline = kind == START and value in ("pre", "listing", "textarea")
    b.need_body()
    number(b.document)
    return b.document


def number(root: Node) -> None:
    """Set id and end of each node below; the document itself is node 0."""
    order = []
    for i, node in enumerate(root.walk()):
        node.id = node.end = i
        order.append(node)
    for node in reversed(order):
        if node.parent is not None and node.end > node.parent.end:
            node.parent.end = node.end


# --- serialization


def _escape(text: str, attribute: bool) -> str:
    text = text.replace("&", "&amp;").replace("\xa0", "&nbsp;")
    return text.replace('"', "&quot;") if attribute else text.replace("<", "&lt;").replace(">", "&gt;")


_VERBATIM = RAW_TEXT | {"noscript", "plaintext"}


def _start_tag(node: Node) -> str:
    return f"<{node.tag}{''.join(f' {k}="{_escape(v, True)}"' for k, v in node.attrs.items())}>"


def _serialized(nodes: list[Node]) -> str:
    out: list[str] = []
    todo: list[Node | str] = [*reversed(nodes)]
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            out.append(node)
        elif node.kind == TEXT_NODE:
            out.append(node.value if node.parent is not None and node.parent.tag in _VERBATIM else _escape(node.value, False))
        elif node.kind == COMMENT_NODE:
            out.append(f"<!--{node.value}-->")
        else:
            if node.kind == ELEMENT:
                out.append(_start_tag(node))
                if node.tag in VOID:
                    continue
                todo.append(f"</{node.tag}>")
            todo.extend(reversed(node.children))
    return "".join(out)


def outer_html(node: Node) -> str:
    return _serialized([node])


def inner_html(node: Node) -> str:
    return _serialized(node.children)
