"""Accessibility: roles, names, states, visibility, the accessibility tree and its snapshot."""

from __future__ import annotations

import functools
import json
import re
from typing import NamedTuple

from pagewright.functions.urls import resolve

from .content import collapse
from .selectors import compile_selector, select, select_first
from .tree import ELEMENT, Node

# Roles of controls, and of the elements in the accessibility tree.
CONTROL_ROLES = {"a": "link", "button": "button", "select": "combobox", "textarea": "textbox"}
INPUT_ROLES = {"checkbox": "checkbox", "radio": "radio", "button": "button", "submit": "button", "reset": "button"}
TREE_ROLES = {
    "a": "link", "button": "button", "nav": "navigation", "main": "main", "header": "banner", "footer": "contentinfo", "aside": "complementary", "ul": "list", "ol": "list",
    "li": "listitem", "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "img": "img", "select": "combobox",
    "textarea": "textbox", "form": "form", "table": "table", "p": "paragraph", "section": "region", "article": "article",
}
TREE_SKIP = frozenset("script style noscript template head meta link".split())
INTERACTIVE = "a[href],button,input,select,textarea,[role=button],[role=link],[role=checkbox],[role=tab],[role=menuitem],[contenteditable],[tabindex],[onclick]"


def _type(node: Node) -> str | None:
    own = node.attrs.get("type")
    return own.lower() if own is not None else None


def role(node: Node) -> str:
    """The explicit role, else the one that the tag implies for a control, else generic."""
    if "role" in node.attrs:
        return node.attrs["role"]
    return INPUT_ROLES.get(_type(node), "textbox") if node.tag == "input" else CONTROL_ROLES.get(node.tag, "generic")


def name(node: Node) -> str:
    """The first of label, text, placeholder, value and title that isn't blank."""
    own = node.attrs.get
    return next((t for x in (own("aria-label"), node.text(), own("placeholder"), own("value"), own("title")) if (t := (x or "").strip())), "")


def _texts_of(node: Node, document: Node, attribute: str) -> str:
    by_id: dict[str, Node] = {}
    for n in document.elements():
        if "id" in n.attrs:
            by_id.setdefault(n.attrs["id"], n)
    return " ".join(t for i in node.attrs[attribute].split() if i in by_id and (t := collapse(by_id[i].text())))


def description(node: Node, document: Node) -> str:
    if node.attrs.get("aria-describedby", "").split():
        return _texts_of(node, document, "aria-describedby")
    return node.attrs.get("title", "").strip()


def error_message(node: Node, document: Node) -> str:
    if node.attrs.get("aria-invalid") != "true" or "aria-errormessage" not in node.attrs:
        return ""
    return _texts_of(node, document, "aria-errormessage")


def is_checked(node: Node) -> bool:
    return "checked" in node.attrs


def is_enabled(node: Node) -> bool:
    return "disabled" not in node.attrs


def is_editable(node: Node) -> bool:
    if node.attrs.get("contenteditable") in ("", "true"):
        return True
    return node.tag in ("input", "textarea", "select") and "disabled" not in node.attrs and "readonly" not in node.attrs


def is_empty(node: Node) -> bool:
    return not any(c.kind == ELEMENT for c in node.children) and not collapse(node.text())


def selected_values(node: Node) -> list[str]:
    return [o.attrs["value"] if "value" in o.attrs else collapse(o.text()) for o in node.elements() if o.tag == "option" and "selected" in o.attrs]


# --- cascade ---------------------------------------------------------------------------------------------------------


class Rule(NamedTuple):
    test: object
    specificity: tuple[int, int, int]
    values: dict[str, tuple[str, bool]]


INHERITED = frozenset({"visibility", "color", "cursor", "direction", "font-family", "font-size", "font-style", "font-weight", "letter-spacing", "line-height", "list-style-type", "text-align", "text-transform", "white-space"})
_COMMENT = re.compile(r"/\*.*?\*/", re.S)
_BLOCK = re.compile(r"([^{}]*)\{([^{}]*)\}")


def declarations(text: str) -> dict[str, tuple[str, bool]]:
    """property -> (value, important)."""
    out: dict[str, tuple[str, bool]] = {}
    for part in _COMMENT.sub("", text).split(";"):
        key, colon, value = part.partition(":")
        if colon and (key := key.strip().lower()):
            value = value.strip()
            important = value.lower().endswith("!important")
            value = value[:-10].strip() if important else value
            if important or not out.get(key, ("", False))[1]:
                out[key] = (value.lower(), important)
    return out


def _specificity(selector: str) -> tuple[int, int, int]:
    s = re.sub(r"\[[^\]]*\]", "[", re.sub(r":(?:not|is)\(", "(", selector))
    return s.count("#"), len(re.findall(r"\.[-\w]|\[|(?<!:):[-\w]", s)), len(re.findall(r"(?:^|[\s>+~(])[a-zA-Z]", s))


def _selectors(text: str) -> list[str]:
    depth, out, held = 0, [], ""
    for c in text:
        depth += (c in "([") - (c in ")]")
        if c == "," and not depth:
            out.append(held)
            held = ""
        else:
            held += c
    return [s.strip() for s in [*out, held] if s.strip()]


@functools.lru_cache(256)
def style_rules(css: str) -> tuple[Rule, ...]:
    """Rules outside of at-rules' blocks."""
    css = re.sub(r"@[^{;]*\{(?:[^{}]*\{[^{}]*\})*[^{}]*\}|@[^{;]*;", "", _COMMENT.sub("", css))
    out = []
    for selectors, body in _BLOCK.findall(css):
        for s in _selectors(selectors):
            if (test := compile_selector(s)) is not None:
                out.append(Rule(test, _specificity(s), declarations(body)))
    return tuple(out)


class Cascade:
    """Computed values from the style elements and style attributes of a document."""

    def __init__(self, document: Node):
        self.rules = style_rules("\n".join(s.text() for s in select(document, "style")))
        self.own: dict[int, dict[str, str]] = {}

    def _own(self, node: Node) -> dict[str, str]:
        found = self.own.get(id(node))
        if found is None:
            best: dict[str, tuple] = {}
            inline = declarations(node.attrs["style"]) if "style" in node.attrs else {}
            cases = [(r.specificity, i, r.values) for i, r in enumerate(self.rules) if r.test(node)]
            for specificity, i, values in [*cases, ((9**9, 0, 0), 0, inline)]:
                for key, (value, important) in values.items():
                    rank = (important, specificity, i)
                    if key not in best or rank >= best[key][0]:
                        best[key] = (rank, value)
            found = self.own[id(node)] = {k: v for k, (_, v) in best.items()}
        return found

    def value(self, node: Node, key: str) -> str:
        for n in node.ancestors(itself=True) if key in INHERITED else (node,):
            if n.kind == ELEMENT and (own := self._own(n).get(key)) not in (None, "inherit"):
                return own
        return ""


def is_visible(node: Node, cascade: Cascade) -> bool:
    if "hidden" in node.attrs or node.tag == "input" and _type(node) == "hidden" or cascade.value(node, "visibility") == "hidden":
        return False
    for n in node.ancestors(itself=True):
        if n.kind == ELEMENT:
            if cascade.value(n, "display") == "none":
                return False
            opacity = cascade.value(n, "opacity").rstrip("%").strip()
            if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)", opacity) and float(opacity) <= 0.001:
                return False
    return True


# --- lists and trees -------------------------------------------------------------------------------------------------


def interactive(document: Node, base: str, check_visible: bool = False) -> list[dict]:
    """What a user can act on, in document order."""
    cascade = Cascade(document) if check_visible else None
    out = []
    for i, n in enumerate(select(document, INTERACTIVE)):
        href = resolve(base, n.attrs.get("href")) if n.tag == "a" else None
        out.append(
            {
                "i": i, "tag": n.tag, "role": role(n), "name": name(n), "value": n.attrs.get("value"), "href": href, "type": _type(n),
                "visible": cascade is None or is_visible(n, cascade),
                "js_handler": "onclick" in n.attrs and href is None and _type(n) != "submit",
                "node": n.id,
            }
        )
    return out


def _tree_role(node: Node) -> str | None:
    if "role" in node.attrs:
        return node.attrs["role"]
    if node.tag == "input":
        return None if _type(node) == "hidden" else INPUT_ROLES.get(_type(node), "textbox")
    return TREE_ROLES.get(node.tag)


def _tree_name(node: Node) -> str:
    if "aria-label" in node.attrs:
        return node.attrs["aria-label"].strip()
    return node.attrs.get("alt", "").strip() if node.tag == "img" else collapse(node.text())


def _tree_value(node: Node) -> str | None:
    if node.tag == "input":
        found = node.attrs.get("value")
    elif node.tag == "textarea":
        found = node.text()
    else:
        found = next(iter(selected_values(node)), None) if node.tag == "select" else None
    return found or None


def ax_subtree(node: Node) -> dict | None:
    """{role, name, value, children}, without what is empty in `ax_json`; elements without a role give way to their only child, or vanish."""
    if node.kind != ELEMENT or node.tag in TREE_SKIP or node.attrs.get("aria-hidden") == "true":
        return None
    children = [k for c in node.children if (k := ax_subtree(c)) is not None]
    own = _tree_role(node)
    if own is None:
        return {"role": "generic", "name": "", "children": children} if len(children) > 1 else children[0] if children else None
    value = _tree_value(node)
    return {"role": own, "name": _tree_name(node)} | ({"value": value} if value else {}) | {"children": children}


def ax_tree(document: Node) -> dict:
    start = select_first(document, "body") or select_first(document, "html") or document
    return ax_subtree(start) or {"role": "document", "name": "", "children": []}


def ax_json(tree: dict) -> dict:
    """The tree without empty names, values and lists."""
    own = {k: v for k, v in tree.items() if k != "children" and v}
    return own | ({"children": [ax_json(c) for c in tree["children"]]} if tree["children"] else {})


def ax_text(tree: dict) -> str:
    """`ax_json` as text, however deep the tree."""
    out: list[str] = []
    todo: list[dict | str] = [tree]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            out.append(item)
            continue
        own = ",".join(f"{json.dumps(k)}:{json.dumps(v, ensure_ascii=False)}" for k, v in item.items() if k != "children" and v)
        out.append("{" + own)
        if kids := item["children"]:
            out.append(("," if own else "") + '"children":[')
            todo.append("]}")
            for i, kid in enumerate(reversed(kids)):
                todo += [",", kid] if i else [kid]
        else:
            out.append("}")
    return "".join(out)


def flat(tree: dict | None, depth: int = 0) -> list[tuple[int, str, str, str | None]]:
    """(depth, role, name, value) of the nodes that show; wrappers don't, nor do they deepen."""
    if tree is None:
        return []
    own = [] if tree["role"] == "generic" else [(depth, tree["role"], tree["name"], tree.get("value"))]
    return own + [x for c in tree["children"] for x in flat(c, depth + len(own))]


def aria_snapshot(node: Node) -> str:
    return "\n".join("  " * d + f"- {r}" + (f' "{n}"' if n else "") for d, r, n, _ in flat(ax_subtree(node)))


_LINE = re.compile(r"-\s*([-\w]+)\s*(.*)\Z", re.S | re.A)


def _expects(text: str):
    """(role, test of a name) of a snapshot's line, None if it's none."""
    m = _LINE.match(text.strip())
    if not m:
        return None
    want = m[2].strip()
    if len(want) > 1 and want[0] == want[-1] == '"':
        return m[1], want[1:-1].__eq__
    if want.startswith("/") and (end := want.rfind("/")) > 0:
        try:
            return m[1], re.compile(want[1:end], re.I if "i" in want[end:] else 0).search
        except re.error:
            pass
    return m[1], lambda n: True


def matches_snapshot(node: Node, expected: str) -> bool:
    """Whether the expected lines are found in this order, others between them or not."""
    shown = iter(flat(ax_subtree(node)))
    wants = [w for line in expected.splitlines() if (w := _expects(line)) is not None]
    return all(any(r == want and test(n) for _, r, n, _ in shown) for want, test in wants)


# --- locators --------------------------------------------------------------------------------------------------------


def text_matches(value: str, want: str, exact: bool = False) -> bool:
    """A /pattern/i, an exact text, or a part of it in any case."""
    value = value.strip()
    if m := re.match(r"/(.*)/([a-z]*)\Z", want, re.S):
        try:
            return re.search(m[1], value, re.I if "i" in m[2] else 0) is not None
        except re.error:
            return False
    return value == want if exact else want.lower() in value.lower()


def by_role(document: Node, want: str, named: str | None = None, exact: bool = False) -> list[Node]:
    return [n for n in document.elements() if role(n) == want and (named is None or text_matches(name(n), named, exact))]


def by_text(document: Node, want: str, exact: bool = False) -> list[Node]:
    """The deepest elements whose text matches."""
    hits = [n for n in document.elements() if text_matches(collapse(n.text()), want, exact)]
    ids = [n.id for n in hits]
    return [n for i, n in enumerate(hits) if i + 1 == len(hits) or not n.id < ids[i + 1] <= n.end]


def by_attribute(document: Node, attribute: str, want: str, exact: bool = False) -> list[Node]:
    return [n for n in document.elements() if attribute in n.attrs and text_matches(n.attrs[attribute], want, exact)]


def by_label(document: Node, want: str, exact: bool = False) -> list[Node]:
    """Controls by their labels: for and id, aria-labelledby, the first control inside, and by aria-label."""
    found: dict[int, Node] = {}
    every = [*document.elements()]
    for label in (n for n in every if n.tag == "label" and text_matches(collapse(n.text()), want, exact)):
        hits = []
        if "for" in label.attrs:
            hits += [n for n in every if n.attrs.get("id") == label.attrs["for"]][:1]
        if "id" in label.attrs:
            hits += [n for n in every if label.attrs["id"] in n.attrs.get("aria-labelledby", "").split()]
        hits += [n for n in label.elements() if n.tag in ("input", "select", "textarea", "button")][:1]
        for n in hits:
            found.setdefault(n.id, n)
    for n in by_attribute(document, "aria-label", want, exact):
        found.setdefault(n.id, n)
    return [*found.values()]

