"""CSS selectors: compiled once, matched on trees.

Type, universal, #id, .class, attribute tests (= ~= |= ^= $= *=, with the i flag), the four combinators, lists, :not(), :is(),
:first-child and its kin, :nth-child(), :nth-of-type(), :empty, :root, :checked, :disabled, :enabled. What doesn't parse matches nothing.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from .tree import DOCUMENT, ELEMENT, TEXT_NODE, Node

Test = Callable[[Node], bool]

_IDENT = r"(?:\\.|[-\w\u0080-\U0010ffff])+"
_SIMPLE = re.compile(
    rf"""(?P<tag>\*|{_IDENT})|\#(?P<id>{_IDENT})|\.(?P<cls>{_IDENT})"""
    rf"""|\[\s*(?P<attr>{_IDENT})\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<dq>(?:\\.|[^"])*)"|'(?P<sq>(?:\\.|[^'])*)'|(?P<bare>{_IDENT}))\s*(?P<flag>[iIsS])?\s*)?\]"""
    rf"""|:(?P<pseudo>{_IDENT})(?P<paren>\()?""",
)
_COMBINATOR = re.compile(r"\s*([>+~])\s*|\s+")
_NTH = re.compile(r"\s*(?:(odd|even)|([+-]?\d*)n\s*(?:([+-])\s*(\d+))?|([+-]?\d+))\s*\Z", re.I)


class SelectorError(ValueError):
    """The text is no selector that is known here."""


def _unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text)


def siblings(node: Node) -> list[Node]:
    return [n for n in node.parent.children if n.kind == ELEMENT] if node.parent is not None else [node]


def _attribute(name: str, op: str | None, value: str, fold: bool) -> Test:
    name = name.lower()
    if op is None:
        return lambda n: name in n.attrs
    if fold:
        value = value.lower()

    def test(n: Node) -> bool:
        own = n.attrs.get(name)
        if own is None:
            return False
        if fold:
            own = own.lower()
        match op:
            case "=":
                return own == value
            case "~=":
                return bool(value) and not re.search(r"\s", value) and value in own.split()
            case "|=":
                return own == value or own.startswith(value + "-")
            case "^=":
                return bool(value) and own.startswith(value)
            case "$=":
                return bool(value) and own.endswith(value)
        return bool(value) and value in own

    return test


def _nth(text: str, same_type: bool, last: bool) -> Test:
    m = _NTH.match(text)
    if not m:
        raise SelectorError(text)
    if m[1]:
        a, b = 2, int(m[1].lower() == "odd")
    elif m[5] is not None:
        a, b = 0, int(m[5])
    else:
        a = int(m[2] + "1" if m[2] in ("", "+", "-") else m[2])
        b = int(f"{m[3]}{m[4]}") if m[4] else 0

    def test(n: Node) -> bool:
        own = [s for s in siblings(n) if not same_type or s.tag == n.tag]
        at = next(i for i, s in enumerate(own) if s is n)
        at = len(own) - at if last else at + 1
        return at == b if a == 0 else (at - b) % a == 0 and (at - b) // a >= 0

    return test


_CONTROLS = frozenset({"button", "input", "select", "textarea", "option", "optgroup", "fieldset"})
_PLAIN: dict[str, Test] = {
    "first-child": lambda n: siblings(n)[0] is n,
    "last-child": lambda n: siblings(n)[-1] is n,
    "only-child": lambda n: len(siblings(n)) == 1,
    "first-of-type": _nth("1", True, False),
    "last-of-type": _nth("1", True, True),
    "only-of-type": lambda n: sum(s.tag == n.tag for s in siblings(n)) == 1,
    "root": lambda n: n.parent is not None and n.parent.kind == DOCUMENT,
    "empty": lambda n: not any(c.kind == ELEMENT or c.kind == TEXT_NODE for c in n.children),
    "checked": lambda n: "checked" in n.attrs if n.tag == "input" else n.tag == "option" and "selected" in n.attrs,
    "disabled": lambda n: n.tag in _CONTROLS and "disabled" in n.attrs,
    "enabled": lambda n: n.tag in _CONTROLS and "disabled" not in n.attrs,
    "link": lambda n: n.tag in ("a", "area") and "href" in n.attrs,
}


class _Parser:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def list(self, closing: bool = False) -> Test:
        tests = [self.complex()]
        while self.at < len(self.text) and self.text[self.at] == ",":
            self.at += 1
            tests.append(self.complex())
        if closing:
            if self.text[self.at : self.at + 1] != ")":
                raise SelectorError(self.text)
            self.at += 1
        elif self.at < len(self.text):
            raise SelectorError(self.text)
        return tests[0] if len(tests) == 1 else lambda n: any(t(n) for t in tests)

    def complex(self) -> Test:
        self.space()
        test = self.compound()
        while self.at < len(self.text) and self.text[self.at] not in ",)":
            m = _COMBINATOR.match(self.text, self.at)
            if not m:
                raise SelectorError(self.text)
            self.at = m.end()
            if self.at >= len(self.text) or self.text[self.at] in ",)":
                if m[1]:
                    raise SelectorError(self.text)
                break
            test = _related(test, m[1] or " ", self.compound())
        return test

    def space(self) -> None:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1

    def compound(self) -> Test:
        tests: list[Test] = []
        begin = self.at
        while m := _SIMPLE.match(self.text, self.at):
            if m["tag"] and self.at > begin:
                raise SelectorError(self.text)
            self.at = m.end()
            tests.append(self.simple(m))
        if not tests:
            raise SelectorError(self.text)
        return tests[0] if len(tests) == 1 else lambda n: all(t(n) for t in tests)

    def simple(self, m: re.Match) -> Test:
        if m["tag"]:
            tag = _unescape(m["tag"]).lower()
            return (lambda n: True) if tag == "*" else lambda n: n.tag == tag
        if m["id"]:
            own = _unescape(m["id"])
            return lambda n: n.attrs.get("id") == own
        if m["cls"]:
            cls = _unescape(m["cls"])
            return lambda n: cls in n.attrs.get("class", "").split()
        if m["attr"]:
            value = next((_unescape(m[k]) for k in ("dq", "sq", "bare") if m[k] is not None), "")
            return _attribute(_unescape(m["attr"]), m["op"], value, (m["flag"] or "").lower() == "i")
        name = m["pseudo"].lower()
        if not m["paren"]:
            if name not in _PLAIN:
                raise SelectorError(self.text)
            return _PLAIN[name]
        if name in ("not", "is", "where"):
            inner = self.list(closing=True)
            return (lambda n: not inner(n)) if name == "not" else inner
        end = self.text.find(")", self.at)
        if not name.startswith("nth-") or end < 0:
            raise SelectorError(self.text)
        inside, self.at = self.text[self.at : end], end + 1
        return _nth(inside, "of-type" in name, "last" in name)


def _related(left: Test, how: str, right: Test) -> Test:
    def up(n: Node) -> bool:
        return any(p.kind == ELEMENT and left(p) for p in n.ancestors())

    def parent(n: Node) -> bool:
        return n.parent is not None and n.parent.kind == ELEMENT and left(n.parent)

    def before(n: Node, nearest: bool) -> bool:
        own = siblings(n)
        at = next(i for i, s in enumerate(own) if s is n)
        return any(left(s) for s in (own[at - 1 : at] if nearest else own[:at]))

    other = {" ": up, ">": parent, "+": lambda n: before(n, True), "~": lambda n: before(n, False)}[how]
    return lambda n: right(n) and other(n)


@functools.lru_cache(512)
def compile_selector(text: str) -> Test | None:
    try:
        return _Parser(text).list()
    except SelectorError:
        return None


def select(root: Node, selector: str) -> list[Node]:
    """Descendants of root that match, in document order."""
    test = compile_selector(selector)
    return [] if test is None else [n for n in root.elements() if test(n)]


def select_first(root: Node, selector: str) -> Node | None:
    test = compile_selector(selector)
    return None if test is None else next((n for n in root.elements() if test(n)), None)
