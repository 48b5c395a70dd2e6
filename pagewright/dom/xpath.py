"""An XPath subset: steps by / and //, name tests and *, six predicates, a trailing /@attribute.

Rules that differ from the standard, kept on purpose: a name test that isn't a name (.., functions) counts as *; text() is the
trimmed text of all descendants; a predicate ends at the first ]; one that isn't understood matches nothing; a position
counts over all matches of a step together, in order of discovery, not per parent.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from typing import NamedTuple

from .tree import ELEMENT, Node

_NAME = re.compile(r"[A-Za-z_][-\w.]*\Z")
_FORMS: list[tuple[re.Pattern, Callable[..., Callable[[Node], bool]]]] = [
    (re.compile(r"@([-\w:]+)\s*=\s*(['\"])(.*)\2\Z", re.S), lambda a, _, v: lambda n: n.attrs.get(a.lower()) == v),
    (re.compile(r"contains\(\s*@([-\w:]+)\s*,\s*(['\"])(.*)\2\s*\)\Z", re.S), lambda a, _, v: lambda n: v in n.attrs.get(a.lower(), "\0") if v else a.lower() in n.attrs),
    (re.compile(r"text\(\)\s*=\s*(['\"])(.*)\1\Z", re.S), lambda _, v: lambda n: n.text().strip() == v),
    (re.compile(r"contains\(\s*text\(\)\s*,\s*(['\"])(.*)\1\s*\)\Z", re.S), lambda _, v: lambda n: v in n.text().strip()),
    (re.compile(r"@([-\w:]+)\Z"), lambda a: lambda n: a.lower() in n.attrs),
]


class Step(NamedTuple):
    deep: bool
    tag: str
    tests: tuple[Callable[[Node], bool] | int, ...]


def _predicate(text: str) -> Callable[[Node], bool] | int:
    text = text.strip()
    if text.isdecimal():
        return int(text)
    for pattern, make in _FORMS:
        if m := pattern.match(text):
            return make(*m.groups())
    return lambda n: False


@functools.lru_cache(512)
def compile_xpath(path: str) -> tuple[tuple[Step, ...], str | None]:
    """(steps, attribute at the end or None)."""
    at, n, steps = 0, len(path := path.strip().lstrip("(").rstrip(")") if path.strip().startswith("(") else path.strip()), []
    if path.startswith("./"):
        at = 1
    elif not path.startswith("/"):
        path, n = "//" + path, n + 2
    attribute = None
    while at < n:
        deep = path.startswith("//", at)
        at += 2 if deep else path.startswith("/", at)
        m = re.compile(r"[^/\[]*").match(path, at)
        name, at = m[0].strip(), m.end()
        if name.startswith("@"):
            attribute = name[1:].lower()
            break
        tests = []
        while path.startswith("[", at):
            end = path.find("]", at)
            if end < 0:
                tests.append(lambda node: False)
                at = n
                break
            tests.append(_predicate(path[at + 1 : end]))
            at = end + 1
        # what stands between a predicate and the next slash has no meaning
        at = next((i for i in range(at, n) if path[i] == "/"), n)
        if not name and not tests:
            continue
        steps.append(Step(deep, name.lower() if _NAME.match(name) else "*", tuple(tests)))
    return tuple(steps), attribute


def _run(root: Node, steps: tuple[Step, ...]) -> list[Node]:
    contexts = [root]
    for step in steps:
        found: dict[int, Node] = {}
        for context in contexts:
            for node in context.elements() if step.deep else context.children:
                if node.kind == ELEMENT and step.tag in ("*", node.tag):
                    found.setdefault(node.id, node)
        contexts = [*found.values()]
        for test in step.tests:
            contexts = contexts[test - 1 : test] if isinstance(test, int) and test else [] if isinstance(test, int) else [n for n in contexts if test(n)]
    return contexts


def xpath(root: Node, path: str) -> list[Node]:
    """The elements that a path finds below root."""
    steps, attribute = compile_xpath(path)
    found = _run(root, steps)
    return [n for n in found if attribute in n.attrs] if attribute else found


def xpath_values(root: Node, path: str) -> list[str]:
    """The strings that a path with a trailing /@attribute finds; without one, the elements' texts."""
    steps, attribute = compile_xpath(path)
    found = _run(root, steps)
    return [n.attrs[attribute] for n in found if attribute in n.attrs] if attribute else [n.text() for n in found]
