"""HTML tokens: one regular expression finds the markup, raw-text elements are cut out by their end tags."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape
from html.entities import html5

# A value may be quoted only after "="; elsewhere quotes are ordinary characters.
_MARKUP = re.compile(
    r"""<(?:(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>=]|=\s*(?:"[^"]*"|'[^']*')?)*+)>"""
    r"""|!--(?:(?P<void>-?>)|(?P<comment>.*?)(?:--!?>|\Z))|(?P<other>[!?][^>]*|/[^a-zA-Z>][^>]*)(?:>|\Z)|(?P<nothing>/>))""",
    re.S,
)
_ATTR = re.compile(r"""([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_REFERENCE = re.compile(r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z0-9]+;?)(=?)")
_CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z0-9]+);")

#: Elements whose content is text up to their end tag; in the second set character references count.
RAW_TEXT = frozenset({"script", "style", "xmp", "iframe", "noembed", "noframes"})
ESCAPABLE_RAW_TEXT = frozenset({"title", "textarea"})
FOREIGN = frozenset({"svg", "math"})
_raw_ends = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>|</{name}\Z", re.I) for name in RAW_TEXT | ESCAPABLE_RAW_TEXT}

START, END, TEXT, COMMENT, DOCTYPE = range(5)
Token = tuple[int, str, str]


def unescape_closed(text: str) -> str:
    """Decodes references that end in a semicolon only; "&amp" and "&copy" stay as they're written."""
    return _CLOSED.sub(lambda m: unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0], text)


def tokens(html: str, foreign: bool = False, decode: Callable[[str], str] = unescape) -> Iterator[Token]:
    """(kind, name or text, raw attributes) in order; names in lower case, text decoded, attributes as written.

    With `foreign`, elements like <title/> have no content within svg and math.
    """
    at, n, depth = 0, len(html), 0
    while at < n:
        m = _MARKUP.search(html, at)
        if not m:
            yield TEXT, decode(html[at:]), ""
            return
        if m.start() > at:
            yield TEXT, decode(html[at : m.start()]), ""
        at = m.end()
        if name := m["name"]:
            name = name.lower()
            if m["end"]:
                if name in FOREIGN and depth:
                    depth -= 1
                yield END, name, ""
                continue
            yield START, name, m["rest"]
            if foreign and (depth or name in FOREIGN) and m["rest"].endswith("/"):
                continue
            if name in FOREIGN:
                depth += 1
            elif end := _raw_ends.get(name):
                close = end.search(html, at)
                text = html[at : close.start() if close else n]
                at = close.end() if close else n
                if text:
                    yield TEXT, decode(text) if name in ESCAPABLE_RAW_TEXT else text, ""
                yield END, name, ""
            elif name == "plaintext":
                yield TEXT, html[at:], ""
                return
        elif m["other"] is not None and m["other"][:8].lower() == "!doctype":
            yield DOCTYPE, m["other"][8:].strip(), ""
        elif m["nothing"] is None:
            yield COMMENT, m["comment"] if m["comment"] is not None else "" if m["void"] else m["other"].removeprefix("!"), ""


def _decode(m: re.Match) -> str:
    name, equals = m[1], m[2]
    if name[0] == "#" or name in html5 and (name[-1] == ";" or not equals):
        return unescape(f"&{name}") + equals
    return m[0]


def attributes(raw: str) -> dict[str, str]:
    """Attributes of a start tag: names in lower case, the first of a name counts, values decoded."""
    out: dict[str, str] = {}
    if not raw or raw.isspace():
        return out
    for m in _ATTR.finditer(raw):
        value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
        out.setdefault(m[1].lower(), _REFERENCE.sub(_decode, value) if "&" in value else value)
    return out
