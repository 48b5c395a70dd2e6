"""Forms and clicks: successful controls, submissions, what a click leads to; edits as new pages."""

from __future__ import annotations

import hashlib

from pagewright.functions.urls import form_encode, parse, resolve

from .access import _type
from .content import collapse
from .selectors import select_first
from .tree import Node

_BUTTONS = frozenset({"submit", "button", "reset", "image"})
FORM_TYPE = "application/x-www-form-urlencoded"


def _option_value(option: Node) -> str:
    return option.attrs["value"] if "value" in option.attrs else collapse(option.text())


def form_pairs(form: Node, submitter: Node | None = None) -> list[tuple[str, str]]:
    """Names and values of the form's successful controls. A textarea counts with its value attribute."""
    out: list[tuple[str, str]] = []
    for c in form.elements():
        if c.tag not in ("input", "select", "textarea", "button") or not c.attrs.get("name") or "disabled" in c.attrs:
            continue
        key, kind, value = c.attrs["name"], _type(c), c.attrs.get("value", "")
        if c.tag == "button" or c.tag == "input" and kind in _BUTTONS:
            out += [(key, value)] if c is submitter else []
        elif c.tag == "input" and kind in ("checkbox", "radio"):
            out += [(key, c.attrs.get("value", "on"))] if "checked" in c.attrs else []
        elif c.tag == "select":
            out += [(key, _option_value(o)) for o in c.elements() if o.tag == "option" and "selected" in o.attrs]
        else:
            out.append((key, value))
    return out


def submission(form: Node, base: str, submitter: Node | None = None) -> dict:
    """{method, url, body, content_type}."""
    pairs = form_pairs(form, submitter)
    action = resolve(base, form.attrs.get("action")) or base
    if form.attrs.get("method", "").upper() != "POST":
        url = parse(action)
        if url is not None and url.opaque is None:
            url.query = form_encode(pairs)
            action = str(url)
        return {"method": "GET", "url": action, "body": None, "content_type": None}
    if "multipart" in form.attrs.get("enctype", "").lower():
        # the boundary follows from the content, so that a page always gives the same body
        boundary = "----form" + hashlib.sha256(repr(pairs).encode()).hexdigest()[:24]
        parts = [f'--{boundary}\r\nContent-Disposition: form-data; name="{k}"\r\n\r\n{v}\r\n' for k, v in pairs]
        return {"method": "POST", "url": action, "body": "".join(parts) + f"--{boundary}--\r\n", "content_type": f"multipart/form-data; boundary={boundary}"}
    return {"method": "POST", "url": action, "body": form_encode(pairs), "content_type": FORM_TYPE}


def click(node: Node, base: str) -> dict:
    """{action: navigate | submit | inert, url, method, body, content_type} for a click on an element."""
    nothing = {"method": None, "body": None, "content_type": None}
    for n in node.ancestors(itself=True):
        if n.tag == "a" and "href" in n.attrs:
            return {"action": "navigate", "url": resolve(base, n.attrs["href"]) or n.attrs["href"]} | nothing
    for n in node.ancestors(itself=True):
        if n.tag == "form":
            submits = node.tag == "button" or node.tag == "input" and _type(node) in ("submit", "image")
            return {"action": "submit"} | submission(n, base, node if submits else None)
    return {"action": "inert", "url": None} | nothing


# --- edits: each changes the parsed page; serialize it to have the new one


def fill(document: Node, selector: str, value: str) -> bool:
    node = select_first(document, selector)
    if node is None:
        return False
    node.attrs["value"] = value
    return True


def fill_many(document: Node, values: dict[str, str]) -> int:
    """The number of selectors that were found."""
    return sum(fill(document, s, v) for s, v in values.items())


def set_checked(document: Node, selector: str, checked: bool) -> bool:
    node = select_first(document, selector)
    if node is None:
        return False
    if checked:
        node.attrs["checked"] = ""
    else:
        node.attrs.pop("checked", None)
    return True


def select_option(document: Node, selector: str, wanted: str) -> bool:
    """Select by value or label; the others are deselected."""
    node = select_first(document, selector)
    options = [o for o in node.elements() if o.tag == "option"] if node is not None else []
    hit = next((o for o in options if wanted in (_option_value(o), collapse(o.text()))), None)
    if hit is None:
        return False
    for o in options:
        o.attrs.pop("selected", None)
    hit.attrs["selected"] = ""
    return True


