"""Data in pages: hydration state, whether a page needs scripts, records by schema."""

from __future__ import annotations

import json
import re
from typing import Any

from pagewright.functions.urls import resolve

from .content import collapse
from .selectors import select, select_first
from .tree import Node, inner_html

# Globals that hold state, mount points, attributes that hold URLs.
STATE_KEYS = ("__INITIAL_STATE__", "__APOLLO_STATE__", "__PRELOADED_STATE__", "__NUXT__", "__remixContext")
MOUNTS = ("#root", "#app", "#__next", "[data-reactroot]")
URL_ATTRIBUTES = frozenset({"href", "src", "action", "poster", "data-src"})


def _no_constant(text: str):
    raise ValueError(text)


def load_json(text: str) -> tuple[bool, Any]:
    """(whether it is JSON, its value)."""
    try:
        return True, json.loads(text.strip(), parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return False, None


def _balanced(text: str, at: int) -> str | None:
    """From the bracket at `at` to its partner; brackets in double quotes don't count."""
    depth = 0
    for m in re.compile(r'"(?:\\.|[^"\\])*"|[\[{]|[\]}]', re.S).finditer(text, at):
        if m[0][0] in "[{":
            depth += 1
        elif m[0][0] in "]}":
            depth -= 1
            if not depth:
                return text[at : m.end()]
    return None


def _assigned(text: str, key: str) -> tuple[bool, Any]:
    for m in re.finditer(re.escape(key) + r"\s*=", text):
        start = re.compile(r"[{\[]").search(text, m.end())
        if start and (part := _balanced(text, start.start())) is not None:
            good, value = load_json(part)
            if good:
                return True, value
    return False, None


def hydration(document: Node) -> dict:
    """{next, json_ld, json, states} of a page."""
    first = select_first(document, "#__NEXT_DATA__")
    found = [(s, *load_json(s.text())) for s in select(document, 'script[type="application/ld+json"], script[type="application/json"]')]
    linked = [v for s, good, v in found if good and s.attrs["type"] == "application/ld+json"]
    islands = {s.attrs["id"]: v for s, good, v in found if good and s.attrs["type"] == "application/json" and s.attrs.get("id") not in (None, "", "__NEXT_DATA__")}
    scripts = "".join("\n" + s.text() for s in select(document, "script") if "src" not in s.attrs)
    states = {k: v for k in STATE_KEYS if k in scripts for good, v in [_assigned(scripts, k)] if good}
    return {"next": load_json(first.text())[1] if first is not None else None, "json_ld": linked, "json": dict(sorted(islands.items())), "states": dict(sorted(states.items()))}


def needs_scripts(document: Node, min_text: int = 200, min_scripts: int = 1) -> dict:
    """{js_required, text_length in bytes, scripts, reason}."""
    body = select_first(document, "body")
    length = len(collapse(body.text()).encode()) if body is not None else 0
    scripts = len(select(document, "script[src]"))
    mounts = (select_first(document, m) for m in MOUNTS)
    empty = any(m is not None and not m.text().strip() for m in mounts)
    needed = scripts >= min_scripts and (length < min_text or empty)
    reason = "server-rendered content present" if not needed else "empty SPA mount + external scripts" if empty else "near-empty body + external scripts"
    return {"js_required": needed, "text_length": length, "scripts": scripts, "reason": reason}


# --- schema ----------------------------------------------------------------------------------------------------------


def normalized(schema: Any) -> dict[str, dict]:
    """A schema with every key of every field; what isn't understood is a string."""
    if not isinstance(schema, dict):
        return {}
    out = {}
    for key in sorted(schema):
        spec = schema[key] if isinstance(schema[key], dict) else {}
        kind = str(spec.get("type", "string")).lower()
        out[key] = {
            "selector": spec.get("selector") if isinstance(spec.get("selector"), str) else None,
            "attr": spec.get("attr") if isinstance(spec.get("attr"), str) else None,
            "type": kind if kind in ("number", "boolean") else "string",
            "list": spec.get("list") is True,
            "fields": normalized(spec["fields"]) if isinstance(spec.get("fields"), dict) else None,
        }
    return out


def _typed(value: str | None, kind: str) -> Any:
    if value is None or kind == "string":
        return value
    if kind == "boolean":
        return bool(value)
    kept = re.sub(r"[^0-9.+-]", "", value)
    return float(kept) if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)", kept) else None


def _raw(node: Node, attr: str | None, base: str) -> str | None:
    if attr in (None, "text"):
        return collapse(node.text())
    if attr == "html":
        return inner_html(node)
    value = node.attrs.get(attr.lower())
    return resolve(base, value) or value if value is not None and attr in URL_ATTRIBUTES else value


def extract(root: Node, schema: dict[str, dict], base: str) -> dict:
    """The record that a normalized schema describes; selectors of inner fields look inside their container."""
    out = {}
    for key, f in schema.items():
        inner, selector = f["fields"], f["selector"]
        if f["list"]:
            nodes = select(root, selector or "*") if selector or inner is None else [root]
            out[key] = [extract(n, inner, base) if inner is not None else _typed(_raw(n, f["attr"], base), f["type"]) for n in nodes]
        else:
            node = select_first(root, selector) if selector else root
            if node is None:
                out[key] = None
            else:
                out[key] = extract(node, inner, base) if inner is not None else _typed(_raw(node, f["attr"], base), f["type"])
    return out
