"""Views of pages as columns: one parse a page, however many views are asked for."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from pagewright.dom import access, content, data, forms
from pagewright.dom.flat import COUNTED, Flat, read
from pagewright.dom.selectors import select, select_first
from pagewright.dom.tree import ELEMENT, Node, inner_html, outer_html, parse
from pagewright.dom.tokenizer import unescape_closed
from pagewright.dom.xpath import xpath, xpath_values


#: Characters of html whose views are held as Python objects at a time.
SLICE_CHARS = 1 << 20


class View(NamedTuple):
    """What a page gives: a function of its document and base URL, and the result's type; perhaps the same from its tokens alone."""

    of: Callable[[Node, str], Any]
    type: str
    flat: Callable[[Flat, str], Any] | None = None


def _json(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _hydration(d: Node, base: str) -> dict:
    h = data.hydration(d)
    return {
        "next": None if h["next"] is None else _json(h["next"]),
        "json_ld": [_json(v) for v in h["json_ld"]],
        "json": {k: _json(v) for k, v in h["json"].items()},
        "states": {k: _json(v) for k, v in h["states"].items()},
    }


def _nodes(d: Node, base: str) -> list[dict]:
    depth = {d.id: 0}
    out = []
    for n in d.walk():
        if n is d:
            continue
        depth[n.id] = depth[n.parent.id] + 1
        out.append(
            {"node_id": n.id, "parent_id": n.parent.id, "end_id": n.end, "depth": depth[n.id], "kind": n.kind, "tag": n.tag.upper() or None, "attrs": n.attrs if n.kind == ELEMENT else None, "value": n.value if n.kind != ELEMENT else None}
        )
    return out


def _forms(d: Node, base: str) -> list[dict]:
    return [{"node": f.id, **forms.submission(f, base), "pairs": [{"name": k, "value": v} for k, v in forms.form_pairs(f)]} for f in select(d, "form")]


NODE_TYPE = "array<struct<node_id:int,parent_id:int,end_id:int,depth:int,kind:int,tag:string,attrs:map<string,string>,value:string>>"
INTERACTIVE_TYPE = "array<struct<i:int,tag:string,role:string,name:string,value:string,href:string,type:string,visible:boolean,js_handler:boolean,node:int>>"
VIEWS: dict[str, View] = {
    "title": View(lambda d, b: content.title(d), "string", lambda f, b: (f.title or "").strip()),
    "text": View(lambda d, b: content.reading_text(d), "string"),
    "markdown": View(content.markdown, "string"),
    "html": View(lambda d, b: outer_html(d), "string"),
    "links": View(content.links, "array<string>", lambda f, b: content.distinct_http(content.resolved(b, f.hrefs))),
    "anchors": View(content.resolved_anchors, "array<string>", lambda f, b: content.resolved(b, f.hrefs)),
    "interactive": View(lambda d, b: access.interactive(d, b), INTERACTIVE_TYPE),
    "interactive_visible": View(lambda d, b: access.interactive(d, b, True), INTERACTIVE_TYPE),
    "ax": View(lambda d, b: access.ax_text(access.ax_tree(d)), "string"),
    "ax_nodes": View(lambda d, b: [{"depth": x[0], "role": x[1], "name": x[2], "value": x[3]} for x in access.flat(access.ax_tree(d))], "array<struct<depth:int,role:string,name:string,value:string>>"),
    "aria_snapshot": View(lambda d, b: access.aria_snapshot(select_first(d, "body") or d), "string"),
    "hydration": View(_hydration, "struct<next:string,json_ld:array<string>,json:map<string,string>,states:map<string,string>>"),
    "needs_scripts": View(lambda d, b: data.needs_scripts(d), "struct<js_required:boolean,text_length:int,scripts:int,reason:string>"),
    "forms": View(_forms, "array<struct<node:int,method:string,url:string,body:string,content_type:string,pairs:array<struct<name:string,value:string>>>>"),
    "nodes": View(_nodes, NODE_TYPE),
}


def find(document: Node, selector: str, kind: str = "auto") -> list[Node]:
    """Elements by CSS or XPath; auto takes paths that begin with /, ( or ./ for XPath."""
    if kind == "auto":
        kind = "xpath" if selector.strip()[:1] in ("/", "(") or selector.startswith("./") else "css"
    return xpath(document, selector) if kind == "xpath" else select(document, selector)


def query_view(selector: str, kind: str = "auto") -> View:
    """All matches as {node, html, text, value}; value holds the strings of a trailing /@attribute."""

    def of(d: Node, base: str) -> list[dict]:
        found = find(d, selector, kind)
        rows = content.matched(found)
        values = xpath_values(d, selector) if "/@" in selector and kind != "css" else []
        return [r | {"value": v} for r, v in zip(rows, values or [None] * len(rows), strict=False)]

    return View(of, "array<struct<node:int,html:string,text:string,value:string>>")


def count_view(selector: str) -> View:
    of = lambda d, b: len(select(d, selector))
    if selector == "a[href]":
        return View(of, "int", lambda f, b: len(f.hrefs))
    return View(of, "int", (lambda f, b: f.counts[selector]) if selector in COUNTED else None)


def locate_view(how: str, *args, scope: str | None = None, **named) -> View:
    """Matches of a locator: role, text, label, placeholder, alt, title or testid; inside the scope's matches if it has any."""
    attribute = {"placeholder": "placeholder", "alt": "alt", "title": "title", "testid": "data-testid"}.get(how)

    def of(d: Node, base: str) -> list[dict]:
        found = access.by_attribute(d, attribute, *args, **named) if attribute else getattr(access, f"by_{how}")(d, *args, **named)
        roots = select(d, scope) if scope else []
        if roots:
            found = [n for n in found if any(r.id <= n.id <= r.end for r in roots)]
        return content.matched(found)

    return View(of, "array<struct<node:int,html:string,text:string>>")


def _first(selector: str, of: Callable[[Node, Node, str], Any], kind: str, otherwise: Any = None) -> View:
    def found(d: Node, base: str) -> Any:
        node = select_first(d, selector)
        return otherwise if node is None else of(node, d, base)

    return View(found, kind)


#: Properties of the first match of a selector; flags are false where nothing matches.
PROPERTIES: dict[str, tuple[Callable[..., Any], str, Any]] = {
    "text_content": (lambda n, d, b: n.text(), "string", None),
    "inner_text": (lambda n, d, b: content.reading_text(n), "string", None),
    "inner_html": (lambda n, d, b: inner_html(n), "string", None),
    "outer_html": (lambda n, d, b: outer_html(n), "string", None),
    "input_value": (lambda n, d, b: n.attrs.get("value", ""), "string", None),
    "is_visible": (lambda n, d, b: access.is_visible(n, access.Cascade(d)), "boolean", False),
    "is_checked": (lambda n, d, b: access.is_checked(n), "boolean", False),
    "is_enabled": (lambda n, d, b: access.is_enabled(n), "boolean", False),
    "is_editable": (lambda n, d, b: access.is_editable(n), "boolean", False),
    "is_empty": (lambda n, d, b: access.is_empty(n), "boolean", False),
    "is_focused": (lambda n, d, b: False, "boolean", False),
    "selected_values": (lambda n, d, b: access.selected_values(n), "array<string>", None),
    "role": (lambda n, d, b: access.role(n), "string", None),
    "name": (lambda n, d, b: access.name(n), "string", None),
    "description": (lambda n, d, b: access.description(n, d), "string", None),
    "error_message": (lambda n, d, b: access.error_message(n, d), "string", None),
    "aria_snapshot": (lambda n, d, b: access.aria_snapshot(n), "string", None),
    "click": (lambda n, d, b: forms.click(n, b), "struct<action:string,url:string,method:string,body:string,content_type:string>", None),
}


def property_view(selector: str, name: str) -> View:
    of, kind, otherwise = PROPERTIES[name]
    return _first(selector, of, kind, otherwise)


def attribute_view(selector: str, attribute: str) -> View:
    return _first(selector, lambda n, d, b: n.attrs.get(attribute.lower()), "string")


def css_view(selector: str, prop: str) -> View:
    return _first(selector, lambda n, d, b: access.Cascade(d).value(n, prop), "string")


def matches_snapshot_view(selector: str, expected: str) -> View:
    return _first(selector, lambda n, d, b: access.matches_snapshot(n, expected), "boolean", False)


def snapshot_view(selector: str) -> View:
    """Many properties of the first match at once."""
    keys = ("role", "name", "text_content", "input_value", "is_visible", "is_checked", "is_enabled", "is_editable", "is_empty")
    kind = ",".join(f"{k}:{PROPERTIES[k][1]}" for k in keys)
    return _first(selector, lambda n, d, b: {k: PROPERTIES[k][0](n, d, b) for k in keys}, f"struct<{kind}>")


def edit_view(edit: Callable[[Node], Any]) -> View:
    """The page's HTML after an edit of its document, as by pagewright.dom.forms."""

    def of(d: Node, base: str) -> str:
        edit(d)
        return outer_html(d)

    return View(of, "string")


def schema_type(schema: dict[str, dict]) -> T.StructType:
    """The Spark type of the records that a normalized extraction schema gives."""
    scalar = {"string": T.StringType(), "number": T.DoubleType(), "boolean": T.BooleanType()}
    fields = []
    for key, f in schema.items():
        own = scalar[f["type"]] if f["fields"] is None else schema_type(f["fields"])
        fields.append(T.StructField(key, T.ArrayType(own) if f["list"] else own))
    return T.StructType(fields)


def extract_view(schema: dict | str) -> View:
    """Typed records; the schema is a dict or its JSON text."""
    wanted = data.normalized(json.loads(schema) if isinstance(schema, str) else schema)
    return View(lambda d, b: data.extract(d, wanted, b), schema_type(wanted).simpleString() if wanted else "struct<>")


def _arrow(kind: str) -> pa.DataType:
    return to_arrow_type(T._parse_datatype_string(kind))


def batch_views(chosen: dict[str, View], types: pa.DataType, closed: bool = False) -> Callable[[pa.Array, pa.Array], pa.Array]:
    """The function from htmls and base URLs to structs of the views."""
    by_tokens = not closed and all(v.flat is not None for v in chosen.values())

    def page(html: str | None, base: str | None) -> dict | None:
        if html is None:
            return None
        if by_tokens and (tokens := read(html)) is not None:
            return {name: v.flat(tokens, base or "") for name, v in chosen.items()}
        document = parse(html, unescape_closed) if closed else parse(html)
        return {name: v.of(document, base or "") for name, v in chosen.items()}

    def run(htmls: pa.Array, bases: pa.Array) -> pa.Array:
        done, held, size = [], [], 0
        for h, b in zip(htmls, bases, strict=True):
            html = h.as_py()
            held.append(page(html, b.as_py()))
            size += len(html or "")
            if size >= SLICE_CHARS:
                done.append(pa.array(held, types))
                held, size = [], 0
        return pa.concat_arrays([*done, pa.array(held, types)])

    return run


def with_views(pages: DataFrame, views: dict[str, View | str], html: str | Column = "html", base: str | Column = "url", closed: bool = False) -> DataFrame:
    """`pages` with a column for each view. The views of a row share one parse; a null page gives nulls.

    The columns come from a single Arrow UDF: filters on other columns run before it, and without a use of the views it
    doesn't run at all. Where all views can do with a page's tokens, no tree is built. Python objects are held for
    about `SLICE_CHARS` of html at a time, then they are Arrow data. With `closed`, references in text count only if a
    semicolon ends them; browsers decode "&amp" and "&copy" without one, too.
    """
    chosen = {name: VIEWS[v] if isinstance(v, str) else v for name, v in views.items()}
    kind = "struct<" + ",".join(f"`{name}`:{v.type}" for name, v in chosen.items()) + ">"

    views_of = batch_views(chosen, _arrow(kind), closed)

    @F.arrow_udf(kind)
    def run(htmls: pa.Array, bases: pa.Array) -> pa.Array:
        return views_of(htmls, bases)

    html_col = F.col(html) if isinstance(html, str) else html
    base_col = F.col(base) if isinstance(base, str) else base
    held = pages.withColumn("_views", run(html_col, base_col))
    return held.select(*[c for c in pages.columns if c not in chosen], *(F.col("_views").getField(name).alias(name) for name in chosen))


def with_view(pages: DataFrame, name: str, view: View | str, html: str = "html", base: str = "url", closed: bool = False) -> DataFrame:
    return with_views(pages, {name: view}, html, base, closed)


def each(rows: DataFrame, column: str, *keys: str, place: str | None = None) -> DataFrame:
    """(keys, place, column): the elements of a view's arrays, one a row.

    By the outer form, as Catalyst puts a filter on the array under the other one, and that would parse every page twice.
    """
    made = F.posexplode_outer(column).alias(place, column) if place else F.explode_outer(column).alias(column)
    return rows.select(*keys, made).where(F.col(column).isNotNull())


def query(pages: DataFrame, selector: str, kind: str = "auto", key: str = "page_id") -> DataFrame:
    """(key, ord, node, html, text, value): one row a match, in document order."""
    found = with_view(pages, "m", query_view(selector, kind))
    return each(found, "m", key, place="ord").select(key, "ord", "m.*")


def query_first(pages: DataFrame, selector: str, kind: str = "auto", key: str = "page_id") -> DataFrame:
    return query(pages, selector, kind, key).where("ord = 0").drop("ord")


def node_batches(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of the node table from batches (key, html), some for each `SLICE_CHARS` of html at a time."""

    def made() -> pa.RecordBatch:
        columns = [pa.array(keys, schema.field(0).type), *(pa.array([r[f.name] for r in rows], f.type) for f in list(schema)[1:])]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    keys, rows, size = [], [], 0
    for batch in batches:
        for key, html in zip(batch.column(0), batch.column(1), strict=True):
            html = html.as_py()
            if html is None:
                continue
            found = _nodes(parse(html), "")
            keys += [key.as_py()] * len(found)
            rows += found
            size += len(html)
            if size >= SLICE_CHARS:
                yield made()
                keys, rows, size = [], [], 0
    yield made()


def nodes(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """The node table: one row a node; a node's descendants are those with ids from its own to its end_id."""
    slim = pages.select(F.col(key), F.col("html"))
    node = T._parse_datatype_string(NODE_TYPE).elementType
    types = T.StructType([T.StructField(key, slim.schema[key].dataType), *node.fields])
    schema = to_arrow_schema(types)
    return slim.mapInArrow(lambda batches: node_batches(batches, schema), types)


def navigation_records(pages: DataFrame, item_selector: str | None = None, key: str = "page_id", status: Column | None = None) -> DataFrame:
    """(key, url, status, title, links, items): what one navigation leaves; links repeat and keep every scheme."""
    found = with_views(pages, {"title": "title", "links": "anchors", "items": count_view(item_selector) if item_selector else View(lambda d, b: 0, "int", lambda f, b: 0)})
    return found.select(key, "url", (F.lit(200) if status is None else status).cast("int").alias("status"), "title", "links", "items")
