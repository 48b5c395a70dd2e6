"""Queries over what the test pages lack, on a page made from each page of the table: its number and the letters of its title
fill a template. Every query has a row or more for each page of the table."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.dom import forms
from pagewright.functions import scalars
from pagewright.operators import matches, side_tables, stats
from pagewright.operators import nodes as N
from pagewright.operators import pages as P
from pagewright.operators.crawl import attempts, crawl
from pagewright.sources import web
from pagewright.sources.shared import durable

from .base import HREFS, LINK, ORIGIN, pages_of, query, table

#: page_id and k, url, o (its origin) and w (its title's letters, after an x).
MADE = f"WITH m AS (SELECT page_id, page_id AS k, url, html, {ORIGIN} AS o, 'x' || regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[^A-Za-z]', '', 'g') AS w FROM pages)"


def filled(template: str) -> Column:
    """A template with {k} and {w} as a column."""
    parts = re.split(r"(\{[kw]\})", template)
    return F.concat(*(F.col("k").cast("string") if x == "{k}" else F.col("w") if x == "{w}" else F.lit(x) for x in parts))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, html, k, w) of the table's own pages."""
    letters = F.regexp_replace(F.regexp_extract("html", "<title>([^<]*)</title>", 1), "[^A-Za-z]", "")
    return pages_of(spark, sf_dir).select("page_id", "url", "html", F.col("page_id").alias("k"), F.concat(F.lit("x"), letters).alias("w"))


def made(spark: SparkSession, sf_dir: str, *templates: str) -> DataFrame:
    """The same with html from the templates in turn."""
    html = filled(templates[-1])
    for i, template in enumerate(templates[:-1]):
        html = F.when(F.col("k") % len(templates) == i, filled(template)).otherwise(html)
    return facts(spark, sf_dir).withColumn("html", html)


# --- forms and clicks -------------------------------------------------------------------------------------------------

_FORMS = (
    '<form action="/find?before=1"><input name=term value="{w}"><input name=page value={k}><input name=off value=x disabled><input value=nameless><input type=submit name=go value=1></form>',
    '<form method=post action=/save><input name=a value="{w} {k}"><input type=checkbox name=c checked><input type=radio name=r value=no><select name=s><option value=a>A<option selected>{w} b</select><textarea name=t>lost</textarea></form>',
    "<form action=https://other.test/f><button name=b>{w}</button></form>",
)


@query(f"""{MADE} SELECT page_id, CASE k % 3 WHEN 1 THEN 'POST' ELSE 'GET' END AS method,
  CASE k % 3 WHEN 0 THEN o || '/find?term=' || w || '&page=' || k WHEN 1 THEN o || '/save' ELSE 'https://other.test/f?' END AS url,
  CASE k % 3 WHEN 1 THEN 'a=' || w || '+' || k || '&c=on&s=' || w || '+b&t=' END AS body FROM m""")
def form_submissions(spark, sf_dir):
    return P.each(P.with_view(made(spark, sf_dir, *_FORMS), "f", "forms"), "f", "page_id").select("page_id", "f.method", "f.url", "f.body")


@query(f"{MADE} SELECT page_id, CASE k % 3 WHEN 0 THEN 2 WHEN 1 THEN 4 ELSE 0 END::INTEGER AS n_pairs, 1 AS n_forms FROM m")
def page_forms(spark, sf_dir):
    f = F.col("f")
    return P.with_view(made(spark, sf_dir, *_FORMS), "f", "forms").select("page_id", F.size(f[0]["pairs"]).alias("n_pairs"), F.size(f).alias("n_forms"))


@query(f"""{MADE} SELECT page_id, o || '/find?term=new+' || k || '&page=2' AS filled, o || '/s?v=' || (CASE WHEN k % 2 = 0 THEN 'one' ELSE 'second' END) || '&on=on' AS chosen FROM m""")
def form_fills(spark, sf_dir):
    """Fields set in the page, then submitted; an option by its value or its label, a box that is checked and one that is not."""
    filling = made(spark, sf_dir, "<form action=/find><input name=term value={w}><input name=page value={k}></form>")
    choosing = made(spark, sf_dir, *("<form action=/s><select name=v><option value=one>First<option value=second selected={k}>%s</select><input type=checkbox name=on><input type=checkbox name=off checked></form>" % x for x in ("Other", "Last")))

    def fill(d):
        forms.fill_many(d, {"[name=term]": "new " + d_number(d), "[name=page]": "2", "[name=none]": "3"})

    def d_number(d):
        return P.select_first(d, "[name=page]").attrs["value"]

    def choose(d):
        forms.select_option(d, "select", "First")
        forms.select_option(d, "select", "Last")
        forms.set_checked(d, "[name=on]", True)
        forms.set_checked(d, "[name=off]", False)

    def sent(pages: DataFrame, edit, name: str) -> DataFrame:
        edited = P.with_view(pages, "html", P.edit_view(edit))
        return P.with_view(edited, "f", "forms").select("page_id", F.col("f")[0]["url"].alias(name))

    return sent(filling, fill, "filled").join(sent(choosing, choose, "chosen"), "page_id")


@query(f"""{MADE} SELECT page_id, CASE k % 3 WHEN 0 THEN 'navigate' WHEN 1 THEN 'submit' ELSE 'inert' END AS action,
  CASE k % 3 WHEN 0 THEN o || '/n' || k WHEN 1 THEN o || '/f?b=' || k END AS url FROM m""")
def click_intents(spark, sf_dir):
    own = made(spark, sf_dir, "<a href=/n{k}><b class=t>{w}</b></a>", "<form action=/f><button class=t name=b value={k}>{w}</button></form>", "<i class=t>{w}</i>")
    return P.with_view(own, "c", P.property_view(".t", "click")).select("page_id", "c.action", "c.url")


@query(f"""{MADE} SELECT page_id, CASE WHEN k % 2 = 0 THEN 'navigate' ELSE 'inert' END AS action, CASE WHEN k % 2 = 0 THEN {LINK} END AS url
  FROM (SELECT *, {HREFS}[1] AS href FROM m)""")
def click_targets(spark, sf_dir):
    """The first link of the table's own pages; every other page has lost its targets."""
    own = pages_of(spark, sf_dir).withColumn("html", F.when(F.col("page_id") % 2 == 0, F.col("html")).otherwise(F.regexp_replace("html", "<a href=", "<a name=")))
    return P.with_view(own, "c", P.property_view("nav a", "click")).select("page_id", "c.action", "c.url")


# --- state of scripts -------------------------------------------------------------------------------------------------

_STATE = """<script id="__NEXT_DATA__" type="application/json">{"page":{k}}</script><script type="application/ld+json">{"name":"{w}"}</script><script type="application/ld+json">broken</script>
<script type="application/json" id=part>{"b":[{k}]}</script><script>window.__INITIAL_STATE__ = {"s":"}{","k":{k}}; __NUXT__=[oops]; __NUXT__ = [{k}]</script>"""


@query(f"""{MADE} SELECT page_id, '{{"page":' || k || '}}' AS next, '{{"name":"' || w || '"}}' AS json_ld, '{{"b":[' || k || ']}}' AS part, '{{"s":"}}{{","k":' || k || '}}' AS initial, '[' || k || ']' AS nuxt FROM m""")
def hydration_state(spark, sf_dir):
    h = F.col("h")
    return P.with_view(made(spark, sf_dir, _STATE), "h", "hydration").select("page_id", "h.next", F.array_join(h["json_ld"], ",").alias("json_ld"), h["json"]["part"].alias("part"), h["states"]["__INITIAL_STATE__"].alias("initial"), h["states"]["__NUXT__"].alias("nuxt"))


@query(f"{MADE} SELECT page_id, (k % 2)::INTEGER AS n_json_ld, (2 * (k % 2))::INTEGER AS n_states, k % 2 = 0 AS no_next FROM m")
def hydration(spark, sf_dir):
    """Every other page carries state."""
    own = made(spark, sf_dir, _STATE).withColumnRenamed("html", "state").join(facts(spark, sf_dir).select("page_id", "html"), "page_id")
    own = own.withColumn("html", F.when(F.col("k") % 2 == 1, F.concat("state", "html")).otherwise(F.col("html")))
    return P.with_view(own, "h", "hydration").select("page_id", F.size("h.json_ld").alias("n_json_ld"), F.size("h.states").alias("n_states"), F.isnull("h.next").alias("no_next"))


@query(f"""{MADE} SELECT page_id, k % 3 <> 0 AS js_required, CASE k % 3 WHEN 0 THEN 0 ELSE 1 END AS scripts FROM m""")
def needs_scripts(spark, sf_dir):
    own = made(spark, sf_dir, "", "<div id=root></div><script src=/app{k}.js></script>", "<p>{k}</p><script src=/app.js></script>")
    real = facts(spark, sf_dir).select("page_id", F.col("html").alias("whole"))
    own = own.join(real, "page_id").withColumn("html", F.when(F.col("k") % 3 == 0, F.col("whole")).otherwise(F.col("html")))
    return P.with_view(own, "d", "needs_scripts").select("page_id", "d.js_required", "d.scripts")


# --- properties -------------------------------------------------------------------------------------------------------

_HIDDEN = (
    "<b hidden>{w}", "<input type=hidden class=t value={k}>", "<div style='display: none'><b>{w}", "<style>.h{display:none}</style><b class=h>{w}", "<div style='visibility:hidden'><b>{w}", "<b style='opacity:0'>{w}", "<b aria-hidden=true>{w}", "<b>{w}",
)


@query(f"{MADE} SELECT page_id, k % 8 > 5 AS visible FROM m")
def visibility(spark, sf_dir):
    return P.with_view(made(spark, sf_dir, *_HIDDEN), "visible", P.property_view("b, .t", "is_visible")).select("page_id", "visible")


@query(f"""{MADE} SELECT page_id, k % 2 = 1 AS checked, k % 3 <> 1 AS enabled, k % 3 = 0 AS editable, false AS focused, true AS empty, k::VARCHAR AS value,
  CASE WHEN k % 6 IN (0, 2, 4) THEN 'textbox' ELSE 'checkbox' END AS role FROM m""")
def control_states(spark, sf_dir):
    kinds = [f"<input class=t value={{k}} {'type=checkbox checked' if i % 2 else 'type=text'} {('', 'disabled', 'readonly')[i % 3]}>" for i in range(6)]
    views = {k: P.property_view(".t", v) for k, v in (("checked", "is_checked"), ("enabled", "is_enabled"), ("editable", "is_editable"), ("focused", "is_focused"), ("empty", "is_empty"), ("value", "input_value"), ("role", "role"))}
    return P.with_views(made(spark, sf_dir, *kinds), views).select("page_id", *views)


@query(f"""{MADE} SELECT page_id, ' ' || w || chr(10) || 'and ' || k || 'var a' AS text_content, w || ' and ' || k AS inner_text, ' <b>' || w || '</b>' || chr(10) || 'and ' || k || '<script>var a</script>' AS inner_html,
  '<p class="t"> <b>' || w || '</b>' || chr(10) || 'and ' || k || '<script>var a</script></p>' AS outer_html, false AS is_empty FROM m""")
def text_properties(spark, sf_dir):
    """Raw text, reading text and both serializations of an element."""
    views = {k: P.property_view(".t", k) for k in ("text_content", "inner_text", "inner_html", "outer_html", "is_empty")}
    return P.with_views(made(spark, sf_dir, "<p class=t> <b>{w}</b>\nand {k}<script>var a</script>"), views).select("page_id", *views)


@query(f"{MADE} SELECT page_id, k % 3 <> 2 AS is_empty, '' AS value FROM m")
def empty_elements(spark, sf_dir):
    views = {"is_empty": P.property_view(".t", "is_empty"), "value": P.property_view(".t", "input_value")}
    return P.with_views(made(spark, sf_dir, "<p class=t> <!-- {w} -->\n</p>", "<p class=t></p>{w}", "<p class=t><i></i></p>"), views).select("page_id", *views)


@query(f"""{MADE} SELECT page_id, 'two ' || w || ' one' AS description, CASE WHEN k % 2 = 0 THEN 'two ' || w ELSE '' END AS error_message, 'tip ' || k AS by_title,
  CASE k % 4 WHEN 0 THEN 'label ' || w WHEN 1 THEN 'T  ' || w WHEN 2 THEN 'hint' ELSE '' || k END AS name FROM m""")
def names_and_descriptions(spark, sf_dir):
    """Ids that a description names in its own order, missing ones skipped; an error only where the control is invalid; four sources of names."""
    texts = "<i id=d1> one</i><i id=d2>two  {w}</i><b title=' tip {k} '>"
    described = "<input class=d aria-describedby='d2 nope d1' title=x aria-invalid=%s aria-errormessage=d2>"
    named = ("<button class=n aria-label=' label {w} '>x</button>", "<button class=n> T  {w} </button>", "<input class=n placeholder=hint value={k}>", "<input class=n value={k} title=x>")
    own = made(spark, sf_dir, *(texts + described % ("true" if i % 2 == 0 else "false") + named[i] for i in range(4)))
    views = {"description": P.property_view(".d", "description"), "error_message": P.property_view(".d", "error_message"), "by_title": P.property_view("b", "description"), "name": P.property_view(".n", "name")}
    return P.with_views(own, views).select("page_id", *views)


@query(f"""{MADE} SELECT page_id, CASE k % 2 WHEN 0 THEN 'a' || k || ',' || w || ' b' ELSE '' END AS selected, 'none' AS display, CASE k % 2 WHEN 0 THEN 'red' ELSE 'blue' END AS color FROM m""")
def selected_and_computed(spark, sf_dir):
    """Selected options by value or label, none by default; computed values with importance, specificity and inheritance."""
    page = "<style>.c{color:red} div{color:green;display:block} #i{display:none!important}</style><div id=i class=c style='display:inline%s'><u></u><select multiple><option value=a{k}%s>x<option%s>{w} b <option>c</select></div>"
    own = made(spark, sf_dir, page % ("", " selected", " selected"), page % (";color:blue", "", ""))
    views = {"s": P.property_view("select", "selected_values"), "display": P.css_view("#i", "display"), "color": P.css_view("u", "color")}
    return P.with_views(own, views).select("page_id", F.array_join("s", ",").alias("selected"), "display", "color")


@query(f"""{MADE} SELECT page_id, 'button' AS role, 'Go ' || w AS name, 'Go ' || w AS text, '' AS value, k % 2 = 0 AS visible, true AS enabled, false AS editable, false AS is_empty FROM m""")
def node_snapshots(spark, sf_dir):
    """Nine properties of a node in one read."""
    own = made(spark, sf_dir, *("<button%s>Go {w}</button>" % x for x in ("", " hidden")))
    s = F.col("s")
    return P.with_view(own, "s", P.snapshot_view("button")).select("page_id", "s.role", "s.name", s["text_content"].alias("text"), s["input_value"].alias("value"), s["is_visible"].alias("visible"), s["is_enabled"].alias("enabled"), s["is_editable"].alias("editable"), "s.is_empty")


@query(f"SELECT page_id, {HREFS}[1] AS href, false AS checked, true AS enabled, CASE WHEN page_id % 2 = 0 THEN 'link' ELSE 'tab' END AS role FROM pages")
def first_link_properties(spark, sf_dir):
    own = pages_of(spark, sf_dir).withColumn("html", F.when(F.col("page_id") % 2 == 0, F.col("html")).otherwise(F.regexp_replace("html", "<a href=", "<a role=tab href=")))
    views = {"href": P.attribute_view("a", "href"), "checked": P.property_view("a", "is_checked"), "enabled": P.property_view("a", "is_enabled"), "role": P.property_view("a", "role")}
    return P.with_views(own, views).select("page_id", *views)


# --- accessibility ----------------------------------------------------------------------------------------------------

_TREE = "<div><nav><a href=/>{w}</a><a href=/b>B{k}</a></nav><div><h1>T {w}</h1><span></span></div><input value=v{k}></div>"


@query(f"""{MADE} SELECT page_id, t.* FROM m, LATERAL (VALUES (0, 'navigation', w || 'B' || k, NULL), (1, 'link', w, NULL), (1, 'link', 'B' || k, NULL), (0, 'heading', 'T ' || w, NULL), (0, 'textbox', '', 'v' || k)) t(depth, role, name, value)""")
def accessibility_tree(spark, sf_dir):
    return P.each(P.with_view(made(spark, sf_dir, _TREE), "a", "ax_nodes"), "a", "page_id").select("page_id", "a.depth", "a.role", "a.name", "a.value")


@query(f"""{MADE} SELECT page_id, '- navigation "' || w || 'B' || k || '"' || chr(10) || '  - link "' || w || '"' || chr(10) || '  - link "B' || k || '"' || chr(10) || '- heading "T ' || w || '"' || chr(10) || '- textbox' AS snapshot,
  '{{"role":"link","name":"' || w || '"}}' AS only FROM m""")
def aria_outlines(spark, sf_dir):
    """The snapshot of a body, and the JSON tree of one where a wrapper gives way to its only child."""
    shown = P.with_view(made(spark, sf_dir, _TREE), "snapshot", "aria_snapshot").select("page_id", "snapshot")
    only = P.with_view(made(spark, sf_dir, "<div><span><a>{w}</a></span></div>"), "only", "ax").select("page_id", "only")
    return shown.join(only, "page_id")


@query(f"{MADE} SELECT page_id, k % 2 = 0 AS in_order, k % 2 = 1 AS reversed, true AS loose FROM m")
def aria_snapshot_match(spark, sf_dir):
    own = made(spark, sf_dir, "<nav><a href=/>Start</a><i>{w}</i><a href=/b>Back</a></nav>", "<nav><a href=/b>Back</a><a href=/>Start</a>{k}</nav>")
    views = {"in_order": P.matches_snapshot_view("nav", '- navigation\n  - link "Start"\n  - link /^b/i'), "reversed": P.matches_snapshot_view("nav", '- link "Back"\n- link "Start"'), "loose": P.matches_snapshot_view("nav", "- link")}
    return P.with_views(own, views).select("page_id", *views)


# --- locators ---------------------------------------------------------------------------------------------------------


@query(f"{MADE} SELECT page_id, 1 AS deepest, 1 AS exact, CASE WHEN k % 2 = 0 THEN 2 ELSE 0 END AS by_regex, 0 AS case_counts, 2 AS any_case FROM m")
def locate_by_text(spark, sf_dir):
    """The deepest match counts; parts in any case, patterns with and without flag, exact texts."""
    own = made(spark, sf_dir, *("<div>a <span>target</span></div><p>Item {k}%s</p><p>item {w}%s</p>" % (x, x) for x in (" even", " odd")))
    n = {"deepest": ("target", False), "exact": ("target", True), "by_regex": ("/EVEN$/i", False), "case_counts": ("/EVEN$/", False), "any_case": ("ITEM", False)}
    views = {name: P.locate_view("text", want, exact) for name, (want, exact) in n.items()}
    return P.with_views(own, views).select("page_id", *(F.size(name).alias(name) for name in n))


@query(f"{MADE} SELECT page_id, CASE k % 2 WHEN 0 THEN 'f' || k || ',a' ELSE 'w,b' END AS found FROM m")
def locate_by_label(spark, sf_dir):
    """Controls by for and id, inside the label, by aria-labelledby and by aria-label."""
    own = made(spark, sf_dir, "<label for=f{k}>Name</label><input id=f{k}><input id=a aria-label=Name><label>Other <input id=o></label>", "<label>Name <input id=w><input id=second></label><label id=l>Name</label><input id=b aria-labelledby='z l'>{w}")
    ids = F.transform(F.col("m"), lambda x: F.regexp_extract(x["html"], 'id="([^"]*)"', 1))
    return P.with_view(own, "m", P.locate_view("label", "Name", True)).select("page_id", F.array_join(ids, ",").alias("found"))


@query(f"{MADE} SELECT page_id, w AS placeholder, 'Picture ' || k AS alt, 'tip' AS title, 't' || k AS testid FROM m")
def locate_by_attribute(spark, sf_dir):
    own = made(spark, sf_dir, "<input placeholder='Search here' data-w={w}><input placeholder=other><img alt='Picture {k}' src=x><b title=' Tip '>tip</b><i data-testid=box data-t=t{k}>y</i>")
    value = lambda column, name: F.regexp_extract(F.col(column)[0]["html"], f'{name}="([^"]*)"', 1)
    views = {"p": P.locate_view("placeholder", "search"), "a": P.locate_view("alt", "/^Pict/"), "t": P.locate_view("title", "tip"), "i": P.locate_view("testid", "box", True)}
    found = P.with_views(own, views)
    return found.select("page_id", value("p", "data-w").alias("placeholder"), value("a", "alt").alias("alt"), F.col("t")[0]["text"].alias("title"), value("i", "data-t").alias("testid"))


@query(f"{MADE} SELECT page_id, how FROM m, LATERAL (VALUES ('aria-labelledby'), ('for'), ('wrap')) h(how)")
def label_joins(spark, sf_dir):
    """Labels and their controls as joins over the node table."""
    own = made(spark, sf_dir, "<label for=f{k}>{w}</label><input id=f{k}><label>W <input></label><label id=l>B</label><input aria-labelledby='z l'>")
    return N.labelled_controls(durable(P.nodes(own), "nodes")).select("page_id", "how")


@query(f"{MADE} SELECT page_id, 'two ' || w || ' one' AS description FROM m")
def aria_id_joins(spark, sf_dir):
    """Descriptions by joins over the node table; controls whose ids name nothing have none."""
    own = made(spark, sf_dir, "<i id=d1> one</i><i id=d2>two  {w}</i><input aria-describedby='d2 nope d1'><input aria-describedby=nope{k}>")
    return matches.described_by(durable(P.nodes(own), "nodes")).select("page_id", "description")


@query(f"{MADE} SELECT page_id, 'first ' || w AS text, (k % 3)::INTEGER AS n_second FROM m")
def first_matches(spark, sf_dir):
    """The first match of a page alone, and how often a selector matches within what another found."""
    own = made(spark, sf_dir, *("<ul><li>first {w}</li>" + "<li class=s>{k}</li>" * i + "</ul>" for i in range(3)))
    first = P.query_first(own, "li").select("page_id", "text")
    return first.join(P.with_view(own, "n_second", P.count_view("ul > li.s")).select("page_id", "n_second"), "page_id")


@query(f"{MADE} SELECT page_id, count(*) AS n FROM m, LATERAL (SELECT unnest(range(0, 1 + k % 4))) GROUP BY ALL")
def distinct_handles(spark, sf_dir):
    """Elements that two selectors find count once."""
    own = durable(made(spark, sf_dir, *("<ul>" + "<li class=k>{w}</li>" * (i + 1) + "</ul>" for i in range(4))), "pages")
    both = P.query(own, "li").unionByName(P.query(own, "//li[@class='k']"))
    return both.dropDuplicates(["page_id", "node"]).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


_SELECTORS = ["li", "ul > li", "#two li", ".k.m", "[data-x~='2']", "li:first-child", "li:not(.k)", "ul ~ ul li", "p", "li:nth-child(2n)", "//ul[2]/li", "//li[@class]", "//li[9]", "//li[contains(text(),'a')]"]


@query(f"""{MADE} SELECT page_id, s.* FROM (SELECT page_id, k % 4 AS a, k % 3 AS b FROM m), LATERAL (VALUES ('li', a + b), ('ul > li', a + b), ('#two li', b), ('.k.m', b), ('[data-x~=''2'']', a), ('li:first-child', (a > 0)::INT + (b > 0)::INT),
  ('li:not(.k)', a), ('ul ~ ul li', b), ('p', 0), ('li:nth-child(2n)', a // 2 + b // 2), ('//ul[2]/li', b), ('//li[@class]', b), ('//li[9]', 0), ('//li[contains(text(),''a'')]', a)) s(selector, n)""")
def selector_counts(spark, sf_dir):
    own = made(spark, sf_dir, *("<ul>" + "<li data-x='1 2'>a" * (i % 4) + "</ul><ul id=two>" + '<li class="k m">b{k}' * (i % 3) + "</ul>" for i in range(12)))
    views = {f"s{i}": P.View(lambda d, b, s=s: len(P.find(d, s)), "bigint") for i, s in enumerate(_SELECTORS)}
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("selector"), F.col(f"s{i}").alias("n")) for i, s in enumerate(_SELECTORS))))
    return P.with_views(own, views).select("page_id", each.alias("t")).select("page_id", "t.*")


# --- content ----------------------------------------------------------------------------------------------------------

_ARTICLE = "<nav>menu</nav><header>Top</header><h2>{w}</h2><p>a <b>{w}</b> <i>c</i> <code>d{k}</code> <a href=/x{k}>e</a> <b> </b></p><ol><li>x<li> <li>{k}</ol><table><tr><th>A<th>B<tr><td>{k}<td>2|</table><blockquote>q <em>{w}</em></blockquote><hr><pre>c  {k}\n</pre><aside>x</aside>"


@query(f"""{MADE} SELECT page_id, 'Top' || e || '## ' || w || e || 'a **' || w || '** *c* `d' || k || '` [e](' || o || '/x' || k || ')' || e || '1. x' || chr(10) || '2. ' || k || e ||
  '| A | B |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || k || ' | 2\\| |' || e || '> q *' || w || '*' || e || '---' || e || '```' || chr(10) || 'c  ' || k || chr(10) || '```' AS markdown FROM (SELECT *, chr(10) || chr(10) AS e FROM m)""")
def markdown_blocks(spark, sf_dir):
    """Every kind of block and of inline markup."""
    return P.with_view(made(spark, sf_dir, _ARTICLE), "markdown", "markdown").select("page_id", "markdown")


@query(f"""{MADE} SELECT page_id, CASE k % 2 WHEN 0 THEN 'in ' || w ELSE 'all ' || k END AS markdown FROM m""")
def markdown_roots(spark, sf_dir):
    """The main element alone, where there is one."""
    return P.with_view(made(spark, sf_dir, "<p>out</p><main><p>in {w}</p></main>", "<p>all {k}</p><footer>f</footer>"), "markdown", "markdown").select("page_id", "markdown")


@query(f"""{MADE} SELECT page_id, '<html><head><title>' || w || '</title></head><body><p>a<b>' || k || '</b></p><p><b>x &amp; y</b></p><table><tbody><tr><td>1</td></tr></tbody></table></body></html>' AS html FROM m""")
def serialized_pages(spark, sf_dir):
    """The tree that is built, with its implied tags, written out."""
    return P.with_view(made(spark, sf_dir, "<title>{w}</title><p>a<b>{k}<p>x & y</b><table><tr><td>1</table>"), "html", "html").select("page_id", "html")


@query(f"{MADE} SELECT page_id, 'a b' AS ascii_only, 'a b c' AS unicode, w || ' b c' AS words FROM m")
def white_space(spark, sf_dir):
    """The three rules of collapsing, side by side."""
    c = F.concat(F.lit("a \t"), F.lit("b"))
    wide = F.concat(F.lit("a "), F.lit("b \tc"))
    return facts(spark, sf_dir).select("page_id", scalars.collapse_ascii(c).alias("ascii_only"), scalars.collapse_unicode(wide).alias("unicode"), scalars.collapse_words(F.concat(F.lit("　 "), "w", F.lit(" b\n\nc "))).alias("words"))


_CARDS = "<h1>Cards</h1>" + "".join(f'<div class=card><h2><a href="/p/{i}/{{k}}">{n} {{w}}</a></h2><b class=price>{p}</b></div>' for i, (n, p) in enumerate([("Pen", "EUR {k}.75"), ("Ink", "{k},250"), ("Pad", "sold out")]))


@query(f"""{MADE} SELECT page_id, t.* FROM m, LATERAL (VALUES ('Pen ' || w, k + 0.75::DOUBLE, o || '/p/0/' || k), ('Ink ' || w, (k || '250')::DOUBLE, o || '/p/1/' || k), ('Pad ' || w, NULL, o || '/p/2/' || k)) t(name, price, link)""")
def schema_records(spark, sf_dir):
    schema = {"cards": {"selector": ".card", "list": True, "fields": {"name": {"selector": "h2"}, "price": {"selector": ".price", "type": "number"}, "link": {"selector": "a", "attr": "href"}}}}
    found = P.with_view(made(spark, sf_dir, _CARDS), "r", P.extract_view(schema)).select("page_id", F.col("r.cards").alias("c"))
    return P.each(found, "c", "page_id").select("page_id", "c.name", "c.price", "c.link")


@query(f"{MADE} SELECT page_id, unnest(['/a' || k || '.css', w || '.css']) AS href FROM m")
def stylesheets(spark, sf_dir):
    own = made(spark, sf_dir, """<link rel="stylesheet" href=" /a{k}.css "><LINK href={w}.css rel='preload StyleSheet'><link rel="alternate stylesheet" href=c><link rel=icon href=d>""")
    return own.select("page_id", F.explode(scalars.stylesheet_hrefs(F.col("html"))).alias("href"))


# --- scalars ----------------------------------------------------------------------------------------------------------


@query("""SELECT page_id, CASE k % 5 WHEN 0 THEN k + 0.25::DOUBLE WHEN 1 THEN (k || '299')::DOUBLE WHEN 4 THEN -k::DOUBLE END AS number, k % 5 <> 3 AS flag FROM (SELECT page_id, page_id AS k FROM pages)""")
def number_coercion(spark, sf_dir):
    kinds = ("EUR {k}.25", "{k},299", "{k}-20", "", "-{k}")
    raw = F.col("html")
    return made(spark, sf_dir, *kinds).select("page_id", scalars.to_number(raw).alias("number"), scalars.to_flag(raw).alias("flag"))


@query("SELECT event_id, epoch_ms(date_trunc('second', ts)) AS ms FROM events")
def http_dates(spark, sf_dir):
    """The times of all events, each written in one of the three forms that HTTP knows."""
    ts = F.col("ts").cast("timestamp")
    form = F.when(F.col("event_id") % 3 == 0, F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).when(F.col("event_id") % 3 == 1, F.date_format(ts, "EEEE, dd-MMM-yy HH:mm:ss 'GMT'")).otherwise(F.date_format(ts, "EEE MMM d HH:mm:ss yyyy"))
    return table(spark, sf_dir, "events").select("event_id", F.unix_millis(scalars.http_date(form)).alias("ms"))


@query(f"{MADE} SELECT page_id, 'https://h.test/?a=1&a=2&b=' || k || '&c=' || w AS canonical FROM m")
def query_order(spark, sf_dir):
    """Query pairs by key, then by value, without what tracks."""
    return facts(spark, sf_dir).select("page_id", scalars.canonical_url(filled("https://H.test:443?c={w}&a=2&utm_source=x&b={k}&a=1#f")).alias("canonical"))


# --- sources and sinks ------------------------------------------------------------------------------------------------


@query("""SELECT page_id, CASE page_id % 4 WHEN 2 THEN 'not html' WHEN 3 THEN 'body too large' END AS error, CASE WHEN page_id % 4 < 2 THEN length(html) END::BIGINT AS n_chars FROM pages""")
def stored_responses(spark, sf_dir):
    """Type gate (a missing type passes), byte cap and decoding; what fails is reported."""
    big = F.lit(1 << 20)
    rows = table(spark, sf_dir, "pages").select(
        "page_id", F.when(F.col("page_id") % 4 == 3, F.concat("html", F.repeat(F.lit(" "), big))).otherwise(F.col("html")).cast("binary").alias("body"), F.element_at(F.array(F.lit("text/html; charset=utf-8"), F.lit(None), F.lit("image/png"), F.lit("text/html")), (F.col("page_id") % 4 + 1).cast("int")).alias("content_type")
    )
    return web.judged_responses(rows, most_bytes=1 << 20).select("page_id", "error", F.char_length("html").cast("long").alias("n_chars"))


@query("""SELECT page_id, CASE page_id % 6 WHEN 5 THEN 'é€' ELSE 'é' || CASE page_id % 6 WHEN 0 THEN '€' WHEN 1 THEN 'ő' WHEN 2 THEN '€' WHEN 3 THEN 'ж' ELSE chr(65533) END END AS text FROM pages""")
def charsets(spark, sf_dir):
    """Labels as the web means them: latin-1 and ascii are windows-1252, an unknown one is UTF-8, a byte order mark outranks all."""
    kinds = [("iso-8859-1", "E980"), ("iso-8859-2", "E9F5"), ("US-ASCII", "E980"), ("utf8", "C3A9D0B6"), ("x-unknown", "C3A9FF"), ("windows-1251", "EFBBBFC3A9E282AC")]
    k = (F.col("page_id") % 6 + 1).cast("int")
    body = F.unhex(F.element_at(F.array(*(F.lit(h) for _, h in kinds)), k))
    kind = F.concat(F.lit("text/html; charset="), F.element_at(F.array(*(F.lit(c) for c, _ in kinds)), k))
    return table(spark, sf_dir, "pages").select("page_id", web.decoded(body, kind).alias("text"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'POST' WHEN 2 THEN 'GET' ELSE 'GET' END AS final_method, (page_id % 4)::INTEGER AS n_hops, 'https://h.test/' || (page_id - page_id % 4) AS final_url FROM pages""")
def redirects(spark, sf_dir):
    """Chains of up to three hops: 303 from the last, 307 from the third, 302 from the second of each four pages."""
    k = F.col("page_id")
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("https://h.test/"), k.cast("string")).alias("url"))
    before = (k - 1).cast("string")
    hops = pages.where(k % 4 > 0).select("url", F.when(k % 4 == 1, 302).when(k % 4 == 2, 307).otherwise(303).alias("status"), F.when(k % 4 == 3, F.concat(F.lit("https://h.test/"), before)).otherwise(F.concat(F.lit("/"), before)).alias("location"))
    found = web.follow_redirects(pages.select("url", F.lit("POST").alias("method")), hops.unionByName(hops))
    return pages.join(found, "url").select("page_id", "final_method", "n_hops", "final_url")


@query("""SELECT page_id, '{"url":"u' || page_id || '","status":200,"title":"t","links":["l"],"items":3}' AS whole, '{"url":"u' || page_id || '","status":200,"title":"t","items":3}' AS brief FROM (SELECT page_id FROM pages)""")
def record_texts(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(F.concat(F.lit("u"), F.col("page_id").cast("string")).alias("url"), F.lit(200).alias("status"), F.lit("t").alias("title"), F.array(F.lit("l")).alias("links"), F.lit(None).cast("int").alias("depth"), F.lit(None).cast("string").alias("error"), F.lit(3).alias("items"))
    texts = [web.record_json(rows, brief=b).select(F.regexp_extract("value", r'"url":"u(\d+)"', 1).cast("long").alias("page_id"), F.col("value").alias(n)) for n, b in (("whole", False), ("brief", True))]
    return texts[0].join(texts[1], "page_id")


_JAR = """SELECT regexp_extract(url, '^https?://([^/?#:]+)', 1) AS domain, 'c' || (page_id % 3) AS name, max(page_id) AS last FROM pages WHERE page_id % 5 <> 4 GROUP BY ALL"""


def _cookies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page sets one of three cookies, every fifth an expired one of its own name; more than 100 attributes don't matter."""
    k = F.col("page_id")
    many = "; x=1" * 120
    line = F.concat(F.when(k % 5 == 4, F.lit("gone=")).otherwise(F.concat(F.lit("c"), (k % 3).cast("string"), F.lit("="))), k.cast("string"), F.lit(many), F.when(k % 5 == 4, "; Max-Age=0").otherwise("; Path=/; HttpOnly"))
    return side_tables.cookie_jar(table(spark, sf_dir, "pages").select("url", line.alias("set_cookie"), k.alias("seq"), F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("now")))


@query(f"SELECT domain, name, last::VARCHAR AS value, '/' AS path, true AS http_only, 'lax' AS same_site FROM ({_JAR})")
def cookie_jar(spark, sf_dir):
    return _cookies(spark, sf_dir).select("domain", "name", "value", "path", "http_only", "same_site")


@query(f"""SELECT '{{"name":"' || name || '","value":"' || last || '","domain":"' || domain || '","path":"/","expires":-1.0,"httpOnly":true,"secure":false,"sameSite":"Lax"}}' AS value FROM ({_JAR})""")
def cookie_state(spark, sf_dir):
    """The jar written, read back and written again."""
    texts = web.storage_state(_cookies(spark, sf_dir)).unionByName(spark.createDataFrame([("nonsense",)], "value string"))
    return web.storage_state(web.load_storage_state(texts))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'e' || page_id END AS if_none_match, CASE WHEN page_id % 3 = 1 THEN 'Wed, 21 Oct 2015 07:28:00 GMT' END AS if_modified_since FROM pages""")
def conditional_requests(spark, sf_dir):
    """Validators of what is stored; without one nothing is."""
    k = F.col("page_id")
    url = F.concat(F.lit("https://h.test/"), k.cast("string")).alias("url")
    pages = table(spark, sf_dir, "pages")
    stored = pages.select(url, F.when(k % 3 == 0, F.concat(F.lit("e"), k.cast("string"))).alias("etag"), F.when(k % 3 == 1, "Wed, 21 Oct 2015 07:28:00 GMT").alias("last_modified"), "html", F.lit(200).alias("status"), k.alias("seq"))
    return side_tables.conditional_headers(pages.select("page_id", url), side_tables.http_cache(stored)).select("page_id", "if_none_match", "if_modified_since")


# --- crawls -----------------------------------------------------------------------------------------------------------


@query("""SELECT 'u' || page_id AS url, CASE page_id % 4 WHEN 0 THEN 200 WHEN 1 THEN 429 WHEN 2 THEN 0 ELSE 404 END AS status, CASE page_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 1 END AS attempts,
  CASE page_id % 4 WHEN 0 THEN 200 WHEN 1 THEN 600 ELSE 0 END::BIGINT AS waited_ms FROM pages""")
def retry_log(spark, sf_dir):
    """Four histories, one of them with an attempt too many; every line of the log is there twice."""
    one = lambda *statuses: F.array(*(F.struct(F.lit(i).alias("attempt"), F.lit(s).cast("int").alias("status")) for i, s in enumerate(statuses)))
    k = F.col("page_id") % 4
    history = F.when(k == 0, one(503, 200)).when(k == 1, one(500, 500, 429, 200)).when(k == 2, one(None)).otherwise(one(404))
    log = table(spark, sf_dir, "pages").select(F.concat(F.lit("u"), F.col("page_id").cast("string")).alias("url"), F.explode(history).alias("h")).select("url", "h.*")
    return attempts(log.unionByName(log))


def _tree(spark: SparkSession, sf_dir: str, lost: bool) -> DataFrame:
    """A site of all pages: page n links to 2n + 1 and 2n + 2, and, if `lost`, to a page that is missing."""
    n = F.col("page_id")
    url = lambda name: F.concat(F.lit("https://site.test/"), name.cast("string"))
    missing = [url(F.concat(F.lit("lost"), n.cast("string")))] if lost else []
    return table(spark, sf_dir, "pages").select(url(n).alias("url"), F.lit(200).alias("status"), n.cast("string").alias("title"), F.array(url(2 * n + 1), url(2 * n + 2), *missing).alias("links"), F.lit(1).alias("items"))


@query("""SELECT 'https://site.test/' || page_id AS url, floor(log2(page_id + 1))::INTEGER AS depth FROM pages WHERE page_id < (SELECT count(*) // 2 FROM pages)""")
def crawl_max_pages(spark, sf_dir):
    """A limit that is met: half the site's pages, in the order in which they are linked to."""
    corpus = durable(_tree(spark, sf_dir, lost=False), "site")
    n = corpus.count()
    return crawl(corpus, ["https://site.test/0"], max_pages=n // 2, max_depth=n).select("url", "depth")


@query("""WITH RECURSIVE reach(n, depth) AS (SELECT 0::BIGINT, 0 UNION ALL
    SELECT 2 * n + j, depth + 1 FROM reach, (VALUES (1), (2)) v(j) WHERE n IN (SELECT page_id FROM pages) AND (2 * n + j)::VARCHAR NOT LIKE '1%' AND (2 * n + j)::VARCHAR NOT LIKE '%7')
  SELECT 'https://site.test/' || n AS url, depth, CASE WHEN page_id IS NULL THEN 0 ELSE 200 END AS status FROM reach LEFT JOIN pages ON page_id = n
  UNION ALL SELECT 'https://site.test/lost' || n, depth + 1, 0 FROM reach JOIN pages ON page_id = n""")
def crawl_robots(spark, sf_dir):
    """Pages that robots rules forbid leave no record; links that the caller's predicate refuses aren't followed; missing pages are errors."""
    files = spark.createDataFrame([("https://site.test", "User-agent: *\nDisallow: /1\nCrawl-delay: 1")], "origin string, text string")
    corpus = durable(_tree(spark, sf_dir, lost=True), "site")
    n = corpus.count()
    found = crawl(corpus, ["https://site.test/0"], max_pages=n + 1, max_depth=n, robots=side_tables.robots_rules(files), allow=lambda u: ~u.rlike("7$"))
    return found.select("url", "depth", "status")


# --- parity -----------------------------------------------------------------------------------------------------------


@query("SELECT count(*) FILTER (page_id % 4 <> 3) AS matched, count(*) AS total, count(*) FILTER (page_id % 4 <> 3) / count(*) AS parity FROM pages")
def engine_parity(spark, sf_dir):
    """Titles as two engines give them, by the tree and by a pattern; the second has every fourth wrong."""
    by_tree = P.with_view(pages_of(spark, sf_dir), "v", "title").select(F.col("page_id").alias("step"), "v")
    other = by_tree.select("step", F.when(F.col("step") % 4 == 3, F.concat("v", F.lit("?"))).otherwise(F.col("v")).alias("v"))
    return stats.parity(by_tree, other, ["step"], "v")


@query("SELECT DISTINCT event_type || '.u' || user_id AS gap FROM events GROUP BY event_type, user_id HAVING NOT bool_or(value > 100)")
def probe_gaps(spark, sf_dir):
    seen = table(spark, sf_dir, "events").select(F.col("event_type").alias("target"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("prop"), F.lit("get").alias("kind"), (F.col("value") > 100).alias("defined"))
    return stats.probe_gaps(stats.probe_accesses(seen))


@query("""SELECT page_id, string_agg(w, ' ' ORDER BY i) AS text FROM (SELECT page_id, unnest(l) AS w, unnest(range(0, len(l))) AS i FROM (SELECT page_id, ['x' || page_id, 'b', 'c'] AS l FROM pages)) GROUP BY ALL""")
def text_concat(spark, sf_dir):
    """The text of elements put together from the node table, white space collapsed."""
    own = made(spark, sf_dir, "<p> x{k}\n<b>b</b><!-- no --> <i> c </i></p>")
    nodes = durable(P.nodes(own), "nodes")
    found = N.text_of(nodes, N.select(nodes, "p"))
    return found.select("page_id", scalars.collapse_words(F.col("text_content")).alias("text"))


@query("SELECT page_id, page_id AS number, 'x' || page_id AS name, 'application/json' AS content_type FROM pages")
def raw_json(spark, sf_dir):
    """Responses that are no pages, read as they are."""
    body = F.concat(F.lit('{"number":'), F.col("page_id").cast("string"), F.lit(',"list":[1,{"name":"x'), F.col("page_id").cast("string"), F.lit('"}]}'))
    rows = table(spark, sf_dir, "pages").select("page_id", body.cast("binary").alias("body"), F.lit("application/json").alias("content_type"))
    read = web.html_responses(rows, allow_non_html=True).withColumn("json", F.parse_json("html"))
    return read.select("page_id", F.variant_get("json", "$.number", "long").alias("number"), F.variant_get("json", "$.list[1].name", "string").alias("name"), "content_type")
