"""Small pages with known results for each view."""

import json

import pytest

from pagewright.dom import access, content, data, forms
from pagewright.dom.selectors import compile_selector, select, select_first
from pagewright.dom.tree import inner_html, outer_html, parse
from pagewright.dom.xpath import xpath, xpath_values

BASE = "https://x.test/"


def body(html):
    return inner_html(select_first(parse(html), "body"))


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p><b>one<br><p>two<p>three", "<p><b>one<br></b></p><p><b>two</b></p><p><b>three</b></p>"),
        ("<b>1<p>2</b>3</p>", "<b>1</b><p><b>2</b>3</p>"),
        ("<a href=1>x<a href=2>y</a>", '<a href="1">x</a><a href="2">y</a>'),
        ("<table><tr><td>a<td>b<tr><td>c</table>d", "<table><tbody><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></tbody></table>d"),
        ("<table>foo<tr><td>x</table>", "foo<table><tbody><tr><td>x</td></tr></tbody></table>"),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", "<ul><li>a</li><li>b<ul><li>c</li></ul></li></ul>"),
        ("<i><div>a</i>b</div>", "<i></i><div><i>a</i>b</div>"),
        ("<p>a</p></p>b", "<p>a</p><p></p>b"),
        ("<pre>\n x</pre>", "<pre> x</pre>"),
        ("<svg><path/><g>a</g></svg>z", "<svg><path></path><g>a</g></svg>z"),
        ("a < b & c &amp; d &lt; &copy &notit;", "a &lt; b &amp; c &amp; d &lt; © ¬it;"),
        ("<a href='?a=1&copy=2&amp;b'>x</a>", '<a href="?a=1&amp;copy=2&amp;b">x</a>'),
        ("<script>if (a<b) '</p>'</script>x", "<script>if (a<b) '</p>'</script>x"),
    ],
)
def test_tree_construction(html, want):
    if html.startswith("<script"):
        assert outer_html(select_first(parse(html), "script")) == want[:-1]
        return
    assert body(html) == want
    assert body(body(html)) == want  # a serialized page parses to itself


def test_deep_and_broken_pages():
    deep = parse("<div>" * 5000 + "x")
    assert len(select(deep, "div")) == 5000 and outer_html(deep).count("</div>") == 5000
    for html in ("", "<", "<a", "<!--", "</", "<!doctype html>", "&", "<p" * 100, "</p>" * 3, "<table><b><tr>"):
        parse(html)


def test_numbers_are_intervals():
    page = parse("<div><p>a<b>c</b></p></div><p>d")
    nodes = [*page.walk()]
    assert [n.id for n in nodes] == [*range(len(nodes))]
    for n in nodes:
        assert {m.id for m in n.walk()} == {*range(n.id, n.end + 1)}


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<section><p>Rain <i>fell</i></p>all<p>night </p></section>", "Rain fell\nall\nnight"),
        ("<address>north<br>south<hr>west</address>", "north\nsouth\nwest"),
        ("<pre>for x:\n\tgo  on\n</pre>end", "for x:\n\tgo  on\nend"),
        ("<table><tr><td>a</td><td>b</td></tr></table>", "a b"),
        ("<nav>n</nav><script>s</script><style>t</style>x", "n\nx"),
    ],
)
def test_reading_text(html, want):
    assert content.reading_text(parse(html)) == want


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<h3>Weather</h3><p>Cold, then\n rain</p><h6> </h6>", "### Weather\n\nCold, then rain"),
        ('<p>a <b>b</b> <i>c</i> <code>d</code> <a href="/x">e</a></p>', "a **b** *c* `d` [e](https://x.test/x)"),
        ("<ul><li>a</li><li>b</li></ul>", "- a\n- b"),
        ("<ol><li>x</li><li> </li><li>y</li></ol>", "1. x\n2. y"),
        ("<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2|</td></tr></table>", "| A | B |\n| --- | --- |\n| 1 | 2\\| |"),
        ("<nav>n</nav><p>keep</p><footer>f</footer><script>s</script>", "keep"),
        ("<p>out</p><main><p>content</p></main>", "content"),
        ("loose<!-- c --><div><div>nested</div></div>", "loose\n\nnested"),
        ("<blockquote>q</blockquote><hr><pre>c\n</pre>", "> q\n\n---\n\n```\nc\n```"),
        ("<div><a href=/x>lost</a></div>", "lost"),
    ],
)
def test_markdown(html, want):
    assert content.markdown(parse(html), BASE) == want


def test_links_and_anchors():
    page = parse('<a href="/a">1</a><a href="/a">2</a><a href="mailto:x@y.test">3</a><a href="https://o.test/b">4</a><a>5</a><a href="">6</a>')
    assert content.links(page, BASE) == ["https://x.test/a", "https://o.test/b"]
    assert content.resolved_anchors(page, BASE) == ["https://x.test/a", "https://x.test/a", "mailto:x@y.test", "https://o.test/b"]


@pytest.mark.parametrize(
    ("selector", "want"),
    [
        ("li", ["a", "b", "c", "d"]), ("ul > li", ["a", "b", "c", "d"]), ("#two li", ["c", "d"]), (".k.m", ["b"]), ("[data-x]", ["c"]), ("[data-x='1 2']", ["c"]), ("li[data-x~=\"2\"]", ["c"]),
        ("li[data-x^='1']", ["c"]), ("li[data-x$=2]", ["c"]), ("li[data-x*=' ']", ["c"]), ("li:first-child, #two>li+li", ["a", "c", "d"]), ("li:nth-child(2n)", ["b", "d"]), ("li:not(.k)", ["a", "c", "d"]),
        ("ul ~ ul li:last-child", ["d"]), ("p", []), ("li::x", []), ("[", []), ("li >", []), ("LI:is(.k, [data-x])", ["b", "c"]), ("li:contains(a)", []),
    ],
)
def test_selectors(selector, want):
    page = parse('<ul><li>a<li class="k m">b</ul><ul id=two><li data-x="1 2">c<li>d</ul>')
    assert [n.text() for n in select(page, selector)] == want
    assert (compile_selector(selector) is None) == (selector in ("li::x", "[", "li >", "li:contains(a)"))


@pytest.mark.parametrize(
    ("path", "want"),
    [
        ("//ul/li[2]", ["2"]), ("//li", ["1", "2", "3", "4", "5"]), ("//li[0]", []), ("//ul[2]/li", ["4", "5"]), ("//a[@href]", ["Next", "Prev"]), ("//a[@class='k']", ["Prev"]), ("//a[text()='Next']", ["Next"]),
        ("//a[contains(text(),'re')]", ["Prev"]), ("//a[contains(@href,'x')]", ["Next"]), ("//[@id]", ["4"]), ("//a[@x=5]", []), ("//li[1]x", ["1"]), ("//p[bogus()]", []), ("/html/body/a", ["Next", "Prev"]),
        ("a", ["Next", "Prev"]), ("./body", []), ("//LI[3]", ["3"]),
    ],
)
def test_xpath(path, want):
    page = parse('<ul><li>1<li>2<li>3</ul><ul><li id=i>4<li>5</ul><a href="/x">Next</a><a href="/y" class=k>Prev</a><p>')
    assert [n.text() for n in xpath(page, path)] == want


def test_xpath_attribute():
    page = parse('<a href="/x"></a><a href="/y"></a><a></a>')
    assert xpath_values(page, "//a/@href") == ["/x", "/y"] and xpath_values(page, "//@href") == []


def test_roles_and_names():
    assert [access.role(n) for n in select(parse("<input><input type=CHECKBOX><input type=submit><a><button><select></select><h1>"), "body *")] == ["textbox", "checkbox", "button", "link", "button", "combobox", "generic"]
    cases = {'<b aria-label=" Lbl ">x': "Lbl", "<b> T  x </b>": "T  x", "<input placeholder=Ph value=V>": "Ph", "<input value=V title=T>": "V", "<input title=T>": "T", "<input>": ""}
    for html, want in cases.items():
        assert access.name(select_first(parse(html), "b, input")) == want
    page = parse('<i id=d1> one</i><i id=d2>two </i><input aria-describedby="d1 nope d2" title=t aria-invalid=true aria-errormessage=d2><input title=" t ">')
    first, second = select(page, "input")
    assert (access.description(first, page), access.description(second, page), access.error_message(first, page), access.error_message(second, page)) == ("one two", "t", "two", "")


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<b id=t hidden>", False), ("<input id=t type=Hidden>", False), ("<b id=t style='display:none'>", False), ("<div style='display: none'><b id=t>", False), ("<style>.h{display:none}</style><b id=t class=h>", False),
        ("<div style='visibility:hidden'><b id=t>", False), ("<b id=t style='opacity:0'>", False), ("<div style='opacity:0.0'><b id=t>", False), ("<b id=t aria-hidden=true>", True), ("<b id=t>", True),
        ("<style>.h{display:none} #t{display:block}</style><b id=t class=h>", True), ("<style>.h{display:none!important} #t{display:block}</style><b id=t class=h>", False), ("<style>@media print{#t{display:none}}</style><b id=t>", True),
    ],
)
def test_visibility(html, want):
    page = parse(html)
    assert access.is_visible(select_first(page, "#t"), access.Cascade(page)) is want


def test_interactive():
    found = access.interactive(parse('<a href="/a">A</a><a>no</a><button type=SUBMIT onclick=x>B</button><div onclick=y role=tab>C</div><input value=v>'), BASE)
    assert [(x["i"], x["tag"], x["role"], x["name"], x["href"], x["type"], x["js_handler"]) for x in found] == [
        (0, "a", "link", "A", "https://x.test/a", None, False), (1, "button", "button", "B", None, "submit", False), (2, "div", "tab", "C", None, None, True), (3, "input", "textbox", "v", None, None, False),
    ]


def test_accessibility_tree():
    page = parse("<nav><a href=/>Home</a><a href=/b>B</a></nav>")
    assert access.ax_tree(page)["role"] == "navigation"
    assert access.aria_snapshot(select_first(page, "nav")) == '- navigation "HomeB"\n  - link "Home"\n  - link "B"'
    assert access.ax_tree(parse("<div><span><a>x</a></span></div>"))["role"] == "link"
    assert access.ax_tree(parse("<div><a>x</a><a>y</a></div>"))["role"] == "generic"
    assert access.ax_tree(parse("text")) == {"role": "document", "name": "", "children": []}
    nav = select_first(page, "nav")
    assert access.matches_snapshot(nav, '- navigation\n  - link "Home"\n - link /^b$/i\nnonsense')
    assert not access.matches_snapshot(nav, '- link "B"\n- link "Home"')


def test_locators():
    page = parse("<button>Save</button><button>Cancel</button><a href=#>go</a><div>a <span>target</span></div><label for=f>Name</label><input id=f><label>Wrap <input id=w></label><label id=l>By</label><input id=b aria-labelledby='z l'><input id=a aria-label=Name>")
    assert len(access.by_role(page, "button")) == 2 and len(access.by_role(page, "button", "save")) == 1 and len(access.by_role(page, "button", "/SAVE/")) == 0 and len(access.by_role(page, "button", "/SAVE/i")) == 1
    assert [n.tag for n in access.by_text(page, "target")] == ["span"]
    assert [[n.attrs["id"] for n in access.by_label(page, t, exact=True)] for t in ("Name", "Wrap", "By")] == [["f", "a"], ["w"], ["b"]]


def test_forms_and_clicks():
    page = parse('<form action="/look?was=here"><input name=what value=boat><input name=where value=lake><input name=no value=x disabled><input value=unnamed><input type=submit name=go value=1></form>')
    form = select_first(page, "form")
    assert forms.submission(form, "https://x.test/page")["url"] == "https://x.test/look?what=boat&where=lake"
    assert forms.click(select_first(page, "[type=submit]"), BASE) == {"action": "submit", "method": "GET", "url": "https://x.test/look?what=boat&where=lake&go=1", "body": None, "content_type": None}
    page = parse("<form method=post><input name=a value='1 é'><input type=checkbox name=c checked><input type=radio name=r value=no><select name=s><option value=a>A<option selected>B b</select><textarea name=t>lost</textarea></form><a href=/n><b>x</b></a><i>y</i>")
    sent = forms.submission(select_first(page, "form"), BASE)
    assert (sent["method"], sent["url"], sent["body"]) == ("POST", BASE, "a=1+%C3%A9&c=on&s=B+b&t=")
    assert forms.click(select_first(page, "b"), BASE)["url"] == "https://x.test/n" and forms.click(select_first(page, "i"), BASE)["action"] == "inert"
    assert forms.select_option(page, "select", "A") and forms.form_pairs(select_first(page, "form"))[2] == ("s", "a")
    assert forms.fill_many(page, {"[name=a]": "2", "nope": "3"}) == 1 and forms.set_checked(page, "[name=c]", False) and forms.form_pairs(select_first(page, "form"))[0] == ("a", "2")


def test_hydration():
    page = parse('<script id="__NEXT_DATA__" type="application/json">{"a":1}</script><script type="application/ld+json">{"@type":"X"}</script><script type="application/ld+json">bad</script><script type="application/ld+json">[2]</script><script type="application/json" id=isle>{"b":2}</script><script type="application/json">{"c":3}</script><script>window.__INITIAL_STATE__ = {"s":"}{\\"", "n": [1]}; window.__NUXT__=[oops]; __NUXT__ = [3]</script>')
    assert data.hydration(page) == {"next": {"a": 1}, "json_ld": [{"@type": "X"}, [2]], "json": {"isle": {"b": 2}}, "states": {"__INITIAL_STATE__": {"s": '}{"', "n": [1]}, "__NUXT__": [3]}}


@pytest.mark.parametrize(
    ("html", "want"),
    [("<p>" + "x" * 300, (False, 300, 0)), ("<script src=a></script>", (True, 0, 1)), ("<div id=root></div>" + "é" * 150 + "<script src=a></script>", (True, 300, 1)), ("<div id=app></div>", (False, 0, 0))],
)
def test_needs_scripts(html, want):
    got = data.needs_scripts(parse(html))
    assert (got["js_required"], got["text_length"], got["scripts"]) == want
    assert got["reason"].startswith("server" if not want[0] else "empty" if "<div" in html else "near")


def test_schema_extraction():
    page = parse('<h1> Oak\n desk</h1><i class=p>EUR 7.25</i><a class=l href=/order>x</a><li>a<li>b<div class=card><h2>One</h2><b class=q>10</b></div><div class=card><h2>Two</h2><b class=q>none left</b></div><u></u>')
    schema = data.normalized({
        "t": {"selector": "h1"}, "p": {"selector": ".p", "type": "number"}, "l": {"selector": ".l", "attr": "href"}, "none": {"selector": ".zz"}, "li": {"selector": "li", "list": True}, "yes": {"selector": "h1", "type": "boolean"},
        "no": {"selector": "u", "type": "boolean"}, "cards": {"selector": ".card", "list": True, "fields": {"t": {"selector": "h2"}, "q": {"selector": ".q", "type": "number"}}}, "gone": {"selector": ".zz", "fields": {"a": {}}},
        "root": {"list": True, "fields": {"t": {"selector": "h1"}}}, "odd": 5, "html": {"selector": "a", "attr": "html"},
    })
    got = data.extract(page, schema, BASE)
    assert list(got) == sorted(got)
    assert got | {"odd": 0, "li": 0} == {
        "t": "Oak desk", "p": 7.25, "l": "https://x.test/order", "none": None, "li": 0, "yes": True, "no": False, "cards": [{"q": 10.0, "t": "One"}, {"q": None, "t": "Two"}], "gone": None, "root": [{"t": "Oak desk"}], "odd": 0, "html": "x",
    }
    assert data._typed("3,450 m", "number") == 3450 and data._typed("7-9", "number") is None and data._typed("", "number") is None


def test_text_of_the_tree():
    for html in ("<nav><a href=/>é</a><a>B</a></nav><ul><li>x<li>y</ul><input value=v>", "text", "<b role=''><i role=x></i><i role=y>z</i></b>", "<b role=''>"):
        tree = access.ax_tree(parse(html))
        assert access.ax_text(tree) == json.dumps(access.ax_json(tree), ensure_ascii=False, separators=(",", ":"))


def test_views_of_deep_pages():
    for tag in ("div", "span", "b", "ul><li"):
        page = parse(f"<{tag}>" * 3000 + "x")
        assert content.markdown(page, BASE) is not None and content.reading_text(page) == "x" and access.ax_text(access.ax_tree(page))
