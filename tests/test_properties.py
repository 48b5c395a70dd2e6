"""Laws that hold for any page."""

from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.dom import access, content, data
from pagewright.dom.selectors import select, select_first
from pagewright.dom.tree import inner_html, outer_html, parse
from pagewright.dom.xpath import xpath

TAGS = st.sampled_from("a b i p div span ul li table tr td h1 form input select option br pre em nav".split())
PIECE = st.one_of(
    TAGS.map(lambda t: f"<{t}>"), TAGS.map(lambda t: f"</{t}>"), TAGS.map(lambda t: f"<{t} class='x y' id=q href=/z>"), st.text(alphabet="ab <>&\n é", max_size=6), st.sampled_from(["<!-- c -->", "&amp;", "&lt", "<", "</"])
)
PAGE = st.lists(PIECE, max_size=25).map("".join)


@settings(max_examples=300, deadline=None)
@given(PAGE)
def test_trees_are_numbered_and_linked(html):
    page = parse(html)
    nodes = [*page.walk()]
    assert [n.id for n in nodes] == [*range(len(nodes))]
    for n in nodes:
        assert all(c.parent is n for c in n.children)
        assert n.end == max(m.id for m in n.walk())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(TAGS.filter(lambda t: t in ("b", "i", "p", "div", "span", "em", "ul", "li")).map(lambda t: f"<{t}>"), st.text(alphabet="ab &é", max_size=5)), max_size=15).map("".join))
def test_serialized_pages_parse_to_themselves(html):
    once = outer_html(parse(html))
    body = inner_html(select_first(parse(html), "body"))
    assert "<p>" in body or outer_html(parse(once)) == once
    assert content.reading_text(parse(once)) == content.reading_text(parse(html)) or "<p>" in body


@settings(max_examples=200, deadline=None)
@given(PAGE)
def test_views_never_fail_and_selectors_agree(html):
    page = parse(html)
    content.markdown(page, "https://x.test/")
    content.links(page, "https://x.test/")
    access.interactive(page, "https://x.test/", True)
    access.ax_tree(page)
    data.needs_scripts(page)
    assert [n.id for n in select(page, "li")] == [n.id for n in xpath(page, "//li")]
    assert {n.id for n in select(page, "p, .x")} == {n.id for n in select(page, "p")} | {n.id for n in select(page, ".x")}
    assert {n.id for n in select(page, "div p")} >= {n.id for n in select(page, "div > p")}
