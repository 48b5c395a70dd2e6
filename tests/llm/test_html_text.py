import html
import random
import re

import numpy as np
import pytest

from pagewright.llm.html_text import FEATURES, blocks, extract, features, main_text, table, trained
from pagewright.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def article(page):
    """Brute force for the template of the test tables: the article's blocks between its h1 and p tags."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", re.sub("<br>", " ", p)))).strip() for p in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(p for p in parts if p)


def test_whole_table_against_brute_force(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = QUERIES["op4_main_text"](spark, SF).collect()
    assert {r.page_id for r in got} == pages.keys()
    for r in got:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, article(pages[r.page_id].html), len(r.text))


LONG = "Words enough to look like the running text of a story that somebody wrote down. "


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<html><head><title>x</title><p>" + LONG, LONG.strip()),
        ("<article>One.<p>a<br>b &lt;c&gt; &amp; d&nbsp;e</article><div class='reader-comments'><p>" + LONG * 2 + "</div>", "One.\na b <c> & d e"),
        (f"<header><h1>Site</h1></header><div id=content><p>{LONG * 3}</p><p>{LONG}</p></div><div class=sideBar>{LONG}</div><form>{LONG}</form>", f"{(LONG * 3).strip()}\n{LONG.strip()}"),
        (f"<main><nav><a href=1>one</a></nav><p>{LONG}<aside>{LONG}</aside><p>End.</main><div class='cookie-notice'>{LONG}</div>", f"{LONG.strip()}\nEnd."),
        (f"<article><script>var a = '<p>{LONG}</p>'</script><style>p{{}}</style><!-- {LONG} --><p>Text <a href=x>link</a> more.</p><p hidden>{LONG}</p></article>", "Text link more."),
        ("<ul><li><a href=1>Home page</a><li><a href=2>About us all</a></ul>", ""),
        ("", ""),
        ("<", ""),
        ("plain words and nothing else at all", "plain words and nothing else at all"),
    ],
)
def test_pages(page, want):
    assert main_text(page) == want


ARTICLE = f"<article><h1>A title</h1><p>{LONG}</p><h2 id='search-algorithms'>Search</h2><p>Short.</p><section id='related-work'><h2>Others</h2><p>{LONG}</p></section></article>"
WHOLE = f"A title\n{LONG.strip()}\nSearch\nShort.\nOthers\n{LONG.strip()}"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (ARTICLE, WHOLE),
        *((f"<div class='{c}'>{ARTICLE}</div>", WHOLE) for c in ("overflow-hidden", "content-sidebar-wrap", "has-banner", "sidebar", "page hidden")),
        (f"<form id=aspnetForm><nav><a href=1>Home page</a></nav>{ARTICLE}<footer>{LONG}</footer></form>", WHOLE),
        (f"<form><h1>{LONG}</h1><p>{LONG * 2}</p><p>{LONG}</p></form>", f"{LONG.strip()}\n{(LONG * 2).strip()}\n{LONG.strip()}"),
        (f"<aside><main><p>Short.</main></aside><aside>{LONG}</aside>", "Short."),
        (f"<main><section id=discussion><p>{LONG}</section><div id=comments><article class=comment-body>{LONG}</article></div></main>", LONG.strip()),
        (f"<div class=content-sidebar-wrap><p>{LONG * 3}</p></div><div class='site-nav'><p>{LONG}</p></div>", (LONG * 3).strip()),
        (f"<div class=notice><p>{LONG * 8}</p><p><a href=x>{LONG * 8}</a></p></div>", (LONG * 8).strip()),
        (f"<article><p>Short.<p hidden>{LONG * 8}</p><div class=related><a href=1>One more</a></div></article>", "Short."),
    ],
)
def test_no_article_is_lost_to_names_or_wrappers(page, want):
    assert main_text(page) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>Let <math><mi>x</mi></math> be", "Let x be"),
        ("<p>Let <math/> be", "Let be"),
        ("<p>An <svg class=icon /> icon <svg/>", "An icon"),
        ("<p>An <svg><path/><svg/><title/><style/><text>none</text></svg> icon", "An icon"),
        ("<p>An <svg><text>none</text><desc><p>none</desc></svg> icon", "An icon"),
        ("<p>One <svg> two.</p><p>Three.", "One two.\nThree."),
        ("<p>One <svg><path><p>Two.<p>Three <svg><title>none</title></svg> four.", "One\nTwo.\nThree four."),
        ("<p>One <svg><svg></svg> two.", "One two."),
        ("<p>One <canvas> two <object> three <video> four.", "One two three four."),
        ("<p>One <noscript>none</noscript> two </svg> three.", "One two three."),
    ],
)
def test_silence(page, want):
    assert main_text(f"<html><head><title>none</title></head><article>{page}</article>") == want
    assert main_text(f"<html><head><title>none</title><article>{page}</article>") == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<main><p>Hi there.</p></main><article class='comment'><p>reader says no</p></article>", "Hi there."),
        ("<article><p>A b c.</p><div id='user_reviews'><p>reader</p></div><div class='kommentare'>x y z</div><section class='social-history'><p>Kept.</p></section></article>", "A b c.\nKept."),
        (f"<article><p>x</p><div class=comments><article><p>{LONG * 9}</article></div></article>", "x"),
        ("<nav><a href=1>One</a></nav><h1>Summer in Rome</h1><h2>Getting there</h2><p>It rained.</p><footer>c</footer>", "Summer in Rome\nGetting there\nIt rained."),
        ("<form><h1>T</h1><p>It was so.</p></form>", "T\nIt was so."),
        ("<article><p>A <math><mi>x</mi></math></p><p><label>Lab</label> text</p></article>", "A x\nLab\ntext"),
        (f"<div class='layout sidebar-right'><p>Before.</p><h1>Name</h1><p>{LONG}</p></div>", f"Before.\nName\n{LONG.strip()}"),
        (f"<div class='sidebar'><p>{LONG * 9}</p></div><div class=related>{LONG * 9}</div><h1>Name</h1><p>{LONG}</p><aside class=sidebar><h1>No</h1>{LONG}</aside>", f"Name\n{LONG.strip()}"),
        (f"<p>{LONG * 3}</p><div>Copyright 2020 {LONG * 3}</div><div>&copy; us</div><div>|</div>", (LONG * 3).strip()),
        (f"<article><p>{LONG}<ul>{'<li><a href=x>Go on</a>' * 4}</ul><p>End.</article>", f"{LONG.strip()}\nEnd."),
        (f"<article><h1><a href=x>Name</a></h1><p>{LONG}<p><a href=y>See this</a><p>{LONG}</article>", f"Name\n{LONG.strip()}\nSee this\n{LONG.strip()}"),
    ],
)
def test_structure_and_text_decide(page, want):
    assert main_text(page) == want


def test_features_and_tree():
    page = blocks("<nav><a>x y</a></nav><h2>one <a>two</a> three four</h2><div class=banner>z</div>")
    assert features(np.array([b.own for b in page], float)).tolist() == [[2, 1, 0, 0, 4, 0.25, 0, 0, 0, 0], [4, 0.25, 2, 1, 1, 0, 1, 0, 0, 0], [1, 0, 4, 0.25, 0, 0, 0, 0, 1, 0]]
    assert [b.furniture for b in page] == [True, False, False]
    x, y = table()
    assert (trained().predict(x) == y).mean() > 0.95

    def used(tree):
        return {FEATURES[tree.feature]} | used(tree.sides[0]) | used(tree.sides[1]) if tree.feature is not None else set()

    # both neighbours decide, and no value of in_article settles it
    assert used(trained()) >= {"words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after"}
    inside = x[:, FEATURES.index("in_article")] == 1
    assert 0 < y[inside].mean() < 1 and 0 < y[~inside].mean() < 1


def test_tree_against_brute_force():
    """Each split is the best of all, each leaf the majority."""

    def impurity(y):
        return 2 * len(y) * y.mean() * (1 - y.mean()) if len(y) else 0.0

    def check(tree, x, y):
        costs = {(f, t): impurity(y[x[:, f] <= t]) + impurity(y[x[:, f] > t]) for f in range(x.shape[1]) for t in (np.unique(x[:, f])[1:] + np.unique(x[:, f])[:-1]) / 2}
        if tree.feature is None:
            assert tree.label == (y.mean() >= 0.5)
            assert not costs or len(np.unique(y)) == 1 or min(costs.values()) > impurity(y) - 1e-6
            return
        assert costs[tree.feature, tree.at] < min(costs.values()) + 1e-6
        left = x[:, tree.feature] <= tree.at
        check(tree.sides[0], x[left], y[left])
        check(tree.sides[1], x[~left], y[~left])

    check(trained(), *table())


VISIBLE = re.compile(r"(?s)<(script|style|title|nav|footer|aside)\b.*?</\1>|<!--.*?-->")


def test_blocks_against_brute_force():
    """On flat pages a block is what lies between two block-level tags, and its link words what lies in anchors."""
    rng = random.Random(3)
    for _ in range(200):
        parts = []
        for _ in range(rng.randrange(1, 12)):
            words = [rng.choice(["a", "bb &amp; c", "<a href=x>d e</a>", "<b>f</b>", "g<i>h</i>"]) for _ in range(rng.randrange(1, 9))]
            tag = rng.choice(["p", "div", "h2", "li"])
            parts.append(f"<{tag}>{' '.join(words)}</{tag}>")
        page = "<script>x</script>" + "".join(parts)
        want = []
        for m in re.finditer(r"<(p|div|h2|li)>(.*?)</\1>", VISIBLE.sub("", page)):
            text = html.unescape(re.sub("<[^>]*>", "", m[2]))
            linked = sum(len(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.findall("<a[^>]*>(.*?)</a>", m[2]))
            want.append((text, len(text.split()), min(1.0, linked / len(text.split())), m[1] == "h2"))
        got = blocks(page)
        assert [(b.text, *b.own[:3]) for b in got] == want


def test_edges(spark):
    rows = [(1, None, None, "c"), (2, "u", "", "c"), (2, "u", "", "c"), (None, "v", f"<article><p>{'é ' * 200_000}</article>", "c"), (4, "w", "<p>" * 20_000, "c"), (5, "w", "<a '=" * 2000, "c")]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in got if r.page_id != 5) == [("1", 0), ("2", 0), ("2", 0), ("4", 0), ("None", 399_999)]
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
