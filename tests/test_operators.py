import datetime

import pytest
from pyspark.sql import functions as F

from pagewright.dom import access, content, forms
from pagewright.dom.selectors import select as select_tree
from pagewright.dom.tree import parse
from pagewright.functions import scalars, urls
from pagewright.operators import matches, nodes, pages, side_tables, stats
from pagewright.operators import crawl as crawls
from pagewright.operators.crawl import attempts, crawl, schedule, totals
from pagewright.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/pages.parquet").cache()


@pytest.fixture(scope="module")
def table(corpus):
    return pages.nodes(corpus).cache()


def test_views_share_a_parse_and_agree_with_the_tree(corpus):
    views = {name: name for name in pages.VIEWS} | {"found": pages.query_view("//ul/li[2]"), "n": pages.count_view("li")}
    views |= {f"p_{k}": pages.property_view("a[href]", k) for k in pages.PROPERTIES} | {"s": pages.snapshot_view("h1"), "href": pages.attribute_view("a", "href"), "css": pages.css_view("p", "margin"), "loc": pages.locate_view("role", "link", scope="nav")}
    rows = pages.with_views(corpus, views).collect()
    assert len(rows) == 50
    for r, p in zip(sorted(rows, key=lambda r: r.page_id), corpus.orderBy("page_id").collect()):
        d = parse(p.html)
        assert (r.title, r.text, r.markdown, r.links) == (content.title(d), content.reading_text(d), content.markdown(d, p.url), content.links(d, p.url))
        assert r.n == len(select_tree(d, "li")) and r.found[0].text == select_tree(d, "li")[1].text() and r.css == "0" and r.href == select_tree(d, "a")[0].attrs["href"]
        assert r.p_is_visible is True and r.p_click.action == "navigate" and r.p_is_focused is False and len(r.loc) == r.n and r.s.role == "generic"
        assert [x.name for x in r.interactive] == [access.name(a) for a in select_tree(d, "a[href]")]


def test_views_of_nulls_and_edits(spark):
    rows = [(1, None, None), (2, "https://x.test/", "<title> a </title><form><input name=q></form>"), (3, None, "<a href=/x>y</a>")]
    frame = spark.createDataFrame(rows, "page_id int, url string, html string")
    got = {r.page_id: r for r in pages.with_views(frame, {"title": "title", "links": "links", "html": pages.edit_view(lambda d: forms.fill(d, "[name=q]", "v"))}).collect()}
    assert got[1].title is None and got[2].title == "a" and 'value="v"' in got[2].html and got[3].links == []
    assert pages.query(frame, "a").count() == 1 and pages.query_first(frame, ".//a/@href").collect()[0].value == "/x"
    record = pages.with_view(frame, "r", pages.extract_view('{"t": {"selector": "title"}, "n": {"selector": "b", "type": "number", "list": true}}'))
    assert record.schema["r"].dataType.simpleString() == "struct<n:array<double>,t:string>" and record.where("page_id = 2").collect()[0].r.t == "a"
    assert pages.navigation_records(frame, "input").where("page_id = 2").collect()[0].items == 1


def test_filters_run_before_the_parse(corpus):
    plan = pages.with_views(corpus, {"t": "title"}).where("page_id < 5")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("Filter")
    assert "ArrowEvalPython" not in pages.with_views(corpus, {"t": "title"}).select("page_id")._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("selector", ["li", "ul > li > a", "nav a[href^='/']", "article p, h1", "div.ad", "body [href]", "html[lang=en] li", "footer", "p > b > b"])
def test_native_selectors_agree_with_the_tree(corpus, table, selector):
    native = {(r.page_id, r.node_id) for r in nodes.select(table, selector).collect()}
    tree = {(r.page_id, r.node) for r in pages.query(corpus, selector, "css").collect()}
    assert native == tree


def test_node_operations(spark, corpus, table):
    li = nodes.select(table, "li")
    second = {r.page_id: r.text_content for r in nodes.text_of(table, nodes.nth_on_page(li, 2)).collect()}
    assert second == {r.page_id: r.text for r in pages.query(corpus, "//ul/li[2]").collect()}
    assert nodes.first_on_page(li).count() == 50 and nodes.inside(nodes.select(table, "a"), nodes.select(table, "nav")).count() == nodes.select(table, "nav a").count()
    near = nodes.nearest_ancestor(nodes.select(table, "a"), nodes.select(table, "li, ul"))
    assert near.count() == nodes.select(table, "a").count()
    html = "<label for=f>N</label><input id=f><label>W <input></label><label id=l>B</label><input aria-labelledby='z l'>"
    own = pages.nodes(spark.createDataFrame([(1, "https://x.test/", html)], "page_id int, url string, html string"))
    assert sorted(r.how for r in nodes.labelled_controls(own).collect()) == ["aria-labelledby", "for", "wrap"]


def test_match_algebra(spark):
    frame = spark.createDataFrame([(1, "https://x.test/", "<p id=a class=k>one</p><p>two</p><p class=k>three</p>")], "page_id int, url string, html string")
    p, k = pages.query(frame, "p"), pages.query(frame, ".k")
    texts = lambda m: [r.text for r in m.orderBy("node", "ord").collect()]
    assert texts(matches.first(p)) == ["one"] and texts(matches.last(p)) == ["three"] and texts(matches.nth(p, -2)) == ["two"] and texts(matches.nth(p, 7)) == []
    assert texts(matches.having_text(p, "e", without="o")) == ["three"] and texts(matches.both(p, k)) == ["one", "three"] and len(texts(matches.either(p, k))) == 5
    assert [r.ord for r in matches.renumbered(matches.both(p, k)).orderBy("node").collect()] == [0, 1]
    html = '<i id=d1> one</i><i id=d2>two  x</i><i id=e> </i><input aria-describedby="d2 nope d1 e"><input aria-describedby=nope>'
    own = pages.nodes(spark.createDataFrame([(1, "https://x.test/", html)], "page_id int, url string, html string"))
    assert [r.description for r in matches.described_by(own).collect()] == ["two x one"]


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).collect()[0])


def test_scalars(spark):
    values = ["EUR 7.25", "3,450 m", "7-9", "none left", "", "-5", None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(scalars.to_number(F.col("v"))).collect()]
    assert got == [7.25, 3450.0, None, None, None, -5.0, None]
    plain = ["https://X.test/p?b=2&utm_source=g&a=1#frag", "https://x.test", "http://x.test:80/a", "https://x.test/p?z=1&a=2&a=1", "https://x.test/?REF=1", "https://x.test/?a", "http://x.test:8080/?a=1&&b="]
    frame = spark.createDataFrame([(u,) for u in plain], "u string")
    rows = frame.select("u", scalars.canonical_url(F.col("u")).alias("native"), scalars.canonicalize(F.col("u")).alias("general"), scalars.host(F.col("u")).alias("h"), scalars.origin(F.col("u")).alias("o"), scalars.is_http(F.col("u")).alias("w")).collect()
    for r in rows:
        assert r.native == r.general == urls.canonicalize(r.u) and (r.h, r.o, r.w) == (urls.host_of(r.u), urls.origin_of(r.u), True)
    dates = ["Wed, 21 Oct 2015 07:28:00 GMT", "Wednesday, 21-Oct-15 07:28:00 GMT", "Wed Oct 21 07:28:00 2015", "Wed Oct  1 07:28:00 2015", "Sunday, 06-Nov-94 08:49:37 GMT", "nonsense"]
    got = [r[0] for r in spark.createDataFrame([(d,) for d in dates], "d string").select(F.unix_millis(scalars.http_date(F.col("d")))).collect()]
    assert got == [1445412480000, 1445412480000, 1445412480000, 1443684480000, 784111777000, None]
    html = F.lit("""<link rel="stylesheet" href=" /a.css "><LINK href=b.css rel='preload StyleSheet'><link rel="alternate stylesheet" href=c><link rel=icon href=d>""")
    assert one(spark, scalars.stylesheet_hrefs(html))[0] == ["/a.css", "b.css"]
    assert one(spark, *(scalars.is_html_type(F.lit(t)) for t in ("text/html; charset=x", "", None, "image/png", "application/xhtml+xml"))) == (True, True, True, False, True)
    assert one(spark, scalars.text_matches(F.lit(" Save "), "sav"), scalars.text_matches(F.lit("Save"), "save", True), scalars.text_matches(F.lit("Save"), "/^S/"), scalars.text_matches(F.lit("Save"), "/^s/i")) == (True, False, True, True)
    assert one(spark, scalars.collapse_words(F.lit(" a　 b\tc ")), scalars.resolve(F.lit("https://x.test/a/b"), F.lit("../c"))) == ("a b c", "https://x.test/c")


ROBOTS = """
Allow: /ignored
User-agent: Special
User-agent: other
Disallow: /s
Crawl-delay: 2
User-agent: *   # all
Disallow: /a/*/b$
Disallow: /private
Allow: /private/ok
Disallow:
Crawl-delay: soon
"""


@pytest.mark.parametrize(
    ("agent", "url", "allowed"),
    [
        ("any", "https://x.test/private/1", False), ("any", "https://x.test/private/ok/1", True), ("any", "https://x.test/a/1/b", False), ("any", "https://x.test/a/1/b/c", True), ("any", "https://x.test/s", True),
        ("my-special/1.0", "https://x.test/s", False), ("my-special/1.0", "https://x.test/private", True), ("any", "https://y.test/private", True), ("any", "https://x.test", True), ("any", "https://x.test/private?q=1", False), ("any", "https://x.test/ignored", True),
    ],
)
def test_robots(spark, agent, url, allowed):
    rules = side_tables.robots_rules(spark.createDataFrame([("https://x.test", ROBOTS), ("https://z.test", None)], "origin string, text string"))
    got = side_tables.robots_gate(spark.createDataFrame([(url,)], "url string"), rules, agent).collect()
    assert [r.allowed for r in got] == [allowed]
    assert got[0].crawl_delay == (2.0 if "special" in agent else None)


def test_cookies(spark):
    now = datetime.datetime(2020, 1, 1)
    lines = [
        ("https://x.test/", "a=1; Path=/"), ("https://x.test/", "b=2; Path=/app"), ("https://x.test/", "s=3; Secure"), ("https://x.test/", "gone=1"), ("https://x.test/", "gone=1; Max-Age=0"), ("https://x.test/", "old=1; Expires=Wed, 21 Oct 2015 07:28:00 GMT"),
        ("https://x.test/", "new=1; Expires=Wed, 21 Oct 2015 07:28:00 GMT; Max-Age=60"), ("https://x.test/", "bad=1; Domain=y.test"), ("https://x.test/", "none=1; SameSite=None"), ("https://www.x.test/", "d=4; Domain=.x.test; Path=/; path=/app/in"), ("https://x.test/", "a=5"),
    ]
    frame = spark.createDataFrame([(u, c, i, now) for i, (u, c) in enumerate(lines)], "url string, set_cookie string, seq int, now timestamp")
    jar = side_tables.cookie_jar(frame).cache()
    assert {r.name for r in jar.collect()} == {"a", "b", "s", "new", "d"}
    asked = ["https://x.test/app", "http://x.test/app/in/x", "https://x.test/application", "https://sub.x.test/", "https://other.test/"]
    got = {r.url: r.cookie for r in side_tables.cookie_headers(spark.createDataFrame([(u,) for u in asked], "url string"), jar, F.lit(now)).collect()}
    assert got == {"https://x.test/app": "b=2; a=5; new=1; s=3", "http://x.test/app/in/x": "d=4; b=2; a=5; new=1", "https://x.test/application": "a=5; new=1; s=3", "https://sub.x.test/": "a=5; new=1; s=3", "https://other.test/": None}


def test_cache_and_walls(spark):
    stored = spark.createDataFrame([("u", "e1", None, "old", 200, 0), ("u", "e2", None, "new", 200, 1), ("v", None, None, "x", 200, 2)], "url string, etag string, last_modified string, html string, status int, seq int")
    cache = side_tables.http_cache(stored)
    assert [tuple(r) for r in cache.collect()] == [("u", "e2", None, "new")]
    got = side_tables.reuse_unchanged(spark.createDataFrame([("u", 304, ""), ("v", 304, None), ("u2", 200, "b")], "url string, status int, html string"), cache).collect()
    assert {r.url: r.html for r in got} == {"u": "new", "v": "", "u2": "b"}
    assert side_tables.conditional_headers(spark.createDataFrame([("u",)], "url string"), cache).collect()[0].if_none_match == "e2"
    cases = [({"cf-mitigated": ["challenge"]}, "", "cloudflare"), ({"set-cookie": ["x", "datadome=1"]}, "", "datadome"), ({"x-kpsdk-ct": [""]}, "", "kasada"), ({"set-cookie": ["_abck=1"]}, None, "akamai"), ({}, "token.awswaf.com", "aws_waf"), ({"server": ["cloudflare"]}, "hi", None), (None, None, None)]
    frame = spark.createDataFrame(cases, "h map<string,array<string>>, body string, want string")
    assert all(r.got == r.want for r in frame.select("want", side_tables.wall_vendor(F.col("h"), F.col("body")).alias("got")).collect())


def site(spark, graph):
    rows = [(f"https://x.test{u}", 200, u, [v if v.startswith("http") else f"https://x.test{v}" for v in out], 2) for u, out in graph.items()]
    return spark.createDataFrame(rows, "url string, status int, title string, links array<string>, items int")


def test_crawl(spark):
    corpus = site(spark, {"/": ["/a", "/b?utm_source=x", "/a#f", "https://o.test/", "mailto:x@y.test"], "/a": ["/c", "/"], "/b": ["/gone"], "/c": ["/d"], "/d": []})
    found = {r.url: (r.depth, r.status) for r in crawl(corpus, ["https://x.test/"]).collect()}
    assert found == {"https://x.test/": (0, 200), "https://x.test/a": (1, 200), "https://x.test/b?utm_source=x": (1, 200), "https://x.test/c": (2, 200), "https://x.test/gone": (2, 0), "https://x.test/d": (3, 200)}
    assert len(crawl(corpus, ["https://x.test/"], max_depth=1).collect()) == 3
    assert [r.url for r in crawl(corpus, ["https://x.test/"], max_pages=2).orderBy("depth").collect()] == ["https://x.test/", "https://x.test/a"]
    assert [r.status for r in crawl(corpus, ["https://x.test/zz"]).collect()] == [0]
    assert "https://o.test/" in {r.url for r in crawl(corpus, ["https://x.test/"], same_host=False).collect()}
    rules = side_tables.robots_rules(spark.createDataFrame([("https://x.test", "User-agent: *\nDisallow: /a")], "origin string, text string"))
    assert {r.url for r in crawl(corpus, ["https://x.test/"], robots=rules, allow=lambda u: ~u.contains("gone")).collect()} == {"https://x.test/", "https://x.test/b?utm_source=x"}
    assert tuple(totals(crawl(corpus, ["https://x.test/"])).collect()[0]) == (5, 10, 1)


def test_attempts(spark):
    log = spark.createDataFrame([("a", 0, 503), ("a", 1, 200), ("b", 0, 500), ("b", 1, 500), ("b", 2, 429), ("b", 3, 200), ("c", 0, None), ("d", 0, 404)], "url string, attempt int, status int")
    assert {r.url: tuple(r)[1:] for r in attempts(log).collect()} == {"a": (200, 2, 200), "b": (429, 3, 600), "c": (0, 1, 0), "d": (404, 1, 0)}


def test_stats(spark):
    ten = spark.createDataFrame([("g", float(v)) for v in (10, 20, 30, 40, 50)] + [("h", 4.0), ("h", 2.0)], "k string, ms double")
    got = {r.k: r for r in stats.summarize(ten, "ms", ["k"]).collect()}
    assert tuple(got["g"])[1:] == (5, 10, 50, 30, 30, 50, 1000 / 30) and got["h"].median == 4
    assert tuple(stats.summarize(ten.limit(0), "ms").collect()[0]) == (0, 0, 0, 0, 0, 0, 0)
    seen = spark.createDataFrame([("nav", "x", "get", False), ("nav", "x", "get", False), ("nav", "y", "get", True), ("nav", "y", "get", False), ("win", "z", "set", False)], "target string, prop string, kind string, defined boolean")
    probed = stats.probe_accesses(seen)
    assert probed.where("prop = 'y'").collect()[0][3:] == (True, 2) and [r.gap for r in stats.probe_gaps(probed).collect()] == ["nav.x"]
    a, b = (spark.createDataFrame([(1, x), (2, "q")], "step int, v string") for x in ("p", None))
    assert tuple(stats.parity(a, b, ["step"], "v").collect()[0]) == (1, 2, 0.5)
    checks = stats.expect(ten, positive=F.col("ms") > 0, small=F.col("ms") < 30, never=F.lit(None).cast("boolean"))
    assert {r.check: (r.passed, r.failed) for r in checks.collect()} == {"positive": (7, 0), "small": (4, 3), "never": (0, 7)}


def test_attempts_with_repeated_rows(spark):
    log = [("a", 0, 503), ("a", 0, 503), ("a", 1, 200), ("a", 1, 200), ("b", 0, 500), ("b", 0, None), ("c", 1, 404), ("c", 1, 500)]
    for order in (log, log[::-1]):
        assert {r.url: tuple(r)[1:] for r in attempts(spark.createDataFrame(order, "url string, attempt int, status int")).collect()} == {"a": (200, 2, 200), "b": (500, 1, 0), "c": (404, 2, 200)}


def test_crawls_repeat(spark):
    """Of pages with one canonical url the same one counts, however the corpus is ordered; null and repeated rows do no harm."""
    rows = [("https://x.test/?utm_source=2", 200, "two", ["https://x.test/b"], 1), ("https://x.test/", 200, "one", ["https://x.test/a"], 1), ("https://x.test/#f", 404, "three", ["https://x.test/c"], 1), (None, 200, "none", [], 0), ("https://x.test/a", 200, "a", None, 1)]
    for order in (rows, rows[::-1], rows * 3):
        got = crawl(spark.createDataFrame(order, "url string, status int, title string, links array<string>, items int"), ["https://x.test/", "mailto:a@b.test"]).collect()
        assert sorted((r.url, r.depth, r.status, r.title) for r in got) == [("https://x.test/", 0, 200, "one"), ("https://x.test/a", 1, 200, "a")]
    empty = spark.createDataFrame([], "url string, status int, title string, links array<string>")
    assert [r.error for r in crawl(empty, ["https://x.test/"]).collect()] == ["not in the corpus"]


def test_long_crawls_and_tables_of_starts(spark, monkeypatch):
    monkeypatch.setattr(crawls, "MOST_PARTS", 2)
    corpus = site(spark, {f"/{i}": [f"/{i + 1}", "/0"] for i in range(7)})
    starts = spark.createDataFrame([(0, "https://x.test/0"), (1, "https://x.test/5")], "place int, url string")
    found = crawl(corpus.withColumn("error", F.when(F.col("title") == "/2", "cut off")), starts, max_depth=50).collect()
    assert sorted((r.url[15:], r.depth) for r in found) == [("0", 0), ("1", 1), ("2", 2), ("3", 3), ("4", 4), ("5", 0), ("6", 1), ("7", 2)]
    assert {r.url[15:]: r.error for r in found if r.error} == {"2": "cut off", "7": "not in the corpus"}


def test_schedule(spark):
    records = spark.createDataFrame([(f"https://{h}.test/{i}", i) for h in "xy" for i in range(3)], "url string, depth int")
    rules = side_tables.robots_rules(spark.createDataFrame([("https://x.test", "User-agent: *\nCrawl-delay: 2")], "origin string, text string"))
    waits = {r.url: r.wait_ms for r in schedule(records, 500, rules).collect()}
    assert [waits[f"https://x.test/{i}"] for i in range(3)] == [0, 2000, 4000] and [waits[f"https://y.test/{i}"] for i in range(3)] == [0, 500, 1000]
    assert sorted(r.wait_ms for r in schedule(records, 500, burst=2).collect()) == [0, 0, 0, 0, 500, 500]


def test_cookie_of_many_attributes(spark):
    line = "a=1" + "; x=1" * 300 + "; Path=/p; Secure"
    jar = side_tables.cookie_jar(spark.createDataFrame([("https://x.test/", line, 0, datetime.datetime(2020, 1, 1))], "url string, set_cookie string, seq int, now timestamp")).collect()
    assert [(r.path, r.secure) for r in jar] == [("/p", True)]


def test_cookie_attributes_are_found_in_one_pass(spark):
    """The last of an attribute counts, whatever its case and spaces; headers of 20,000 attributes take no time that grows with their square."""
    now = datetime.datetime(2020, 1, 1)
    lines = [
        "a=1;PATH = /x ;; Path=/y=z;HttpOnly=no ; secure", "b=domain=y.test; xpath=/no; path; securely; x=;path=/q", "c=1; path=/p; path", "d=1; Domain=; Max-Age=60; max-age=x", "e=1; SameSite=STRICT;samesite=Lax\n", "path=/f", "g;path=/g", None,
        "h=1" + "; Secure; Path=/h" * 10_000,
    ]
    rows = [("https://x.test/", c, i, now) for i, c in enumerate(lines)]
    got = sorted(side_tables.cookie_jar(spark.createDataFrame(rows, "url string, set_cookie string, seq int, now timestamp")).collect(), key=lambda r: r.name)
    assert [(r.name, r.value, r.path, r.secure, r.http_only, r.same_site) for r in got] == [
        ("a", "1", "/y=z", True, True, "lax"), ("b", "domain=y.test", "/q", False, False, "lax"), ("c", "1", "/", False, False, "lax"), ("d", "1", "/", False, False, "lax"), ("e", "1", "/", False, False, "lax\n"), ("h", "1", "/h", True, False, "lax"), ("path", "/f", "/", False, False, "lax"),
    ]
    assert {r.domain for r in got} == {"x.test"} and not any(r.expires_at for r in got)


def test_a_304_reuses_the_version_that_its_etag_names(spark):
    stored = spark.createDataFrame([("u", "a", None, "first", 200, 0), ("u", "b", None, "second", 200, 1), ("u", "a", None, "first again", 200, 2), ("u", None, "m", "undated", 200, 3)], "url string, etag string, last_modified string, html string, status int, seq int")
    cache = side_tables.http_cache(stored, versions=True)
    asked = spark.createDataFrame([("u", "a", 304), ("u", "b", 304), ("u", None, 304), ("u", "c", 304), ("v", "a", 304)], "url string, etag string, status int").withColumn("html", F.lit(None).cast("string"))
    got = side_tables.reuse_unchanged(asked, cache)
    assert got.columns == ["url", "etag", "status", "html"]
    assert {(r.url, r.etag): r.html for r in got.collect()} == {("u", "a"): "first again", ("u", "b"): "second", ("u", None): "undated", ("u", "c"): "", ("v", "a"): ""}


def test_cache_reuse_of_pages_with_one_url(spark, tmp_path):
    spark.createDataFrame([(i, "https://x.test/", "x" * (9 - i)) for i in range(7)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: (r.n_chars, r.reused) for r in QUERIES["cache_reuse"](spark, str(tmp_path)).collect()}
    assert got == {i: (9 - i, i % 3 == 0) for i in range(7)}


def test_texts_of_cut_references(spark, tmp_path):
    """A title may be cut within a reference; the registered texts keep what the cut left, the view decodes as browsers do."""
    html = "<html><head></head><body><h1>a &amp; b&amp</h1><p>&copy &copy; &#65 &#66; &x; &ampy; &quo</p><xmp>&amp;</xmp></body></html>"
    frame = spark.createDataFrame([(0, "https://x.test/en/", html)], "page_id long, url string, html string")
    frame.write.parquet(str(tmp_path / "pages.parquet"))
    assert QUERIES["page_text"](spark, str(tmp_path)).first().text == "a & b&amp\n&copy © &#65 B &x; &ampy; &quo\n&amp;"
    assert tuple(QUERIES["text_stats"](spark, str(tmp_path)).first()) == ("en", 1, 3, 46)
    assert pages.with_view(frame, "t", "text").first().t == "a & b&\n© © A B &x; &y; &quo\n&amp;"


def test_cookie_headers_are_parsed_once(spark):
    """No test of a cookie is pushed below the parsing, which would be repeated for each."""
    rows = spark.range(3).selectExpr("concat('https://x.test/', id) as url", "concat('a=', id) as set_cookie", "id as seq", "timestamp'2020-01-01' as now")
    plan = side_tables.cookie_jar(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("; *samesite *") == plan.count("; *domain *") == plan.count("; *secure *") == 1
