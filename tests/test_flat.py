"""What tokens alone tell against what the tree tells."""

import os
import resource
import subprocess
import sys

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.dom import content
from pagewright.dom.flat import COUNTED, UNSURE, read
from pagewright.dom.selectors import select
from pagewright.dom.tree import parse
from pagewright.operators import pages as P

BASE = "https://x.test/d/"
PARTS = [
    "<p>", "</p>", "<b>", "</b>", "<i>", "</i>", "<a href=/x>", "<a href='y z'>", "<a>", "</a>", "<div>", "</div>", "<li>", "<ul>", "</ul>", "<h1>", "</h1>", "<h2>", "<br>", "text ", "&amp;", "<title>T &lt;</title>", "<title>", "</title>", "<!-- <a href=c> -->",
    "<script>'<a href=s>'</script>", "<style>", "</style>", "<body>", "</body>", "<html>", "<head>", "</head>", "<nav>", "</nav>", "<form>", "</form>", "<button>", "</button>", "<img src=x>", "<span>", "</span>", "<iframe><a href=i></iframe>", "<pre>", "\n", "<hr>", "<main>", "<em>", "</em>",
    "<article>", "</article>", "<footer>", "<header>", "<section>", "<dd>", "<dt>", "<nobr>", "</nobr>", "<center>", "</br>", "<input>", "<meta>", "<link href=z>",
]


def agrees(html):
    flat = read(html)
    if flat is None:
        return False
    d = parse(html)
    assert (flat.title or "").strip() == content.title(d), html
    assert content.resolved(BASE, flat.hrefs) == content.resolved_anchors(d, BASE), html
    for tag in COUNTED:
        assert flat.counts[tag] == len(select(d, tag)), (tag, html)
    return True


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
def test_tokens_and_tree_agree(html):
    agrees(html)


@pytest.mark.parametrize("tag", sorted(UNSURE))
def test_unsure_pages_are_parsed(tag):
    assert read(f"<a href=x>y</a><{tag}>") is None


def test_pages_of_the_table_need_no_tree():
    pages = pq.read_table("/root/testdata/sf0.001/pages.parquet").column("html").to_pylist()
    assert all(agrees(p) for p in pages)


def test_views_fall_back_to_the_tree(spark):
    rows = [(1, BASE, "<title>a</title><a href=x>y</a>"), (2, BASE, "<table><a href=q>r<tr><td><a href=s>t"), (3, BASE, None), (4, None, "<p><a href=http://y.test/>u<p>v")]
    frame = spark.createDataFrame(rows, "page_id int, url string, html string")
    got = {r.page_id: r for r in P.with_views(frame, {"title": "title", "links": "links", "n": P.count_view("a[href]"), "p": P.count_view("li")}).collect()}
    for i, base, html in rows:
        if html is None:
            assert got[i].links is None and got[i].n is None
            continue
        d = parse(html)
        assert (got[i].title, got[i].links, got[i].n, got[i].p) == (content.title(d), content.links(d, base or ""), len(select(d, "a[href]")), 0)


BATCH = """
import resource
import pyarrow as pa
from pagewright.operators.pages import node_batches
fields = [("node_id", pa.int32()), ("parent_id", pa.int32()), ("end_id", pa.int32()), ("depth", pa.int32()), ("kind", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("value", pa.string())]
page = "<html><head><title>t</title></head><body>" + ("<p>some <b>words</b> of a <a href=/x>text</a> that goes on" + " and on, as text does" * 20 + "</p>") * 200
n = 64 * 2**20 // len(page)
batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([page] * n)], ["page_id", "html"])
rows = sum(b.num_rows for b in node_batches(iter([batch]), pa.schema([("page_id", pa.int64()), *fields])))
assert rows == n * (5 + 200 * 8), rows / n
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""


def test_memory_of_a_full_batch():
    """The node tables of 64 MB of html, Spark's largest batch, without more Python objects at a time than a slice has."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", BATCH], env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr
    print(done.stdout)
    assert int(done.stdout) < 500
