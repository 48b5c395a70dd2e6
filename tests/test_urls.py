import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewright.functions import scalars
from pagewright.functions.urls import canonicalize, host_of, is_http, origin_of, resolve


@pytest.mark.parametrize(
    ("base", "href", "want"),
    [
        ("https://x.test/a/b", "../c", "https://x.test/c"), ("https://x.test/", "https://y.test/z", "https://y.test/z"), ("https://x.test/", "", None), ("https://x.test/a/b?q#f", "?z", "https://x.test/a/b?z"),
        ("https://x.test/a/b?q", "#f", "https://x.test/a/b?q#f"), ("https://x.test/a/", "//y.test", "https://y.test/"), ("https://x.test/", "/é ü", "https://x.test/%C3%A9%20%C3%BC"), ("https://x.test/a", "mailto:a@b", "mailto:a@b"),
        ("https://x.test/a/b", "./", "https://x.test/a/"), ("https://x.test/a/b", "..\\c", "https://x.test/c"), ("nope", "/x", None), ("https://x.test/", "HTTP://Y.test:80/a/./b/../c", "http://y.test/a/c"),
    ],
)
def test_resolve(base, href, want):
    assert resolve(base, href) == want


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://X.test/p?b=2&utm_source=g&a=1#frag", "https://x.test/p?a=1&b=2"), ("https://x.test", "https://x.test/"), ("http://x.test:80/a", "http://x.test/a"), ("https://x.test/a/../b", "https://x.test/b"),
        ("https://x.test/p?z=1&a=2&a=1", "https://x.test/p?a=1&a=2&z=1"), ("https://x.test/?REF=1", "https://x.test/"), ("https://x.test/?a", "https://x.test/?a="), ("https://x.test/?a=b c&d=%7E", "https://x.test/?a=b+c&d=%7E"), ("nope", None),
    ],
)
def test_canonicalize(url, want):
    assert canonicalize(url) == want
    if want:
        assert canonicalize(want) == want


def test_parts():
    assert [is_http(u) for u in ("http://x.test", "https://x.test", "mailto:a@b.test", "not a url", None)] == [True, True, False, False, False]
    assert host_of("https://x.test:8443/a") == "x.test:8443" and host_of("mailto:a@b.test") is None
    assert origin_of("http://x.test:81/a") == "http://x.test:81"


@given(st.text(max_size=30), st.text(max_size=30))
def test_canonical_form_is_stable(path, query):
    once = canonicalize(f"https://x.test/{path}?{query}")
    assert once is None or canonicalize(once) == once


HOSTS = ["x.test", "a-b.x.test", "x.test:80", "x.test:443", "x.test:8080", "X.test", "1.2.3.4", "x.1", "xn--e1afmkfd.test", "é.test", "x", "x..test", "x.test:0", "x.test:99999", "u@x.test", "-a.test"]
PATHS = ["", "/", "/a/b_c-d/", "/a//b", "/a/../b", "/./a", "/a.html", "/%41", "/é", "/a b"]
QUERIES = ["", "?", "?a", "?b=2&a=1&a=0", "?utm_source=x&k=v", "?UTM_Source=x", "?ref=1&REF=2", "?a=b=c", "?&&a=", "?q=a+b", "?q=%20", "?=v", "?a&a="]
REST = ["", "#f", "#", "#a/b", "\n"]


def test_native_and_general_agree(spark):
    urls_ = [f"{s}://{h}{p}{q}{r}" for s in ("http", "https", "HTTP", "ftp") for h in HOSTS for p in PATHS for q in QUERIES for r in REST] + ["", None, "nonsense", "//x.test/", "https:x.test"]
    frame = spark.createDataFrame([(i, u) for i, u in enumerate(urls_)], "i int, u string")
    got = {r.i: r.c for r in frame.select("i", scalars.canonicalize(F.col("u")).alias("c")).collect()}
    assert [got[i] for i in range(len(urls_))] == [canonicalize(u) for u in urls_]
