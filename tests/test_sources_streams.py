import datetime
import http.server
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from pagewright.sources import web
from pagewright.sources.encodings import decode_as
from pagewright.streaming import streams


SEEN = []


class Site(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        SEEN.append((self.path, time.monotonic(), self.headers.get("Cookie"), self.headers.get("If-None-Match")))
        if self.path.startswith("/busy") and sum(s[0] == self.path for s in SEEN) < 3:
            self.send_response(503)
            self.end_headers()
            return
        if self.path == "/same" and self.headers.get("If-None-Match") == "e1":
            self.send_response(304)
            self.end_headers()
            return
        kind, body, status = {
            "/page": ("text/html; charset=latin-1", "é".encode("latin-1"), 200), "/img": ("image/png", b"x", 200), "/big": ("text/html", b"y" * (9 << 20), 200), "/gone": ("text/html", b"gone", 404),
        }.get(self.path, ("text/html", b"", 302))
        self.send_response(status)
        if status == 302:
            self.send_header("Location", "/page")
        self.send_header("Content-Type", kind)
        if self.path == "/page":
            self.send_header("ETag", "e1")
            self.send_header("Set-Cookie", "a=1")
            self.send_header("Set-Cookie", "b=2; Path=/")
        self.end_headers()
        try:
            self.wfile.write(body)
        except OSError:
            pass

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def server():
    own = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=own.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{own.server_port}"
    own.shutdown()


def test_fetching(spark, server):
    paths = ["/page", "/img", "/big", "/gone", "/moved"]
    urls = [server + p for p in paths] + ["http://127.0.0.1:1/none", "nonsense"]
    got = [tuple(r)[1:] for r in web.fetch(spark.createDataFrame([*enumerate(urls)], "ord long, url string"), 2).orderBy("ord").collect()]
    assert [(r[2], r[3], r[5], (r[6] or "").split(":")[0]) for r in got] == [
        (200, False, "é", ""), (200, False, None, "not html"), (200, False, None, "body too large"), (404, False, "gone", ""), (200, True, "é", ""), (0, False, None, "URLError"), (0, False, None, "ValueError"),
    ]
    spark.dataSource.register(web.WebFetch)
    assert [r.status for r in spark.read.format("webfetch").option("urls", "\n".join(urls[:2])).load().orderBy("url").collect()] == [200, 200]


def test_retries_headers_and_politeness(spark, server):
    rows = [(0, server + "/busy", None, None), (1, server + "/page", "a=1", None), (2, server + "/same", None, "e1"), (3, server + "/gone", None, None), (4, "http://127.0.0.1:1/", None, None), (5, "none", None, None)]
    asked = spark.createDataFrame(rows, "ord long, url string, cookie string, if_none_match string")
    SEEN.clear()
    got = {r.ord: r for r in web.fetch(asked, politeness_ms=150, retries=2, backoff_ms=10).collect()}
    assert [(got[i].status, got[i].attempts) for i in range(6)] == [(200, 3), (200, 1), (304, 1), (404, 1), (0, 3), (0, 1)]
    assert got[2].html is None and got[2].error is None
    assert (got[1].etag, got[1].set_cookie) == ("e1", ["a=1", "b=2; Path=/"])
    assert {(s[0], s[2], s[3]) for s in SEEN} >= {("/page", "a=1", None), ("/same", None, "e1")}
    first = sorted({p: min(s[1] for s in SEEN if s[0] == p) for p in ("/busy", "/page", "/same", "/gone")}.values())
    assert all(b - a > 0.1 for a, b in zip(first, first[1:]))


def test_stored_responses(spark, tmp_path):
    rows = [(b"\xe9", "text/html; charset=latin-1"), (b"<meta charset='latin-1'>\xe9", None), ("é".encode(), ""), (b"x", "image/png"), (b"\xff", "text/html; charset=nope"), (b"z" * 50, "text/html")]
    got = web.html_responses(spark.createDataFrame(rows, "body binary, content_type string"), most_bytes=40)
    assert [r.html for r in got.collect()] == ["é", "<meta charset='latin-1'>é", "é", "�"]
    (tmp_path / "a.html").write_text("<p>hi")
    assert [r.html for r in web.read_html_files(spark, str(tmp_path)).collect()] == ["<p>hi"]


def test_redirects(spark):
    hops = spark.createDataFrame([("https://x.test/a", 302, "/b"), ("https://x.test/b", 307, "https://x.test/c"), ("https://x.test/s", 303, "/c"), ("https://x.test/l", 301, "/l")], "url string, status int, location string")
    asked = spark.createDataFrame([("https://x.test/a", "POST"), ("https://x.test/b", "POST"), ("https://x.test/s", "PUT"), ("https://x.test/z", "GET"), ("https://x.test/l", "GET")], "url string, method string")
    got = {r.url[-1]: tuple(r)[2:] for r in web.follow_redirects(asked, hops, most=4).collect()}
    assert got == {"a": ("https://x.test/c", "GET", 2, False), "b": ("https://x.test/c", "POST", 1, False), "s": ("https://x.test/c", "GET", 1, False), "z": ("https://x.test/z", "GET", 0, False), "l": ("https://x.test/l", "GET", 4, True)}


def test_cookie_state_round_trip(spark):
    jar = spark.createDataFrame([("x.test", "/", "a", "1", True, False, "lax", datetime.datetime(2030, 1, 1)), ("x.test", "/", "b", "", False, True, "none", None)], "domain string, path string, name string, value string, secure boolean, http_only boolean, same_site string, expires_at timestamp")
    texts = web.storage_state(jar).unionByName(spark.createDataFrame([("nonsense",)], "value string"))
    assert sorted(map(tuple, web.load_storage_state(texts).collect())) == sorted(map(tuple, jar.collect()))
    records = spark.createDataFrame([("u", 200, 1, "t", ["l"], None, 3)], "url string, status int, depth int, title string, links array<string>, error string, items int")
    assert web.record_json(records, brief=True).collect()[0].value == '{"url":"u","status":200,"title":"t","items":3}'


def drain(df, name, mode="append"):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    query.processAllAvailable()
    query.stop()
    return df.sparkSession.table(name).collect()


@pytest.fixture
def stream(spark, tmp_path):
    def make(rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))

    return make


AT = datetime.datetime(2024, 1, 1)


def test_frontier_stream(stream):
    rows = [("https://x.test/a?utm_source=1", AT), ("https://x.test/a", AT), ("mailto:a@b", AT), ("https://x.test/b#f", AT)]
    assert sorted(r.canon for r in drain(streams.frontier(stream(rows, "url string, ts timestamp_ntz")), "frontier")) == ["https://x.test/a", "https://x.test/b"]


def test_politeness(spark, stream):
    rows = [("https://x.test/1", AT), ("https://x.test/2", AT), ("https://x.test/3", AT + datetime.timedelta(seconds=5)), ("https://y.test/1", AT)]
    want = {"https://x.test/1": 0, "https://x.test/2": 1000, "https://x.test/3": 5000, "https://y.test/1": 0}
    start = int(AT.replace(tzinfo=datetime.timezone.utc).timestamp() * 1000)
    got = drain(streams.polite(stream(rows, "url string, ts timestamp_ntz")).withColumn("ms", F.unix_millis("send_at")), "polite")
    assert {r.url: r.ms - start for r in got} == want
    stored = streams.polite_delays(spark.createDataFrame(rows, "url string, ts timestamp_ntz"))
    assert {r.url: r.send_ms - start for r in stored.collect()} == want
    burst = drain(streams.polite(stream([], "url string, ts timestamp_ntz"), burst=2).withColumn("ms", F.unix_millis("send_at")), "burst")
    assert {r.url: r.ms - start for r in burst} == want | {"https://x.test/2": 0}


def test_windows_of_streams_and_tables_agree(spark, stream):
    rows = [("a", 1, AT + datetime.timedelta(minutes=m), 1.0) for m in (0, 10, 45, 61, 200)]
    schema = "event_type string, user_id int, ts timestamp_ntz, value double"
    live = drain(streams.windowed_counts(stream(rows, schema)), "windows", "complete")
    batch = streams.windowed_counts(spark.createDataFrame(rows, schema)).collect()
    assert sorted(map(tuple, live)) == sorted(map(tuple, batch)) and sorted(r.n for r in batch) == [1, 1, 3]
    assert sorted(r.n for r in streams.sessions(spark.createDataFrame(rows, schema)).collect()) == [1, 2, 2]


@pytest.mark.parametrize(
    ("label", "body", "want"),
    [
        ("iso-8859-1", b"\x80\x81\x93\xe9", "€\x81“é"), ("ASCII", b"\x99", "™"), (" Latin1 ", b"\x85", "…"), ("us-ascii", b"\xa0", "\xa0"), ("windows-1252", b"\x8d", "\x8d"), ("iso-8859-9", b"\x80\xfd", "€ı"), ("tis-620", b"\xa1", "ก"), ("iso-8859-2", b"\xf5", "ő"),
        ("gb2312", "中文".encode("gbk"), "中文"), ("euc-kr", "한".encode("cp949"), "한"), ("shift_jis", "①".encode("cp932"), "①"), ("big5", "中".encode("big5"), "中"), ("koi8-ru", "ж".encode("koi8-u"), "ж"), ("x-sjis", "カ".encode("cp932"), "カ"), ("macintosh", b"\x8e", "é"),
        ("utf-16", "é".encode("utf-16-le"), "é"), ("utf-7", b"+AOk-", "+AOk-"), ("cp437", "é".encode(), "é"), ("rot13", b"abc", "abc"), ("nope", b"\xff", "�"), ("hz-gb-2312", b"abc", "�"), ("iso-2022-kr", b"", ""), ("windows-1253", b"\xaa", "�"),
        ("iso-8859-1", b"\xef\xbb\xbf\xc3\xa9", "é"), ("utf-8", b"\xfe\xff\x00a", "a"), ("iso-8859-8-i", b"\xe0", "א"), ("", b"\xc3\xa9", "é"),
    ],
)
def test_encodings_of_the_web(label, body, want):
    assert decode_as(body, label) == want


def test_what_fails_is_reported(spark, tmp_path):
    rows = [(1, b"ok", None), (2, b"x" * 50, "text/html"), (3, b"x", "image/png"), (4, None, "text/html"), (5, b"x" * 50, "image/png")]
    got = web.judged_responses(spark.createDataFrame(rows, "id int, body binary, content_type string"), most_bytes=40).orderBy("id").collect()
    assert [(r.html, r.error) for r in got] == [("ok", None), (None, "body too large"), (None, "not html"), (None, None), (None, "not html")]
    (tmp_path / "a.html").write_text("<p>hi")
    (tmp_path / "b.html").write_text("<p>" + "x" * 99)
    assert {r.url[-6:]: (r.html, r.error) for r in web.read_html_files(spark, str(tmp_path), most_bytes=50, report=True).collect()} == {"a.html": ("<p>hi", None), "b.html": (None, "body too large")}


def test_bodies_that_fail_a_gate_are_not_held_for_decoding(spark):
    rows = spark.range(3).select("id", F.when(F.col("id") < 2, F.repeat(F.lit("x"), (30 * (F.col("id") + 1)).cast("int"))).cast("binary").alias("body"), F.lit("text/html").alias("content_type"))
    got = web.judged_responses(rows, most_bytes=40).select("id", "error", F.char_length("html").alias("n"))
    assert sorted(map(tuple, got.collect())) == [(0, None, 30), (1, "body too large", None), (2, None, None)]
    at = got._jdf.queryExecution().optimizedPlan()
    while at.nodeName() != "ArrowEvalPython":
        at = at.children().apply(0)
    held = at.children().apply(0).output()
    assert {held.apply(i).name() for i in range(held.size())} == {"id", "error", "_passed"}


def test_redirects_of_repeated_hops(spark):
    hops = [("https://x.test/a", 302, "/c"), ("https://x.test/a", 302, "/b"), ("https://x.test/a", 307, "/d")]
    asked = spark.createDataFrame([("https://x.test/a", "GET")], "url string, method string")
    for order in (hops, hops[::-1]):
        got = web.follow_redirects(asked, spark.createDataFrame(order, "url string, status int, location string")).collect()
        assert [(r.final_url, r.n_hops) for r in got] == [("https://x.test/b", 1)]


def test_polite_delays_of_repeated_urls_and_bursts(spark):
    rows = [(i, "https://x.test/1", AT) for i in range(3)] + [(9, "https://x.test/2", AT + datetime.timedelta(seconds=9))]
    frame = spark.createDataFrame(rows, "id int, url string, ts timestamp_ntz")
    start = int(AT.replace(tzinfo=datetime.timezone.utc).timestamp() * 1000)
    assert {r.id: r.send_ms - start for r in streams.polite_delays(frame, carry=("id",)).collect()} == {0: 0, 1: 1000, 2: 2000, 9: 9000}
    assert {r.id: r.send_ms - start for r in streams.polite_delays(frame, carry=("id",), burst=2).collect()} == {0: 0, 1: 0, 2: 1000, 9: 9000}


def test_shared_folder(spark):
    from pagewright.sources import shared

    frame = shared.durable(spark.range(3), "x")
    path = frame.inputFiles()[0]
    assert frame.count() == 3
    shared.drop_durable(frame)
    assert not os.path.exists(path.removeprefix("file://"))
    kept = shared.durable(spark.range(2), "x").inputFiles()[0].removeprefix("file://")
    assert os.path.exists(kept)


def test_no_machine_local_folder_on_a_cluster():
    from pagewright.sources import shared

    class Session:
        def __init__(self, master):
            self.conf = {}
            self.sparkContext = type("C", (), {"master": master})()

    assert shared.shared_dir(Session("local[4]")).startswith("file://")
    for master in ("spark://h:7077", "yarn", "k8s://h", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="checkpoint"):
            shared.shared_dir(Session(master))
