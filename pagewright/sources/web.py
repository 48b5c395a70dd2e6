"""Where pages come from and go: stored files, stored responses, HTTP; records and cookie state as JSON."""

from __future__ import annotations

import http.client
import re
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pagewright.functions import scalars

from .encodings import decode_as

MOST_BYTES, MOST_REDIRECTS, SNIFFED = 8 << 20, 20, 1024
FETCHED = "url string, final_url string, status int, redirected boolean, content_type string, html string, error string, attempts int, etag string, last_modified string, set_cookie array<string>"
_CHARSET = re.compile(r"charset\s*=\s*[\"']?\s*([-\w:]+)", re.I)


# --- decoding --------------------------------------------------------------------------------------------------------


def charset(body: bytes, content_type: str | None) -> str:
    """From the header, else from the first kilobyte, else UTF-8."""
    m = _CHARSET.search(content_type or "") or _CHARSET.search(body[:SNIFFED].decode("latin-1"))
    return m[1].lower() if m else "utf-8"


def decode(body: bytes, content_type: str | None) -> str:
    return decode_as(body, charset(body, content_type))


def decoded(body: Column, content_type: Column) -> Column:
    """Text of binary responses."""

    @F.arrow_udf("string")
    def run(bodies: pa.Array, types: pa.Array) -> pa.Array:
        return pa.array([None if b.as_py() is None else decode(b.as_py(), t.as_py()) for b, t in zip(bodies, types)], pa.string())

    return run(body, content_type)


def judged_responses(responses: DataFrame, most_bytes: int = MOST_BYTES, allow_non_html: bool = False) -> DataFrame:
    """Every stored response (body binary, content_type ...) with `html` and `error`; one of the two is null. The gates run before the decoding.

    Spark keeps the rows that wait for a Python function, on disk where they're large. Hence what failed a gate isn't among their
    columns; the two uses of `_passed` keep Spark from merging it into the function's arguments, which would need the whole body there.
    """
    error = F.when(~scalars.within_bytes(F.col("body"), most_bytes), "body too large")
    if not allow_non_html:
        error = F.when(~scalars.is_html_type(F.col("content_type")), "not html").otherwise(error)
    judged = responses.withColumn("error", error).withColumn("_passed", F.when(F.col("error").isNull(), F.col("body")))
    return judged.withColumn("html", decoded(F.col("_passed"), F.when(F.col("_passed").isNotNull(), F.col("content_type")))).drop("_passed")


def html_responses(responses: DataFrame, most_bytes: int = MOST_BYTES, allow_non_html: bool = False) -> DataFrame:
    """Those of `judged_responses` that may be pages, with `html`."""
    kept = responses.where(scalars.within_bytes(F.col("body"), most_bytes))
    if not allow_non_html:
        kept = kept.where(scalars.is_html_type(F.col("content_type")))
    return kept.withColumn("html", decoded(F.col("body"), F.col("content_type")))


def read_html_files(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES, report: bool = False) -> DataFrame:
    """(url, html) of a folder of files; the path stands for the url. The size gate is pushed to the listing.

    With `report` too large files aren't left out, but have a null html and an `error`; their content isn't read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    text = decoded(F.col("content"), F.lit(None).cast("string")).alias("html")
    kept = files.where(F.col("length") <= most_bytes).select(F.col("path").alias("url"), text)
    if not report:
        return kept
    large = files.where(F.col("length") > most_bytes).select(F.col("path").alias("url"), F.lit(None).cast("string").alias("html"), F.lit("body too large").alias("error"))
    return kept.withColumn("error", F.lit(None).cast("string")).unionByName(large)


def read_pages(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """(page_id, url, html) and what else there is, from any of Spark's formats."""
    return spark.read.format(format).load(path)


# --- redirects -------------------------------------------------------------------------------------------------------


def follow_redirects(requests: DataFrame, hops: DataFrame, most: int = MOST_REDIRECTS) -> DataFrame:
    """(url, method, final_url, final_method, n_hops, exhausted) of requests (url, method) over stored hops (url, status, location).

    303 turns any method into GET, 301 and 302 a POST; 307 and 308 keep it. One join a hop, until none moves.
    """
    from .shared import durable

    moves = hops.where(F.col("status").isin(301, 302, 303, 307, 308) & F.col("location").isNotNull()).select(F.col("url").alias("_at"), F.col("status").alias("_status"), F.col("location").alias("_to"))
    moves = moves.groupBy("_at").agg(F.min(F.struct("_status", "_to")).alias("_hop")).select("_at", "_hop.*")  # of several hops of one url the same in every run
    now = requests.select("url", "method", F.col("url").alias("final_url"), F.col("method").alias("final_method"), F.lit(0).alias("n_hops"), F.lit(True).alias("moving"))
    for _ in range(most):
        step = now.join(moves, F.col("moving") & (F.col("final_url") == F.col("_at")), "left")
        turned = (F.col("_status") == 303) | F.col("_status").isin(301, 302) & (F.col("final_method") == "POST")
        now = durable(
            step.select(
                "url", "method", F.coalesce(scalars.resolve(F.col("final_url"), F.col("_to")), "final_url").alias("final_url"), F.when(turned, "GET").otherwise(F.col("final_method")).alias("final_method"), (F.col("n_hops") + F.col("_at").isNotNull().cast("int")).alias("n_hops"), F.col("_at").isNotNull().alias("moving")
            ),
            "hops",
        )
        if not now.where("moving").take(1):
            break
    return now.withColumnRenamed("moving", "exhausted")


# --- HTTP ------------------------------------------------------------------------------------------------------------


class _Hops(urllib.request.HTTPRedirectHandler):
    max_redirections = MOST_REDIRECTS
    max_repeats = MOST_REDIRECTS


def _once(url: str, headers: dict[str, str], timeout: float, most_bytes: int, allow_non_html: bool) -> tuple:
    try:
        request = urllib.request.Request(url, headers=headers)
        try:
            response = urllib.request.build_opener(_Hops).open(request, timeout=timeout)
        except urllib.error.HTTPError as e:
            response = e
        with response:
            got = response.headers
            kind, extra = got.get("content-type", ""), (got.get("etag"), got.get("last-modified"), got.get_all("set-cookie") or [])
            head = (url, response.url, response.status, response.url != url, kind)
            if response.status == 304:
                return *head, None, None, *extra
            if kind and not allow_non_html and not re.search(r"text/html|application/xhtml\+xml|application/xml|text/xml", kind.lower()):
                return *head, None, "not html", *extra
            if int(got.get("content-length") or 0) > most_bytes or len(body := response.read(most_bytes + 1)) > most_bytes:
                return *head, None, "body too large", *extra
            return *head, decode(body, kind), None, *extra
    except (OSError, ValueError, http.client.HTTPException) as e:
        return url, url, 0, False, None, None, f"{type(e).__name__}: {e}", None, None, []


def fetch_one(
    url: str, user_agent: str = "pagewright", timeout: float = 30, most_bytes: int = MOST_BYTES, allow_non_html: bool = False, headers: dict[str, str | None] | None = None, retries: int = 0, backoff_ms: int = 200
) -> tuple:
    """A row of FETCHED; what fails has status 0 and an error, nothing is raised.

    429, 5xx and transport errors are tried again up to `retries` times, after backoff * 2^attempt. Urls that are none aren't.
    """
    sent = {"User-Agent": user_agent} | {k: v for k, v in (headers or {}).items() if v}
    for attempt in range(retries + 1):
        row = _once(url, sent, timeout, most_bytes, allow_non_html)
        again = row[2] == 429 or row[2] >= 500 or row[2] == 0 and not row[6].startswith("ValueError")
        if not again or attempt == retries:
            break
        time.sleep(backoff_ms * 2**attempt / 1000)
    return *row[:7], attempt + 1, *row[7:]


def fetch(urls: DataFrame, concurrency: int | None = None, url: str = "url", politeness_ms: int = 0, **options) -> DataFrame:
    """(ord, FETCHED...) for each row of (ord, url), with `options` as of `fetch_one`.

    `concurrency` tasks work at a time, as many as there are cores by default. A host's urls go to one of them, which
    keeps `politeness_ms` between its requests, or the row's crawl_delay in seconds if that is longer; no lock is shared. Columns cookie,
    if_none_match and if_modified_since, as of `cookie_headers` and `conditional_headers`, are sent as headers.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("ord long, " + FETCHED)
    arrow = to_arrow_schema(schema)
    known = {"cookie": "Cookie", "if_none_match": "If-None-Match", "if_modified_since": "If-Modified-Since"}
    carried = [c for c in known if c in urls.columns]
    delay = F.col("crawl_delay").cast("double") if "crawl_delay" in urls.columns else F.lit(None).cast("double")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free: dict[str | None, float] = {}  # of the hosts of this task
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                now = time.monotonic()
                if (wait := free.get(r["host"], now) - now) > 0:
                    time.sleep(wait)
                rows.append((r["ord"], *fetch_one(r["url"], headers={known[c]: r[c] for c in carried}, **options)))
                interval = max(politeness_ms / 1000, r["delay"] or 0)
                if interval:
                    free[r["host"]] = max(now, free.get(r["host"], now)) + interval
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)] if rows else [pa.array([], f.type) for f in arrow], schema=arrow)

    slim = urls.select("ord", F.col(url).alias("url"), scalars.host(F.col(url)).alias("host"), delay.alias("delay"), *carried)
    return slim.repartition(concurrency or urls.sparkSession.sparkContext.defaultParallelism, "host").mapInArrow(step, schema)


class WebFetch(DataSource):
    """spark.read.format("webfetch").option("urls", "one a line").load(): FETCHED rows; register it with spark.dataSource.register."""

    @classmethod
    def name(cls) -> str:
        return "webfetch"

    def schema(self) -> str:
        return FETCHED

    def reader(self, schema) -> DataSourceReader:
        return _WebReader(self.options)


class _WebReader(DataSourceReader):
    def __init__(self, options):
        self.urls = [u for u in options.get("urls", "").splitlines() if u.strip()]
        self.agent = options.get("useragent", "pagewright")

    def partitions(self):
        return [InputPartition(u) for u in self.urls]

    def read(self, partition):
        yield fetch_one(partition.value, self.agent)


# --- sinks -----------------------------------------------------------------------------------------------------------


def record_json(records: DataFrame, brief: bool = False) -> DataFrame:
    """One JSON text a crawl record; the brief form leaves depth and links out."""
    keys = ["url", "status", *([] if brief else ["depth"]), "title", *([] if brief else ["links"]), "error", "items"]
    return records.select(F.to_json(F.struct(*keys)).alias("value"))


def storage_state(jar: DataFrame) -> DataFrame:
    """A cookie jar as JSON texts, one a cookie; times in seconds, -1 for a session's."""
    expires = F.coalesce(F.unix_micros("expires_at") / 1e6, F.lit(-1.0))
    return jar.select(F.to_json(F.struct("name", "value", "domain", "path", expires.alias("expires"), F.col("http_only").alias("httpOnly"), "secure", F.initcap("same_site").alias("sameSite"))).alias("value"))


def load_storage_state(texts: DataFrame) -> DataFrame:
    """The jar of such texts; bad ones are left out."""
    c = F.from_json("value", "name string, value string, domain string, path string, expires double, httpOnly boolean, secure boolean, sameSite string")
    rows = texts.select(c.alias("c")).where("c.name is not null and c.domain is not null")
    expires = F.when(F.col("c.expires") >= 0, F.timestamp_micros((F.col("c.expires") * 1e6).cast("long")))
    return rows.select("c.domain", "c.path", "c.name", "c.value", "c.secure", F.col("c.httpOnly").alias("http_only"), F.lower("c.sameSite").alias("same_site"), expires.alias("expires_at"))
