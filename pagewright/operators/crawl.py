"""Breadth-first crawl of a stored corpus: one round of joins a depth."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from pagewright.functions import scalars
from pagewright.sources.shared import durable

from .side_tables import robots_gate

#: Rounds after which the tables of visited urls become one.
MOST_PARTS = 16
RECORD = ["url", "depth", "status", "title", "links", "items", "error"]


def edges(records: DataFrame, canonical: Callable[[Column], Column] = scalars.canonical_url) -> DataFrame:
    """(source, target, position) of the link graph, by canonical urls."""
    return records.select(canonical(F.col("url")).alias("source"), F.posexplode("links").alias("position", "link")).select("source", canonical(F.col("link")).alias("target"), "position")


def crawl(
    corpus: DataFrame,
    start: list[str] | DataFrame,
    max_pages: int = 100,
    max_depth: int = 3,
    same_host: bool = True,
    allow: Callable[[Column], Column] | None = None,
    robots: DataFrame | None = None,
    user_agent: str = "pagewright",
    canonical: Callable[[Column], Column] = scalars.canonical_url,
) -> DataFrame:
    """One record (RECORD) a page reached from `start` in `corpus` (url, status, title, links, and items and error if there).

    `start` is a list of urls, or a table (place, url) of them. A url counts once, by its canonical form; the frontier and what was
    visited are tables, and a round's frontier is what its predecessor linked to, anti-joined with the visited. Of corpus rows with
    one canonical url the least counts. Urls outside the corpus leave a record of status 0 that doesn't count towards
    `max_pages`. Within a round pages come in the order of discovery: by the place of their first link. Robots rules (from
    `robots_rules`) drop urls silently. The corpus is put on shared storage once; a round is two writes there, which also count.
    """
    spark = corpus.sparkSession
    own = lambda name, default: F.col(name) if name in corpus.columns else default
    pages = corpus.select(
        canonical(F.col("url")).alias("canon"),
        F.struct(F.col("status").cast("int").alias("status"), "title", "links", own("items", F.lit(0)).cast("int").alias("items"), own("error", F.lit(None).cast("string")).alias("error"), "url").alias("page"),
    )
    pages = durable(pages.where("canon is not null").groupBy("canon").agg(F.min("page").alias("page")).select("canon", "page.status", "page.title", "page.links", "page.items", "page.error"), "corpus")
    seeds = start if isinstance(start, DataFrame) else spark.createDataFrame([(i, u) for i, u in enumerate(start)], "place long, url string")
    seeds = seeds.where(scalars.is_http(F.col("url")))
    frontier = seeds.withColumn("canon", canonical(F.col("url"))).groupBy("canon").agg(F.min_by("url", "place").alias("url"), F.min("place").cast("long").alias("place"))
    hosts = seeds.select(scalars.host(F.col("url")).alias("_host")).distinct()
    out, taken = None, 0
    seen: list[DataFrame] = []
    for depth in range(max_depth + 1):
        if robots is not None:
            frontier = robots_gate(frontier, robots, user_agent).where("allowed").select("canon", "url", "place")
        fetched = frontier.join(pages, "canon", "left").withColumn("found", F.col("status").isNotNull())
        counted = Observation()
        ranked = durable(fetched.observe(counted, F.count(F.when(F.col("found"), 1)).alias("n")), "round")
        n_found, left = counted.get["n"], max_pages - taken
        # the first `left` pages of the round; records of failures stay if they come before the last of these
        if n_found > left:
            last = ranked.where("found").orderBy("place").select("place").limit(left).agg(F.max("place")).first()[0]
            ranked = ranked.where(F.col("place") <= F.lit(-1 if last is None else last))
        taken += min(n_found, left)
        records = ranked.select(
            "url", F.lit(depth).alias("depth"), F.coalesce("status", F.lit(0)).alias("status"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("links", F.array().cast("array<string>")).alias("links"), F.coalesce("items", F.lit(0)).alias("items"), F.when(~F.col("found"), "not in the corpus").otherwise(F.col("error")).alias("error")
        )
        out = records if out is None else out.unionByName(records)
        if depth == max_depth or taken >= max_pages or not n_found:
            break
        seen.append(ranked.select("canon"))
        if len(seen) > MOST_PARTS:
            seen = [durable(_union(seen), "visited")]
        found = ranked.where("found").select("place", F.posexplode("links").alias("at", "url")).where(scalars.is_http(F.col("url")))
        if same_host:
            found = found.withColumn("_host", scalars.host(F.col("url"))).join(hosts, "_host", "left_semi").drop("_host")
        if allow is not None:
            found = found.where(allow(F.col("url")))
        first = F.struct("place", "at")
        fresh = found.withColumn("canon", canonical(F.col("url"))).groupBy("canon").agg(F.min_by("url", first).alias("url"), F.min(first).alias("first"))
        counted = Observation()
        fresh = fresh.join(_union(seen), "canon", "left_anti").observe(counted, F.count(F.lit(1)).alias("n"), F.max("first.at").alias("at"), F.max("first.place").alias("place"))
        fresh = durable(fresh, "frontier")
        if not counted.get["n"]:
            break
        # a place that sorts as (parent's place, link's place) does, within the round
        widest = counted.get["at"] + 1
        frontier = fresh.select("canon", "url", (F.col("first.place") * widest + F.col("first.at")).alias("place"))
        if (counted.get["place"] + 1) * widest > 1 << 40:
            frontier = _dense(frontier)
    return out.select(*RECORD)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def schedule(records: DataFrame, politeness_ms: int = 0, robots: DataFrame | None = None, user_agent: str = "pagewright", burst: int = 1) -> DataFrame:
    """`records` with `wait_ms`: when each may be fetched at the earliest, if all are known at time 0.

    A host's pages go in order of depth and url, `burst` at once and then one an interval, which is the longer of `politeness_ms` and the
    Crawl-delay that robots rules give the agent.
    """
    rows = robots_gate(records, robots, user_agent) if robots is not None else records.withColumn("crawl_delay", F.lit(None).cast("double"))
    rows = rows.withColumn("_host", F.coalesce(scalars.host(F.col("url")), F.lit(""))).withColumn("_interval", F.greatest(F.lit(float(politeness_ms)), F.coalesce(F.col("crawl_delay") * 1000, F.lit(0.0))))
    n = F.row_number().over(Window.partitionBy("_host").orderBy("depth", "url"))
    return rows.withColumn("wait_ms", (F.greatest(n - burst, F.lit(0)) * F.col("_interval")).cast("long")).select(*records.columns, "wait_ms")


def _dense(frontier: DataFrame) -> DataFrame:
    """Places counted anew from 0; a range sort numbers each partition, no task sees all rows."""
    parts = durable(frontier.repartitionByRange("place").sortWithinPartitions("place").withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "dense")
    counts = sorted((r["_part"], r["count"]) for r in parts.groupBy("_part").count().collect())
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    table = frontier.sparkSession.createDataFrame(starts, "_part int, _start long")  # a row a partition
    return parts.join(F.broadcast(table), "_part").select("canon", "url", (F.col("_start") + F.col("_at")).alias("place"))


def totals(records: DataFrame) -> DataFrame:
    """pages, items and errors of a crawl; failures count as errors only."""
    good = F.col("error").isNull()
    return records.agg(F.count(F.when(good, 1)).alias("pages"), F.coalesce(F.sum(F.when(good, F.col("items"))), F.lit(0)).alias("items"), F.count(F.when(~good, 1)).alias("errors"))


def attempts(log: DataFrame, retries: int = 2, backoff_ms: int = 200) -> DataFrame:
    """What retrying makes of a log (url, attempt, status): final status, attempts and time spent backing off.

    429, 5xx and transport errors (null) are tried again up to `retries` times, after backoff * 2^attempt. Of an attempt
    that the log has twice, a good outcome counts, else the least status, a null last.
    """
    bad = F.col("status").isNull() | (F.col("status") == 429) | (F.col("status") >= 500)
    tries = log.where(F.col("attempt") <= retries).groupBy("url").agg(F.min(F.when(~bad, F.col("attempt"))).alias("good"), F.max("attempt").alias("last"), F.min(F.when(~bad, F.struct("attempt", "status"))).alias("best"), F.max_by("status", F.struct(F.col("attempt"), F.col("status").isNotNull(), -F.col("status"))).alias("worst"))
    end = F.coalesce("good", "last")
    return tries.select("url", F.coalesce(F.col("best.status"), "worst", F.lit(0)).alias("status"), (end + 1).alias("attempts"), (F.lit(backoff_ms) * (F.pow(F.lit(2), end) - 1)).cast("long").alias("waited_ms"))
