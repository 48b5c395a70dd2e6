"""Streams: the frontier, politeness per host, event-time windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagewright.functions import scalars


def frontier(links: DataFrame, within: str = "1 hour", url: str = "url", ts: str = "ts") -> DataFrame:
    """New urls of a stream of links: the first of each canonical form. State is kept for `within` of event time."""
    found = links.where(scalars.is_http(F.col(url))).withColumn("canon", scalars.canonical_url(F.col(url))).withColumn(ts, F.col(ts).cast("timestamp"))
    return found.withWatermark(ts, within).dropDuplicatesWithinWatermark(["canon"])


def fresh_robots(files: DataFrame, ttl: str = "1 hour") -> DataFrame:
    """Robots files of a stream, at most one an origin within `ttl`."""
    return files.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["origin"])


def polite(requests: DataFrame, interval_ms: int = 1000, burst: int = 1, url: str = "url", ts: str = "ts") -> DataFrame:
    """(host, url, ts, send_at): when each request may go out, by a token bucket a host.

    The bucket is one number of state: the earliest time of the next request if no burst were allowed. A request may go
    `interval * (burst - 1)` before it.
    """
    slack = interval_ms * (burst - 1)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        free = state.get[0] if state.exists else 0
        rows = pd.concat(batches).sort_values(["ms", "url"], kind="stable")
        send = []
        for ms in rows["ms"]:
            at = max(int(ms), free - slack)
            send.append(at)
            free = max(free, at) + interval_ms
        state.update((free,))
        yield pd.DataFrame({"host": key[0], "url": rows["url"], "ms": rows["ms"], "send_ms": send})

    keyed = requests.select(scalars.host(F.col(url)).alias("host"), F.col(url).alias("url"), F.unix_millis(F.col(ts).cast("timestamp")).alias("ms"))
    out = keyed.groupBy("host").applyInPandasWithState(step, "host string, url string, ms long, send_ms long", "free long", "append", GroupStateTimeout.NoTimeout)
    return out.select("host", "url", F.timestamp_millis("ms").alias("ts"), F.timestamp_millis("send_ms").alias("send_at"))


def polite_delays(log: DataFrame, interval_ms: int = 1000, url: str = "url", ts: str = "ts", carry: tuple[str, ...] = (), burst: int = 1) -> DataFrame:
    """The same for a stored log: (host, url, carry..., ms, send_ms), in the order of ms, url and what is carried.

    A request is sent when it comes, or `interval` after its predecessor's place in line if that is later: the
    greatest of (ms_j + interval * requests since j) over all j up to it, less what the burst allows.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("host").orderBy("ms", "url", *carry)
    rows = log.select(scalars.host(F.col(url)).alias("host"), F.col(url).alias("url"), *carry, F.unix_millis(F.col(ts).cast("timestamp")).alias("ms"))
    rows = rows.withColumn("n", F.row_number().over(order))
    ahead = F.max(F.col("ms") - F.col("n") * interval_ms).over(order.rowsBetween(Window.unboundedPreceding, 0))
    free = ahead + F.col("n") * interval_ms
    return rows.select("host", "url", *carry, "ms", F.greatest(F.col("ms"), free - interval_ms * (burst - 1)).cast("long").alias("send_ms"))


def windowed_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes", by: tuple[str, ...] = ("event_type",), value: str = "value") -> DataFrame:
    """(window_start, by..., n, total) over tumbling or sliding windows; `events` may be a table or a stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return timed.groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), *by, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", key: str = "user_id") -> DataFrame:
    """(key, session_start, session_end, n): runs of a user's events without a pause of `gap`."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
