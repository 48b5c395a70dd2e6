"""Lookups that a crawler keeps in memory, as joins: robots rules, cookies, cache validators, challenge walls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import scalars

# --- robots ----------------------------------------------------------------------------------------------------------


def robots_rules(files: DataFrame) -> DataFrame:
    """(origin, group_no, agents, rule_no, allow, pattern, len, crawl_delay) from (origin, text, perhaps status), one row a rule.

    A file whose status isn't 2xx has no rules, which allows everything. Neighbouring User-agent lines share a group; any rule closes it. Groups without rules have one row with null pattern.
    """
    if "status" in files.columns:
        files = files.where(F.col("status").between(200, 299))
    lines = files.select("origin", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r\n|\r|\n")).alias("at", "line"))
    clean = lines.withColumn("line", F.trim(F.regexp_replace("line", "#.*", ""))).where(F.contains("line", F.lit(":")))
    clean = clean.select("origin", "at", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("key"), F.trim(F.regexp_replace("line", "^[^:]*:", "")).alias("value"))
    clean = clean.where(F.col("key").isin("user-agent", "allow", "disallow", "crawl-delay"))
    order = Window.partitionBy("origin").orderBy("at")  # the lines of one file
    agent = F.col("key") == "user-agent"
    begins = agent & (F.coalesce(F.lag("key").over(order), F.lit("")) != "user-agent")
    grouped = clean.withColumn("group_no", F.sum(begins.cast("int")).over(order)).where("group_no > 0")
    heads = grouped.groupBy("origin", "group_no").agg(
        F.collect_set(F.when(agent, F.lower("value"))).alias("agents"),
        F.max_by(F.col("value").try_cast("double"), F.when((F.col("key") == "crawl-delay") & F.col("value").try_cast("double").isNotNull(), F.col("at"))).alias("crawl_delay"),
    )
    rules = grouped.where((F.col("key") == "allow") | (F.col("key") == "disallow") & (F.col("value") != "")).select(
        "origin", "group_no", F.col("at").alias("rule_no"), (F.col("key") == "allow").alias("allow"), F.col("value").alias("pattern"), F.octet_length("value").alias("len")
    )
    return heads.join(rules, ["origin", "group_no"], "left").select("origin", "group_no", "agents", "rule_no", "allow", "pattern", "len", "crawl_delay")


def _as_regex(pattern: Column) -> Column:
    body = F.regexp_replace(pattern, r"\$$", "")
    escaped = F.regexp_replace(F.regexp_replace(body, r"([\\.+?^${}()|\[\]])", r"\\$1"), r"\*", ".*")
    return F.concat(F.lit("(?s)^"), escaped, F.when(pattern.endswith("$"), "$").otherwise(""))


def robots_gate(requests: DataFrame, rules: DataFrame, user_agent: str, url: str = "url") -> DataFrame:
    """`requests` with `allowed` and `crawl_delay`: the first group naming the agent, else the first for *; the longest rule decides, of equals the earlier."""
    ua = user_agent.lower()
    named = F.exists("agents", lambda a: (a != "*") & (a != "") & F.contains(F.lit(ua), a))
    groups = rules.groupBy("origin").agg(F.min(F.when(named, F.col("group_no"))).alias("own"), F.min(F.when(F.array_contains("agents", "*"), F.col("group_no"))).alias("any"))
    mine = rules.join(groups.select("origin", F.coalesce("own", "any").alias("group_no")), ["origin", "group_no"])
    keyed = requests.withColumn("_origin", scalars.origin(F.col(url))).withColumn("_path", F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^#]*)", 1))
    keyed = keyed.withColumn("_path", F.when(F.col("_path").startswith("/"), F.col("_path")).otherwise(F.concat(F.lit("/"), "_path")))
    asked = keyed.select("_origin", "_path").distinct()
    judged = (
        asked.join(mine.withColumn("_regex", _as_regex(F.col("pattern"))), asked["_origin"] == mine["origin"])
        .groupBy("_origin", "_path")
        .agg(F.max_by("allow", F.when(F.expr("_path rlike _regex"), F.struct("len", -F.col("rule_no")))).alias("_allow"), F.max("crawl_delay").alias("crawl_delay"))
    )
    return keyed.join(judged, ["_origin", "_path"], "left").select(*requests.columns, F.coalesce("_allow", F.lit(True)).alias("allowed"), "crawl_delay")


# --- cookies ---------------------------------------------------------------------------------------------------------


def _host(url: Column) -> Column:
    return F.regexp_replace(scalars.host(url), r":\d+$", "")


def cookie_jar(responses: DataFrame) -> DataFrame:
    """(domain, path, name, value, secure, http_only, same_site, expires_at) from (url, set_cookie, seq, now): the last of a key counts.

    `now` is a timestamp. Foreign domains and SameSite=None without Secure are refused; what has expired deletes.
    """
    # of an attribute that is given twice, the last counts: a greedy start finds it from the end, in time that grows with the header's length only
    form = r"(?is)^.*; *{} *(?:=([^;]*))?(?:;|\z)"

    def given(name: str) -> Column:
        return F.rlike("set_cookie", F.lit(form.format(name)))

    def attribute(name: str) -> Column:
        return F.trim(F.regexp_extract("set_cookie", form.format(name), 1))

    # exploded, as Spark would otherwise put the tests below before the parsing, and parse once for each of them
    parsed = F.struct(
        F.substring_index("set_cookie", ";", 1).alias("pair"), _host(F.col("url")).alias("host"), attribute("domain").alias("of"), attribute("path").alias("path"), attribute("max-age").try_cast("long").alias("age"), attribute("expires").alias("until"),
        attribute("samesite").alias("same_site"), given("secure").alias("secure"), given("httponly").alias("http_only"),
    )
    rows = responses.where(F.contains("set_cookie", F.lit("="))).select("seq", "now", F.explode(F.array(parsed)).alias("c")).select("seq", "now", "c.*").where(F.contains("pair", F.lit("=")))
    domain = F.lower(F.regexp_replace(F.coalesce(F.nullif("of", F.lit("")), F.col("host")), r"^\.", ""))
    expires = F.when(F.col("age").isNotNull(), F.timestamp_micros(F.unix_micros("now") + F.col("age") * 1_000_000)).when(F.col("until") != "", scalars.http_date(F.col("until")))
    same_site = F.lower(F.coalesce(F.nullif("same_site", F.lit("")), F.lit("lax")))
    rows = rows.select(
        domain.alias("domain"), F.when(F.col("path").startswith("/"), F.col("path")).otherwise("/").alias("path"), F.trim(F.substring_index("pair", "=", 1)).alias("name"), F.trim(F.regexp_replace("pair", "^[^=]*=", "")).alias("value"),
        "secure", "http_only", same_site.alias("same_site"), expires.alias("expires_at"), "seq", "now", "host",
    )
    good = rows.where(((F.col("host") == F.col("domain")) | F.col("host").endswith(F.concat(F.lit("."), "domain"))) & ((F.col("same_site") != "none") | F.col("secure")) & (F.col("name") != ""))
    last = good.groupBy("domain", "path", "name").agg(F.max_by(F.struct("value", "secure", "http_only", "same_site", "expires_at", "now"), "seq").alias("c"))
    return last.where("c.expires_at is null or c.expires_at > c.now").select("domain", "path", "name", "c.value", "c.secure", "c.http_only", "c.same_site", "c.expires_at")


def cookie_headers(requests: DataFrame, jar: DataFrame, now: Column, url: str = "url") -> DataFrame:
    """`requests` with `cookie`, the header of the cookies that fit: longest path first, then by name. Null without any."""
    path = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    asked = requests.select(F.col(url).alias("_url"), _host(F.col(url)).alias("_host"), F.when(path.startswith("/"), path).otherwise("/").alias("_path")).distinct()
    labels = F.split("_host", r"\.")
    # a host's own name and every name above it: an equi-join in place of a suffix test
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fit = asked.withColumn("domain", F.explode(suffixes)).join(jar, "domain")
    under = (F.col("_path") == F.col("path")) | F.col("_path").startswith(F.when(F.col("path").endswith("/"), F.col("path")).otherwise(F.concat("path", F.lit("/"))))
    fit = fit.where(under & (~F.col("secure") | F.lower("_url").startswith("https:")) & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))
    pairs = F.array_sort(F.collect_list(F.struct((-F.length("path")).alias("n"), "name", "value")))
    headers = fit.groupBy("_url").agg(F.array_join(F.transform(pairs, lambda p: F.concat(p["name"], F.lit("="), p["value"])), "; ").alias("cookie"))
    return requests.join(headers, requests[url] == headers["_url"], "left").drop("_url")


# --- cache -----------------------------------------------------------------------------------------------------------


def http_cache(responses: DataFrame, versions: bool = False) -> DataFrame:
    """(url, etag, last_modified, html): the last response of each url that has a validator; with `versions`, of each url and etag."""
    kept = responses.where("(etag is not null or last_modified is not null) and status = 200")
    if versions:
        return kept.groupBy("url", "etag").agg(F.max_by(F.struct("last_modified", "html"), "seq").alias("c")).select("url", "etag", "c.*")
    return kept.groupBy("url").agg(F.max_by(F.struct("etag", "last_modified", "html"), "seq").alias("c")).select("url", "c.*")


def conditional_headers(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """`requests` (url) with if_none_match and if_modified_since."""
    return requests.join(cache.select("url", F.col("etag").alias("if_none_match"), F.col("last_modified").alias("if_modified_since")), "url", "left")


def reuse_unchanged(responses: DataFrame, cache: DataFrame) -> DataFrame:
    """`responses` (url, status, html) with the cached body where the status is 304; unknown urls have an empty one.

    With a column etag they get the version that it names, from a cache with `versions`.
    """
    known = cache.select(F.col("url").alias("_url"), F.col("html").alias("_cached"), *([F.col("etag").alias("_etag")] if "etag" in responses.columns else []))
    same = F.col("url") == F.col("_url")
    if "etag" in responses.columns:
        same &= F.col("etag").eqNullSafe(F.col("_etag"))
    body = F.when(F.col("status") == 304, F.coalesce("_cached", F.lit(""))).otherwise(F.col("html"))
    return responses.join(known, same, "left").withColumn("html", body).select(*responses.columns)


# --- walls -----------------------------------------------------------------------------------------------------------

#: Vendor, headers with a needle ("" for mere presence), cookie needles, body needles; the first hit names the vendor.
WALLS = [
    ("cloudflare", [("cf-mitigated", "challenge")], ["cf_clearance"], ["__cf_chl", "/cdn-cgi/challenge-platform/"]),
    ("datadome", [("x-datadome", ""), ("x-datadome-cid", "")], ["datadome"], ["geo.captcha-delivery.com"]),
    ("kasada", [("x-kpsdk-ct", ""), ("x-kpsdk-st", "")], [], ["KPSDK", "/ips.js"]),
    ("akamai", [], ["_abck", "bm_sz", "ak_bmsc"], []),
    ("aws_waf", [("x-amzn-waf-action", "")], ["aws-waf-token"], ["token.awswaf.com", "captcha.awswaf.com", "challenge.js"]),
]


def _has(needle: str):
    return lambda value: F.contains(value, F.lit(needle))


def wall_vendor(headers: Column, body: Column) -> Column:
    """Whose challenge a stored response is, null for a page; headers is a map of lower-case names to arrays of values."""
    out = F.lit(None).cast("string")
    for vendor, by_header, by_cookie, by_body in reversed(WALLS):
        hit = F.lit(False)
        for key, needle in by_header:
            hit |= F.coalesce(F.contains(F.get(headers[key], F.lit(0)), F.lit(needle)), F.lit(False))
        for needle in by_cookie:
            hit |= F.coalesce(F.exists(headers["set-cookie"], _has(needle)), F.lit(False))
        for needle in by_body:
            hit |= F.coalesce(F.contains(body, F.lit(needle)), F.lit(False))
        out = F.when(hit, vendor).otherwise(out)
    return out
