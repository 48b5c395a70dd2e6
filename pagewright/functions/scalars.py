"""Scalar functions as native column expressions, where Catalyst has what they need; the general URL rules as Arrow UDFs."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls

_UNICODE_SPACE = r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def collapse_ascii(c: Column) -> Column:
    """Runs of space, tab, CR and LF as one space."""
    return F.regexp_replace(c, r"[ \t\r\n]+", " ")


def collapse_unicode(c: Column) -> Column:
    """Runs of Unicode white space as one space, at the ends too."""
    return F.regexp_replace(c, _UNICODE_SPACE, " ")


def collapse_words(c: Column) -> Column:
    """Words with one space between, Unicode white space counts."""
    return F.trim(F.regexp_replace(c, _UNICODE_SPACE, " "))


def to_number(c: Column) -> Column:
    """Digits, dot and signs only, as a double; null if these are no number."""
    kept = F.regexp_replace(c, r"[^0-9.+-]", "")
    return F.when(kept.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), kept.try_cast("double"))


def to_flag(c: Column) -> Column:
    """Whether a text isn't empty; null stays null."""
    return c != ""


def is_html_type(content_type: Column) -> Column:
    """Whether a response's type may be a page; a missing one may."""
    low = F.lower(F.coalesce(content_type, F.lit("")))
    return (low == "") | low.rlike("text/html|application/xhtml\\+xml|application/xml|text/xml")


def within_bytes(body: Column, most: int = 8 << 20) -> Column:
    return F.octet_length(body) <= most


def text_matches(value: Column, want: str, exact: bool = False) -> Column:
    """A /pattern/i, an exact text, or a part in any case."""
    import re

    value = F.trim(value)
    if m := re.match(r"/(.*)/([a-z]*)\Z", want, re.S):
        return value.rlike(("(?i)" if "i" in m[2] else "") + m[1])
    return value == want if exact else F.contains(F.lower(value), F.lit(want.lower()))


def stylesheet_hrefs(html: Column) -> Column:
    """href of each <link> whose rel has stylesheet and not alternate, as written."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)(<link\b[^>]*>)"), F.lit(1))

    def value(tag: Column, name: str) -> Column:
        pattern = rf"""(?is)\b{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
        return F.trim(F.concat(*(F.regexp_extract(tag, pattern, i) for i in (1, 2, 3))))

    rel = lambda t: F.split(F.lower(value(t, "rel")), r"\s+")
    href = lambda t: value(t, "href")
    good = F.filter(tags, lambda t: F.array_contains(rel(t), "stylesheet") & ~F.array_contains(rel(t), "alternate") & (href(t) != ""))
    return F.transform(good, href)


def canonical_url(url: Column) -> Column:
    """Canonical form of http(s) URLs that are written plainly (ASCII host and query, no dot segments): all native."""
    parts = r"^([A-Za-z]+)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
    scheme, host, path, query = (F.regexp_extract(url, parts, i) for i in (1, 2, 3, 4))
    scheme = F.lower(scheme)
    host = F.regexp_replace(F.lower(host), F.when(scheme == "https", ":443$").otherwise(":80$"), "")
    keep = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*urls.TRACKING))
    pairs = F.array_sort(F.transform(keep, lambda p: F.named_struct(F.lit("k"), F.substring_index(p, "=", 1), F.lit("v"), F.when(F.contains(p, F.lit("=")), F.substr(p, F.instr(p, "=") + 1)).otherwise(""))))
    joined = F.array_join(F.transform(pairs, lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")
    return F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), F.when(joined == "", "").otherwise(F.concat(F.lit("?"), joined)))


def host(url: Column) -> Column:
    """Host and port, unless it's the scheme's own; null without one."""
    scheme, found = F.lower(F.regexp_extract(url, r"^([A-Za-z]+)://", 1)), F.lower(F.regexp_extract(url, r"^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#]*)", 1))
    plain = F.regexp_replace(found, F.when(scheme == "https", ":443$").when(scheme == "http", ":80$").otherwise("^$"), "")
    return F.nullif(plain, F.lit(""))


def origin(url: Column) -> Column:
    return F.concat(F.lower(F.regexp_extract(url, r"^([A-Za-z]+)://", 1)), F.lit("://"), host(url))


def is_http(url: Column) -> Column:
    return F.coalesce(url.rlike(r"(?i)^\s*https?://[^/?#\s]"), F.lit(False))


def _arrow(of, *columns: Column) -> Column:
    @F.arrow_udf("string")
    def run(*values: pa.Array) -> pa.Array:
        return pa.array([of(*(v.as_py() for v in row)) for row in zip(*values)], pa.string())

    return run(*columns)


def resolve(base: Column, href: Column) -> Column:
    """WHATWG resolution of href against base."""
    return _arrow(urls.resolve, base, href)


#: URLs for which `canonical_url` gives what the general rules give.
PLAIN = r"^https?://(?:[a-z0-9]+(?:-[a-z0-9]+)*\.)+[a-z]{2,}(?::[1-9][0-9]{0,3})?(?:/[A-Za-z0-9_-]+)*/?(?:\?[A-Za-z0-9_-]*(?:=[A-Za-z0-9_-]*)?(?:&[A-Za-z0-9_-]*(?:=[A-Za-z0-9_-]*)?)*)?(?:#[A-Za-z0-9_-]*)?$"


def canonicalize(url: Column) -> Column:
    """The canonical form under the general rules; only URLs that aren't plainly written leave the JVM."""
    plain = F.coalesce(url.rlike(PLAIN) & ~F.contains(url, F.lit("\n")), F.lit(False))
    return F.when(plain, canonical_url(url)).otherwise(_arrow(urls.canonicalize, F.when(~plain, url)))


def http_date(c: Column) -> Column:
    """Timestamps of RFC 1123, RFC 850 and asctime dates; two-digit years below 70 are 20xx."""
    c = F.trim(F.regexp_replace(c, r"\s+", " "))
    day = F.regexp_replace(c, r"^[A-Za-z]+,? ", "")
    rfc850 = F.regexp_replace(day, r"^(\d+)-([A-Za-z]{3})-(\d\d) ", F.concat(F.lit("$1 $2 "), F.when(F.regexp_extract(day, r"^\d+-[A-Za-z]{3}-(\d\d) ", 1).try_cast("int") < 70, "20").otherwise("19"), F.lit("$3 ")))
    rfc1123 = F.regexp_replace(F.regexp_replace(rfc850, r"^(\d+)-([A-Za-z]{3})-(\d{4}) ", "$1 $2 $3 "), " GMT$", "")
    return F.coalesce(F.try_to_timestamp(rfc1123, F.lit("d MMM yyyy HH:mm:ss")), F.try_to_timestamp(day, F.lit("MMM d HH:mm:ss yyyy")))
