"""What the registered queries share: the registry, the tables, and pieces of their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators import pages as P
from pagewright.sources.shared import durable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages. Parsing is what costs: where they come in fewer files than there are cores, they're dealt out first."""
    pages, cores = table(spark, sf_dir, "pages"), spark.sparkContext.defaultParallelism
    return pages.repartition(cores) if len(pages.inputFiles()) < cores else pages


def elements_of(spark: SparkSession, sf_dir: str, *tags: str) -> DataFrame:
    """The elements of the node table, parsed once for plans that read it several times; given tags, only these."""
    found = P.nodes(pages_of(spark, sf_dir)).where("kind = 1").drop("value")
    if tags:
        found = found.where(F.col("tag").isin(*tags))
    return durable(found, "nodes")


# --- what the SQL side shares -----------------------------------------------------------------------------------------


def unescaped(text: str) -> str:
    """Decoding of the references that the test pages have."""
    for name, char in (("quot", "'\"'"), ("copy", "'©'"), ("middot", "'·'"), ("lt", "'<'"), ("gt", "'>'"), ("amp", "'&'")):
        text = f"replace({text}, '&{name};', {char})"
    return text


TITLE = f"trim(regexp_replace({unescaped("regexp_extract(html, '<title>([^<]*)</title>', 1)")}, '&amp$', '&'))"
ORIGIN = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"
HREFS = "regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)"
LINK = f"{ORIGIN} || '/' || replace(url_encode(regexp_replace(href, '^/', '')), '%2C', ',')"
CANONICAL = """regexp_extract(url, '^(https?://[^/?#]+)', 1)
  || CASE WHEN regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) END
  || CASE WHEN url LIKE '%?page=2&ref=x%' THEN '?page=2' ELSE '' END"""
LINES = f"""
WITH flat AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<head>.*?</head>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '\\s+', ' ', 'g') AS h FROM pages),
cut AS (SELECT page_id, url, regexp_replace(regexp_replace(h, '</?(p|div|article|footer|nav|ul|li|h1|br|body)( [^>]*)?>', chr(10), 'g'), '<[^>]*>', '', 'g') AS h FROM flat),
lines AS (SELECT page_id, url, list_filter(list_transform(string_split({unescaped("h")}, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM cut)"""
LANG = "regexp_extract(html, '<html lang=\"([^\"]*)\"', 1)"
