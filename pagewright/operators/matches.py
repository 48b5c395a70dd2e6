"""Locator algebra over match tables (page, ord, node, text ...), as `pages.query` gives them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nth(found: DataFrame, n: int, key: str = "page_id") -> DataFrame:
    """The n-th match of each page from 0; from the end if n is negative."""
    if n >= 0:
        return found.where(F.col("ord") == n)
    sizes = found.groupBy(key).agg(F.max("ord").alias("_last"))
    return found.join(sizes, key).where(F.col("ord") == F.col("_last") + 1 + n).drop("_last")


def first(found: DataFrame) -> DataFrame:
    return nth(found, 0)


def last(found: DataFrame, key: str = "page_id") -> DataFrame:
    return nth(found, -1, key)


def having_text(found: DataFrame, text: str | None = None, without: str | None = None) -> DataFrame:
    """Matches whose text has one string, in this case, and hasn't the other."""
    out = found if text is None else found.where(F.contains("text", F.lit(text)))
    return out if without is None else out.where(~F.contains("text", F.lit(without)))


def both(a: DataFrame, b: DataFrame, key: str = "page_id") -> DataFrame:
    """Matches of a whose node b matches too."""
    return a.join(b.select(key, "node").distinct(), [key, "node"], "left_semi").select(*a.columns)


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    """Matches of a, then of b; what both match comes twice."""
    return a.unionByName(b)


def renumbered(found: DataFrame, key: str = "page_id") -> DataFrame:
    """`ord` counted anew in document order."""
    return found.withColumn("ord", (F.row_number().over(Window.partitionBy(key).orderBy("node", "ord")) - 1).cast("int"))


def described_by(nodes: DataFrame, key: str = "page_id", attribute: str = "aria-describedby") -> DataFrame:
    """(key, node_id, description): the texts of the elements that an id list names, in its order; ids that don't exist are skipped."""
    from .nodes import text_of

    named = nodes.where(F.col("attrs")[attribute].isNotNull()).select(key, "node_id", F.posexplode(F.split(F.trim(F.col("attrs")[attribute]), r"\s+")).alias("at", "id"))
    targets = nodes.where(F.col("attrs")["id"].isNotNull()).groupBy(key, F.col("attrs")["id"].alias("id")).agg(F.min_by(F.struct("node_id", "end_id"), "node_id").alias("t")).select(key, "id", F.col("t.node_id").alias("node_id"), F.col("t.end_id").alias("end_id"))
    texts = text_of(nodes, targets, key).select(key, "id", F.trim(F.regexp_replace("text_content", r"\s+", " ")).alias("text"))
    joined = named.join(texts.where("text <> ''"), [key, "id"]).groupBy(key, "node_id").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("d"))
    return joined.select(key, "node_id", F.array_join(F.transform("d", lambda x: x["text"]), " ").alias("description"))
