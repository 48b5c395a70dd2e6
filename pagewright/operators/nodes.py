"""Native queries over the node table: selectors become filters and joins that Catalyst plans.

Every join has the page as its equi-key, then the interval of ids; no pairs across pages arise. What a selector needs beyond
simple tests and the descendant and child combinators is left to `pages.query`, which parses the page.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_COMPOUND = re.compile(r"(?P<tag>\*|[-\w]+)?(?P<rest>(?:#[-\w]+|\.[-\w]+|\[[^\]]*\])*)\Z")
_TEST = re.compile(r"#(?P<id>[-\w]+)|\.(?P<cls>[-\w]+)|\[\s*(?P<attr>[-\w]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?P<q>[\"']?)(?P<value>.*?)(?P=q)\s*)?\]")


def _compound(text: str) -> Column:
    m = _COMPOUND.match(text)
    if not m or not text:
        raise ValueError(f"not a native selector: {text}")
    out = F.col("kind") == 1
    if m["tag"] not in (None, "*"):
        out &= F.col("tag") == m["tag"].upper()
    for t in _TEST.finditer(m["rest"]):
        if t["id"]:
            out &= F.col("attrs")["id"] == t["id"]
        elif t["cls"]:
            out &= F.array_contains(F.split(F.col("attrs")["class"], r"\s+"), t["cls"])
        else:
            own, op, value = F.col("attrs")[t["attr"].lower()], t["op"], t["value"]
            if op is None:
                out &= own.isNotNull()
            elif op == "=":
                out &= own == value
            elif op == "|=":
                out &= (own == value) | own.startswith(value + "-")
            elif not value:
                out &= F.lit(False)
            elif op == "~=":
                out &= F.array_contains(F.split(own, r"\s+"), value)
            else:
                out &= {"^=": own.startswith, "$=": own.endswith, "*=": own.contains}[op](value)
    return out


def select(nodes: DataFrame, selector: str, key: str = "page_id") -> DataFrame:
    """The rows of `nodes` that a selector of compounds, descendant and child combinators and commas matches."""
    parts = [_path(nodes, p.strip(), key) for p in selector.split(",")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates([key, "node_id"]) if len(parts) > 1 else out


def _path(nodes: DataFrame, selector: str, key: str) -> DataFrame:
    steps = re.sub(r"\s*>\s*", " >", selector).split()
    found = nodes.where(_compound(steps[0].lstrip(">")))
    for step in steps[1:]:
        inner = nodes.where(_compound(step.lstrip(">"))).alias("inner")
        outer = found.select(key, "node_id", "end_id").alias("outer")
        same = F.col(f"inner.{key}") == F.col(f"outer.{key}")
        if step.startswith(">"):
            how = F.col("inner.parent_id") == F.col("outer.node_id")
        else:
            how = (F.col("inner.node_id") > F.col("outer.node_id")) & (F.col("inner.node_id") <= F.col("outer.end_id"))
        found = inner.join(outer, same & how, "left_semi")
    return found


def nth_on_page(found: DataFrame, n: int, key: str = "page_id") -> DataFrame:
    """The n-th match of each page, in document order."""
    place = F.row_number().over(Window.partitionBy(key).orderBy("node_id"))
    return found.withColumn("_place", place).where(F.col("_place") == n).drop("_place")


def first_on_page(found: DataFrame, key: str = "page_id") -> DataFrame:
    """The first match of each page, by an aggregate that combines before the shuffle."""
    rest = [c for c in found.columns if c != key]
    return found.groupBy(key).agg(F.min_by(F.struct(*rest), "node_id").alias("m")).select(key, "m.*")


def text_of(nodes: DataFrame, found: DataFrame, key: str = "page_id") -> DataFrame:
    """`found` with `text_content`: the ordered text nodes inside each element; null if there are none."""
    text = nodes.where("kind = 3").select(F.col(key).alias("_k"), F.col("node_id").alias("_n"), F.col("value").alias("_v"))
    inside = (F.col(key) == F.col("_k")) & (F.col("_n") > F.col("node_id")) & (F.col("_n") <= F.col("end_id"))
    joined = found.select(key, "node_id", "end_id").join(text, inside)
    texts = joined.groupBy(key, "node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_v"))), lambda x: x["_v"]), "").alias("text_content"))
    return found.join(texts, [key, "node_id"], "left")


def attribute(found: DataFrame, name: str, key: str = "page_id") -> DataFrame:
    return found.select(key, "node_id", F.col("attrs")[name.lower()].alias(name))


def inside(found: DataFrame, roots: DataFrame, key: str = "page_id") -> DataFrame:
    """Matches that are one of the roots or in one; pages without a root keep theirs all."""
    r = roots.select(F.col(key).alias("_k"), F.col("node_id").alias("_n"), F.col("end_id").alias("_e"))
    within = found.join(r, (F.col(key) == F.col("_k")) & (F.col("node_id") >= F.col("_n")) & (F.col("node_id") <= F.col("_e")), "left_semi")
    free = found.join(r.select(F.col("_k").alias(key)).distinct(), key, "left_anti")
    return within.unionByName(free.select(*within.columns))


def nearest_ancestor(found: DataFrame, ancestors: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, node_id, ancestor_id): the closest of `ancestors` around each match, itself included."""
    a = ancestors.select(F.col(key).alias("_k"), F.col("node_id").alias("_n"), F.col("end_id").alias("_e"))
    around = (F.col(key) == F.col("_k")) & (F.col("_n") <= F.col("node_id")) & (F.col("_e") >= F.col("node_id"))
    return found.select(key, "node_id").join(a, around).groupBy(key, "node_id").agg(F.max("_n").alias("ancestor_id"))


def labelled_controls(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, label_id, control_id, how): labels joined with controls by for, by aria-labelledby and by containment."""
    label = nodes.where("kind = 1 and tag = 'LABEL'").select(key, F.col("node_id").alias("label_id"), F.col("end_id").alias("label_end"), F.col("attrs")["for"].alias("target"), F.col("attrs")["id"].alias("own"))
    every = nodes.where("kind = 1")
    ids = every.where(F.col("attrs")["id"].isNotNull()).groupBy(key, F.col("attrs")["id"].alias("target")).agg(F.min("node_id").alias("control_id"))
    by_for = label.join(ids, [key, "target"]).select(key, "label_id", "control_id", F.lit("for").alias("how"))
    listed = every.select(key, F.col("node_id").alias("control_id"), F.explode(F.split(F.col("attrs")["aria-labelledby"], r"\s+")).alias("own"))
    by_list = label.join(listed, [key, "own"]).select(key, "label_id", "control_id", F.lit("aria-labelledby").alias("how"))
    control = every.where(F.col("tag").isin("INPUT", "SELECT", "TEXTAREA", "BUTTON")).select(F.col(key).alias("_k"), F.col("node_id").alias("control_id"))
    wraps = (F.col(key) == F.col("_k")) & (F.col("control_id") > F.col("label_id")) & (F.col("control_id") <= F.col("label_end"))
    by_wrap = label.join(control, wraps).groupBy(key, "label_id").agg(F.min("control_id").alias("control_id")).select(key, "label_id", "control_id", F.lit("wrap").alias("how"))
    return by_for.unionByName(by_list).unionByName(by_wrap)
