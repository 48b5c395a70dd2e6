"""URL filters: rules first, then the ratio of two character language models, with DataFrame functions only.

A rule is a host suffix and a path prefix with a verdict; the longest that fits decides. URLs that rules accept train one
model, those that rules reject another: Markov models of up to `ORDER` characters of context, each order smoothed by the
next shorter one (Witten-Bell; contexts never seen drop out, so the order varies). A URL that no rule fits is rejected
if its log-likelihood ratio, per character, is below a threshold. One in `HELD_OUT` of the ruled strings, by a checksum, trains no model; the threshold is
calibrated on these, so that its error rates aren't those of URLs the models know (on all ruled ones where the held-out ones
are of one kind). Logarithms are summed as multiples of 2^-32, so that no order of addition changes a verdict.

Models see the host and path in lower case with every digit as 0. Pages are aggregated to such strings before anything is counted, so
a hot host is a few rows with large counts. Tables of n-grams and scores are broadcast only if counted and small.

Nulls and URLs without "://" have an empty host and path, and are judged by the models like others. Without ruled URLs
of both kinds everything else is allowed. Repeated rows get equal verdicts; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_durable, durable

ORDER = 4
#: Rows up to which an n-gram or score table is broadcast; one has some 50 bytes.
SMALL = 400_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_START, _END = "\x02", "\x03"
_SYMBOLS = 256.0
HELD_OUT = 4
_UNIT = float(1 << 32)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z in lower case, and path; both empty for a null or without "://"."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    u = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(u, parts, 1), _UPPER, _LOWER), F.regexp_extract(u, parts, 2)


def ruled(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. Rules are (verdict, host suffix and path prefix)."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, rule in sorted(rules, key=lambda r: len(r[1])):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def shape(host: Column, path: Column) -> Column:
    return F.regexp_replace(F.lower(F.concat(host, path)), "[0-9]", "0")


def grams(shapes: DataFrame, order: int) -> DataFrame:
    """Each character of each string with the `order` ones before it, as one string `gram`."""
    padded = F.concat(F.lit(_START * order), F.col("shape"), F.lit(_END))
    return shapes.withColumn("padded", padded).withColumn("at", F.explode(F.sequence(F.lit(1), F.char_length("shape") + 1))).withColumn(
        "gram", F.substr("padded", F.col("at"), F.lit(order + 1))
    ).drop("padded", "at")


def _small(df: DataFrame, most: int = SMALL) -> DataFrame:
    return F.broadcast(df) if df.count() <= most else df


def model(counted: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, ratio): the difference of the two models' log-probabilities of a gram's last character after the others, in units of 2^-32.

    `counted` has each gram once with its counts `good` and `bad`; counts of shorter contexts are sums of these.
    """
    lower = None
    for k in range(order + 1):
        each = counted.groupBy(F.right("gram", F.lit(k + 1)).alias("key")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        context = F.left("key", F.lit(k))
        heads = each.groupBy(context.alias("head")).agg(*(x for c in ("good", "bad") for x in (F.sum(c).alias(f"{c}_all"), F.sum((F.col(c) > 0).cast("long")).alias(f"{c}_kinds"))))
        rows = each.withColumn("head", context).join(heads, "head")
        if lower is None:
            rows = rows.withColumns({"good_less": F.lit(1 / _SYMBOLS), "bad_less": F.lit(1 / _SYMBOLS)})
        else:
            rows = rows.withColumn("tail", F.right("key", F.lit(k))).join(lower, "tail")
        p = {c: F.when(F.col(f"{c}_all") > 0, (F.col(c) + F.col(f"{c}_kinds") * F.col(f"{c}_less")) / (F.col(f"{c}_all") + F.col(f"{c}_kinds"))).otherwise(F.col(f"{c}_less")) for c in ("good", "bad")}
        lower = rows.select(F.col("key").alias("tail"), p["good"].alias("good_less"), p["bad"].alias("bad_less"))
    return lower.select(F.col("tail").alias("gram"), F.round((F.log("good_less") - F.log("bad_less")) * _UNIT).cast("long").alias("ratio"))


def held_out(shape_col: Column) -> Column:
    return F.crc32(F.encode(shape_col, "UTF-8")) % HELD_OUT == 0


def error_rates(scores: DataFrame) -> list[tuple[float, float, float]]:
    """(threshold, share of accepted rejected, share of rejected accepted) at each step of 0.01, from at most 2,001 sums for the held-out and as many for the others."""
    step = F.least(F.lit(1000), F.greatest(F.lit(-1000), F.floor(F.col("score") * 100))).alias("step")
    found = scores.where("good + bad > 0").groupBy(held_out(F.col("shape")).alias("held"), step).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).collect()
    held = [r for r in found if r["held"]]
    used = held if any(r["good"] for r in held) and any(r["bad"] for r in held) else found
    good, bad = sum(r["good"] for r in used), sum(r["bad"] for r in used)
    if not good or not bad:
        return []
    steps = sorted({r["step"] for r in used})
    return [(t / 100, sum(r["good"] for r in used if r["step"] < t) / good, sum(r["bad"] for r in used if r["step"] >= t) / bad) for t in (*steps, steps[-1] + 1)]


def threshold(scores: DataFrame) -> float | None:
    """The score that divides accepted from rejected best, by the mean of the two error rates."""
    return min(((lost + kept, abs(t), t) for t, lost, kept in error_rates(scores)), default=(0, 0, None))[2]


def judge(pages: DataFrame, rules: list[tuple[str, str]], order: int = ORDER, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every page."""
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    name, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", name.alias("rule"), verdict.alias("ruled"), shape(F.col("host"), F.col("path")).alias("shape"))
    shapes = durable(
        rows.groupBy("shape").agg(F.sum((F.col("ruled") == "allow").cast("long")).alias("good"), F.sum((F.col("ruled") == "block").cast("long")).alias("bad")).select("shape", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("bad", F.lit(0)).alias("bad")),
        "shapes",
    )
    learned = {c: F.when(held_out(F.col("shape")), 0).otherwise(F.col(c)) for c in ("good", "bad")}
    counted = durable(grams(shapes.withColumns(learned), order).groupBy("gram").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")), "grams")
    ratios = durable(model(counted, order), "ratios")
    scored = grams(shapes, order).join(_small(ratios), "gram").groupBy("shape", "good", "bad").agg((F.sum("ratio") / F.count(F.lit(1)) / _UNIT).alias("score"))
    scored = durable(scored, "scores")
    for used in (shapes, counted, ratios):
        drop_durable(used)
    least = threshold(scored)
    judged = F.lit("allow") if least is None else F.when(F.col("score") < least, "block").otherwise("allow")
    return rows.join(_small(scored.select("shape", "score")), "shape").select("page_id", "host", "path", "rule", F.coalesce("ruled", judged).alias("verdict"), "score")
