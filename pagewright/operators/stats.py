"""Fixed aggregates: latency summaries, probe accesses, oracle parity, and checks on page data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summarize(samples: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """n, min, max, mean, median, p95 and ops_per_sec of millisecond samples.

    Percentiles are samples: of n in order, the one at floor(share * n). Values are counted, and the counts summed within
    value ranges (the same, a few thousand at most, for all groups) and then over ranges; so a group with most of the samples is spread over its
    ranges and never collected. Without samples all are 0.
    """
    by = by or []
    counts = samples.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    counts = counts.withColumn("_range", F.floor(F.asinh(F.col("_v") * 1000) * 32))  # rises with the value
    own = Window.partitionBy(*(F.col(c) for c in by), F.lit(0))
    ranges = counts.groupBy(*by, "_range").agg(F.sum("_c").alias("_t"))
    ranges = ranges.select(
        *(F.col(c).alias(f"_by_{c}") for c in by), F.col("_range").alias("_r"), F.sum("_t").over(own).alias("_n"), F.coalesce(F.sum("_t").over(own.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before")
    )
    same = F.col("_range") == F.col("_r")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    inside = Window.partitionBy(*by, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("_upto", F.sum("_c").over(inside)).join(ranges, same).withColumn("_upto", F.col("_upto") + F.col("_before"))

    def at(share: float) -> Column:
        return F.min(F.when(F.col("_upto") > F.least(F.floor(F.lit(share) * F.col("_n")), F.col("_n") - 1), F.col("_v")))

    mean = F.sum(F.col("_v") * F.col("_c")) / F.sum("_c")
    out = placed.groupBy(*by).agg(
        F.coalesce(F.sum("_c"), F.lit(0)).alias("n"), F.min("_v").alias("min"), F.max("_v").alias("max"), mean.alias("mean"), at(0.5).alias("median"), at(0.95).alias("p95"), F.when(mean > 0, 1000 / mean).alias("ops_per_sec")
    )
    return out.fillna(0.0, ["min", "max", "mean", "median", "p95", "ops_per_sec"])


def probe_accesses(accesses: DataFrame) -> DataFrame:
    """(target, prop, kind, defined, count) from single accesses: ever defined, and how often."""
    return accesses.groupBy("target", "prop", "kind").agg(F.bool_or("defined").alias("defined"), F.count(F.lit(1)).alias("count"))


def probe_gaps(probed: DataFrame) -> DataFrame:
    """Properties read but never defined, each once, as target.prop."""
    return probed.where("kind = 'get' and not defined").select(F.concat_ws(".", "target", "prop").alias("gap")).distinct()


def parity(got: DataFrame, oracle: DataFrame, on: list[str], value: str) -> DataFrame:
    """matched, total and their ratio between two engines' observations per step."""
    both = got.select(*on, F.col(value).alias("_a")).join(oracle.select(*on, F.col(value).alias("_b")), on)
    return both.agg(F.count(F.when(F.col("_a").eqNullSafe(F.col("_b")), 1)).alias("matched"), F.count(F.lit(1)).alias("total")).withColumn("parity", F.when(F.col("total") > 0, F.col("matched") / F.col("total")))


def expect(rows: DataFrame, **checks: Column) -> DataFrame:
    """(check, passed, failed): how many rows keep each expectation, in one pass; null counts as failed."""
    sums = rows.agg(*(x for name, c in checks.items() for x in (F.count(F.when(c, 1)).alias(f"{name}\x01passed"), F.count(F.when(~F.coalesce(c, F.lit(False)), 1)).alias(f"{name}\x01failed"))))
    table = F.array(*(F.struct(F.lit(n).alias("check"), F.col(f"`{n}\x01passed`").alias("passed"), F.col(f"`{n}\x01failed`").alias("failed")) for n in checks))
    return sums.select(F.explode(table).alias("r")).select("r.*")
