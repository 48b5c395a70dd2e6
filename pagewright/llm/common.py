"""What the training-data operators share: tables, durable intermediate results, connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.sources.shared import drop_durable, durable

EDGES_A_FILE = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; Spark's own reader, so any file system will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 500, size: int = 16 << 20) -> None:
    """Arrow batches of at most so many rows and about so many bytes, unless the session has smaller ones.

    Spark's 10,000 rows may be gigabytes of long texts; a batch and what is made of it must fit a Python worker. The settings stay, as
    they count when a lazy result is run; they change no result.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def renamed(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """`df` with columns c0, c1 ..., so that an operator's own columns clash with none, and the names to go back to."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))), df.columns


def spread(df: DataFrame) -> DataFrame:
    """`df`, dealt out where it comes in fewer files than there are cores, for work that costs more than a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) for each end of the undirected `edges` (a, b); component is the smallest id reachable.

    Alternating large-star and small-star steps on (child, parent) edges. A hot node never gathers its neighbours: each step is a
    `min` per node, which combines before the shuffle, and an equi-join that adaptive execution can split. The files
    of a round go as soon as the next is written. Raises if `rounds` don't suffice (they grow with log of the size).
    """
    now = durable(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "cc",
    )
    # a small table needn't be as many files as the cluster has shuffle partitions
    parts = max(edges.sparkSession.sparkContext.defaultParallelism, now.count() // EDGES_A_FILE + 1)
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # on storage, so that both sides of the join are plain exchanges, which adaptive execution splits for a hot node
        low = durable(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(parts), "cc-low")
        # large star: every larger neighbour of a node goes to the smallest one
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every smaller neighbour, and the node itself, goes to the smallest one
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        settled = least.select("u", F.col("m").alias("v"))
        moved = large.join(least.where("n > 1"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = durable(settled.unionByName(moved).where("u <> v").distinct().coalesce(parts), "cc")
        # done when each node has one parent and no parent is a child
        many = after.groupBy("u").count().where("count > 1").select("u").limit(1)
        deep = after.join(after.select(F.col("u").alias("v")), "v", "left_semi").select("u").limit(1)
        done = not many.unionByName(deep).take(1)
        drop_durable(now)
        drop_durable(low)
        now = after
        if done:
            roots = now.select(F.col("v").alias("id")).distinct()
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))
    raise RuntimeError(f"components didn't settle in {rounds} rounds")
