"""Sharding: a keyed Feistel permutation over global row numbers gives a reproducible shuffle.

A row's place after the shuffle, hence its shard and its slot, is computed from its number and the key alone; nothing is
moved to find it, and `row_number_at` inverts it. Shard sizes differ by one row at most (law `rows`).

Nulls: rows without a doc_id are numbered first; a null text has size 16 and the checksum of no bytes. Repeated rows are
numbered like any others; rows equal in id, checksum and size may swap places, which no column shows. An empty table
gives no rows. Columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable

ROUNDS = 8
M = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer with full avalanche."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> M(30))) * M(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> M(27))) * M(0x94D049BB133111EB)
    return x ^ (x >> M(31))


class Feistel:
    """A permutation of 0..n-1. The domain is the next power of two; results past n-1 are permuted again ("cycle
    walking"), under two steps a row on average."""

    def __init__(self, n: int, key: int = 0):
        self.n = n
        bits = max(2, (max(n, 1) - 1).bit_length())
        self.low, self.high = bits // 2, bits - bits // 2
        self.keys = _mix(np.arange(1, ROUNDS + 1, dtype=M) * M(0x9E3779B97F4A7C15) ^ M(key & 0xFFFFFFFFFFFFFFFF))

    def _mask(self, bits: int) -> np.uint64:
        return M((1 << bits) - 1)

    def _once(self, x: np.ndarray) -> np.ndarray:
        """The halves swap widths in every round, so that odd numbers of bits work too."""
        wide, narrow = self.high, self.low
        for k in self.keys:
            left, right = x >> M(narrow), x & self._mask(narrow)
            left = left ^ (_mix(right ^ k) & self._mask(wide))
            x = (right << M(wide)) | left
            wide, narrow = narrow, wide
        return x

    def _back(self, x: np.ndarray) -> np.ndarray:
        wide, narrow = (self.high, self.low) if ROUNDS % 2 == 0 else (self.low, self.high)
        for k in self.keys[::-1]:
            wide, narrow = narrow, wide
            right, left = x >> M(wide), x & self._mask(wide)
            left = left ^ (_mix(right ^ k) & self._mask(wide))
            x = (left << M(narrow)) | right
        return x

    def _walk(self, x, step) -> np.ndarray:
        x = step(np.array(x, dtype=M, ndmin=1))
        while (out := x >= M(self.n)).any():
            x[out] = step(x[out])
        return x.astype(np.int64)

    def place(self, number) -> np.ndarray:
        return self._walk(number, self._once) if self.n else np.zeros(0, np.int64)

    def number(self, place) -> np.ndarray:
        return self._walk(place, self._back) if self.n else np.zeros(0, np.int64)


def row_number_at(shard, slot, shards: int, n: int, key: int = 0) -> np.ndarray:
    """The global number of the row in that slot of that shard."""
    return Feistel(n, key).number(np.asarray(slot, dtype=np.int64) * shards + np.asarray(shard, dtype=np.int64))


def numbered(df: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """`df` with `row_number` (from 0, in that order) and the number of rows.

    Range partitions are sorted and counted locally; only their counts, one a partition, meet on the driver. The
    partitions are kept on shared storage in between, as the bounds of a range partitioning are drawn anew each time.
    """

    def count(batches):
        n = 0
        for b in batches:
            yield b.append_column("_local_number", pa.array(np.arange(n, n + b.num_rows)))
            n += b.num_rows

    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_local_number", T.LongType())])
    parts = durable(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).mapInArrow(count, schema), "numbered"
    )
    counts = sorted((r["_part"], r["count"]) for r in parts.groupBy("_part").count().collect())
    n, starts = 0, {}
    for part, c in counts:
        starts[part] = n
        n += c
    if not n:
        return parts.select(*df.columns, F.col("_local_number").alias("row_number")), 0
    spark = df.sparkSession
    start = spark.createDataFrame(list(starts.items()), "_part int, _part_start long")  # one row a partition
    return parts.join(F.broadcast(start), "_part").select(*df.columns, (F.col("_part_start") + F.col("_local_number")).alias("row_number")), n


def shard(docs: DataFrame, shards: int = 40, key: int = 20240229, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, row_number, shard, slot) of every row. The text itself is never shuffled."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(16)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
    )
    rows, n = numbered(slim, "doc_id", "text_crc32", "size")
    law = Feistel(n, key)

    @F.pandas_udf("long")
    def place(number: pd.Series) -> pd.Series:
        return pd.Series(law.place(number.to_numpy()))

    return rows.withColumn("place", place("row_number")).select(
        "doc_id", "size", "text_crc32", "row_number", F.pmod("place", F.lit(shards)).cast("int").alias("shard"), F.floor(F.col("place") / shards).cast("long").alias("slot")
    )
