"""Intermediate results on storage that all executors share.

`durable` results stay until `drop_durable` or `release` deletes them, as a lazy result may still read them.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where it is unset and all runs in one local process, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.gettempdir()}/pagewright-{os.getpid()}"
    return found.rstrip("/")


def durable(df: DataFrame, label: str = "part") -> DataFrame:
    """Write `df` once and read it back: later jobs don't recompute it, and no executor's loss undoes it."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_durable(df: DataFrame) -> None:
    """Delete the files behind a result of `durable` that nothing will read again."""
    for path in {os.path.dirname(f) for f in df.inputFiles()}:
        _delete(df.sparkSession, path)
        _written[:] = [p for p in _written if os.path.basename(p) != os.path.basename(path)]


def release(spark: SparkSession) -> None:
    """Delete all that `durable` has written in this process; to be called when its results have been saved or are no longer needed."""
    while _written:
        _delete(spark, _written.pop())
