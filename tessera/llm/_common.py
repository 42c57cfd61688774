"""What several operators of this subpackage share: reading tables, cutting lineage, sizing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNKNOWN_SIZE = 1 << 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where the session has none, as in tests on one machine, a temporary
    folder is set.
    """
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isEmpty():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="tessera-"))
        have = sc._jsc.sc().getCheckpointDir()
    return have.get()


def cut(df: DataFrame) -> DataFrame:
    """Narrow rows, computed once and kept in the shared folder.

    The optimizer keeps the size that it estimated before, which for a join is the product of
    its sides. In rounds of joins on what the round before gave, that number gets more digits
    than planning can bear: there use stored, whose size is that of its files.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Wide rows, computed once and kept as compressed Parquet in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes what stored() wrote for df, once nothing is to read it again."""
    spark = df.sparkSession
    of = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for path in of:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def in_reach(df: DataFrame, most: int = 400_000) -> DataFrame:
    """Narrow rows to join with: to be broadcast if they were counted to be at most `most`, else as they are, and Spark deals both sides by key."""
    kept = cut(df)
    return F.broadcast(kept) if kept.count() <= most else kept


def size_hint(df: DataFrame) -> int:
    """The optimizer's estimate of the bytes of df; for tables read from files, their size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def pieces_for(df: DataFrame, bytes_each: int) -> int:
    """How many parts of about bytes_each df makes, by size_hint; by a count where that knows nothing."""
    size = size_hint(df)
    if size >= UNKNOWN_SIZE:
        size = df.count() * 2_000
    return max(1, -(-size // bytes_each))


@contextmanager
def small_batches(spark: SparkSession, most: str = "2m") -> Iterator[None]:
    """What runs meanwhile sends rows to Python in batches of about so many bytes; wide rows in Spark's own size are held several times by each task, in Arrow's buffers and in the worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, most)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def give_back() -> None:
    """Gives what a worker has freed back to the system; workers are kept for later stages, and so is what their allocators hold."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
