"""As-of and interval joins by time buckets, so that they are equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, value: str, key: str) -> DataFrame:
    """left with value of the last row of right of the same `by` that is not later; one union and one window, no join of ranges."""
    rows = left.select(by, at, key, F.lit(1).alias("_side"), F.lit(None).cast(dict(right.dtypes)[value]).alias(value))
    rows = rows.unionByName(right.select(by, at, F.lit(None).cast(dict(left.dtypes)[key]).alias(key), F.lit(0).alias("_side"), value))
    w = Window.partitionBy(by).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(w)).where("_side = 1").drop("_side")


def within(left: DataFrame, right: DataFrame, by: str, at: str, start: str, end: str, bucket_seconds: int) -> DataFrame:
    """Pairs of the same `by` whose left time is from start up to, not including, end: intervals are dealt to the buckets that they touch."""
    b = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / (bucket_seconds * 1_000_000))
    a = left.withColumn("_b", b(F.col(at)))
    r = right.withColumn("_b", F.explode(F.sequence(b(F.col(start)), b(F.col(end)))))
    return a.join(r, [by, "_b"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_b")
