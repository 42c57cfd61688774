"""Order without a single task: exact positions, hash order, first rows of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.components import _kept


def hash_order(seed: int, *parts: str) -> Column:
    """Seeded pseudo-random order that any SQL engine can repeat: the md5 of seed and parts."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(p).cast("string") for p in parts)))


def positions(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with each row's position from 0 in a total order.

    Rows are range-partitioned and numbered in their partition; the offsets are
    one number for each partition. A window without keys would put all rows in
    one task.
    """
    dealt = _kept(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    offsets = sizes.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + own - 1).drop("_part", "_before")


def running(df: DataFrame, by: list[str], order: list[Column], weight: Column, name: str) -> DataFrame:
    """df with the sum of weight over the rows before each row in its group, in a total order.

    Rows are range-partitioned by group and order, so a group of any size is spread.
    A window runs over the piece of a group in one partition, and another over one sum for each
    piece; there are no more pieces than groups and partitions together. Null groups are groups.
    """
    dealt = _kept(df.withColumn("_w", weight).repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))
    earlier = lambda keys, along: Window.partitionBy(*keys).orderBy(*along).rowsBetween(Window.unboundedPreceding, -1)
    pieces = dealt.groupBy("_part", *by).agg(F.sum("_w").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(earlier(by, ["_part"])), F.lit(0)))
    theirs = pieces.select(F.col("_part").alias("_p"), *(F.col(c).alias(f"_b{i}") for i, c in enumerate(by)), "_before")
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_b{i}"))
    own = dealt.withColumn("_own", F.coalesce(F.sum("_w").over(earlier(["_part", *by], order)), F.lit(0)))
    return own.join(theirs, same).withColumn(name, F.col("_before") + F.col("_own")).select(*df.columns, name)


def group_positions(df: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """df with each row's position from 0 in its group, without a window over whole groups."""
    return running(df, by, order, F.lit(1), name)


def average_ranks(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """df with value's rank from 1 in its group, ties sharing the mean of theirs: rows are counted by value first, and the counts are summed up in order."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_c"))
    ranked = running(counts, by, [F.col(value)], F.col("_c"), "_below")
    theirs = ranked.select(*(F.col(c).alias(f"_r{i}") for i, c in enumerate([*by, value])), (F.col("_below") + (F.col("_c") + 1) / 2).alias(name))
    same = F.lit(True)
    for i, c in enumerate([*by, value]):
        same = same & F.col(c).eqNullSafe(F.col(f"_r{i}"))
    return df.join(theirs, same).select(*df.columns, name)


def taken(df: DataFrame, by: list[str], quotas: DataFrame, seed: int, key: str, name: str = "_in", buckets: int = 4096) -> DataFrame:
    """df with whether a row is among the first `quota` of its group in hash order (then by key). quotas: by and quota, a row a group; without one nothing is taken.

    buckets is a power of 16. No row is ranked but those at the edge: rows are counted by group and the first
    digits of their hash, which tells the bucket in which each quota ends. Rows of earlier
    buckets are in and of later ones out, where they stand; only those of that bucket,
    one in 4,096 of a group, are put in order.
    """
    held = [f"_g{i}" for i in range(len(by))]
    digits = (buckets - 1).bit_length() // 4
    hashed = df.withColumn("_h", hash_order(seed, key)).withColumn("_k", F.conv(F.substring("_h", 1, digits), 16, 10).cast("int"))
    counts = hashed.groupBy(*by, "_k").agg(F.count("*").alias("_c"))
    group = Window.partitionBy(*by).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)  # at most `buckets` rows
    upto = counts.withColumn("_upto", F.coalesce(F.sum("_c").over(group), F.lit(0)))
    asked = quotas.select(*(F.col(c).alias(h) for c, h in zip(by, held, strict=True)), F.col("quota").cast("long").alias("_q"))
    same = F.lit(True)
    for c, h in zip(by, held, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(h))
    ends = (F.col("_upto") <= F.col("_q")) & (F.col("_q") < F.col("_upto") + F.col("_c"))
    # the bucket where the quota ends and how many of it are in; groups whose quota holds all have none
    edges = upto.join(asked, same).groupBy(*held).agg(F.max(F.when(ends, F.col("_k"))).alias("_edge"), F.max(F.when(ends, F.col("_q") - F.col("_upto"))).alias("_need"))
    edges = _kept(edges)
    few = F.broadcast(edges) if edges.count() <= 400_000 else edges
    told = hashed.join(few.withColumn("_asked", F.lit(True)), same, "left")
    inside = F.coalesce(F.col("_asked"), F.lit(False)) & (F.col("_edge").isNull() | (F.col("_k") < F.col("_edge")))
    at_edge = F.coalesce(F.col("_k") == F.col("_edge"), F.lit(False))
    clear = told.where(~at_edge).withColumn(name, inside).select(*df.columns, name)
    ranked = group_positions(told.where(at_edge), by, [F.col("_h"), F.col(key)], "_p").withColumn(name, F.col("_p") < F.col("_need")).select(*df.columns, name)
    return clear.unionByName(ranked)


def first_rows(df: DataFrame, by: list[Column | str], order: list[Column], n: Column | int = 1, name: str = "_n") -> DataFrame:
    """The first n rows of each group in a total order."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn(name, rank).where(F.col(name) <= n).drop(name)


def first_of_key(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of each key, where order ends in a unique column: keys are reduced before rows move, so hot keys cost nothing."""
    label = F.struct(*order)
    first = df.groupBy(key.alias("_key")).agg(F.min(label).alias("_first"))
    return df.withColumn("_label", label).join(first.select(F.col("_first").alias("_label")), "_label", "left_semi").drop("_label")


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows of all."""
    return df.orderBy(*order).limit(k)
