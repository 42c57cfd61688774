"""Count matrices in long form (layer, expert, count): concentration, masks and their overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.stats import effective_count, variation


def concentration(df: DataFrame, layer: str, n: str) -> DataFrame:
    """Effective count and coefficient of variation of each layer."""
    return df.groupBy(layer).agg(effective_count(n).alias("effective"), variation(n).alias("cv"), F.sum(n).alias("total"))


def coverage(df: DataFrame, layer: str, expert: str, n: str) -> DataFrame:
    """Rank from the largest count and the share that is covered up to it."""
    order = Window.partitionBy(layer).orderBy(F.desc(n), expert)
    upto = F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.sum(n).over(Window.partitionBy(layer))
    return df.select(layer, expert, F.row_number().over(order).cast("long").alias("rank"), upto.alias("covered"))


def top(df: DataFrame, layer: str, expert: str, n: str, k: int) -> DataFrame:
    """The k largest of each layer; the larger expert first among equals."""
    order = Window.partitionBy(layer).orderBy(F.desc(n), F.desc(expert))
    return df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).select(layer, expert)


def jaccard(a: DataFrame, b: DataFrame, layer: str, expert: str, empty: float = 1.0) -> DataFrame:
    """Overlap of two sets of experts by layer."""
    both = a.select(layer, expert, F.lit(1).alias("_a")).join(b.select(layer, expert, F.lit(1).alias("_b")), [layer, expert], "full_outer")
    shared, union = F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)), F.count("*")
    return both.groupBy(layer).agg(F.when(union == 0, empty).otherwise(shared / union).alias("jaccard"))


def missing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """What of a is not in b."""
    return a.join(b, keys, "left_anti")


def protected(df: DataFrame, layer: str, expert: str, counts: list[str], by: str = "mean") -> DataFrame:
    """Experts above their layer's mean (or median) in every count."""
    w = Window.partitionBy(layer)
    ok: Column = F.lit(True)
    for c in counts:
        ok = ok & (F.col(c) > (F.avg(c).over(w) if by == "mean" else F.median(c).over(w)))
    return df.withColumn("_ok", ok).where("_ok").select(layer, expert)


def keep_mask(df: DataFrame, safe: DataFrame, layer: str, expert: str, n: str, k: int, exactly: bool = False) -> DataFrame:
    """The k largest of each layer and all protected ones; or exactly k, protected first, an error where more are protected."""
    rows = df.join(safe.select(layer, expert, F.lit(1).alias("_p")), [layer, expert], "left").withColumn("_p", F.coalesce("_p", F.lit(0)))
    largest = Window.partitionBy(layer).orderBy(F.desc(n), F.desc(expert))
    if not exactly:
        return rows.withColumn("_r", F.row_number().over(largest)).where((F.col("_r") <= k) | (F.col("_p") == 1)).select(layer, expert)
    first = Window.partitionBy(layer).orderBy(F.desc("_p"), F.desc(n), F.desc(expert))
    too_many = F.sum("_p").over(Window.partitionBy(layer)) > k
    ranked = rows.withColumn("_r", F.when(too_many, F.raise_error(F.lit("more experts are protected than may be kept"))).otherwise(F.row_number().over(first)))
    return ranked.where(F.col("_r") <= k).select(layer, expert)


def weight_norm(vector: Column) -> Column:
    """Sum of sizes over the root of their number times the sum of squares; 0 for zero vectors."""
    v = F.transform(vector, lambda x: x.cast("double"))
    size = F.aggregate(v, F.lit(0.0), lambda s, x: s + F.abs(x))
    square = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    return F.when(square > 0, size / F.sqrt(F.size(v) * square)).otherwise(0.0)
