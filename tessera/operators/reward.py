"""Rewards within groups of rollouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import stats

EPSILON = 1e-8


def z_in_group(value: Column, group: Window) -> Column:
    """By the population deviation; EPSILON keeps constant groups at 0."""
    return (value - F.avg(value).over(group)) / (F.stddev_pop(value).over(group) + EPSILON)


def check_credit(checks: DataFrame, group: str, item: str, check: str, passed: str) -> DataFrame:
    """Of each item the share of passed checks, each weighted by 1 - the rate at which its group passes it; 0 where all weights are 0."""
    rate = F.avg(F.col(passed).cast("double")).over(Window.partitionBy(group, check))
    rows = checks.withColumn("_d", 1 - rate)
    return rows.groupBy(group, item).agg(F.when(F.sum("_d") > 0, F.sum(F.col("_d") * F.col(passed).cast("double")) / F.sum("_d")).otherwise(0.0).alias("credit"))


def imputed(value: Column, group: Window, default: float = 0.0) -> Column:
    """The group's mean for what is missing."""
    return F.coalesce(value, F.avg(value).over(group), F.lit(default))


def composite(df: DataFrame, group: str, parts: dict[str, float], failed: Column, offset: float = 0.0, low: float = -5.0, high: float = 5.0) -> DataFrame:
    """Columns <part>_norm, was_imputed, composite_pre_gate and reward: the weighted sum of z-scores, moved and clipped, 0 for what failed for good."""
    w = Window.partitionBy(group)
    out = df
    for p in parts:
        out = out.withColumn(f"_{p}", imputed(F.col(p), w))
    for p in parts:
        out = out.withColumn(f"{p}_norm", z_in_group(F.col(f"_{p}"), w))
    total = sum((F.col(f"{p}_norm") * k for p, k in parts.items()), F.lit(0.0)) + offset
    missing = F.lit(False)
    for p in parts:
        missing = missing | F.col(p).isNull()
    out = out.withColumn("was_imputed", missing).withColumn("composite_pre_gate", F.greatest(F.lit(low), F.least(F.lit(high), total)))
    return out.withColumn("reward", F.when(failed, 0.0).otherwise(F.col("composite_pre_gate"))).drop(*(f"_{p}" for p in parts))


def concordance(items: DataFrame, anchors: DataFrame, key: str, gt: str, model: str, block_rows: int = 100_000) -> DataFrame:
    """Of each item the share of anchors with another truth that the model orders as the truth does, and 1 - |error|/100; null without such an anchor.

    Any number of anchors: they are counted by ranks (stats.dominance), never joined as pairs.
    """
    point = lambda df, w: df.select(F.col(gt).cast("double").alias("_g"), F.col(model).cast("double").alias("_m"), F.lit(w).alias("_w")).where(stats._known("_g") & stats._known("_m"))
    known = point(anchors, 1)
    n = known.count()
    found = stats.dominance(point(items, 0).unionByName(known).withColumn("_all", F.lit(0)), ["_all"], "_g", "_m", "_w", block_rows)
    found = found.select("_g", "_m", (F.col("less") + F.col("more")).alias("_good"))
    same = known.groupBy("_g").agg(F.count("*").alias("_same"))
    rows = items.select(key, gt, model, F.col(gt).cast("double").alias("_g"), F.col(model).cast("double").alias("_m")).join(found, ["_g", "_m"], "left").join(same, "_g", "left")
    others = F.sum(F.when(F.col("_good").isNotNull(), n - F.coalesce("_same", F.lit(0))))
    return rows.groupBy(key).agg(F.when(others > 0, F.sum("_good") / others).alias("pairwise"), (1 - F.abs(F.first(gt) - F.first(model)) / 100).alias("calibration"))


def blended(a: Column, b: Column, weight: float, cap: float = 1.0) -> Column:
    """A convex blend; b counts for nothing at weight 0 or where it is not a number, and never for more than cap."""
    w = min(weight, cap)
    return a if w == 0 else F.when(b.isNull() | F.isnan(b), a).otherwise((1 - w) * a + w * b)


def shared_dims(a: Column, b: Column) -> Column:
    """1 - the mean distance over 10 of the dimensions that both maps have; null without any."""
    keys = F.filter(F.map_keys(a), lambda k: F.try_element_at(a, k).isNotNull() & F.try_element_at(b, k).isNotNull())
    total = F.aggregate(keys, F.lit(0.0), lambda s, k: s + F.abs(F.try_element_at(a, k) - F.try_element_at(b, k)) / 10)
    return F.when(F.size(keys) > 0, 1 - total / F.size(keys))


def centred(df: DataFrame, group: str, reward: str) -> DataFrame:
    """group_std and advantage; groups whose reward does not vary go, after their statistics were taken."""
    w = Window.partitionBy(group)
    out = df.withColumn("group_std", F.stddev_pop(reward).over(w)).withColumn("advantage", F.col(reward) - F.avg(reward).over(w))
    return out.where(F.col("group_std") > 0)


def density(df: DataFrame, seq: str, passed: str, size: int = 4) -> DataFrame:
    """Over groups of `size` rows in order of seq (from 0): mean deviation and shares that are all 0, all 1 or mixed."""
    g = df.groupBy(F.floor(F.col(seq) / size).alias("g")).agg(F.avg(F.col(passed).cast("double")).alias("m"), F.stddev_pop(F.col(passed).cast("double")).alias("s"))
    share = lambda c: F.avg(c.cast("double"))
    return g.agg(F.count("*").alias("groups"), F.avg("s").alias("mean_std"), share(F.col("m") == 0).alias("all_zero"), share(F.col("m") == 1).alias("all_one"), share((F.col("m") > 0) & (F.col("m") < 1)).alias("mixed"))


def tiered(text: Column, parsed: Column, kept: Column, gain: Column, least_kept: float = 0.5, norm: float = 20.0) -> Column:
    """Empty 0, unparsed 0.25, too little kept 0.5, else 0.5 and up to 0.5 more for the gain."""
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", 0.0).when(~parsed, 0.25).when(kept < least_kept, 0.5).otherwise(0.5 + 0.5 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), gain / norm)))
