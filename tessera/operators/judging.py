"""Evaluation of a judge's answers against truths of several origins.

One plan: each example is given the first reason for which it is left out or the first
truth that it has, with its origin; counts, preflight and correlations are aggregates of that.
Nothing is dropped on the way, so examples = paired + left out by reason.

Nulls in a condition mean that it does not hold; null and NaN truths are no truths.
Repeated examples count each. Groups without a pair have counts and a stop. Empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import stats
from tessera.functions.resampling import rank_correlation

NO_TRUTH = "no_truth"
#: Why no correlation is given.
TOO_FEW, FLAT = "under_two_pairs", "truth_does_not_vary"


def _present(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c.cast("double"))


def tagged(df: DataFrame, skips: list[tuple[str, Column]], truths: list[tuple[str, Column]]) -> DataFrame:
    """Df with reason (of the first skip that holds, NO_TRUTH, or null: paired), gt_source and gt of the first truth that there is.

    What is left out has neither source nor truth.
    """
    chain = lambda value: reduce(lambda rest, t: F.when(_present(t[1]), value(t)).otherwise(rest), reversed(truths), F.lit(None))
    source = chain(lambda t: F.lit(t[0])).cast("string")
    last = F.when(source.isNull(), NO_TRUTH)
    reason = reduce(lambda rest, s: F.when(s[1], s[0]).otherwise(rest), reversed(skips), last)
    out = df.withColumn("reason", reason)
    paired = F.col("reason").isNull()
    return out.withColumn("gt_source", F.when(paired, source)).withColumn("gt", F.when(paired, chain(lambda t: t[1].cast("double"))).cast("double"))


def dimensions(df: DataFrame, keep: list[str], model: str, truths: list[tuple[str, str]]) -> DataFrame:
    """Of paired rows keep, dim, model_value, gt_value and gt_source, a row for each dimension of the map model for which one of the maps in truths has a value, in their order."""
    each = df.where("reason IS NULL").select(*keep, *(F.col(c).alias(f"_t{k}") for k, (_, c) in enumerate(truths)), F.explode(model).alias("dim", "model_value"))
    value = lambda k: F.try_element_at(F.col(f"_t{k}"), F.col("dim")).cast("double")
    gt, source = F.lit(None).cast("double"), F.lit(None).cast("string")
    for k in reversed(range(len(truths))):
        gt, source = F.when(_present(value(k)), value(k)).otherwise(gt), F.when(_present(value(k)), truths[k][0]).otherwise(source)
    out = each.select(*keep, "dim", F.col("model_value").cast("double").alias("model_value"), gt.alias("gt_value"), source.alias("gt_source"))
    return out.where(_present(F.col("model_value")) & F.col("gt_value").isNotNull())


def left_out(df: DataFrame, by: list[str]) -> DataFrame:
    """By, reason and n; rows that are paired have the reason "paired:" and the truth's source."""
    return df.groupBy(*by, F.coalesce("reason", F.concat(F.lit("paired:"), "gt_source")).alias("reason")).agg(F.count("*").alias("n"))


def correlations(df: DataFrame, by: list[str], key: str, model: str, gt: str = "gt") -> DataFrame:
    """by, n and rho of paired rows; rho is 0 where a side does not vary or there are under two rows."""
    rows = df.where(_present(F.col(model)) & _present(F.col(gt)))
    n = rows.groupBy(*by).agg(F.count("*").alias("n"))
    return _beside(n, rank_correlation(rows, by, key, model, gt, degenerate=0.0), by)


def _beside(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """a with b's other columns, groups compared with nulls as values."""
    theirs = b.withColumnsRenamed({c: f"_b{i}" for i, c in enumerate(by)})
    same = reduce(lambda x, i: x & a[by[i]].eqNullSafe(theirs[f"_b{i}"]), range(len(by)), F.lit(True))
    return a.join(theirs, same, "left").drop(*(f"_b{i}" for i in range(len(by))))


def summary(df: DataFrame, by: list[str], key: str, model: str, least_stdev: float | None = None, least_unique: int = 3, soft: str | None = None) -> DataFrame:
    """By, examples, paired, skipped, stdev, distinct, rho, stopped; with soft, also soft_pairs and soft_rho.

    With least_stdev (G09) the truths of the pairs must vary before a correlation is
    taken: a population deviation of at least that and least_unique values rounded to 3
    digits, else rho is null and stopped says why. Without it rho is 0 for what does not vary. soft: a second truth, compared over the same
    pairs where it is there, which stops nothing.
    """
    paired = df.where("reason IS NULL")
    counts = df.groupBy(*by).agg(F.count("*").alias("examples"), F.count_if(F.col("reason").isNull()).alias("paired"), F.count_if(F.col("reason").isNotNull()).alias("skipped"))
    spread = paired.groupBy(*by).agg(F.stddev_pop("gt").alias("stdev"), F.count_distinct(stats.rounded(F.col("gt"), 3)).alias("distinct"), stats.varies(F.col("gt"), least_stdev or 0.0, least_unique).alias("_varies"))
    out = _beside(_beside(counts, spread, by), correlations(paired, by, key, model).drop("n"), by)
    if least_stdev is None:
        out = out.withColumn("stopped", F.lit(None).cast("string")).withColumn("rho", F.coalesce("rho", F.lit(0.0)))
    else:
        out = out.withColumn("stopped", F.when(F.col("paired") < 2, TOO_FEW).when(~F.col("_varies"), FLAT)).withColumn("rho", F.when(F.col("stopped").isNull(), F.col("rho")))
    wanted = [*by, "examples", "paired", "skipped", "stdev", F.coalesce("distinct", F.lit(0)).alias("distinct"), "rho", "stopped"]
    if soft is None:
        return out.select(*wanted)
    other = correlations(paired, by, key, model, soft).withColumnsRenamed({"n": "soft_pairs", "rho": "soft_rho"})
    return _beside(out, other, by).select(*wanted, F.coalesce("soft_pairs", F.lit(0)).alias("soft_pairs"), F.coalesce("soft_rho", F.lit(0.0)).alias("soft_rho"))
