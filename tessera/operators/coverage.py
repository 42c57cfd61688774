"""Coverage, provenance and acceptance of what sources, raters and batches gave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.resampling import rank_correlation


def covered(wanted: DataFrame, have: DataFrame, key: str, group: str) -> DataFrame:
    """How many wanted ids and groups there are, how many ids are there already, and in how many groups all are."""
    seen = have.select(key).distinct().withColumn("_seen", F.lit(True))
    ids = wanted.select(group, key).distinct().join(seen, key, "left")
    groups = ids.groupBy(group).agg(F.count("*").alias("n"), F.count("_seen").alias("s"))
    return groups.agg(F.sum("n").alias("ids"), F.sum("s").alias("covered_ids"), F.count("*").alias("groups"), F.count_if(F.col("n") == F.col("s")).alias("covered_groups"))


def status(df: DataFrame, by: str, states: list[tuple[str, Column]], otherwise: str = "other") -> DataFrame:
    """Rows of each source and state; a row's state is the first that holds."""
    out = None
    for name, cond in states:
        held = F.coalesce(cond, F.lit(False))
        out = F.when(held, name) if out is None else out.when(held, name)
    state = F.lit(otherwise) if out is None else out.otherwise(otherwise)
    return df.groupBy(by, state.alias("state")).agg(F.count("*").alias("rows"))


def stamped(sources: dict[str, DataFrame], name: str = "provenance") -> DataFrame:
    """The rows of all sources, each with the name of its own; a column that a source lacks is null there."""
    out = None
    for source, df in sources.items():
        one = df.withColumn(name, F.lit(source))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no sources")
    return out


def concatenated(first: DataFrame, second: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
    """Both row by row, unchanged, and a report of rows from each and of keys that both have."""
    both = first.union(second)
    a, b = first.select(key.alias("_k")), second.select(key.alias("_k"))
    sides = a.withColumn("_f", F.lit(1)).withColumn("_s", F.lit(0)).unionByName(b.withColumn("_f", F.lit(0)).withColumn("_s", F.lit(1)))
    keys = sides.groupBy("_k").agg(F.sum("_f").alias("f"), F.sum("_s").alias("s"))
    return both, keys.agg(F.sum("f").alias("first_rows"), F.sum("s").alias("second_rows"), F.count_if((F.col("f") > 0) & (F.col("s") > 0)).alias("shared_keys"))


def gap_to_ceiling(rho: Column, reliability: Column, parsed: Column, rows: Column, noise: Column) -> dict[str, Column]:
    """What is left to the ceiling sqrt(reliability), rho without attenuation, the parse rate, and whether the gap is beyond the noise floor."""
    ceiling = F.sqrt(reliability)
    return {"ceiling": ceiling, "gap": ceiling - rho, "corrected": F.when(ceiling > 0, rho / ceiling), "parse_rate": F.when(rows > 0, parsed / rows), "beyond_noise": (ceiling - rho) > noise}


def batch_acceptance(df: DataFrame, batch: str, valid: Column, dims_filled: Column, abstained: Column, least_valid: float = 1.0, least_filled: float = 0.95, most_abstained: float = 0.05) -> DataFrame:
    """Of each batch the shares of valid rows, filled dimensions and abstentions, and whether it is accepted."""
    share = lambda c: F.avg(F.coalesce(c.cast("double"), F.lit(0.0)))
    out = df.groupBy(batch).agg(F.count("*").alias("rows"), share(valid).alias("valid"), share(dims_filled).alias("filled"), share(abstained).alias("abstained"))
    return out.withColumn("accepted", (F.col("valid") >= least_valid) & (F.col("filled") >= least_filled) & (F.col("abstained") < most_abstained))


def fidelity(a: DataFrame, b: DataFrame, key: str, by: list[str], verdict: str, score: str, least_coverage: float = 0.9, least_agreement: float = 0.9, least_rho: float = 0.8) -> DataFrame:
    """Two models on the same rows: coverage of a's rows, share of equal verdicts, Spearman's rho of scores, and whether all three reach their floors."""
    all_rows = a.groupBy(*by).agg(F.count("*").alias("rows"))
    both = a.select(key, *by, F.col(verdict).alias("va"), F.col(score).cast("double").alias("sa")).join(b.select(key, F.col(verdict).alias("vb"), F.col(score).cast("double").alias("sb")), key)
    both = both.where(F.col("sa").isNotNull() & F.col("sb").isNotNull())
    got = both.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col("va") == F.col("vb")).cast("double")).alias("agreement"))
    rho = rank_correlation(both, by, key, "sa", "sb")
    out = all_rows.join(got, by, "left").join(rho, by, "left").withColumn("coverage", F.coalesce(F.col("n"), F.lit(0)) / F.col("rows"))
    ok = (F.col("coverage") >= least_coverage) & (F.col("agreement") >= least_agreement) & (F.col("rho") >= least_rho)
    return out.select(*by, "rows", "coverage", "agreement", "rho", F.coalesce(ok, F.lit(False)).alias("passed"))


def seed_ensemble(df: DataFrame, item: str, seed: str, truth: str, score: str) -> DataFrame:
    """A row for each seed and one, "ensemble", for the items' medians over seeds: n, the share that parsed, and Spearman's rho with the truth."""
    rows = df.select(item, F.col(seed).cast("string").alias("seed"), F.col(truth).cast("double").alias("t"), F.col(score).cast("double").alias("s"))
    medians = rows.groupBy(item).agg(F.min("t").alias("t"), F.median("s").alias("s")).select(item, F.lit("ensemble").alias("seed"), "t", "s")
    every = rows.unionByName(medians)
    rates = every.groupBy("seed").agg(F.count("*").alias("n"), F.avg(F.col("s").isNotNull().cast("double")).alias("parse_rate"))
    return rates.join(rank_correlation(every, ["seed"], item, "t", "s"), "seed", "left")


def dimension_means(df: DataFrame, item: str, seed: str, dim: str, score: str) -> DataFrame:
    """Of each dimension items, the number that any seed gave a score, and mean, the mean of their medians over seeds."""
    number = F.col(score).cast("double")
    rows = df.where(number.isNotNull() & ~F.isnan(number) & F.col(item).isNotNull() & F.col(seed).isNotNull())
    medians = rows.groupBy(dim, item).agg(F.median(number).alias("s"))
    return medians.groupBy(dim).agg(F.count("*").alias("items"), F.avg("s").alias("mean"))
