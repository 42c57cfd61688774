"""Metric logs: windows of steps, trailing slopes, halting rules, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def window_means(df: DataFrame, step: str, windows: DataFrame, columns: list[str], broadcast_windows: int = 10_000) -> DataFrame:
    """Name, n and the mean of each column over steps from lo to hi; a column that the log lacks gives null. windows: name, lo, hi.

    Windows are broadcast if they were counted to be at most broadcast_windows; else
    they meet steps by ranges of steps as long as a window on average.
    """
    have = [F.col(c).cast("double").alias(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in columns]
    rows = df.select(F.col(step).alias("_step"), *have)
    inside = (F.col("_step") >= F.col("lo")) & (F.col("_step") <= F.col("hi"))
    n, span = windows.agg(F.count("*"), F.avg(F.col("hi") - F.col("lo"))).first()
    if n <= broadcast_windows:
        joined = F.broadcast(windows).join(rows, inside, "left")
    else:
        at = lambda c: F.floor(F.col(c) / max(1.0, float(span or 0)))
        dealt = windows.where("lo <= hi").withColumn("_b", F.explode(F.sequence(at("lo"), at("hi"))))
        met = dealt.join(rows.withColumn("_b", at("_step")), "_b").where(inside).select("name", "_step", *columns)
        joined = met.unionByName(windows.select("name"), allowMissingColumns=True)
    return joined.groupBy("name").agg(F.count("_step").alias("n"), *(F.avg(c).alias(c) for c in columns))


def trailing_slope(y: Column, x: Column, by: list[str], order: str, rows: int = 10) -> Column:
    """W23, ST4: the least-squares slope over the last rows; null under two, 0 where x does not vary."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-(rows - 1), 0)
    n = F.count(F.when(x.isNotNull() & y.isNotNull(), 1)).over(w)
    return F.when(n < 2, None).when(F.var_pop(x).over(w) == 0, 0.0).otherwise(F.regr_slope(y, x).over(w))


def ever_falls(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Whether any value, of those that are there, is less than the one before."""
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(order))
    return rows.withColumn("_f", F.col(value) < before).groupBy(*by).agg(F.coalesce(F.bool_or("_f"), F.lit(False)).alias("falls"))


def first_violation(df: DataFrame, by: list[str], step: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """The first step at which a rule holds, and the first such rule in their order."""
    reason = None
    for name, cond in rules:
        reason = F.when(cond, name) if reason is None else reason.when(cond, name)
    hit = df.withColumn("_reason", reason).where(F.col("_reason").isNotNull())
    return hit.groupBy(*by).agg(F.min(F.struct(F.col(step), F.col("_reason"))).alias("_f")).select(*by, F.col(f"_f.{step}").alias(step), F.col("_f._reason").alias("reason"))


def winner(df: DataFrame, by: list[str], gates: list[tuple[str, Column]], order: list[Column]) -> DataFrame:
    """Every candidate with the gates that it fails, its place among the eligible ones, and whether it wins."""
    reasons = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), n) for n, ok in gates)))
    rows = df.withColumn("reasons", reasons).withColumn("_ok", F.size("reasons") == 0)
    place = F.row_number().over(Window.partitionBy(*by, "_ok").orderBy(*order))
    return rows.withColumn("place", F.when(F.col("_ok"), place)).withColumn("wins", F.coalesce(F.col("place") == 1, F.lit(False))).drop("_ok")


def triaged(df: DataFrame, by: list[str], hard: list[tuple[str, Column]], value: str, within: float = 0.05) -> DataFrame:
    """The first hard gate that fails, else "behind" where value is further than within from the best of those that pass, else null."""
    reason = None
    for name, ok in hard:
        bad = ~F.coalesce(ok, F.lit(False))
        reason = F.when(bad, name) if reason is None else reason.when(bad, name)
    rows = df.withColumn("_hard", reason)
    best = F.max(F.when(F.col("_hard").isNull(), F.col(value))).over(Window.partitionBy(*by))
    return rows.withColumn("reason", F.coalesce("_hard", F.when(F.col(value) < best - within, "behind"))).drop("_hard")


def gates(row: DataFrame, rules: list[tuple[str, str, str, float]]) -> DataFrame:
    """A row for each gate of a one-row table of metrics: gate, value, threshold, passed; a missing value fails. rules: name, column, ">=" or ">" or "<=" or "<", threshold."""
    tests = {">=": lambda v, t: v >= t, ">": lambda v, t: v > t, "<=": lambda v, t: v <= t, "<": lambda v, t: v < t}
    built = F.array(*(F.struct(F.lit(n).alias("gate"), F.col(c).cast("double").alias("value"), F.lit(float(t)).alias("threshold"), F.coalesce(tests[op](F.col(c), t), F.lit(False)).alias("passed")) for n, c, op, t in rules))
    return row.select(F.explode(built).alias("g")).select("g.*")


def threshold_sweep(df: DataFrame, label: str, score: str, thresholds: list[float]) -> DataFrame:
    """Threshold, tp, fp, fn, tn, precision, recall, f1 and accuracy of each threshold, and which is best (the first of equals)."""
    rows = df.where(F.col(score).isNotNull()).select(F.col(label).cast("int").alias("y"), F.col(score).alias("s"), F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    yes = F.col("s") >= F.col("threshold")
    c = rows.groupBy("threshold").agg(*(F.count_if(cond).alias(n) for n, cond in (("tp", yes & (F.col("y") == 1)), ("fp", yes & (F.col("y") == 0)), ("fn", ~yes & (F.col("y") == 1)), ("tn", ~yes & (F.col("y") == 0)))))
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    out = c.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn)).withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn)).withColumn("accuracy", ratio(tp + tn, tp + fp + fn + tn))
    return out.withColumn("best", F.row_number().over(Window.orderBy(F.desc("f1"), "threshold")) == 1)  # one row for each threshold


def telemetry(df: DataFrame, by: list[str], order: str, columns: list[str], warm_up: int = 2, least: int = 3) -> DataFrame:
    """Least, largest and mean of each column after the first rows; null where too few are left."""
    rows = df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("_r") > warm_up)
    aggs = [F.when(F.count("*") >= least, f(c)).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max), ("avg", F.avg))]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *aggs)


def power_zone(watts: Column, temperature: Column, memory_gb: Column) -> Column:
    """Throttled, hot, idle, light, busy or full, the most urgent first."""
    return F.when(memory_gb < 4, "throttled").when(temperature >= 85, "hot").when(watts < 20, "idle").when(watts < 60, "light").when(watts < 90, "busy").when(watts.isNotNull(), "full")


def coupled(value: Column, by: Column, least: int = 1) -> Column:
    """The quotient where it is whole, else rounded half to even, at least `least`."""
    return F.greatest(F.lit(least), F.when(value % by == 0, (value / by).cast("long")).otherwise(F.bround(value / by).cast("long")))


def importance_diff(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Both values (0 where absent), their distance and whether a key appeared or vanished."""
    both = a.select(key, F.col(value).alias("before")).join(b.select(key, F.col(value).alias("after")), key, "full_outer")
    state = F.when(F.col("before").isNull(), "appeared").when(F.col("after").isNull(), "vanished").otherwise("both")
    return both.select(key, state.alias("state"), F.coalesce("before", F.lit(0.0)).alias("before"), F.coalesce("after", F.lit(0.0)).alias("after")).withColumn("distance", F.abs(F.col("after") - F.col("before")))
