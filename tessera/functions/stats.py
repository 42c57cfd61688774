"""Statistics: correlations, agreement, tests and resampling.

Moments, ranks and distances are aggregates; only the tails of distributions,
of which Spark has none, are small Python functions over one row a test.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.components import _kept


def average_rank(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """df with value's rank in its group, ties sharing the mean of theirs."""
    ordered = Window.partitionBy(*by).orderBy(value)
    ties = F.count("*").over(Window.partitionBy(*by, value))
    return df.withColumn(name, F.rank().over(ordered) + (ties - 1) / 2)


def spearman(df: DataFrame, by: list[str], x: str, y: str, degenerate: float | None = 0.0) -> DataFrame:
    """By, n, rho; degenerate where one side does not vary or there are under two rows."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_rank(average_rank(rows, by, x, "_rx"), by, y, "_ry")
    flat = (F.count("*") < 2) | (F.stddev_pop("_rx") == 0) | (F.stddev_pop("_ry") == 0)
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.when(flat, degenerate).otherwise(F.corr("_rx", "_ry")).alias("rho"))


def agreement(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Pearson's r, mean absolute error and bias (mean of y - x)."""
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.corr(x, y).alias("pearson"), F.avg(F.abs(F.col(y) - F.col(x))).alias("mae"), F.avg(F.col(y) - F.col(x)).alias("bias"))


def auc(df: DataFrame, by: list[str], label: str, score: str) -> DataFrame:
    """C17: the area under the ROC curve by the rank sum of the positives; null where a class is missing."""
    ranked = average_rank(df.where(F.col(score).isNotNull()), by, score, "_r")
    p, n = F.sum(F.col(label).cast("double")), F.sum(1 - F.col(label).cast("double"))
    return ranked.groupBy(*by).agg(p.cast("long").alias("positives"), n.cast("long").alias("negatives"), F.when((p > 0) & (n > 0), (F.sum(F.col("_r") * F.col(label)) - p * (p + 1) / 2) / (p * n)).alias("auc"))


def kappa(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Cohen's kappa of two yes/no raters; 1 where both always say the same one thing."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    po = F.avg((x == y).cast("double"))
    pe = F.avg(x) * F.avg(y) + (1 - F.avg(x)) * (1 - F.avg(y))
    return df.where(x.isNotNull() & y.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), po.alias("observed"), F.when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe)).alias("kappa"))


def spearman_brown(r: Column, k: int | Column) -> Column:
    """Reliability of k passes from that of one."""
    return k * r / (1 + (k - 1) * r)


def krippendorff_nominal(df: DataFrame, unit: str, value: str) -> DataFrame:
    """Alpha for nominal values: 1 - observed over expected disagreement among units with two ratings or more."""
    per = df.where(F.col(value).isNotNull()).groupBy(unit, value).agg(F.count("*").alias("c"))
    sizes = per.groupBy(unit).agg(F.sum("c").alias("m")).where("m > 1")
    per = per.join(sizes, unit)
    observed = per.groupBy(unit, "m").agg((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))).alias("d")).agg(F.sum(F.col("d") / (F.col("m") - 1)).alias("o"), F.sum("m").alias("n"))
    totals = per.groupBy(value).agg(F.sum("c").alias("t")).agg(F.sum(F.col("t") * F.col("t")).alias("t2"))
    row = observed.crossJoin(F.broadcast(totals))  # one row each
    expected = (F.col("n") * F.col("n") - F.col("t2")) / (F.col("n") - 1)
    return row.select(F.col("n").cast("long").alias("n"), F.when(expected == 0, 1.0).otherwise(1 - F.col("o") / expected).alias("alpha"))


def ks_distance(df: DataFrame, by: list[str], sample: str, value: str) -> DataFrame:
    """The two-sample Kolmogorov-Smirnov distance of sample 0 and 1, with both sizes."""
    w = Window.partitionBy(*by)
    upto = w.orderBy(value).rangeBetween(Window.unboundedPreceding, 0)
    is0, is1 = (F.col(sample) == 0).cast("double"), (F.col(sample) == 1).cast("double")
    gap = F.abs(F.try_divide(F.sum(is0).over(upto), F.sum(is0).over(w)) - F.try_divide(F.sum(is1).over(upto), F.sum(is1).over(w)))
    return df.where(F.col(value).isNotNull()).withColumn("_g", gap).groupBy(*by).agg(F.max("_g").alias("d"), F.sum(is0).cast("long").alias("n0"), F.sum(is1).cast("long").alias("n1"))


def _ks_tail(d: float, n0: int, n1: int) -> float:
    lam = d * math.sqrt(n0 * n1 / (n0 + n1))
    if lam < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * (k * lam) ** 2) for k in range(1, 101))))


def with_ks_p(df: DataFrame, tests: int = 1) -> DataFrame:
    """D, n0 and n1 with the asymptotic p-value, times the number of tests (Bonferroni)."""

    @F.pandas_udf("double")
    def p(d: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([min(1.0, tests * _ks_tail(*r)) if r[1] and r[2] else None for r in zip(d, a, b, strict=True)])

    return df.withColumn("p", p("d", "n0", "n1"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            c = 1 + top / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_tail(t: float, df: float) -> float:
    """P(T > t)."""
    p = 0.5 * incomplete_beta(df / 2, 0.5, df / (df + t * t))
    return p if t >= 0 else 1 - p


def welch_moments(df: DataFrame, by: list[str], sample: str, value: str) -> DataFrame:
    """Difference of means (0 minus 1), its standard error and Welch's degrees of freedom, from sample variances."""
    of = lambda k, f: f(F.when(F.col(sample) == k, F.col(value)))
    out = df.groupBy(*by).agg(*(f.alias(n) for k in (0, 1) for f, n in ((of(k, F.count), f"n{k}"), (of(k, F.avg), f"m{k}"), (of(k, F.var_samp), f"v{k}"))))
    a, b = F.col("v0") / F.col("n0"), F.col("v1") / F.col("n1")
    dof = F.when(a + b > 0, (a + b) * (a + b) / (a * a / (F.col("n0") - 1) + b * b / (F.col("n1") - 1)))
    return out.select(*by, "n0", "n1", (F.col("m0") - F.col("m1")).alias("diff"), F.sqrt(a + b).alias("se"), dof.alias("dof"))


def tost(moments: DataFrame, margin: float, level: float = 0.05) -> DataFrame:
    """P of two one-sided tests against +-margin, and the verdict; with no variance the difference itself decides."""

    @F.pandas_udf("double")
    def p(diff: pd.Series, se: pd.Series, dof: pd.Series) -> pd.Series:
        out = []
        for d, s, n in zip(diff, se, dof, strict=True):
            if pd.isna(d):
                out.append(None)
            elif pd.isna(s) or s == 0:
                out.append(0.0 if abs(d) < margin else 1.0)
            else:
                out.append(max(t_tail((d + margin) / s, n), 1 - t_tail((d - margin) / s, n)))
        return pd.Series(out, dtype="float64")

    return moments.withColumn("p", p("diff", "se", "dof")).withColumn("equivalent", F.col("p") < level)


def interval_inside(low: Column, high: Column, margin: float) -> Column:
    """C25."""
    return (low > -margin) & (high < margin)


def wilson_upper(hits: Column, n: Column, z: float = 1.96) -> Column:
    """The upper bound of a share; 1 without cases."""
    p = hits / n
    return F.when(n == 0, 1.0).otherwise((p + z * z / (2 * n) + z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n))


def less_in_both(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of each point the weight of the points that are less in x and in y. x: whole numbers from 0.

    Two x first differ in one bit; for each bit, points that have it set are
    compared with those of the same higher bits that do not, by cumulated
    weights in order of y.
    """
    order = np.argsort(y, kind="stable")
    x, y, w = x[order], y[order], w[order]
    found, at = np.zeros(len(x), np.int64), np.arange(len(x))
    for k in range(int(x.max(initial=0)).bit_length()):
        o = np.argsort(x >> (k + 1), kind="stable")
        high, upper = x[o] >> (k + 1), (x[o] >> k & 1).astype(bool)
        before = np.concatenate(([0], np.cumsum(np.where(upper, 0, w[o]))))
        node = np.concatenate(([True], high[1:] != high[:-1]))
        tie = node | np.concatenate(([True], y[o][1:] != y[o][:-1]))
        first = lambda new: np.maximum.accumulate(np.where(new, at, 0))
        found[o] += np.where(upper, before[first(tie)] - before[first(node)], 0)
    out = np.empty(len(x), np.int64)
    out[order] = found
    return out


def _dominating(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys, x, y, less and more of rows x, y and w that are distinct in their group, which one task holds."""
    cols = [*keys, x, y]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*cols).schema.fields)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (np.unique(pdf[c].to_numpy(), return_inverse=True)[1].astype(np.int64) for c in (x, y))
        w = pdf["w"].to_numpy(np.int64)
        return pdf[cols].assign(less=less_in_both(a, b, w), more=less_in_both(a.max() - a, -b, w))

    return df.select(*cols, "w").groupBy(*keys).applyInPandas(one, f"{schema}, less long, more long")


def _range_blocks(df: DataFrame, column: str, pieces: int) -> tuple[list[float], list[int]]:
    """Lower bounds of blocks of about equal size, and which blocks hold one value only, as frequent values get their own."""
    if pieces < 2:
        return [], []
    q = df.approxQuantile(column, [k / pieces for k in range(1, pieces)], 0.25 / pieces)
    hot = {a for a, b in zip(q, q[1:], strict=False) if a == b}
    bounds = sorted(set(q) | {float(np.nextafter(v, np.inf)) for v in hot})
    return bounds, [bounds.index(v) + 1 for v in hot]


def dominance(points: DataFrame, by: list[str], x: str, y: str, weight: str, block_rows: int = 100_000) -> DataFrame:
    """by, x, y, w, less and more of each distinct point: its weight, and the weights of its group's points that are less, and more, in both x and y (as doubles).

    No pair is made: x and y are cut into ranges of about block_rows points. What
    is in other ranges of both is counted by cells, what shares one range within it.
    """
    cells = _kept(points.groupBy(*by, F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y)).agg(F.sum(weight).alias("w")))
    pieces = -(-cells.count() // block_rows)
    (xs, single_x), (ys, single_y) = _range_blocks(cells, x, pieces), _range_blocks(cells, y, pieces)

    def block(bounds: list[float], column: str) -> Column:
        if not bounds:
            return F.lit(0)

        @F.pandas_udf("int")
        def at(v: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(bounds, v.to_numpy(), "right").astype(np.int32))

        return at(column)

    cells = cells.withColumn("_a", block(xs, x)).withColumn("_b", block(ys, y))
    inner = _dominating(cells.where(~F.col("_a").isin(single_x)), [*by, "_a"], x, y)
    if pieces < 2:
        return cells.join(inner, [*by, "_a", x, y]).drop("_a", "_b")
    # in the same range of y, by ranges of x; and in other ranges of both
    beside = _dominating(cells.where(~F.col("_b").isin(single_y)).groupBy(*by, "_b", "_a", y).agg(F.sum("w").alias("w")), [*by, "_b"], "_a", y)
    apart = _dominating(cells.groupBy(*by, "_a", "_b").agg(F.sum("w").alias("w")), by, "_a", "_b")
    out = cells
    for k, (part, on) in enumerate(((inner, [*by, "_a", x, y]), (beside, [*by, "_b", "_a", y]), (apart, [*by, "_a", "_b"]))):
        out = out.join(part.withColumnsRenamed({"less": f"_l{k}", "more": f"_m{k}"}), on, "left")
    total = lambda n: sum((F.coalesce(f"_{n}{k}", F.lit(0)) for k in range(3)), F.lit(0))
    return out.select(*by, x, y, "w", total("l").alias("less"), total("m").alias("more"))


def _known(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))


def pair_agreement(df: DataFrame, by: list[str], gt: str, model: str, key: str, block_rows: int = 100_000) -> DataFrame:
    """Among pairs whose truths differ, the share that the model orders alike; its ties count against it.

    Pairs are counted by ranks (dominance), never made. Rows without key or truth
    are in no pair, and rows of the same key in none together; pairs without a
    model's value count as pairs but not in the share.
    """
    group = by or ["_all"]
    rows = df.withColumn("_all", F.lit(0)).select(*group, key, gt, model, F.lit(1).alias("_one")).where(F.col(key).isNotNull() & _known(gt))
    for c in group:
        rows = rows.where(F.col(c).isNotNull())

    def counted(rows: DataFrame, within: list[str]) -> DataFrame:
        def differing(r: DataFrame, name: str) -> DataFrame:
            same = r.groupBy(*within, gt).agg(F.count("*").alias("_c"))
            c, n = F.col("_c"), F.sum("_c")
            return same.groupBy(*within).agg(((n * n - F.sum(c * c)) / 2).cast("long").alias(name))

        judged = rows.where(_known(model))
        good = dominance(judged, within, gt, model, "_one", block_rows).groupBy(*within).agg(F.sum(F.col("w") * F.col("less")).alias("good"))
        return differing(rows, "pairs").join(differing(judged, "judged"), within, "left").join(good, within, "left")

    found = counted(rows, group)
    again = rows.groupBy(*group, key).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    if not again.isEmpty():
        less = counted(rows.join(again, [*group, key], "left_semi"), [*group, key])
        found = found.unionByName(less.select(*group, *((-F.col(c)).alias(c) for c in ("pairs", "judged", "good"))))
    out = found.groupBy(*group).agg(*(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("pairs", "judged", "good"))).where("pairs > 0")
    return out.select(*by, "pairs", F.try_divide("good", "judged").alias("agreement"))


def ndcg(df: DataFrame, by: list[str], gain: str, score: str, key: str, k: int = 10) -> DataFrame:
    """Linear gains, discount log2(rank + 1); 0 where there is nothing to gain."""
    rank = lambda c: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(c), key))
    term = lambda r: F.sum(F.when(F.col(r) <= k, F.col(gain) / F.log2(F.col(r) + 1)))
    out = df.withColumn("_a", rank(score)).withColumn("_b", rank(gain)).groupBy(*by).agg(F.coalesce(term("_a"), F.lit(0.0)).alias("_d"), F.coalesce(term("_b"), F.lit(0.0)).alias("_i"))
    return out.select(*by, F.when(F.col("_i") == 0, 0.0).otherwise(F.col("_d") / F.col("_i")).alias("ndcg"))


def bootstrap(df: DataFrame, by: list[str], columns: list[str], statistic, resamples: int = 2000, seed: int = 42, linear: bool = True) -> DataFrame:
    """By, estimate, low, high: 95 % bounds of statistic(array of rows x columns) over resampled rows, jointly for all columns.

    Seeded by group, so a group's result does not depend on others. Bounds are
    interpolated (linear) or taken at sorted positions. NaN resamples are left out.
    """
    kinds = dict(df.dtypes)
    schema = "".join(f"{c} {kinds[c]}, " for c in by)

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(columns)[columns].to_numpy(float)
        rng = np.random.default_rng([seed, int.from_bytes(repr(key).encode(), "big") % (1 << 63)])
        found = np.array([statistic(x[rng.integers(0, len(x), len(x))]) for _ in range(resamples)], float)
        found = np.sort(found[~np.isnan(found)])
        if not len(found):
            low = high = None
        elif linear:
            low, high = np.percentile(found, [2.5, 97.5])
        else:
            low, high = found[int(0.025 * len(found))], found[min(len(found) - 1, int(0.975 * len(found)))]
        return pd.DataFrame([[*key, statistic(x), low, high]], columns=[*by, "estimate", "low", "high"])

    return df.groupBy(*by).applyInPandas(one, f"{schema}estimate double, low double, high double")


def array_spearman(x: np.ndarray, y: np.ndarray, degenerate: float = 0.0) -> float:
    def ranks(v: np.ndarray) -> np.ndarray:
        _, back, n = np.unique(v, return_inverse=True, return_counts=True)
        return (np.cumsum(n) - (n - 1) / 2)[back]

    a, b = ranks(x), ranks(y)
    return degenerate if a.std() == 0 or b.std() == 0 else float(np.corrcoef(a, b)[0, 1])


def spearman_delta(x: np.ndarray) -> float:
    """By how much column 1 follows column 0 better than column 2 does."""
    return array_spearman(x[:, 0], x[:, 1]) - array_spearman(x[:, 0], x[:, 2])


def rounded(value: Column, digits: int) -> Column:
    """value as a double, rounded as DuckDB does, from the product with the power of ten; F.round takes the shortest decimal (0.5005 gives 0.5 here and 0.501 there)."""
    scaled = F.round(value.cast("double") * 10.0**digits) / 10.0**digits
    return F.when(F.abs(scaled) < float("inf"), scaled).otherwise(value.cast("double"))


def varies(value: Column, least: float, distinct: int = 3) -> Column:
    """F19, as an aggregate: population deviation of at least `least` and so many values rounded to 3 digits."""
    return (F.stddev_pop(value) >= least) & (F.count_distinct(rounded(value, 3)) >= distinct)


def effective_count(n: str) -> Column:
    """C37, as an aggregate over rows of counts: exp of the entropy of their shares; null without any."""
    total, weighted = F.sum(n), F.sum(F.when(F.col(n) > 0, F.col(n) * F.log(F.col(n).cast("double"))))
    return F.when(total > 0, F.exp(F.log(total.cast("double")) - weighted / total))


def variation(n: str) -> Column:
    """Population deviation over mean."""
    return F.when(F.avg(n) != 0, F.stddev_pop(n) / F.avg(n))


