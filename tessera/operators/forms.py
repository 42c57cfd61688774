"""Reward forms, their gate and their sweep.

A form tells from a checkpoint's scores and the truths of the same items how
well the checkpoint judges. AGGREGATES are aggregate columns: all that are asked for are
computed in one grouping. GROUPED are functions of a frame, for forms that need ranks.
Callers add their own with ``register`` or hand them to ``gate``.

Rows without checkpoint, item, truth or a finite score are left out; repeated rows count
each. A form without a value at a checkpoint is null there. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import resampling, stats
from tessera.operators import reward

Aggregate = Callable[[Column, Column], Column]
Grouped = Callable[[DataFrame, str, str, str, str], DataFrame]

AGGREGATES: dict[str, Aggregate] = {"calibration": lambda model, gt: 1 - F.avg(F.abs(model - gt)) / 100}


def _pairwise(df: DataFrame, checkpoint: str, item: str, model: str, gt: str) -> DataFrame:
    return stats.pair_agreement(df, [checkpoint], gt, model, item).select(checkpoint, F.col("agreement").alias("value"))


GROUPED: dict[str, Grouped] = {
    "pairwise": _pairwise,
    "in_group_spearman": lambda df, c, i, m, g: resampling.rank_correlation(df, [c], i, m, g).withColumnRenamed("rho", "value"),
    "ndcg_at_10": lambda df, c, i, m, g: stats.ndcg(df, [c], g, m, i, 10).withColumnRenamed("ndcg", "value"),
}

#: Forms that a completion can be given by itself, and the weights of the sweep: fixed values.
COMPLETION_FORMS = ("calibration", "hybrid", "pairwise")
WEIGHTS = (0.0, 0.15, 0.3, 0.45, 0.6, 0.8, 1.0)
ERROR_WEIGHT = 0.10
MOST_ECHO = 0.30
LEAST_CHECKPOINTS = 4


def register(name: str, form: Aggregate | Grouped, grouped: bool = False) -> None:
    """Adds a form; a name that is taken is an error."""
    if name in AGGREGATES or name in GROUPED:
        raise ValueError(f"form {name!r} exists")
    (GROUPED if grouped else AGGREGATES)[name] = form


def shared_items(df: DataFrame, checkpoint: str, item: str, model: str, gt: str) -> DataFrame:
    """The rows, with scores and truths as doubles, of items that every checkpoint has."""
    number = lambda c: F.col(c).cast("double").alias(c)
    rows = df.select(checkpoint, item, number(model), number(gt)).where(F.col(checkpoint).isNotNull() & F.col(item).isNotNull() & stats._known(model) & stats._known(gt))
    every = rows.agg(F.count_distinct(checkpoint).alias("_all"))  # one row
    held = rows.groupBy(item).agg(F.count_distinct(checkpoint).alias("_n")).join(F.broadcast(every), F.col("_n") == F.col("_all"))
    return rows.join(held.select(item), item, "left_semi")


def series(df: DataFrame, checkpoint: str, item: str, model: str, gt: str, forms: dict[str, Aggregate | None]) -> DataFrame:
    """A row for each checkpoint: target, Spearman's rho of scores and truths, and a column for each form; a form of None is looked up."""
    unknown = [f for f, own in forms.items() if own is None and f not in AGGREGATES and f not in GROUPED]
    if unknown:
        raise ValueError(f"unknown forms {unknown}; there are {sorted([*AGGREGATES, *GROUPED])}, or give a function")
    rows = shared_items(df, checkpoint, item, model, gt)
    plain = {f: own or AGGREGATES[f] for f, own in forms.items() if own or f in AGGREGATES}
    out = rows.groupBy(checkpoint).agg(F.count("*").alias("items"), *(f(F.col(model), F.col(gt)).cast("double").alias(n) for n, f in plain.items()))
    out = out.join(resampling.rank_correlation(rows, [checkpoint], item, model, gt).withColumnRenamed("rho", "target"), checkpoint, "left")
    for name in forms:
        if name not in plain:
            out = out.join(GROUPED[name](rows, checkpoint, item, model, gt).withColumnRenamed("value", name), checkpoint, "left")
    return out.select(checkpoint, "items", "target", *forms)


def validity(points: DataFrame, by: list[str], checkpoint: str, value: str, target: str, resamples: int = 2000, seed: int = 42) -> DataFrame:
    """By, n, estimate, low, high and valid: Spearman's rho of value and target over checkpoints, with 95 % bounds of seeded Poisson resamples.

    valid is a lower bound above 0. Checkpoints without either number do not count; under
    LEAST_CHECKPOINTS there is neither estimate nor validity. Resamples in which a side does not vary are left out.
    """
    number = lambda c: F.round(F.col(c).cast("double"), 9)
    rows = points.select(*by, checkpoint, number(value).alias("_x"), number(target).alias("_y"))
    held = F.count_if(stats._known("_x") & stats._known("_y"))
    sizes = rows.groupBy(*by).agg(held.alias("n"))
    drawn = resampling.resampled(rows, by, checkpoint, {"rho": ("_x", "_y")}, {}, resamples, seed, degenerate=None)
    found = resampling.bounds(drawn, by, F.col("rho"), linear=False)
    same = reduce(lambda a, c: a & sizes[c].eqNullSafe(found[c]), by, F.lit(True))
    enough = F.col("n") >= LEAST_CHECKPOINTS
    out = sizes.join(found, same, "left").select(*(sizes[c] for c in by), "n", *(F.when(enough, F.col(c)).alias(c) for c in ("estimate", "low", "high")))
    return out.withColumn("valid", F.coalesce(F.round("low", 9) > 0, F.lit(False)))


def _long(wide: DataFrame, names: list[str], keep: list[str]) -> DataFrame:
    each = F.array(*(F.struct(F.lit(n).alias("form"), F.col(n).cast("double").alias("value")) for n in names))
    return wide.select(*keep, F.inline(each))


def gate(df: DataFrame, checkpoint: str, item: str, model: str, gt: str, forms: dict[str, Aggregate | None], external: DataFrame | None = None, resamples: int = 2000, seed: int = 42) -> DataFrame:
    """A row for each form, and for each column of external (checkpoint and series known from elsewhere): n, estimate, low, high, valid.

    A caller's form is a function of two columns; a name that is neither known nor given one is an error.
    """
    wide = series(df, checkpoint, item, model, gt, forms)
    names = list(forms)
    if external is not None:
        others = [c for c in external.columns if c != checkpoint]
        wide, names = wide.join(external, checkpoint, "left"), names + others
    return validity(_long(wide, names, [checkpoint, "target"]), ["form"], checkpoint, "value", "target", resamples, seed)


def hybrid(pairwise: Column, calibration: Column) -> Column:
    """Pairwise less a tenth of the error that calibration is 1 minus, within 0 and 1."""
    return F.when(pairwise.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), pairwise - ERROR_WEIGHT * (1 - calibration))))


def calibrated(items: DataFrame, anchors: DataFrame, key: str, gt: str, model: str) -> DataFrame:
    """key and COMPLETION_FORMS of each item against the anchors' truths; null where score or truth is missing."""
    against = anchors.select(key, F.col(gt).alias("_at")).select(key, F.col("_at").alias(gt), F.col("_at").alias(model))
    # an anchor stands at its truth in both, so it is ordered alike if score and item's truth lie on the same side of it
    known = items.where(stats._known(gt) & stats._known(model))
    found = reward.concordance(known, against, key, gt, model).withColumn("hybrid", hybrid(F.col("pairwise"), F.col("calibration")))
    return items.select(key).join(found.select(key, *COMPLETION_FORMS), key, "left")


def sweep(checkpoints: DataFrame, completions: DataFrame, adversaries: DataFrame, checkpoint: str, group: str, fix: str = "fix", target: str = "target", forms: tuple[str, ...] = COMPLETION_FORMS, weights: tuple[float, ...] = WEIGHTS, resamples: int = 2000, seed: int = 42) -> DataFrame:
    """A row for each form and weight w of the reward (1 - w) * fix + w * form, under three lenses, and its place.

    Validity: n, estimate, low, high, valid of the blended series of checkpoints. Density, over completions in groups: mid, the share of
    rewards strictly between 0.1 and 0.9, mean_std, all_zero and nonuniform, shares of groups. Echo: the largest reward of
    the adversaries. Each frame has fix and a column for each form; a null form leaves fix as it is (reward.blended), but
    a checkpoint without it does not count. place numbers what is valid with an echo of at most MOST_ECHO by mid,
    fewest all_zero, low, then form and weight; 1 is selected and without any the sweep selects nothing.

    Completions are read once, whatever the size of the grid: a group has four aggregates for each setting.
    """
    grid = [(f, float(w)) for f in sorted(forms) for w in weights]
    # a reward of 0.3 may be 0.1 + 0.2 in one order of sums and not in another
    blend = lambda f, w: F.round(reward.blended(F.coalesce(F.col(fix).cast("double"), F.lit(0.0)), F.col(f).cast("double"), w), 9)

    mixed = F.array(*(F.struct(F.lit(f).alias("form"), F.lit(w).alias("weight"), ((1 - w) * F.col(fix) + w * F.col(f)).cast("double").alias("value")) for f, w in grid))
    valid = validity(checkpoints.select(checkpoint, target, F.inline(mixed)), ["form", "weight"], checkpoint, "value", target, resamples, seed)

    each = completions.groupBy(group).agg(F.count("*").alias("_n"), *(c.alias(f"_{n}{k}") for k, (f, w) in enumerate(grid) for n, c in (("s", F.stddev_pop(blend(f, w))), ("l", F.min(blend(f, w))), ("h", F.max(blend(f, w))), ("m", F.count_if((blend(f, w) > 0.1) & (blend(f, w) < 0.9))))))
    share = lambda c: F.avg(c.cast("double"))
    lenses = [
        F.struct(
            F.lit(f).alias("form"),
            F.lit(w).alias("weight"),
            F.sum("_n").alias("samples"),
            F.count("*").alias("groups"),
            (F.sum(f"_m{k}") / F.sum("_n")).alias("mid"),
            F.avg(f"_s{k}").alias("mean_std"),
            share((F.col(f"_l{k}") == 0) & (F.col(f"_h{k}") == 0)).alias("all_zero"),
            share(F.col(f"_l{k}") < F.col(f"_h{k}")).alias("nonuniform"),
        )
        for k, (f, w) in enumerate(grid)
    ]
    dense = each.agg(F.array(*lenses).alias("_g")).select(F.inline("_g"))
    echoed = adversaries.agg(F.array(*(F.struct(F.lit(f).alias("form"), F.lit(w).alias("weight"), F.coalesce(F.max(blend(f, w)), F.lit(0.0)).alias("echo")) for f, w in grid)).alias("_g")).select(F.inline("_g"))

    on = ["form", "weight"]
    out = dense.join(echoed, on).join(valid, on, "left").withColumn("valid", F.coalesce("valid", F.lit(False))).withColumn("n", F.coalesce("n", F.lit(0)))
    passes = F.col("valid") & (F.col("echo") <= MOST_ECHO)
    order = Window.partitionBy("_passes").orderBy(F.desc_nulls_last("mid"), F.asc_nulls_last("all_zero"), F.desc("low"), "form", "weight")  # rows of the grid
    out = out.withColumn("_passes", passes).withColumn("place", F.when(passes, F.row_number().over(order)))
    return out.select("form", "weight", "n", "estimate", "low", "high", "valid", "samples", "groups", "mid", "mean_std", "all_zero", "nonuniform", "echo", "place")
