"""Gradient-boosted trees by histograms, with a grid of settings and cross-validation.

Features are cut at quantiles into at most ``bins`` bins, a byte each; null is a
bin of its own whose side is learnt at every split. A level of trees is one pass over the rows: each
task adds up gradients and hessians by (model, node, feature, bin) while it reads, the
sums meet in one grouped aggregate, and gains are running sums over bins. What comes back
is one split for each open node, so the driver holds models and never rows.

All models of a grid and of all folds grow in the same passes: a tree's sums for
sixty models cost one scan. A setting with fewer trees is the beginning of the one with more, so
it is not trained again. Margins are written every ``keep`` trees, so a pass adds up a
few trees only.

Gains, leaves and the weight of a child are those of second-order boosting with
an L2 term of ``ridge``; a split must leave ``child_weight`` of hessian on both sides. Of equal
gains (to nine digits) the first feature, then the smaller threshold, then nulls to the left. A
row without label takes no part in training and is predicted like any other; a feature
that is null everywhere is never split on; an empty table gives models of no trees.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.components import _kept, _written
from tessera.operators.order import average_ranks, group_positions, hash_order

MISSING = 255


@dataclass(frozen=True)
class Setting:
    depth: int = 3
    trees: int = 100
    rate: float = 0.1
    child_weight: float = 5.0
    #: Rows of this fold are left out.
    fold: int = -1


def grid(depths: tuple = (3, 4, 5), trees: tuple = (100, 200, 400), rates: tuple = (0.05, 0.1), weights: tuple = (5, 10)) -> list[Setting]:
    """The 36 settings of the calibration, in its order."""
    return [Setting(*point) for point in itertools.product(depths, trees, rates, weights)]


@dataclass
class Tree:
    """Nodes in heap order: the children of i are 2i + 1 and 2i + 2. feature is -1 at leaves."""

    feature: np.ndarray
    cut: np.ndarray
    null_left: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def of_depth(cls, depth: int) -> Tree:
        n = (2 << depth) - 1
        return cls(np.full(n, -1), np.zeros(n, int), np.zeros(n, bool), np.zeros(n), np.zeros(n))

    def nodes(self, rows: np.ndarray, levels: int) -> np.ndarray:
        """Where each row of bins is after so many levels."""
        at, line = np.zeros(len(rows), int), np.arange(len(rows))
        for _ in range(levels):
            f = self.feature[at]
            bins = rows[line, np.maximum(f, 0)]
            left = np.where(bins == MISSING, self.null_left[at], bins <= self.cut[at])
            at = np.where(f < 0, at, 2 * at + np.where(left, 1, 2))
        return at


@dataclass
class Model:
    setting: Setting
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)


@dataclass
class Booster:
    """Models that were trained together, over the same bins."""

    features: list[str]
    edges: list[list[float]]
    objective: str
    models: list[Model]

    def splits(self, spark: object, model: int = 0) -> DataFrame:
        """tree, node, feature, threshold, null_left, gain of one model."""
        rows = [(t, i, self.features[f], float(self.edges[f][tree.cut[i]]), bool(tree.null_left[i]), float(tree.gain[i])) for t, tree in enumerate(self.models[model].trees) for i, f in enumerate(tree.feature) if f >= 0]
        return spark.createDataFrame(rows, "tree int, node int, feature string, threshold double, null_left boolean, gain double")

    def importances(self, spark: object, model: int = 0) -> DataFrame:
        """feature, importance: the mean gain of its splits, as a share of all features' means."""
        by = self.splits(spark, model).groupBy("feature").agg(F.avg("gain").alias("gain"))
        return by.withColumn("importance", F.col("gain") / F.sum("gain").over(Window.partitionBy())).drop("gain")  # one row for each feature


def quantile_edges(df: DataFrame, features: list[str], bins: int = 64, accuracy: int = 10_000) -> list[list[float]]:
    """Ascending cuts of each feature, at most bins - 1 and the largest value; one aggregate over all features."""
    if bins > 250:
        raise ValueError("a bin is a byte")
    at = [k / (bins - 1) for k in range(bins)]
    found = df.agg(*(F.percentile_approx(F.nanvl(F.col(f).cast("double"), F.lit(None)), at, accuracy).alias(str(k)) for k, f in enumerate(features))).first()
    return [sorted({*(v or [])}) for v in found]


def binned(df: DataFrame, key: str, label: Column, features: list[str], edges: list[list[float]], fold: Column) -> DataFrame:
    """key, y, fold, b (a byte for each feature), written once. A value above the last edge is in the last bin."""
    limits = [np.array(e) for e in edges]
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), label.cast("double").alias("y"), fold.cast("int").alias("fold"), F.array(*(F.nanvl(F.col(f).cast("double"), F.lit(None)) for f in features)).alias("x"))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column(3).flatten().to_numpy(zero_copy_only=False), float).reshape(b.num_rows, len(limits))
            out = np.full(x.shape, MISSING, np.uint8)
            for k, e in enumerate(limits):
                if len(e):
                    known = ~np.isnan(x[:, k])
                    out[known, k] = np.minimum(np.searchsorted(e, x[known, k], "left"), len(e) - 1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([r.tobytes() for r in out], pa.binary())], names=["key", "y", "fold", "b"])

    return _written(rows.mapInArrow(coded, f"key {kind}, y double, fold int, b binary"))


def _arrays(b: pa.RecordBatch, width: int, models: int) -> tuple:
    x = np.frombuffer(b"".join(b.column("b").to_pylist()), np.uint8).reshape(b.num_rows, width)
    y, fold = (np.asarray(b.column(c).to_numpy(zero_copy_only=False), float) for c in ("y", "fold"))
    if "margins" in b.schema.names:
        margins = np.frombuffer(b"".join(b.column("margins").to_pylist()), "<f8").reshape(b.num_rows, models).copy()
    else:
        margins = np.zeros((b.num_rows, models))
    return x, y, fold, margins


def _add(margins: np.ndarray, x: np.ndarray, models: list[Model], begin: int, first: bool) -> None:
    for m, model in enumerate(models):
        if first:
            margins[:, m] += model.base
        for tree in model.trees[begin:]:
            margins[:, m] += tree.value[tree.nodes(x, model.setting.depth)]


def _gradients(objective: str, margin: np.ndarray, y: np.ndarray, positive: float) -> tuple[np.ndarray, np.ndarray]:
    if objective == "squared":
        return margin - y, np.ones(len(y))
    p = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
    weight = np.where(y == 1, positive, 1.0)
    return (p - y) * weight, np.maximum(p * (1 - p), 1e-16) * weight


def _histograms(rows: DataFrame, models: list[Model], growing: dict[int, Tree], begin: int, level: int, sizes: list[int], objective: str, positive: float) -> DataFrame:
    """model, node, feature, bin, g, h over the rows of each node of the level that may be split."""
    width, first = len(sizes), "margins" not in rows.columns
    offsets = np.concatenate(([0], np.cumsum(np.array(sizes) + 1)))  # a place more for nulls
    cells, low = int(offsets[-1]), (1 << level) - 1

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {m: np.zeros((2, (1 << level) * cells)) for m in growing}
        for b in batches:
            x, y, fold, margins = _arrays(b, width, len(models))
            _add(margins, x, models, begin, first)
            place = np.where(x == MISSING, np.array(sizes), x) + offsets[:-1]
            for m, tree in growing.items():
                node = tree.nodes(x, level)
                here = (node >= low) & (fold != models[m].setting.fold) & ~np.isnan(y)
                if not here.any():
                    continue
                g, h = _gradients(objective, margins[here, m], y[here], positive)
                at = ((node[here] - low) * cells)[:, None] + place[here]
                for row, v in zip(sums[m], (g, h), strict=True):
                    row += np.bincount(at.ravel(), np.repeat(v, width), len(row))
        for m, (g, h) in sums.items():
            some = np.flatnonzero(h)
            node, cell = np.divmod(some, cells)
            feature = np.searchsorted(offsets, cell, "right") - 1
            spot = cell - offsets[feature]
            spot = np.where(spot == np.array(sizes)[feature], MISSING, spot)
            columns = [np.full(len(some), m), node + low, feature, spot]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns), pa.array(g[some]), pa.array(h[some])], names=["model", "node", "feature", "bin", "g", "h"])

    parts = rows.mapInArrow(summed, "model int, node int, feature int, bin int, g double, h double")
    parts = parts.repartition("model", "node", "feature")  # tasks have added up theirs; running sums over bins need no further shuffle
    return parts.groupBy("model", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))


def split_gains(cells: DataFrame, by: list[str], child_weight: Column, ridge: float = 1.0) -> DataFrame:
    """by, feature, bin, null_left, gain, and sums of both sides (gl, hl, gr, hr), of every split that leaves enough on both sides."""
    group = Window.partitionBy(*by, "feature")
    upto = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # at most as many rows as bins
    null = lambda c: F.coalesce(F.max(F.when(F.col("bin") == MISSING, F.col(c))).over(group), F.lit(0.0))
    told = cells.select(*by, "feature", "bin", *(F.sum(c).over(group).alias(f"all_{c}") for c in "gh"), *(F.sum(c).over(upto).alias(f"to_{c}") for c in "gh"), *(null(c).alias(f"null_{c}") for c in "gh")).where(F.col("bin") != MISSING)
    side = F.explode(F.array(F.lit(True), F.lit(False)))
    told = told.withColumn("null_left", side).where(F.col("null_left") | (F.col("null_h") > 0))  # without nulls both sides are one
    for c in "gh":
        told = told.withColumn(f"{c}l", F.col(f"to_{c}") + F.when(F.col("null_left"), F.col(f"null_{c}")).otherwise(0.0)).withColumn(f"{c}r", F.col(f"all_{c}") - F.col(f"{c}l"))
    score = lambda g, h: F.col(g) * F.col(g) / (F.col(h) + ridge)
    told = told.withColumn("gain", F.round(score("gl", "hl") + score("gr", "hr") - score("all_g", "all_h"), 9))
    return told.where((F.col("hl") >= child_weight) & (F.col("hr") >= child_weight)).select(*by, "feature", "bin", "null_left", "gain", "gl", "hl", "gr", "hr")


def fit(df: DataFrame, key: str, label: Column, features: list[str], settings: list[Setting], objective: str = "logistic", positive: float | None = None, fold: Column | None = None, bins: int = 64, ridge: float = 1.0, keep: int = 10) -> tuple[Booster, DataFrame]:
    """Models of all settings, and the rows in bins, as ``predicted`` takes them.

    objective: logistic (labels 0 and 1) or squared. positive: weight of label 1; if not
    given, zeros to ones. The base margin is the mean, or the log-odds of weighted labels.
    """
    edges = quantile_edges(df, features, bins)
    rows = binned(df, key, label, features, edges, F.lit(0) if fold is None else fold)
    n, ones, mean = rows.where("y IS NOT NULL").agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("y") == 1, 1)), F.lit(0)), F.avg("y")).first()
    if objective == "logistic":
        positive = ((n - ones) / ones if ones else 1.0) if positive is None else positive
        base = math.log(positive * ones / (n - ones)) if 0 < ones < n and positive > 0 else 0.0
    else:
        positive, base = 1.0, mean or 0.0
    models = [Model(s, base) for s in settings]
    booster = Booster(features, edges, objective, models)
    if not n:
        return booster, rows
    state, begin, sizes = rows, 0, [max(len(e), 1) for e in edges]
    weight = F.element_at(F.array(*(F.lit(float(s.child_weight)) for s in settings)), F.col("model") + 1)
    for t in range(max(s.trees for s in settings)):
        growing = {m: Tree.of_depth(s.depth) for m, s in enumerate(settings) if s.trees > t}
        for level in range(max(settings[m].depth for m in growing)):
            open_ = {m: tree for m, tree in growing.items() if settings[m].depth > level and (level == 0 or (tree.feature[(1 << (level - 1)) - 1 : (1 << level) - 1] >= 0).any())}
            if not open_:
                break
            cells = _histograms(state, models, open_, begin, level, sizes, objective, positive)
            if level == 0:
                cells = _kept(cells)
                for m, g, h in cells.where("feature = 0").groupBy("model").agg(F.sum("g"), F.sum("h")).collect():  # one row for each model
                    growing[m].value[0] = -g / (h + ridge) * settings[m].rate
            rank = F.struct("gain", -F.col("feature"), -F.col("bin"), F.col("null_left"))
            best = split_gains(cells, ["model", "node"], weight, ridge).where("gain > 0").groupBy("model", "node").agg(F.max_by(F.struct("feature", "bin", "null_left", "gain", "gl", "hl", "gr", "hr"), rank).alias("s"))
            for m, node, s in best.collect():  # one row for each open node
                tree, rate = growing[m], settings[m].rate
                tree.feature[node], tree.cut[node], tree.null_left[node], tree.gain[node] = s.feature, s.bin, s.null_left, s.gain
                tree.value[2 * node + 1], tree.value[2 * node + 2] = -s.gl / (s.hl + ridge) * rate, -s.gr / (s.hr + ridge) * rate
        for m, tree in growing.items():
            models[m].trees.append(tree)
        if (t + 1) % keep == 0:
            state, begin = _advanced(state, models, begin, len(sizes)), t + 1
    return booster, rows


def _advanced(state: DataFrame, models: list[Model], begin: int, width: int) -> DataFrame:
    """The rows with what their models give so far, written."""
    first = "margins" not in state.columns
    frozen = [replace(m, trees=list(m.trees)) for m in models]

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, _, _, margins = _arrays(b, width, len(frozen))
            _add(margins, x, frozen, begin, first)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("key", "y", "fold", "b")] + [pa.array([r.tobytes() for r in margins.astype("<f8")], pa.binary())], names=["key", "y", "fold", "b", "margins"])

    kind = state.schema["key"].dataType.simpleString()
    return _written(state.mapInArrow(added, f"key {kind}, y double, fold int, b binary, margins binary"))


def predicted(rows: DataFrame, booster: Booster, counts: tuple[int, ...] = (), held_out: bool = False) -> DataFrame:
    """key, y, fold, model, trees, score (a chance for logistic): one row for each model, and for each number of trees in counts (all of a model's, if none).

    held_out: of each model only the fold that it has not seen.
    """
    models, logistic, width = booster.models, booster.objective == "logistic", len(booster.features)
    kind = rows.schema["key"].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y, fold, _ = _arrays(b, width, len(models))
            for m, model in enumerate(models):
                want = np.flatnonzero(fold == model.setting.fold) if held_out else np.arange(len(y))
                if not len(want):
                    continue
                margin, done, some = np.full(len(want), model.base), 0, x[want]
                for n in sorted({c for c in counts if c <= model.setting.trees} or {model.setting.trees}):
                    for tree in model.trees[done:n]:
                        margin = margin + tree.value[tree.nodes(some, model.setting.depth)]
                    done = n
                    score = 1 / (1 + np.exp(-np.clip(margin, -500, 500))) if logistic else margin
                    picked = b.take(pa.array(want))
                    yield pa.RecordBatch.from_arrays([picked.column("key"), picked.column("y"), picked.column("fold"), pa.array(np.full(len(want), m), pa.int32()), pa.array(np.full(len(want), n), pa.int32()), pa.array(score)], names=["key", "y", "fold", "model", "trees", "score"])

    return rows.select("key", "y", "fold", "b").mapInArrow(scored, f"key {kind}, y double, fold int, model int, trees int, score double")


def folds(df: DataFrame, key: str, by: list[Column], k: int = 5, seed: int = 42, name: str = "fold") -> DataFrame:
    """df with a fold from 0 to k - 1; classes of by are spread evenly, by their place in hash order."""
    held = [f"_by{i}" for i in range(len(by))]
    keyed = df.withColumns(dict(zip(held, by, strict=True))).withColumn("_h", hash_order(seed, key))
    out = group_positions(keyed, held, [F.col("_h"), F.col(key)], "_p")
    return out.withColumn(name, (F.col("_p") % k).cast("int")).drop("_p", "_h", *held)


def of_fold(scores: DataFrame, objective: str) -> DataFrame:
    """model, trees and s: AUC or Spearman correlation of y and score, by ranks that no single task puts in order."""
    by = ["model", "trees"]
    ranked = average_ranks(scores, by, "score", "_r")
    if objective == "logistic":
        p, n = F.sum("y"), F.sum(1 - F.col("y"))
        s = F.when((p > 0) & (n > 0), (F.sum(F.col("_r") * F.col("y")) - p * (p + 1) / 2) / (p * n)).otherwise(0.5)
        return ranked.groupBy(*by).agg(s.alias("s"))
    ranked = average_ranks(ranked, by, "y", "_y")
    flat = (F.stddev_pop("_r") == 0) | (F.stddev_pop("_y") == 0)
    return ranked.groupBy(*by).agg(F.when(flat, 0.0).otherwise(F.corr("_r", "_y")).alias("s"))


def cross_validated(df: DataFrame, key: str, label: str, features: list[str], settings: list[Setting], objective: str = "logistic", k: int = 5, seed: int = 42, **how: object) -> DataFrame:
    """depth, trees, rate, child_weight, score, best: the mean over folds of the AUC (logistic) or Spearman correlation (squared) on the fold left out; the first of the highest is best.

    Where a fold has one class only its AUC is 0.5; where labels or scores do not vary the correlation is 0.
    """
    dealt = folds(df.where(F.col(label).isNotNull()), key, [F.col(label)] if objective == "logistic" else [], k, seed)
    longest: dict[tuple, int] = {}
    for s in settings:
        at = (s.depth, s.rate, float(s.child_weight))
        longest[at] = max(s.trees, longest.get(at, 0))
    trained = [Setting(d, n, r, w, f) for (d, r, w), n in longest.items() for f in range(k)]
    booster, rows = fit(dealt, key, F.col(label), features, trained, objective, fold=F.col("fold"), **how)
    scores = predicted(rows, booster, tuple({s.trees for s in settings}), held_out=True)
    by_fold = of_fold(scores, objective)
    points = df.sparkSession.createDataFrame([(m, s.depth, s.rate, float(s.child_weight)) for m, s in enumerate(trained)], "model int, depth int, rate double, child_weight double")
    asked = df.sparkSession.createDataFrame([(i, s.depth, s.trees, s.rate, float(s.child_weight)) for i, s in enumerate(settings)], "place int, depth int, trees int, rate double, child_weight double")
    means = by_fold.join(points, "model").join(asked, ["depth", "rate", "child_weight", "trees"]).groupBy("place", "depth", "trees", "rate", "child_weight").agg(F.avg("s").alias("score"))
    top = F.row_number().over(Window.partitionBy().orderBy(F.desc("score"), "place"))  # one row for each setting
    return means.withColumn("best", top == 1).drop("place")
