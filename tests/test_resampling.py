"""Bootstraps against plain ones over repeated items, and both ways of computing them against each other."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import resampling, stats


def items(n=120):
    r = np.random.default_rng(2)
    x = np.round(r.random(n) * 20)
    return [(i, "big" if i % 5 else None, float(a), float(round(a + 8 * r.random())), float(r.random())) for i, a in enumerate(x)]


def plain(rows, h, replicate):
    """Items repeated as often as they weigh, then unweighted ranks."""
    w = resampling.array_weights(h, 42, replicate)
    again = np.repeat(np.array([r[2:] for r in rows]), w, axis=0)
    return stats.array_spearman(again[:, 0], again[:, 1]), again[:, 2].mean()


@pytest.mark.parametrize("most", [10, 1_000_000])
def test_equals_repeated_items(spark, most):
    rows = items()
    df = spark.createDataFrame([*rows, (900, "big", None, 1.0, 1.0), (901, "big", float("nan"), 1.0, 1.0), (902, "flat", 3.0, 1.0, 2.0), (903, "flat", 3.0, 2.0, 2.0)], "id long, g string, x double, y double, z double")
    got = {(r.g, r.replicate): (r.rho, r.mean) for r in resampling.resampled(df, ["g"], "id", {"rho": ("x", "y")}, {"mean": "z"}, resamples=12, most=most, block=5).collect()}
    hashes = {r.id: r.h for r in df.select("id", resampling.item_hash(F.col("id")).alias("h")).collect()}
    for g in ("big", None):
        own = [r for r in rows if r[1] == g]
        for k in range(-1, 12):
            assert np.allclose(got[g, k], plain(own, np.array([hashes[r[0]] for r in own]), k), atol=1e-9)
    assert all(v[0] == 0 and math.isclose(v[1], 2) for (g, _), v in got.items() if g == "flat")
    assert resampling.resampled(df.limit(0), ["g"], "id", {"rho": ("x", "y")}, {}, resamples=3).collect() == []


def test_weights_are_poisson():
    h = np.random.default_rng(3).integers(0, resampling.PRIME, 4000)
    w = np.concatenate([resampling.array_weights(h, 42, r) for r in range(50)])
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03
    assert abs((w == 0).mean() - math.exp(-1)) < 0.01 and w.max() >= 6


def test_bounds(spark):
    found = spark.createDataFrame([(1, -1, 0.5), *((1, k, k / 100) for k in range(101)), (1, 200, None), (2, -1, 1.0)], "g int, replicate int, v double")
    linear = {r.g: r for r in resampling.bounds(found, ["g"], F.col("v")).collect()}
    assert (linear[1].estimate, round(linear[1].low, 9), round(linear[1].high, 9)) == (0.5, 0.025, 0.975) and linear[2].low is None
    placed = {r.g: r for r in resampling.bounds(found, ["g"], F.col("v"), linear=False).collect()}
    assert (placed[1].low, placed[1].high) == (0.02, 0.98)


def test_a_mean_is_covered(spark):
    r = np.random.default_rng(5)
    df = spark.createDataFrame([(int(i), float(v)) for i, v in enumerate(r.normal(10, 2, 400))], "id long, v double").withColumn("g", F.lit("g"))
    row = resampling.bounds(resampling.resampled(df, ["g"], "id", {}, {"m": "v"}, resamples=400), ["g"], F.col("m")).first()
    assert row.low < row.estimate < row.high and abs((row.high - row.low) - 2 * 1.96 * 2 / 20) < 0.1


def test_many_weights_at_once_are_the_same():
    h = np.concatenate([np.random.default_rng(4).integers(0, resampling.PRIME, 5000), [0, 1, resampling.PRIME - 2, resampling.PRIME - 1]])
    chosen = [-1, *range(30)]
    got = resampling.Weights(h, 42, chosen).of(slice(3, None))
    assert all((row == resampling.array_weights(h, 42, r)).all() for row, r in zip(got, chosen[3:], strict=True))
    assert (resampling.Weights(h, 42, chosen).of(slice(0, 1)) == 1).all()


@pytest.mark.parametrize("n", [1, 2, 3, 7, 600, 5000])
@pytest.mark.parametrize("distinct", [(10**9, 50, 11), (3, 2, 2), (1, 4, 2), (10**9, 10**9, 10**6), (300, 200, 5)])
def test_many_correlations_at_once_are_the_same(n, distinct):
    r = np.random.default_rng(n)
    values = {"_h": r.integers(0, resampling.PRIME, n), **{c: r.integers(0, k, n).astype(float) for c, k in zip("xyz", distinct, strict=True)}}
    if n == 5000:
        values |= {c: values[c] % 40 for c in "xyz"}  # many items that are equal
    pairs, chosen = {"a": ("x", "y"), "b": ("z", "x"), "c": ("y", "z"), "d": ("x", "x")}, [-1, *range(8)]
    got = resampling._found(values, pairs, {"m": "y"}, 42, chosen)
    for k, replicate in enumerate(chosen):
        w = resampling.array_weights(values["_h"], 42, replicate)
        again = {c: np.repeat(values[c], w) for c in "xyz"}
        for name, (x, y) in pairs.items():
            flat = w.sum() < 2 or np.ptp(again[x]) == 0 or np.ptp(again[y]) == 0
            assert np.isnan(got[name][k]) if flat else got[name][k] == pytest.approx(stats.array_spearman(again[x], again[y]), abs=1e-9)
        assert np.isnan(got["m"][k]) if w.sum() == 0 else got["m"][k] == pytest.approx(again["y"].mean())


@pytest.mark.parametrize(("most", "alone"), [(1_000_000, 200_000_000), (1_000_000, 500), (10, 200_000_000)])
def test_intervals_are_bounds_of_replicates(spark, monkeypatch, most, alone):
    monkeypatch.setattr(resampling, "ALONE", alone)
    df = spark.createDataFrame([*items(), (902, "flat", 3.0, 1.0, 2.0), (903, "flat", 3.0, 2.0, 2.0)], "id long, g string, x double, y double, z double")
    given = (df, ["g"], "id", {"near": ("x", "y"), "far": ("x", "z")}, {})
    got = {r.g: r for r in resampling.intervals(*given, {"near": 1.0, "far": -1.0}, resamples=40, degenerate=None, most=most, block=15).collect()}
    want = resampling.bounds(resampling.resampled(*given, resamples=40, degenerate=None), ["g"], F.col("near") - F.col("far")).collect()
    assert len(want) == 3
    for r in want:
        assert tuple(got[r.g])[1:] == ((None,) * 3 if r.g == "flat" else pytest.approx(tuple(r)[1:], abs=1e-12))


def test_replicates_of_small_groups_move_no_rows(spark):
    """2,000 replicates of 3,000 rows in a second or two, and rows are not repeated for blocks of replicates."""
    r = np.random.default_rng(6)
    values = {"_h": r.integers(0, resampling.PRIME, 3000), "x": r.random(3000), "y": r.integers(0, 50, 3000).astype(float), "z": r.integers(0, 11, 3000).astype(float)}
    began = time.process_time()
    resampling._found(values, {"near": ("x", "y"), "far": ("x", "z")}, {}, 42, [-1, *range(2000)])
    assert time.process_time() - began < 2.5
    df = spark.createDataFrame(items(), "id long, g string, x double, y double, z double")
    plan = resampling.intervals(df, ["g"], "id", {"near": ("x", "y")}, {}, {"near": 1.0})._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
