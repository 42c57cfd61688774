"""Reward forms, their gate and sweep, and evaluations of judges: plain versions, missing values, empty tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import resampling, stats
from tessera.operators import coverage, forms, judging

POINTS = "c string, i long, m double, g double"


def scored(spark, checkpoints=6, items=12):
    """Checkpoint k orders more of its items rightly than k - 1."""
    r = np.random.default_rng(1)
    truth = r.permutation(items) * 7.0
    rows = [(f"s{k}", i, float(truth[i] + r.normal(0, 60 / (1 + k))), float(truth[i])) for k in range(checkpoints) for i in range(items)]
    return spark.createDataFrame(rows, POINTS), rows


def plain_pairwise(rows):
    pairs = [(a, b) for n, a in enumerate(rows) for b in rows[n + 1 :] if a[3] != b[3]]
    return sum((a[2] - b[2]) * (a[3] - b[3]) > 0 for a, b in pairs) / len(pairs)


def test_series_equals_plain_forms(spark):
    df, rows = scored(spark)
    got = {r.c: r for r in forms.series(df, "c", "i", "m", "g", dict.fromkeys(["pairwise", "in_group_spearman", "calibration"]) | {"least": lambda m, g: F.min(m)}).collect()}
    for c in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == c]
        assert got[c].items == 12 and got[c].pairwise == pytest.approx(plain_pairwise(mine))
        assert got[c].target == got[c].in_group_spearman == pytest.approx(stats.array_spearman(np.array([r[2] for r in mine]), np.array([r[3] for r in mine])))
        assert got[c].calibration == pytest.approx(1 - np.mean([abs(r[2] - r[3]) for r in mine]) / 100)
        assert got[c].least == min(r[2] for r in mine)


def test_only_items_that_all_checkpoints_have(spark):
    rows = [("a", 1, 1.0, 1.0), ("a", 2, 2.0, 2.0), ("a", 3, 9.0, 1.0), ("b", 1, 2.0, 1.0), ("b", 2, 1.0, 2.0), ("b", 3, None, 1.0), ("b", 4, float("nan"), 1.0), (None, 1, 1.0, 1.0), ("c", None, 1.0, 1.0)]
    got = {r.c: (r.items, r.target) for r in forms.series(spark.createDataFrame(rows, POINTS), "c", "i", "m", "g", {"calibration": None}).collect()}
    assert got == {"a": (2, pytest.approx(1.0)), "b": (2, pytest.approx(-1.0))}


def test_gate_accepts_and_rejects(spark):
    df, _ = scored(spark, 8)
    opposite = {"opposite": lambda m, g: F.avg(F.abs(m - g))}
    got = {r.form: r for r in forms.gate(df, "c", "i", "m", "g", {"in_group_spearman": None} | opposite, spark.createDataFrame([(f"s{k}", 0.5) for k in range(8)], "c string, still double"), resamples=300).collect()}
    assert got["in_group_spearman"].valid and got["in_group_spearman"].estimate == pytest.approx(1.0) and got["in_group_spearman"].n == 8
    assert not got["opposite"].valid and got["opposite"].estimate < 0
    assert not got["still"].valid and got["still"].low is None


def test_gate_needs_four_checkpoints(spark):
    df, _ = scored(spark, 3)
    (got,) = forms.gate(df, "c", "i", "m", "g", {"pairwise": None}, resamples=50).collect()
    assert (got.n, got.estimate, got.low, got.valid) == (3, None, None, False)


def test_names(spark):
    df, _ = scored(spark, 2)
    with pytest.raises(ValueError, match="unknown"):
        forms.series(df, "c", "i", "m", "g", {"nothing": None})
    with pytest.raises(ValueError, match="exists"):
        forms.register("pairwise", lambda m, g: F.avg(m))
    forms.register("mean_score", lambda m, g: F.avg(m))
    try:
        assert "mean_score" in forms.series(df, "c", "i", "m", "g", {"mean_score": None}).columns
    finally:
        del forms.AGGREGATES["mean_score"]


def test_empty_forms(spark):
    none = spark.createDataFrame([], POINTS)
    assert forms.series(none, "c", "i", "m", "g", dict.fromkeys(["pairwise", "ndcg_at_10", "calibration"])).collect() == []
    assert forms.gate(none, "c", "i", "m", "g", {"calibration": None}, resamples=5).collect() == []


def test_calibrated_against_anchors(spark):
    anchors = [(k, float(k), 0.0) for k in (10, 20, 20, 30, 40)]
    items = [(1, 20.0, 35.0), (2, 50.0, 50.0), (3, None, 5.0), (4, 25.0, None), (5, 20.0, 20.0)]
    make = lambda rows: spark.createDataFrame(rows, "k long, g double, m double")
    got = {r.k: r for r in forms.calibrated(make(items), make(anchors), "k", "g", "m").collect()}
    for k, g, m in items:
        if g is None or m is None:
            assert got[k].pairwise is got[k].hybrid is got[k].calibration is None
            continue
        others = [a[1] for a in anchors if a[1] != g]
        share = sum((m - a) * (g - a) > 0 for a in others) / len(others)
        assert got[k].pairwise == pytest.approx(share) and got[k].calibration == pytest.approx(1 - abs(g - m) / 100)
        assert got[k].hybrid == pytest.approx(max(0, min(1, share - abs(g - m) / 1000)))


def sweep_parts(spark, echo):
    checkpoints = spark.createDataFrame([(f"s{k}", k / 10, 0.9 - k / 20, k / 9) for k in range(8)], "c string, target double, fix double, pairwise double")
    done = spark.createDataFrame([(0, 0.0, None), (0, 0.0, None), (1, 0.2, 0.8), (1, 0.6, 0.6), (2, 1.0, 1.0), (2, 1.0, 0.0)], "grp long, fix double, pairwise double")
    return checkpoints, done, spark.createDataFrame([(0.0, None), (0.1, echo)], "fix double, pairwise double")


def test_sweep_lenses_and_selection(spark):
    weights = (0.0, 0.3, 1.0)
    got = {r.weight: r for r in forms.sweep(*sweep_parts(spark, 0.5), "c", "grp", forms=("pairwise",), weights=weights, resamples=200).collect()}
    rewards = {w: [(0.0, 0.0), tuple((1 - w) * f + w * p for f, p in ((0.2, 0.8), (0.6, 0.6))), tuple((1 - w) * f + w * p for f, p in ((1.0, 1.0), (1.0, 0.0)))] for w in weights}
    for w in weights:
        flat = [x for g in rewards[w] for x in g]
        assert (got[w].samples, got[w].groups, got[w].n) == (6, 3, 8)
        assert got[w].mid == pytest.approx(sum(0.1 < x < 0.9 for x in flat) / 6)
        assert got[w].mean_std == pytest.approx(np.mean([np.std(g) for g in rewards[w]]))
        assert got[w].all_zero == pytest.approx(1 / 3) and got[w].nonuniform == pytest.approx(sum(len(set(g)) > 1 for g in rewards[w]) / 3)
        assert got[w].echo == pytest.approx(max(0.0, 0.1 * (1 - w) + 0.5 * w))
    assert not got[0.0].valid and got[0.0].place is None
    assert not got[0.3].valid and got[0.3].estimate < 0  # fix falls faster than a third of the form rises
    assert got[1.0].valid and got[1.0].echo > forms.MOST_ECHO and got[1.0].place is None


def test_sweep_selects_where_the_echo_is_small(spark):
    got = {r.weight: r for r in forms.sweep(*sweep_parts(spark, 0.2), "c", "grp", forms=("pairwise",), weights=(0.0, 0.8, 1.0), resamples=200).collect()}
    assert sorted(r.place for r in got.values() if r.place) == [1, 2]
    assert got[0.8].place == 1 and got[0.8].mid > got[1.0].mid


ANSWERS = "k long, g string, ok boolean, m double, a double, b double"
ROWS = [(1, "x", True, 1.0, 5.0, 6.0), (2, "x", True, 2.0, None, 7.0), (3, "x", None, 3.0, float("nan"), None), (4, "x", False, 4.0, 1.0, 1.0), (5, "x", True, None, 1.0, 1.0), (6, "y", True, 1.0, 5.0, 1.0), (7, "y", True, 2.0, 5.0, 2.0), (8, None, True, 1.0, 1.0, 1.0), (8, None, True, 2.0, 2.0, 1.0)]


def tagged(spark, rows=ROWS):
    return judging.tagged(spark.createDataFrame(rows, ANSWERS), [("api_error", ~F.col("ok")), ("parse_fail", F.col("m").isNull())], [("first", F.col("a")), ("second", F.col("b"))])


def test_reasons_and_sources(spark):
    got = sorted((r.k, r.reason, r.gt_source, r.gt) for r in tagged(spark).where("k < 7").collect())
    assert got == [(1, None, "first", 5.0), (2, None, "second", 7.0), (3, "no_truth", None, None), (4, "api_error", None, None), (5, "parse_fail", None, None), (6, None, "first", 5.0)]
    counts = {(r.g, r.reason): r.n for r in judging.left_out(tagged(spark), ["g"]).collect()}
    assert counts == {("x", "paired:first"): 1, ("x", "paired:second"): 1, ("x", "no_truth"): 1, ("x", "api_error"): 1, ("x", "parse_fail"): 1, ("y", "paired:first"): 2, (None, "paired:first"): 2}


def test_summary_with_preflight(spark):
    df = tagged(spark)
    hard = {r.g: r for r in judging.summary(df, ["g"], "k", "m", least_stdev=0.5, least_unique=2, soft="b").collect()}
    assert (hard["x"].examples, hard["x"].paired, hard["x"].skipped, hard["x"].rho, hard["x"].stopped) == (5, 2, 3, pytest.approx(1.0), None)
    assert (hard["y"].rho, hard["y"].stopped, hard["y"].soft_pairs, hard["y"].soft_rho) == (None, judging.FLAT, 2, pytest.approx(1.0))
    assert hard[None].rho == pytest.approx(1.0) and hard[None].soft_rho == 0.0
    soft = {r.g: r.rho for r in judging.summary(df, ["g"], "k", "m").collect()}
    assert soft["y"] == 0.0 and soft["x"] == pytest.approx(1.0)


def test_summary_of_nothing(spark):
    assert judging.summary(tagged(spark, []), ["g"], "k", "m", 1.0).collect() == []
    (only,) = judging.summary(tagged(spark, [(1, "x", False, 1.0, 1.0, 1.0)]), ["g"], "k", "m", 1.0).collect()
    assert (only.examples, only.paired, only.distinct, only.rho, only.stopped) == (1, 0, 0, None, judging.TOO_FEW)


def test_dimensions_fall_back(spark):
    rows = [(1, None, {"a": 1.0, "b": 2.0, "c": 3.0, "d": None}, {"a": 9.0, "b": None}, {"b": 8.0, "a": 7.0, "d": 1.0}), (2, "no_truth", {"a": 1.0}, {"a": 1.0}, None), (3, None, None, {"a": 1.0}, None), (4, None, {"a": 1.0}, None, {"a": 4.0})]
    df = spark.createDataFrame(rows, "k long, reason string, said map<string,double>, t map<string,double>, u map<string,double>")
    got = sorted((r.k, r.dim, r.model_value, r.gt_value, r.gt_source) for r in judging.dimensions(df, ["k"], "said", [("own", "t"), ("rubric", "u")]).collect())
    assert got == [(1, "a", 1.0, 9.0, "own"), (1, "b", 2.0, 8.0, "rubric"), (4, "a", 1.0, 4.0, "rubric")]


def test_truths_are_rounded_as_in_sql(spark, duck):
    values = [0.5, 0.5005, -0.5015, *(k / 2000 for k in range(-20001, 60001, 2)), 1e306]
    df = spark.createDataFrame([(n, v) for n, v in enumerate(values)], "k long, gt double")
    (want,) = duck.execute("SELECT list(round(v, 3)) FROM (SELECT unnest(?) AS v)", [values]).fetchone()
    got = df.select("k", stats.rounded(F.col("gt"), 3).alias("v")).union(spark.createDataFrame([(len(values), None)], "k long, v double")).orderBy("k").collect()
    assert [r.v for r in got] == [*want, None]
    assert spark.sql("SELECT double('nan') AS v").select(F.isnan(stats.rounded(F.col("v"), 3)).alias("v")).first().v
    rows = df.where("k < 2").select("k", F.lit("x").alias("g"), F.lit(None).cast("string").alias("reason"), "gt", F.col("k").cast("double").alias("m"))
    (only,) = judging.summary(rows, ["g"], "k", "m").collect()
    assert only.distinct == 1  # both are 0.5 to three digits in SQL


@pytest.mark.parametrize("most", [3, 1_000_000])
def test_rank_correlation_both_ways(spark, most):
    r = np.random.default_rng(3)
    rows = [(i, float(r.integers(9)), float(r.integers(9))) for i in range(200)]
    df = spark.createDataFrame(rows, "i long, x double, y double").withColumn("g", F.lit("all"))
    (got,) = resampling.resampled(df, ["g"], "i", {"rho": ("x", "y")}, {}, resamples=0, most=most).collect()
    assert got.replicate == -1 and math.isclose(got.rho, stats.array_spearman(np.array([x[1] for x in rows]), np.array([x[2] for x in rows])), rel_tol=1e-9)


def test_dimension_means(spark):
    rows = [(1, "a", "d", 1.0), (1, "b", "d", 5.0), (1, "c", "d", 6.0), (2, "a", "d", None), (2, "b", "d", 3.0), (3, "a", "d", float("nan")), (1, "a", "e", None)]
    got = coverage.dimension_means(spark.createDataFrame(rows, "i long, s string, d string, v double"), "i", "s", "d", "v").collect()
    assert [(r.d, r["items"], r["mean"]) for r in got] == [("d", 2, 4.0)]
