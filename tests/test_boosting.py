"""C49 against a plain booster in numpy, and quotas of strata against plain ranks."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import boosting, order
from tessera.operators.boosting import Setting


def numbers(n, seed=1):
    r = np.random.default_rng(seed)
    x = np.round(r.random((n, 4)) * 10) / 10
    x[r.random((n, 4)) < 0.1] = np.nan
    y = ((x[:, 0] > 0.5) != (np.nan_to_num(x[:, 1], nan=0.9) > 0.4)).astype(float)
    y[r.random(n) < 0.05] = 1
    return x, y


def frame(spark, x, y, more=()):
    rows = [(i, *(None if np.isnan(v) else float(v) for v in a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame([*rows, *more], "id long, a double, b double, c double, d double, y double")


def plain_tree(x, g, h, depth, weight):
    """{node: (feature, threshold, nulls go left)} and values by node: every split is tried, over whole columns."""
    splits, values = {}, {0: -g.sum() / (h.sum() + 1)}
    score = lambda at: g[at].sum() ** 2 / (h[at].sum() + 1)

    def grow(node, at, level):
        if level == depth:
            return
        best = None
        for f in range(x.shape[1]):
            null = np.isnan(x[:, f])
            for v in sorted(set(x[at & ~null, f])):
                for left_too in (True, False) if (at & null).any() else (True,):
                    left = at & np.where(null, left_too, x[:, f] <= v)
                    right = at & ~left
                    if h[left].sum() >= weight and h[right].sum() >= weight:
                        gain = round(score(left) + score(right) - score(at), 9)
                        if gain > 0 and (best is None or (gain, -f, -v, left_too) > best[:4]):
                            best = (gain, -f, -v, left_too, left, right)
        if best:
            splits[node] = (-best[1], -best[2], best[3])
            for child, side in ((2 * node + 1, best[4]), (2 * node + 2, best[5])):
                values[child] = -g[side].sum() / (h[side].sum() + 1)
                grow(child, side, level + 1)

    grow(0, np.ones(len(x), bool), 0)
    return splits, values


def plain_margins(x, y, setting, objective):
    positive = (y == 0).sum() / (y == 1).sum()
    margin = np.full(len(y), 0.0 if objective == "logistic" else y.mean())
    for _ in range(setting.trees):
        p = 1 / (1 + np.exp(-margin))
        w = np.where(y == 1, positive, 1.0)
        g, h = ((p - y) * w, p * (1 - p) * w) if objective == "logistic" else (margin - y, np.ones(len(y)))
        splits, values = plain_tree(x, g, h, setting.depth, setting.child_weight)
        for i, row in enumerate(x):
            node = 0
            while node in splits:
                f, v, null_left = splits[node]
                left = null_left if np.isnan(row[f]) else row[f] <= v
                node = 2 * node + (1 if left else 2)
            margin[i] += setting.rate * values[node]
    return margin


@pytest.mark.parametrize("objective", ["logistic", "squared"])
def test_equals_a_plain_booster(spark, objective):
    x, y = numbers(300)
    y = y if objective == "logistic" else y * 3 + np.nan_to_num(x[:, 2])
    settings = [Setting(3, 5, 0.3, 2.0), Setting(2, 3, 0.1, 10.0)]
    df = frame(spark, x, y).repartition(3)
    booster, rows = boosting.fit(df, "id", F.col("y"), list("abcd"), settings, objective, keep=2)
    got = {(r.model, r.key): r.score for r in boosting.predicted(rows, booster).collect()}
    for m, s in enumerate(settings):
        want = plain_margins(x, y, s, objective)
        want = 1 / (1 + np.exp(-want)) if objective == "logistic" else want
        assert np.allclose([got[m, i] for i in range(len(y))], want, atol=1e-9)


def test_learns_what_is_held_out(spark):
    x, y = numbers(2000, 7)
    settings = boosting.grid(depths=(2, 3), trees=(3, 8), rates=(0.3,), weights=(5, 10))
    rows = boosting.cross_validated(frame(spark, x, y), "id", "y", list("abcd"), settings, k=3).collect()
    assert len(rows) == 8 and sum(r.best for r in rows) == 1
    best = next(r for r in rows if r.best)
    assert best.score == max(r.score for r in rows) > 0.93
    rows = boosting.cross_validated(frame(spark, x, y * 2 + np.nan_to_num(x[:, 2])), "id", "y", list("abcd"), settings[-2:], "squared", k=3).collect()
    assert max(r.score for r in rows) > 0.75


def test_edges(spark):
    x, y = numbers(60)
    df = frame(spark, x, y, more=[(1000, None, None, None, None, None), (1001, 99.0, -99.0, float("nan"), 0.1, None)])
    booster, rows = boosting.fit(df.withColumn("none", F.lit(None).cast("double")), "id", F.col("y"), [*"abcd", "none"], [Setting(trees=2, child_weight=1)])
    assert boosting.predicted(rows, booster).count() == 62
    assert {f for r in booster.splits(spark).collect() for f in [r.feature]} <= set("abcd")
    none, rows = boosting.fit(df.limit(0), "id", F.col("y"), ["a"], [Setting(trees=2)])
    assert none.models[0].trees == [] and boosting.predicted(rows, none).collect() == []
    assert len(boosting.grid()) == 36 and boosting.grid()[0] == Setting(3, 100, 0.05, 5)


@pytest.mark.parametrize("buckets", [16, 4096])
def test_quotas_of_strata(spark, buckets):
    """A stratum of most rows, a null one, quotas of nothing, of some and of more than there is."""
    rows = [(i, "big" if i % 4 else None if i % 8 else f"s{i % 5}") for i in range(3000)]
    quotas = {"big": 777, None: 11, "s0": 0, "s1": 10_000, "s2": 5}
    df = spark.createDataFrame(rows, "id long, g string")
    asked = spark.createDataFrame(list(quotas.items()), "g string, quota long")
    got = {r.id for r in order.taken(df, ["g"], asked, 42, "id", buckets=buckets).where("_in").collect()}
    want = set()
    for g, n in quotas.items():
        want |= set(sorted((i for i, s in rows if s == g), key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))[:n])
    assert got == want and order.taken(df, ["g"], asked, 42, "id").count() == 3000


def test_positions_and_ranks_in_groups(spark):
    rows = [(i, "big" if i % 3 else None, (i * 7919) % 50) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, g string, v long").repartition(7)
    at = {r.id: r.p for r in order.group_positions(df, ["g"], [F.col("v"), F.col("id")], "p").collect()}
    ranks = {r.id: r.r for r in order.average_ranks(df, ["g"], "v", "r").collect()}
    for g in ("big", None):
        group = sorted((v, i) for i, s, v in rows if s == g)
        assert [at[i] for _, i in group] == list(range(len(group)))
        values = [v for v, _ in group]
        assert all(ranks[i] == values.index(v) + (values.count(v) + 1) / 2 for v, i in group)
