"""Reward forms and judge evaluations. Suppliers stand in for judged items, months for checkpoints, orders for completions, events for a judge's answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import resampling, stats
from tessera.operators import forms, judging
from tessera.plans._registry import query, tables

_ITEMS = """i AS (SELECT l_suppkey AS item, month(l_shipdate)::BIGINT AS ck, round(2 * avg(l_quantity), 6) AS m FROM lineitem GROUP BY 1, 2),
tr AS (SELECT l_suppkey AS item, round(2 * avg(l_quantity), 6) AS g FROM lineitem GROUP BY 1),
co AS (SELECT item FROM i GROUP BY item HAVING count(*) = (SELECT count(DISTINCT ck) FROM i)),
v AS (SELECT ck, item, m, g FROM i JOIN tr USING (item) SEMI JOIN co USING (item)),
fx AS (SELECT month(l_shipdate)::BIGINT AS ck, round(avg(l_discount) * 10, 9) AS fix FROM lineitem GROUP BY 1),
rk AS (SELECT *, rank() OVER (PARTITION BY ck ORDER BY m) + (count(*) OVER (PARTITION BY ck, m) - 1) / 2.0 AS rm, rank() OVER (PARTITION BY ck ORDER BY g) + (count(*) OVER (PARTITION BY ck, g) - 1) / 2.0 AS rg,
  row_number() OVER (PARTITION BY ck ORDER BY m DESC, item) AS pm, row_number() OVER (PARTITION BY ck ORDER BY g DESC, item) AS pg FROM v),
pl AS (SELECT ck, count(*) AS items, 1 - avg(abs(m - g)) / 100 AS calibration, avg((m > g)::INT) AS above, corr(rm, rg) AS target, sum(CASE WHEN pm <= 10 THEN g / log2(pm + 1) END) / sum(CASE WHEN pg <= 10 THEN g / log2(pg + 1) END) AS ndcg_at_10 FROM rk GROUP BY ck),
pw AS (SELECT a.ck, avg(((a.m - b.m) * (a.g - b.g) > 0)::INT) AS pairwise FROM v a JOIN v b ON a.ck = b.ck AND a.item < b.item AND a.g <> b.g GROUP BY a.ck),
se AS (SELECT ck, items, target, calibration, above, ndcg_at_10, target AS in_group_spearman, pairwise, greatest(0, least(1, pairwise - 0.1 * (1 - calibration))) AS hybrid, fix FROM pl JOIN pw USING (ck) JOIN fx USING (ck))"""

_DRAWS, _HASH, _WEIGHT = resampling.weights_sql("ck", 2000)


def _validity_sql(keys: str) -> str:
    """CTEs from lo (keys, ck, x, y) to va (keys, n, estimate, low, high, valid)."""
    rank = f"sum(sum(w)) OVER (PARTITION BY {keys}, replicate ORDER BY {{0}}) - (sum(w) - 1) / 2.0"
    return f"""{_DRAWS}, e AS (SELECT {keys}, replicate, round(x, 9) AS x, round(y, 9) AS y, {_WEIGHT} AS w FROM (SELECT *, {_HASH} AS h FROM lo) s, d),
ex AS (SELECT {keys}, replicate, x, {rank.format("x")} AS a FROM e WHERE w > 0 GROUP BY {keys}, replicate, x),
ey AS (SELECT {keys}, replicate, y, {rank.format("y")} AS b FROM e WHERE w > 0 GROUP BY {keys}, replicate, y),
mo AS (SELECT {keys}, replicate, sum(w) AS n, (sum(w) + 1) / 2.0 AS m, sum(w * a * a) AS aa, sum(w * b * b) AS bb, sum(w * a * b) AS ab FROM e JOIN ex USING ({keys}, replicate, x) JOIN ey USING ({keys}, replicate, y) WHERE w > 0 GROUP BY {keys}, replicate),
rh AS (SELECT {keys}, replicate, CASE WHEN n >= 2 AND aa - n * m * m >= 1e-9 AND bb - n * m * m >= 1e-9 THEN (ab - n * m * m) / sqrt((aa - n * m * m) * (bb - n * m * m)) END AS rho FROM mo),
bo AS (SELECT {keys}, max(rho) FILTER (replicate < 0) AS estimate, list_sort(list(rho) FILTER (replicate >= 0 AND rho IS NOT NULL)) AS l FROM rh GROUP BY {keys}),
va AS (SELECT {keys}, (SELECT count(*) FROM se) AS n, estimate, l[least(len(l), floor(len(l) * 0.025)::INT + 1)] AS low, l[least(len(l), floor(len(l) * 0.975)::INT + 1)] AS high, round(low, 9) > 0 AS valid FROM bo)"""


def _judged(spark, sf_dir):
    """Suppliers' monthly mean quantities as scores of checkpoints, their own means as truths, and of each month a series of discounts."""
    (li,) = tables(spark, sf_dir, "lineitem")
    rows = li.select(F.col("l_suppkey").alias("item"), F.month("l_shipdate").cast("long").alias("ck"), "l_quantity", "l_discount")
    mean = lambda: F.round(2 * F.avg("l_quantity"), 6)
    truth = rows.groupBy("item").agg(mean().alias("g"))
    scores = rows.groupBy("item", "ck").agg(mean().alias("m")).join(truth, "item")
    return scores, rows.groupBy("ck").agg(F.round(F.avg("l_discount") * 10, 9).alias("fix"))


_NAMES = ["pairwise", "in_group_spearman", "ndcg_at_10", "calibration"]
#: A caller's form, to be judged by the gate.
_ABOVE = {"above": lambda m, g: F.avg((m > g).cast("double"))}


@query(f"WITH {_ITEMS} SELECT ck, items, round(target, 6) AS target, " + ", ".join(f"round({n}, 6) AS {n}" for n in [*_NAMES, "above"]) + " FROM se")
def reward_forms(spark, sf_dir):
    """All forms of each checkpoint, one of them the caller's."""
    scores, _ = _judged(spark, sf_dir)
    out = forms.series(scores, "ck", "item", "m", "g", dict.fromkeys(_NAMES) | _ABOVE)
    return out.select("ck", "items", *(F.round(c, 6).alias(c) for c in ["target", *_NAMES, "above"]))


@query(f"""
WITH {_ITEMS}, lo AS (UNPIVOT (SELECT ck, target AS y, {", ".join(_NAMES)}, above, fix FROM se) ON {", ".join(_NAMES)}, above, fix INTO NAME form VALUE x), {_validity_sql("form")}
SELECT form, n, round(estimate, 6) AS estimate, round(low, 6) AS low, round(high, 6) AS high, valid FROM va
""")
def reward_validity(spark, sf_dir):
    """Which forms follow the target over checkpoints: four known ones, a caller's, and a series that does not depend on scores."""
    scores, fix = _judged(spark, sf_dir)
    out = forms.gate(scores, "ck", "item", "m", "g", dict.fromkeys(_NAMES) | _ABOVE, fix)
    return out.select("form", "n", *(F.round(c, 6).alias(c) for c in ("estimate", "low", "high")), "valid")


_FORMS = ["calibration", "hybrid", "pairwise"]
_W = "(VALUES (0.0::DOUBLE), (0.15), (0.3), (0.45), (0.6), (0.8), (1.0)) w(weight)"
_BLEND = "round(CASE WHEN weight = 0 OR value IS NULL THEN fix ELSE (1 - weight) * fix + weight * value END, 9)"
_RATED = """SELECT {0}, {1} AS fix, p AS pairwise, c AS calibration, greatest(0, least(1, p - 0.1 * (1 - c))) AS hybrid
  FROM (SELECT {0}, m, any_value(g) AS g, 1 - abs(any_value(g) - m) / 100 AS c, avg((sign(m - t) = sign(g - t))::INT) FILTER (g <> t) AS p FROM {2}, an GROUP BY {0}, m, g)"""


@query(f"""
WITH {_ITEMS}, lo AS (SELECT form, weight, ck, y, (1 - weight) * fix + weight * value AS x FROM (UNPIVOT (SELECT ck, target AS y, fix, {", ".join(_FORMS)} FROM se) ON {", ".join(_FORMS)} INTO NAME form VALUE value), {_W}), {_validity_sql("form, weight")},
an AS (SELECT o_totalprice / 5000 AS t FROM orders WHERE o_orderstatus = 'P'),
it AS (SELECT o_orderkey AS k, o_orderkey // 4 AS grp, o_totalprice / 5000 AS g, (o_custkey % 100)::DOUBLE AS m FROM orders WHERE o_orderpriority <> '5-LOW'),
ra AS ({_RATED.format("k, grp", "m / 100", "it")} UNION ALL SELECT o_orderkey, o_orderkey // 4, 0, NULL, NULL, NULL FROM orders WHERE o_orderpriority = '5-LOW'),
bl AS (SELECT grp, form, weight, {_BLEND} AS r FROM (SELECT grp, fix, unnest({_FORMS}) AS form, unnest([{", ".join(_FORMS)}]) AS value FROM ra), {_W}),
gr AS (SELECT form, weight, grp, count(*) AS n, stddev_pop(r) AS s, min(r) AS l, max(r) AS h, count(*) FILTER (r > 0.1 AND r < 0.9) AS mid FROM bl GROUP BY form, weight, grp),
de AS (SELECT form, weight, sum(n)::BIGINT AS samples, count(*) AS groups, sum(mid) / sum(n) AS mid, avg(s) AS mean_std, avg((l = 0 AND h = 0)::INT) AS all_zero, avg((l < h)::INT) AS nonuniform FROM gr GROUP BY form, weight),
ad AS (SELECT 0 AS k, 95.0 AS g, 95.0 AS m), ea AS ({_RATED.format("k", "0.1", "ad")}),
ec AS (SELECT form, weight, {_BLEND} AS echo FROM (UNPIVOT (SELECT * FROM ea) ON {", ".join(_FORMS)} INTO NAME form VALUE value), {_W}),
al AS (SELECT * FROM de JOIN ec USING (form, weight) JOIN va USING (form, weight))
SELECT form, weight, n, round(estimate, 6) AS estimate, round(low, 6) AS low, round(high, 6) AS high, valid, samples, groups, round(mid, 6) AS mid, round(mean_std, 6) AS mean_std, round(all_zero, 6) AS all_zero, round(nonuniform, 6) AS nonuniform, round(echo, 6) AS echo,
  CASE WHEN valid AND echo <= 0.3 THEN row_number() OVER (PARTITION BY valid AND echo <= 0.3 ORDER BY mid DESC, all_zero, low DESC, form, weight) END AS place FROM al
""")
def reward_sweep(spark, sf_dir):
    """21 settings of form and weight. Orders are completions in groups of four, those of low priority could not be parsed; orders of status P are anchors; one answer repeats its truth but is right in a tenth."""
    scores, fix = _judged(spark, sf_dir)
    (o,) = tables(spark, sf_dir, "orders")
    orders = o.select(F.col("o_orderkey").alias("k"), F.floor(F.col("o_orderkey") / 4).alias("grp"), (F.col("o_totalprice") / 5000).alias("g"), F.when(F.col("o_orderpriority") != "5-LOW", (F.col("o_custkey") % 100).cast("double")).alias("m"), "o_orderstatus")
    anchors = orders.where("o_orderstatus = 'P'")
    done = orders.select("k", "grp", F.coalesce(F.col("m") / 100, F.lit(0.0)).alias("fix")).join(forms.calibrated(orders, anchors, "k", "g", "m"), "k")
    echo = spark.createDataFrame([(0, 95.0, 95.0)], "k long, g double, m double")
    adversaries = forms.calibrated(echo, anchors, "k", "g", "m").withColumn("fix", F.lit(0.1))
    points = forms.series(scores, "ck", "item", "m", "g", dict.fromkeys(["pairwise", "calibration"])).withColumn("hybrid", forms.hybrid(F.col("pairwise"), F.col("calibration"))).join(fix, "ck")
    out = forms.sweep(points, done, adversaries, "ck", "grp")
    return out.select("form", "weight", "n", *(F.round(c, 6).alias(c) for c in ("estimate", "low", "high", "mid", "mean_std", "all_zero", "nonuniform", "echo")), "valid", "samples", "groups", "place")


_JUDGED = """u AS (SELECT user_id, round(avg(value), 6) AS usual FROM events WHERE event_type = 'view' GROUP BY user_id),
a AS (SELECT event_id, event_type, user_id, TRY_CAST(props ->> '$.k' AS DOUBLE) AS m, CASE WHEN value < 50 THEN value END AS own, usual FROM events LEFT JOIN u USING (user_id)),
t AS (SELECT *, CASE WHEN event_type = 'error' AND m % 2 = 1 THEN 'api_error' WHEN m IS NULL THEN 'parse_fail' WHEN m > 95 THEN 'type_error' WHEN own IS NULL AND usual IS NULL THEN 'no_truth' END AS reason,
  CASE WHEN reason IS NULL THEN CASE WHEN own IS NOT NULL THEN 'dataset' ELSE 'usual' END END AS gt_source, CASE WHEN reason IS NULL THEN coalesce(own, usual) END AS gt FROM a)"""


def _answers(spark, sf_dir):
    (e,) = tables(spark, sf_dir, "events")
    usual = e.where("event_type = 'view'").groupBy("user_id").agg(stats.rounded(F.avg("value"), 6).alias("usual"))
    return e.join(usual, "user_id", "left").select("event_id", "event_type", "user_id", F.get_json_object("props", "$.k").try_cast("double").alias("m"), F.when(F.col("value") < 50, F.col("value")).alias("own"), "usual")


def _skips():
    return [("api_error", (F.col("event_type") == "error") & (F.col("m") % 2 == 1)), ("parse_fail", F.col("m").isNull()), ("type_error", F.col("m") > 95)]


@query(f"WITH {_JUDGED} SELECT event_id, reason, gt_source, round(gt, 6) AS gt FROM t")
def judge_pairs(spark, sf_dir):
    """Each answer's reason to be left out, or its truth and where that is from."""
    out = judging.tagged(_answers(spark, sf_dir), _skips(), [("dataset", F.col("own")), ("usual", F.col("usual"))])
    return out.select("event_id", "reason", "gt_source", F.round("gt", 6).alias("gt"))


@query(f"WITH {_JUDGED} SELECT event_type, coalesce(reason, 'paired:' || gt_source) AS reason, count(*) AS n FROM t GROUP BY 1, 2")
def judge_left_out(spark, sf_dir):
    """How many were left out and why, and how many were paired with which truth."""
    return judging.left_out(judging.tagged(_answers(spark, sf_dir), _skips(), [("dataset", F.col("own")), ("usual", F.col("usual"))]), ["event_type"])


@query(f"""
WITH {_JUDGED}, p AS (SELECT event_type, unnest(['k', 'low', 'none']) AS dim, unnest([m, m % 10, m]) AS v, unnest([own, NULL, NULL]) AS d, unnest([usual, usual, NULL]) AS f FROM t WHERE reason IS NULL),
q AS (SELECT event_type, dim, v, coalesce(d, f) AS g, d IS NULL AS fell FROM p WHERE coalesce(d, f) IS NOT NULL),
r AS (SELECT *, rank() OVER (PARTITION BY event_type, dim ORDER BY v) + (count(*) OVER (PARTITION BY event_type, dim, v) - 1) / 2.0 AS a, rank() OVER (PARTITION BY event_type, dim ORDER BY g) + (count(*) OVER (PARTITION BY event_type, dim, g) - 1) / 2.0 AS b FROM q)
SELECT event_type, dim, count(*) AS n, sum(fell::INT)::BIGINT AS fallbacks, round(coalesce(corr(a, b), 0), 6) AS rho FROM r GROUP BY event_type, dim
""")
def judge_dimensions(spark, sf_dir):
    """Correlations by dimension, each with the first truth that has it; a dimension without any has no pair."""
    number = lambda *kv: F.create_map(*(x for k, v in kv for x in (F.lit(k), v)))
    rows = judging.tagged(_answers(spark, sf_dir), _skips(), [("dataset", F.col("own")), ("usual", F.col("usual"))])
    rows = rows.withColumn("said", number(("k", F.col("m")), ("low", F.col("m") % 10), ("none", F.col("m")))).withColumn("d", number(("k", F.col("own")))).withColumn("f", number(("k", F.col("usual")), ("low", F.col("usual"))))
    each = judging.dimensions(rows, ["event_id", "event_type"], "said", [("dataset", "d"), ("usual", "f")])
    fell = each.groupBy("event_type", "dim").agg(F.count_if(F.col("gt_source") == "usual").alias("fallbacks"))
    out = judging.correlations(each, ["event_type", "dim"], "event_id", "model_value", "gt_value").join(fell, ["event_type", "dim"])
    return out.select("event_type", "dim", "n", "fallbacks", F.round("rho", 6).alias("rho"))


@query(f"""
WITH {_JUDGED}, c AS (SELECT event_type, event_id, m, own, CASE WHEN event_type = 'click' THEN 50.0 ELSE usual END AS g, CASE WHEN reason IN ('api_error', 'parse_fail') THEN reason WHEN event_type = 'purchase' OR g IS NULL THEN 'no_truth' END AS why FROM t),
n AS (SELECT event_type, count(*) AS examples, count(*) FILTER (why IS NULL) AS paired, count(*) FILTER (why IS NOT NULL) AS skipped, stddev_pop(g) FILTER (why IS NULL) AS stdev, count(DISTINCT round(g, 3)) FILTER (why IS NULL) AS u FROM c GROUP BY event_type),
r AS (SELECT event_type, corr(a, b) AS rho FROM (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY m) + (count(*) OVER (PARTITION BY event_type, m) - 1) / 2.0 AS a, rank() OVER (PARTITION BY event_type ORDER BY g) + (count(*) OVER (PARTITION BY event_type, g) - 1) / 2.0 AS b FROM c WHERE why IS NULL) GROUP BY event_type),
s AS (SELECT event_type, count(*) AS soft_pairs, corr(a, b) AS soft_rho FROM (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY m) + (count(*) OVER (PARTITION BY event_type, m) - 1) / 2.0 AS a, rank() OVER (PARTITION BY event_type ORDER BY own) + (count(*) OVER (PARTITION BY event_type, own) - 1) / 2.0 AS b FROM c WHERE why IS NULL AND own IS NOT NULL) GROUP BY event_type)
SELECT event_type, examples, paired, skipped, round(stdev, 6) AS stdev, u AS distinct_truths, CASE WHEN paired >= 2 AND stdev >= 1 AND u >= 10 THEN round(rho, 6) END AS rho,
  CASE WHEN paired < 2 THEN 'under_two_pairs' WHEN NOT (stdev >= 1 AND u >= 10) THEN 'truth_does_not_vary' END AS stopped, coalesce(soft_pairs, 0) AS soft_pairs, round(coalesce(soft_rho, 0), 6) AS soft_rho FROM n LEFT JOIN r USING (event_type) LEFT JOIN s USING (event_type)
""")
def judge_canonical(spark, sf_dir):
    """One truth only and no fallback, its variance checked first, with a second truth beside it. Clicks have a truth that does not vary, purchases none."""
    rows = _answers(spark, sf_dir).withColumn("g", F.when(F.col("event_type") == "click", 50.0).when(F.col("event_type") != "purchase", F.col("usual")))
    out = judging.summary(judging.tagged(rows, _skips()[:2], [("canonical", F.col("g"))]), ["event_type"], "event_id", "m", least_stdev=1.0, least_unique=10, soft="own")
    six = {c: stats.rounded(F.col(c), 6) for c in ("stdev", "rho", "soft_rho")}
    return out.withColumns(six).select("event_type", "examples", "paired", "skipped", "stdev", F.col("distinct").alias("distinct_truths"), "rho", "stopped", "soft_pairs", "soft_rho")
