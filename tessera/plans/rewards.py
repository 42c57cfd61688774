"""Group rewards, count matrices and metric logs. Orders stand in for groups, returnflags for layers, suppliers for experts, events for a log."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import matrix, metrics, reward
from tessera.plans._registry import query, tables
from tessera.streaming.metrics import step_histogram


@query("""
SELECT l_orderkey, l_linenumber, round((l_extendedprice - avg(l_extendedprice) OVER w) / (stddev_pop(l_extendedprice) OVER w + 1e-8), 6) + 0.0 AS z FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)
""")
def group_zscore(spark, sf_dir):
    """C31."""
    (li,) = tables(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", (F.round(reward.z_in_group(F.col("l_extendedprice"), Window.partitionBy("l_orderkey")), 6) + 0.0).alias("z"))


CHECKS = "SELECT l_orderkey AS g, l_linenumber AS i, unnest(['q', 'd', 't']) AS c, unnest([l_quantity >= 25, l_discount >= 0.05, l_tax >= 0.04]) AS p FROM lineitem"


@query(f"""
WITH c AS ({CHECKS}), d AS (SELECT *, 1 - avg(p::INT) OVER (PARTITION BY g, c) AS d FROM c)
SELECT g, i, round(CASE WHEN sum(d) > 0 THEN sum(d * p::INT) / sum(d) ELSE 0 END, 6) AS credit FROM d GROUP BY g, i
""")
def check_credit(spark, sf_dir):
    """C32."""
    (li,) = tables(spark, sf_dir, "lineitem")
    tests = F.array(*(F.struct(F.lit(n).alias("c"), ok.alias("p")) for n, ok in (("q", F.col("l_quantity") >= 25), ("d", F.col("l_discount") >= 0.05), ("t", F.col("l_tax") >= 0.04))))
    rows = li.select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("i"), F.explode(tests).alias("x")).select("g", "i", "x.*")
    return reward.check_credit(rows, "g", "i", "c", "p").select("g", "i", F.round("credit", 6).alias("credit"))


@query("""
WITH r AS (SELECT l_orderkey AS g, l_linenumber AS i, l_quantity AS a, CASE WHEN l_returnflag <> 'R' THEN l_discount END AS b, l_tax AS c, l_linestatus = 'F' AND l_quantity < 5 AS bad FROM lineitem),
m AS (SELECT *, coalesce(b, avg(b) OVER (PARTITION BY g), 0) AS bi FROM r),
z AS (SELECT *, 0.35 * (a - avg(a) OVER w) / (stddev_pop(a) OVER w + 1e-8) + 0.35 * (bi - avg(bi) OVER w) / (stddev_pop(bi) OVER w + 1e-8) + 0.3 * (c - avg(c) OVER w) / (stddev_pop(c) OVER w + 1e-8) AS s FROM m WINDOW w AS (PARTITION BY g))
SELECT g, i, b IS NULL AS was_imputed, round(CASE WHEN bad THEN 0 ELSE greatest(-5, least(5, s)) END, 5) + 0.0 AS reward FROM z
""")
def composite_reward(spark, sf_dir):
    """C33 X07."""
    (li,) = tables(spark, sf_dir, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("i"), F.col("l_quantity").alias("a"), F.when(F.col("l_returnflag") != "R", F.col("l_discount")).alias("b"), F.col("l_tax").alias("c"), ((F.col("l_linestatus") == "F") & (F.col("l_quantity") < 5)).alias("bad"))
    return reward.composite(rows, "g", {"a": 0.35, "b": 0.35, "c": 0.30}, F.col("bad")).select("g", "i", "was_imputed", (F.round("reward", 5) + 0.0).alias("reward"))


@query("""
SELECT l_orderkey, l_linenumber, round(s, 6) AS group_std, round(a, 6) + 0.0 AS advantage FROM (SELECT *, stddev_pop(l_quantity) OVER w AS s, l_quantity - avg(l_quantity) OVER w AS a FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)) WHERE s > 0
""")
def centred_advantage(spark, sf_dir):
    """G02."""
    (li,) = tables(spark, sf_dir, "lineitem")
    out = reward.centred(li.select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey", "l_quantity")
    return out.select("l_orderkey", "l_linenumber", F.round("group_std", 6).alias("group_std"), (F.round("advantage", 6) + 0.0).alias("advantage"))


@query("""
WITH i AS (SELECT o_orderkey AS k, o_totalprice / 5000 AS gt, o_custkey % 100 AS m FROM orders), a AS (SELECT * FROM i WHERE k <= 40),
p AS (SELECT i.k, avg(((i.gt - a.gt) * (i.m - a.m) > 0)::INT) AS w FROM i LEFT JOIN a ON i.gt <> a.gt GROUP BY i.k)
SELECT k, round(w, 6) AS pairwise, round(1 - abs(gt - m) / 100, 8) AS calibration FROM p JOIN i USING (k)
""")
def calibration_reward(spark, sf_dir):
    """J12 C34."""
    (o,) = tables(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") / 5000).alias("gt"), (F.col("o_custkey") % 100).alias("m"))
    out = reward.concordance(rows, rows.where("k <= 40"), "k", "gt", "m")
    return out.select("k", F.round("pairwise", 6).alias("pairwise"), F.round("calibration", 8).alias("calibration"))


@query()
def calibration_reward_whole(spark, sf_dir):
    """J12 C34 with all orders as anchors; as SQL, a join with the square of the table."""
    (o,) = tables(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") / 5000).alias("gt"), (F.col("o_custkey") % 100).alias("m"))
    out = reward.concordance(rows, rows, "k", "gt", "m")
    return out.select("k", F.round("pairwise", 6).alias("pairwise"), F.round("calibration", 8).alias("calibration"))


@query("""
WITH g AS (SELECT (event_id - (SELECT min(event_id) FROM events)) // 4 AS g, avg((value >= 50)::INT) AS m, stddev_pop((value >= 50)::INT) AS s FROM events GROUP BY 1)
SELECT count(*) AS groups, round(avg(s), 6) AS mean_std, round(avg((m = 0)::INT), 6) AS all_zero, round(avg((m = 1)::INT), 6) AS all_one, round(avg((m > 0 AND m < 1)::INT), 6) AS mixed FROM g
""")
def group_density(spark, sf_dir):
    """A19."""
    (e,) = tables(spark, sf_dir, "events")
    first = e.agg(F.min("event_id").alias("least"))
    rows = e.crossJoin(F.broadcast(first)).select((F.col("event_id") - F.col("least")).alias("seq"), (F.col("value") >= 50).alias("ok"))
    out = reward.density(rows, "seq", "ok")
    return out.select("groups", *(F.round(c, 6).alias(c) for c in ("mean_std", "all_zero", "all_one", "mixed")))


COUNTS = "SELECT l_returnflag AS layer, l_suppkey AS expert, count(*) AS n FROM lineitem GROUP BY 1, 2"


def _counts(spark, sf_dir):
    (li,) = tables(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_returnflag").alias("layer"), F.col("l_suppkey").alias("expert")).agg(F.count("*").alias("n"))


@query(f"WITH c AS ({COUNTS}), t AS (SELECT *, n / sum(n) OVER (PARTITION BY layer) AS p FROM c) SELECT layer, round(exp(-sum(p * ln(p))), 6) AS effective, round(stddev_pop(n) / avg(n), 6) AS cv, sum(n)::BIGINT AS total FROM t GROUP BY layer")
def effective_count(spark, sf_dir):
    """C37 C38."""
    out = matrix.concentration(_counts(spark, sf_dir), "layer", "n")
    return out.select("layer", F.round("effective", 6).alias("effective"), F.round("cv", 6).alias("cv"), "total")


@query(f"WITH c AS ({COUNTS}) SELECT layer, expert, row_number() OVER (PARTITION BY layer ORDER BY n DESC, expert) AS rank, round(sum(n) OVER (PARTITION BY layer ORDER BY n DESC, expert ROWS UNBOUNDED PRECEDING) / sum(n) OVER (PARTITION BY layer), 6) AS covered FROM c")
def coverage_curve(spark, sf_dir):
    """W25."""
    return matrix.coverage(_counts(spark, sf_dir), "layer", "expert", "n").withColumn("covered", F.round("covered", 6))


@query("""
WITH c AS (SELECT l_returnflag AS layer, l_suppkey AS expert, count(*) FILTER (l_linenumber <= 3) AS a, count(*) FILTER (l_linenumber > 3) AS b FROM lineitem GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY a DESC, expert DESC) <= 8 AS ta, row_number() OVER (PARTITION BY layer ORDER BY b DESC, expert DESC) <= 8 AS tb FROM c)
SELECT layer, round(count(*) FILTER (ta AND tb) / count(*) FILTER (ta OR tb), 6) AS jaccard FROM t GROUP BY layer
""")
def mask_overlap_jaccard(spark, sf_dir):
    """W07 U07 C39."""
    (li,) = tables(spark, sf_dir, "lineitem")
    c = li.groupBy(F.col("l_returnflag").alias("layer"), F.col("l_suppkey").alias("expert")).agg(F.count_if(F.col("l_linenumber") <= 3).alias("a"), F.count_if(F.col("l_linenumber") > 3).alias("b"))
    out = matrix.jaccard(matrix.top(c, "layer", "expert", "a", 8), matrix.top(c, "layer", "expert", "b", 8), "layer", "expert")
    return out.withColumn("jaccard", F.round("jaccard", 6))


@query(f"""
WITH c AS ({COUNTS}), m AS (SELECT l_returnflag AS layer, l_suppkey AS expert, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
p AS (SELECT layer, expert, n, n > avg(n) OVER (PARTITION BY layer) AND q > avg(q) OVER (PARTITION BY layer) AS safe FROM c JOIN m USING (layer, expert))
SELECT layer, expert FROM p QUALIFY row_number() OVER (PARTITION BY layer ORDER BY n DESC, expert DESC) <= 10 OR safe
""")
def keep_mask(spark, sf_dir):
    """C40 C41."""
    (li,) = tables(spark, sf_dir, "lineitem")
    c = li.groupBy(F.col("l_returnflag").alias("layer"), F.col("l_suppkey").alias("expert")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    return matrix.keep_mask(c, matrix.protected(c, "layer", "expert", ["n", "q"]), "layer", "expert", "n", 10)


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))) / sqrt(len(embedding) * list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS score FROM embeddings")
def vector_norm_score(spark, sf_dir):
    """C42."""
    (e,) = tables(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(matrix.weight_norm(F.col("embedding")), 6).alias("score"))


DAILY = "SELECT event_type, date_diff('day', DATE '2024-01-01', ts::DATE) AS step, avg(value) AS v, count(*) AS n FROM events GROUP BY 1, 2"


def _daily(spark, sf_dir):
    (e,) = tables(spark, sf_dir, "events")
    return e.groupBy("event_type", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("step")).agg(F.avg("value").alias("v"), F.count("*").alias("n"))


@query(f"""
WITH d AS ({DAILY}), w AS (SELECT * FROM (VALUES ('early', 0, 4), ('mid', 5, 14), ('late', 15, 400), ('never', 900, 901)) v(name, lo, hi))
SELECT name, count(step) AS n, round(avg(v), 6) AS v, NULL::DOUBLE AS absent FROM w LEFT JOIN d ON step BETWEEN lo AND hi GROUP BY name
""")
def window_means(spark, sf_dir):
    """A16."""
    w = spark.createDataFrame([("early", 0, 4), ("mid", 5, 14), ("late", 15, 400), ("never", 900, 901)], "name string, lo int, hi int")
    out = metrics.window_means(_daily(spark, sf_dir), "step", w, ["v", "absent"])
    return out.select("name", "n", F.round("v", 6).alias("v"), "absent")


@query(f"""
WITH d AS ({DAILY}) SELECT event_type, step, CASE WHEN count(*) OVER w < 2 THEN NULL ELSE round(regr_slope(v, step) OVER w, 5) + 0.0 END AS slope FROM d WINDOW w AS (PARTITION BY event_type ORDER BY step ROWS 9 PRECEDING)
""")
def trailing_slope(spark, sf_dir):
    """W23."""
    s = metrics.trailing_slope(F.col("v"), F.col("step"), ["event_type"], "step")
    return _daily(spark, sf_dir).select("event_type", "step", (F.round(s, 5) + 0.0).alias("slope"))


@query(f"WITH d AS ({DAILY}), r AS (SELECT event_type, step, CASE WHEN n < 15 THEN 'few' WHEN v > 60 THEN 'high' END AS reason FROM d) SELECT event_type, min(step) AS step, arg_min(reason, step) AS reason FROM r WHERE reason IS NOT NULL GROUP BY event_type")
def first_violation(spark, sf_dir):
    """W26."""
    return metrics.first_violation(_daily(spark, sf_dir), ["event_type"], "step", [("few", F.col("n") < 15), ("high", F.col("v") > 60)])


@query(f"WITH d AS ({DAILY}), l AS (SELECT event_type, n < lag(n) OVER (PARTITION BY event_type ORDER BY step) AS f FROM d) SELECT event_type, coalesce(bool_or(f), false) AS falls FROM l GROUP BY event_type")
def ever_falls(spark, sf_dir):
    """W24."""
    return metrics.ever_falls(_daily(spark, sf_dir), ["event_type"], "step", "n")


@query("""
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events)
SELECT event_type, count(*) AS n, min(value) AS min_value, max(value) AS max_value, round(avg(value), 6) AS avg_value FROM r WHERE r > 2 GROUP BY event_type
""")
def telemetry_summary(spark, sf_dir):
    """A11."""
    (e,) = tables(spark, sf_dir, "events")
    return metrics.telemetry(e, ["event_type"], "event_id", ["value"]).withColumn("avg_value", F.round("avg_value", 6))


@query("SELECT user_id % 20 AS step, CASE WHEN value >= 80 THEN 3 WHEN value >= 40 THEN 2 WHEN value >= 10 THEN 1 WHEN value >= 0 THEN 0 ELSE -1 END AS bin, count(*) AS n FROM events GROUP BY 1, 2")
def step_histograms(spark, sf_dir):
    """A22 ST3."""
    (e,) = tables(spark, sf_dir, "events")
    return step_histogram(e.select((F.col("user_id") % 20).alias("step"), "value"), "step", "value", [0, 10, 40, 80])


@query("SELECT event_id, CASE WHEN value < 4 THEN 'throttled' WHEN value >= 95 THEN 'hot' WHEN value < 20 THEN 'idle' WHEN value < 60 THEN 'light' WHEN value < 90 THEN 'busy' ELSE 'full' END AS zone, CASE WHEN event_id % 4 = 0 THEN greatest(1, event_id // 4) ELSE greatest(1, round_even(event_id / 4, 0)::BIGINT) END AS share FROM events")
def power_zones(spark, sf_dir):
    """P23 G14."""
    (e,) = tables(spark, sf_dir, "events")
    return e.select("event_id", metrics.power_zone(F.col("value"), F.when(F.col("value") >= 95, 90).otherwise(50), F.col("value")).alias("zone"), metrics.coupled(F.col("event_id"), F.lit(4)).alias("share"))
