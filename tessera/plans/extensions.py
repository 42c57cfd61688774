"""Extensions that the tables invite: rollups, sessions, time windows, as-of and interval joins, sketches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import ranges
from tessera.plans._registry import query, tables
from tessera.streaming import metrics as stream


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def ext_rollup(spark, sf_dir):
    (li,) = tables(spark, sf_dir, "lineitem")
    return li.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT n_name, c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY CUBE (n_name, c_mktsegment)")
def ext_cube(spark, sf_dir):
    orders, customer, nation = tables(spark, sf_dir, "orders", "customer", "nation")
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    return rows.cube("n_name", "c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events),
i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM i GROUP BY user_id, k
""")
def ext_session(spark, sf_dir):
    (e,) = tables(spark, sf_dir, "events")
    return stream.sessions(e, "ts", "user_id", "6 hours")


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, (date_trunc('day', ts) + INTERVAL 1 DAY)::TIMESTAMP AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def ext_tumbling(spark, sf_dir):
    (e,) = tables(spark, sf_dir, "events")
    out = stream.windowed(e, "ts", ["event_type"], "value", "1 day")
    return out.select("start", "end", "event_type", "n", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"))


@query("""
WITH p AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2), c AS (SELECT * FROM events WHERE event_type = 'click')
SELECT c.event_id, c.user_id, c.ts, p.value FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.ts >= p.ts
""")
def ext_asof(spark, sf_dir):
    (e,) = tables(spark, sf_dir, "events")
    bought = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    clicks = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    return ranges.as_of(clicks, bought, "user_id", "ts", "value", "event_id").select("event_id", "user_id", "ts", "value")


@query("""
WITH i AS (SELECT event_id AS i, user_id, ts AS s, ts + INTERVAL 12 HOUR AS e FROM events WHERE event_type = 'purchase')
SELECT i, event_id FROM i JOIN events USING (user_id) WHERE event_type = 'click' AND ts >= s AND ts < e
""")
def ext_interval_join(spark, sf_dir):
    (e,) = tables(spark, sf_dir, "events")
    spans = e.where("event_type = 'purchase'").select(F.col("event_id").alias("i"), "user_id", F.col("ts").alias("s"), (F.col("ts") + F.expr("INTERVAL 12 HOURS")).alias("e"))
    clicks = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    return ranges.within(clicks, spans, "user_id", "ts", "s", "e", 12 * 3600).select("i", "event_id")


@query()
def ext_approx_distinct(spark, sf_dir):
    (li,) = tables(spark, sf_dir, "lineitem")
    return li.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"), F.percentile_approx("l_extendedprice", 0.5, 1000).alias("median"))
