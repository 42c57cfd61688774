"""Streams over whole tables that stop and go on in the middle, held against batch SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators.components import _shared_dir
from tessera.plans._registry import query, tables
from tessera.streaming import metrics, stateful


def _folder(spark) -> str:
    return f"{_shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def _halves(events):
    """Events before and after the middle of their time."""
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    first, last = events.agg(F.min(at), F.max(at)).first()  # one row
    late = F.coalesce(at >= ((first or 0) + (last or 0)) // 2, F.lit(True))
    return [events.where(~late), events.where(late)]


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS k FROM events WHERE user_id IS NOT NULL AND event_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL),
s AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS millis, count(*) OVER w AS n, regr_slope(value, (epoch_us(ts) // 1000 - (SELECT min(epoch_us(ts) // 1000) FROM events)) / 1000.0) OVER w AS slope
FROM r WINDOW w AS (PARTITION BY user_id ORDER BY k ROWS 9 PRECEDING))
SELECT user_id, event_id, CASE WHEN n >= 2 THEN round(coalesce(slope, 0) * 86400, 6) END AS slope FROM s WHERE millis < (SELECT epoch_us(max(ts)) // 1000 - 3600000 FROM r)
""")
def stream_slopes(spark, sf_dir):
    """ST4 ST1: each user's slope over the last ten events, for all that an hour's watermark has passed."""
    (events,) = tables(spark, sf_dir, "events")
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    seconds = (at - (events.agg(F.min(at)).first()[0] or 0)) / 1000  # one row
    stream = lambda log: stateful.ordered_slopes(log.withColumn("at", seconds), "user_id", "event_id", "ts", "at", "value", 10, "1 hour")
    out = stateful.in_parts(_halves(events.select("event_id", "ts", "user_id", "value")), _folder(spark), stream)
    return out.select(F.col("key").alias("user_id"), F.col("id").alias("event_id"), F.round(F.col("slope") * 86400, 6).alias("slope"))


@query("""
SELECT sha256(coalesce(text, '')) AS content, count(*) AS n, max(len(list_distinct(string_split(coalesce(text, ''), ' '))))::DOUBLE AS score, 1 AS computed FROM documents GROUP BY 1
""")
def stream_score_cache(spark, sf_dir):
    """ST5: every content is scored once over two runs of a stream, whatever the number of its copies."""
    (docs,) = tables(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "text")
    odd = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 1, F.lit(False))
    out = stateful.in_parts([docs.where(odd), docs.where(~odd)], _folder(spark), lambda log: stateful.scored_once(log, "doc_id", "text", distinct_words))
    return out.groupBy(F.col("key").alias("content")).agg(F.count("*").alias("n"), F.max("score").alias("score"), F.count_if("fresh").cast("int").alias("computed"))


def distinct_words(text: str) -> float:
    return float(len(set(text.split(" "))))


@query("""
WITH w AS (SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL)
SELECT * FROM w WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)
""")
def stream_windows(spark, sf_dir):
    """ST1: counts and sums by day and kind, as windows close over two runs of a stream."""
    (events,) = tables(spark, sf_dir, "events")
    stream = lambda log: metrics.windowed(log.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], "value", "1 day", late="10 minutes")
    out = stateful.in_parts(_halves(events.select("ts", "event_type", "value")), _folder(spark), stream)
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
