"""Stateful streams that outlive restarts (ST1, ST4, ST5): slopes in order of event time, scores computed once for each content, sinks that repeat nothing.

State is kept in RocksDB below the stream's checkpoint, so neither the number of
keys nor of contents is bound by memory. A key's rows may be any share of a
batch: they are read as an iterator, and what is kept of them is bounded by the
slope's rows and by what the watermark has not passed yet.

Slopes have the state of all keys of a bucket together, as packed columns: a call of
the state store for each row, and a timer for each, take far longer than the slopes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Of the keys' hashes: what one call for the rows of a batch, or one timer, is about. A stream keeps its number.
BUCKETS = 1024


def slope(points: list[tuple[float, float]]) -> float | None:
    """Least squares; null for fewer than two points, 0 where x does not vary."""
    n = len(points)
    if n < 2:
        return None
    mx, my = sum(x for x, _ in points) / n, sum(y for _, y in points) / n
    var = sum((x - mx) ** 2 for x, _ in points)
    return 0.0 if var == 0 else sum((x - mx) * (y - my) for x, y in points) / var


def trailing_slopes(place: np.ndarray, x: np.ndarray, y: np.ndarray, rows: int) -> np.ndarray:
    """slope() of each row and those before it, `rows` at most; place: its number in its key, whose rows follow each other. NaN for null."""
    n = np.minimum(place + 1, rows)
    # from the oldest to the newest, each with whether there is such a row
    lags = [(lag, n > lag) for lag in reversed(range(rows)) if len(n) > lag]

    def total(f: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        out = np.zeros(len(n))
        for lag, there in lags:
            at = np.flatnonzero(there)
            out[at] += f(x[at - lag], y[at - lag], at)
        return out

    mx, my = total(lambda a, _, at: a) / n, total(lambda _, b, at: b) / n
    var = total(lambda a, _, at: (a - mx[at]) ** 2)
    both = total(lambda a, b, at: (a - mx[at]) * (b - my[at]))
    flat = var == 0
    return np.where(n < 2, np.nan, np.where(flat, 0.0, both / np.where(flat, 1.0, var)))


def _packed(rows: pd.DataFrame) -> tuple[bytes]:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(rows, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return (sink.getvalue().to_pybytes(),)


def _unpacked(packed: tuple[bytes]) -> pd.DataFrame:
    return pa.ipc.open_stream(packed[0]).read_pandas()


class TrailingSlope(StatefulProcessor):
    """Holds the rows of a bucket of keys until the watermark has passed them, then gives each the slope over the last `rows` of its key before and with it."""

    COLUMNS = ("key", "at", "id", "x", "y")

    def __init__(self, rows: int) -> None:
        self.rows = rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.told = handle, None
        self.waiting = handle.getListState("waiting", "rows binary")
        self.history = handle.getValueState("history", "rows binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        firsts = []
        for part in rows:
            self.waiting.appendValue(_packed(part[list(self.COLUMNS)]))
            firsts.append(int(part["at"].min()))
        self.handle.registerTimer(min(firsts) + 1)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        if self.told == (key, passed):  # an earlier timer of this batch has told all that is due
            return
        self.told = (key, passed)
        parts = [_unpacked(x) for x in self.waiting.get()]
        if not parts:
            return
        waiting = pd.concat(parts, ignore_index=True)
        due = waiting["at"] < passed
        if not due.any():
            return
        later = waiting[~due]
        if len(later):
            self.waiting.put([_packed(later)])
            self.handle.registerTimer(int(later["at"].min()) + 1)
        else:
            self.waiting.clear()
        kept = self.history.get()
        ready = waiting[due].drop_duplicates(["key", "at", "id"], keep="last").assign(new=True)
        rows = pd.concat([*([_unpacked(kept).assign(new=False)] if kept else []), ready], ignore_index=True)
        rows = rows.sort_values(["key", "at", "id"], ignore_index=True)  # what is kept is older than what comes
        groups = rows.groupby("key", sort=False)
        place, left = (groups.cumcount(ascending=a).to_numpy() for a in (True, False))
        slopes = trailing_slopes(place, rows["x"].to_numpy(), rows["y"].to_numpy(), self.rows)
        self.history.update(_packed(rows.loc[left < self.rows - 1, list(self.COLUMNS)]))
        new = rows["new"].to_numpy(bool)
        yield pd.DataFrame({"key": rows["key"], "id": rows["id"], "slope": pd.Series(pd.arrays.FloatingArray(slopes, place == 0))})[new]

    def close(self) -> None:
        pass


class ScoredOnce(StatefulProcessor):
    """Computes a key's score for its first row and gives the kept one to all others, in this batch and after restarts."""

    def __init__(self, score: Callable[[str], float], ttl_ms: int | None) -> None:
        self.score, self.ttl_ms = score, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("score", "score double", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        kept = self.known.get()
        value = kept[0] if kept else None
        computed = kept is not None
        for r in rows:
            fresh = not computed
            if fresh:
                value, computed = self.score(r["_text"]), True
                self.known.update((value,))
            yield Row(key=key[0], id=r["_id"], score=value, fresh=fresh)

    def close(self) -> None:
        pass


def ordered_slopes(df: DataFrame, key: str, id: str, ts: str, x: str, y: str, rows: int = 10, late: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """ST4: key, id and slope of each row that the watermark has passed, in order of event time (to the millisecond), then id.

    Rows later than the watermark are left out, as are rows without key, id, ts, x
    or y. Rows may come in any order within `late`; a repeated (ts, id) of a key
    counts once.
    """
    kind = dict(df.dtypes)[key]
    known = df.dropna(subset=[key, id, ts, x, y]).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    fed = known.select(bucket.alias("bucket"), F.col(key).alias("key"), F.col(ts).alias("time"), F.unix_millis(ts).alias("at"), F.col(id).cast("long").alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    schema = T._parse_datatype_string(f"key {kind}, id long, slope double")
    return fed.groupBy("bucket").transformWithStateInPandas(TrailingSlope(rows), schema, "Append", "EventTime")


def scored_once(df: DataFrame, id: str, text: str, score: Callable[[str], float], ttl_ms: int | None = None) -> DataFrame:
    """ST5: key (SHA-256 of the content), id, score and whether it was computed for this row. A null text counts as empty.

    With ttl_ms a score is forgotten so long after it was computed, and computed again.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    fed = df.select(F.sha2(content, 256).alias("_key"), F.col(id).cast("long").alias("_id"), content.alias("_text"))
    schema = T._parse_datatype_string("key string, id long, score double, fresh boolean")
    return fed.groupBy("_key").transformWithState(ScoredOnce(score, ttl_ms), schema, "Append", "ProcessingTime" if ttl_ms else "None")


@contextmanager
def rocks(spark: SparkSession):
    """The session's state store while stateful streams start; what was set before comes back."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def run_into(df: DataFrame, folder: str) -> None:
    """ST1: processes what has arrived and ends. Each batch writes one folder, and a batch that is repeated after a failure overwrites its own, so rows are there once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    with rocks(df.sparkSession):
        q = df.writeStream.option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).foreachBatch(write).start()
        q.awaitTermination()


def results(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The rows that run_into has written so far."""
    return spark.read.schema(schema).parquet(f"{folder}/rows").select(*schema.names)


def in_parts(parts: Iterable[DataFrame], folder: str, stream: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Adds parts to a log one after another and lets a new run of the stream go on after each, as restarts between arrivals do; the rows of all runs."""
    out = None
    for n, part in enumerate(parts):
        spark = part.sparkSession
        part.write.mode("overwrite").parquet(f"{folder}/log/part={n}")
        log = spark.readStream.schema(part.schema).parquet(f"{folder}/log/part=*")
        out = stream(log)
        run_into(out, folder)
    return results(spark, folder, out.schema)
