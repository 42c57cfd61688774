"""Structured Streaming over append-only logs (ST1-ST5, A22): means by step, histograms, slopes, resumable scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def log_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """ST1: JSON lines as they are appended in new files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def windowed(df: DataFrame, ts: str, keys: list[str], value: str, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count, sum and mean by event-time window; rows later than the watermark are left out."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = df.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total", "mean")


def sessions(df: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a key by gaps in event time."""
    out = df.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def step_histogram(df: DataFrame, step: str, value: str, edges: list[float]) -> DataFrame:
    """A22, ST3: counts by step and bin; a bin begins at its edge."""
    bin_ = F.lit(-1)
    for k, e in enumerate(edges):
        bin_ = F.when(F.col(value) >= e, k).otherwise(bin_)
    return df.groupBy(step, bin_.alias("bin")).agg(F.count("*").alias("n"))


def trailing_slopes(df: DataFrame, key: str, x: str, y: str, rows: int = 10) -> DataFrame:
    """ST4: the slope over each key's last rows, kept as state between batches; rows of a batch are taken in order of x."""

    def update(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        xs, ys = (list(v) for v in state.get) if state.exists else ([], [])
        new = pd.concat(list(parts)).sort_values(x)
        out = []
        for a, b in zip(new[x].astype(float), new[y].astype(float), strict=True):
            xs, ys = (xs + [a])[-rows:], (ys + [b])[-rows:]
            mx, my = sum(xs) / len(xs), sum(ys) / len(ys)
            var = sum((i - mx) ** 2 for i in xs)
            slope = None if len(xs) < 2 else 0.0 if var == 0 else sum((i - mx) * (j - my) for i, j in zip(xs, ys, strict=True)) / var
            out.append((keys[0], a, slope))
        state.update((xs, ys))
        yield pd.DataFrame(out, columns=["key", "x", "slope"])

    kind = dict(df.dtypes)[key]
    return df.groupBy(key).applyInPandasWithState(update, f"key {kind}, x double, slope double", "xs array<double>, ys array<double>", "append", GroupStateTimeout.NoTimeout)


def run_to_end(df: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """ST1, ST2: what has arrived, once, batch by batch; a restart with the same checkpoint goes on where it stopped."""
    q = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()


def scored_once(df: DataFrame, cache: DataFrame, key: str, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """ST5: key and score of every row, computed only for distinct keys that the cache (key, score) lacks."""
    distinct = df.dropDuplicates([key])
    fresh = score(distinct.join(cache.select(key), key, "left_anti")).select(key, "score")
    return df.join(cache.select(key, "score").unionByName(fresh), key, "left")
