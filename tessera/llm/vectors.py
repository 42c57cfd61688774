"""What the vector searches share: usable rows, shards, and rounds in which queries stream past shards."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._common import cut, pieces_for


def usable(vectors: DataFrame, each: Callable[[Column], Column] = lambda x: x) -> DataFrame:
    """vec_id and v (each component as double, through each) of rows whose vector and components are there and finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    rows = rows.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v")).where(F.forall("v", finite))
    return rows.select("vec_id", F.transform("v", each).alias("v"))


def queries_of(rows: DataFrame, every: int) -> DataFrame:
    """query_id and q of the rows whose vec_id is divisible by every; of repeated ids the least vector."""
    chosen = rows.where(F.col("vec_id") % every == 0)
    return chosen.groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("q"))


def sharded(rows: DataFrame, source: DataFrame, shard_bytes: int) -> tuple[DataFrame, int]:
    shards = pieces_for(source, shard_bytes)
    return rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")), shards


Search = Callable[[object, pa.Table], pa.Table]


def met(queries: DataFrame, rows: DataFrame, low: int, high: int, build: Callable, search: Search, extra: str, parts: int) -> DataFrame:
    """search(build(vec_ids, vectors), batch of queries) for every shard from low to high - 1 that has rows, and all queries.

    A stated query set against all rows, in blocks. A shard's rows and then the
    queries reach one task in order: its index is built once and the queries
    stream past it. Each row is dealt once and each query once for each shard;
    a task holds one shard and one batch of queries, whatever the input.
    """
    kind, carried = dict(rows.dtypes)["vec_id"], [c for c in queries.columns if c not in ("query_id", "q")]
    none = [F.lit(None).cast(t).alias(c) for c, t in queries.dtypes if c in carried]
    left = queries.select(F.explode(F.sequence(F.lit(low), F.lit(high - 1))).alias("shard"), F.size("q").alias("dim"), F.lit(1).alias("side"), F.col("query_id").alias("id"), F.col("q").alias("v"), *carried)
    right = rows.where((F.col("shard") >= low) & (F.col("shard") < high)).select("shard", F.size("v").alias("dim"), F.lit(0).alias("side"), F.col("vec_id").alias("id"), "v", *none)
    dealt = right.unionByName(left).repartition(parts, "shard").sortWithinPartitions("shard", "dim", "side", "id")

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, index = None, [], None
        for b in batches:
            keys = np.stack([b.column(k).to_numpy() for k in range(3)], 1)
            begins = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)])) if len(keys) else [0]
            for x, y in zip(begins[:-1], begins[1:], strict=True):
                key, side = tuple(keys[x][:2].tolist()), keys[x][2]
                if key != at:
                    at, held, index = key, [], None
                part = pa.Table.from_batches([b.slice(x, y - x)])
                if side == 0:
                    held.append(part)
                    continue
                if index is None:
                    if not held:
                        continue  # no row of this length is in the shard
                    whole = pa.concat_tables(held)
                    index, held = build(whole.column("id").to_numpy(), whole.column("v")), []
                for k in range(0, part.num_rows, 1024):
                    yield from search(index, part.slice(k, 1024)).to_batches()

    return dealt.mapInArrow(streamed, f"query_id {kind}, vec_id {kind}, {extra}")


def by_rounds(queries: DataFrame, rows: DataFrame, shards: int, k: int, build: Callable, search: Search, extra: str, order: list[Column], bound: Column, bound_type: str) -> DataFrame:
    """Of each query the k best found, with rank. Rounds search one shard, then 7, then 56 and so on; each hands the kth value so far on (queries' column kth, null if there are not k)."""
    low, high, found = 0, 1, None
    w = Window.partitionBy("query_id").orderBy(*order, "vec_id")
    asked = queries.withColumn("kth", F.lit(None).cast(bound_type))
    while True:
        got = met(asked, rows, low, high, build, search, extra, min(high - low, 1 << 13))
        found = cut((got if found is None else found.drop("rank").unionByName(got)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))
        if high >= shards:
            return found
        low, high = high, min(shards, 8 * high)
        asked = queries.join(found.where(F.col("rank") == k).select("query_id", bound.cast(bound_type).alias("kth")), "query_id", "left")


def matrix(column: pa.ChunkedArray, kind: type = np.float64) -> np.ndarray:
    n = len(column)
    return pa.concat_arrays([c.flatten() for c in column.chunks]).to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(n, -1) if n else np.zeros((0, 1), kind)
