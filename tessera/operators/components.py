"""Connected components of a graph given by its edges."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; one is set only where there is none, as in tests on one machine."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="tessera-"))
    return sc._jsc.sc().getCheckpointDir().get()


def _kept(df: DataFrame) -> DataFrame:
    _shared_dir(df.sparkSession)
    return df.checkpoint()


def _written(df: DataFrame) -> DataFrame:
    """df kept as a table in the checkpoint folder.

    After a checkpoint the optimizer still takes a join's size for the product of its
    sides; over rounds of joins that number gets more digits than planning can bear.
    A table has the size of its files.
    """
    spark = df.sparkSession
    path = f"{_shared_dir(spark)}/c-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """node, root of every node that has an edge. edges: columns a, b of one type.

    Contraction: each round every node picks the smallest of itself and its
    neighbours, in an order drawn anew, and edges are drawn between what their
    ends picked. Nodes nobody picked are gone, at least a constant share in
    expectation, so rounds grow with the logarithm of the nodes. Each round is
    a grouped minimum (combined before the shuffle, so a node with many edges
    is no burden) and two joins. Null ends and loops are left out.
    """
    current = _written(edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    picks = []
    for k in range(rounds):
        if current.isEmpty():
            break
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("h"), F.col(c).alias("id"))  # noqa: B023, E731
        pick = _written(both.groupBy(F.col("a").alias("node")).agg(F.min(order("b")).alias("m")).select("node", F.least("m", order("node"))["id"].alias("pick")))
        picks.append(pick)
        on = lambda c: pick.select(F.col("node").alias(c), F.col("pick").alias(f"to_{c}"))  # noqa: B023, E731
        moved = current.join(on("a"), "a").join(on("b"), "b").where(F.col("to_a") != F.col("to_b"))
        current = _written(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct())
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    if not picks:
        return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = picks[-1].select("node", F.col("pick").alias("root"))
    for pick in reversed(picks[:-1]):
        later = roots.select(F.col("node").alias("pick"), "root")
        roots = _written(pick.join(later, "pick", "left").select("node", F.coalesce("root", "pick").alias("root")))  # else one plan holds all rounds
    return roots
