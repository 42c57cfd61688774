"""Sinks: JSON lines, chat and instruction formats, ordered CSV, batches, receipts, resumable output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.components import _kept
from tessera.operators.order import positions

#: The task tokens of the two kinds of training examples.
TASK_TOKENS = {"gen": "<wp_gen>", "judge": "<wp_judge>"}


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One object a line; Spark's committer makes the files appear whole or not at all."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def task_type(messages: Column, declared: Column) -> Column:
    """P07: "judge" or "gen", as declared or by the first user message that holds a token."""
    gen, judge = TASK_TOKENS["gen"], TASK_TOKENS["judge"]
    marked = F.filter(messages, lambda m: (m["role"] == "user") & (m["content"].contains(judge) | m["content"].contains(gen)))
    first = F.get(marked, 0)["content"]
    return F.when(declared.eqNullSafe("judge") | F.coalesce(first.contains(judge), F.lit(False)), "judge").otherwise("gen")


def with_token(messages: Column, kind: Column) -> Column:
    """The token before each user message that has none."""
    token = F.when(kind == "judge", TASK_TOKENS["judge"]).otherwise(TASK_TOKENS["gen"])

    def one(m: Column) -> Column:
        bare = (m["role"] == "user") & ~m["content"].contains(TASK_TOKENS["gen"]) & ~m["content"].contains(TASK_TOKENS["judge"])
        return F.struct(m["role"].alias("role"), F.when(bare, F.concat_ws(" ", token, m["content"])).otherwise(m["content"]).alias("content"))

    return F.transform(messages, one)


def chat_format(df: DataFrame) -> DataFrame:
    """Messages alone, with tokens."""
    return df.select(with_token(F.col("messages"), task_type(F.col("messages"), F.col("task_type"))).alias("messages"))


def last_of(messages: Column, role: str) -> Column:
    return F.coalesce(F.try_element_at(F.filter(messages, lambda m: m["role"] == role), F.lit(-1))["content"], F.lit(""))


def instruction_format(df: DataFrame) -> DataFrame:
    """Instruction (after the system text, if any), input and output; the last message of a role counts."""
    m = with_token(F.col("messages"), task_type(F.col("messages"), F.col("task_type")))
    rows = df.select(m.alias("m"))
    system, user = last_of(F.col("m"), "system"), last_of(F.col("m"), "user")
    return rows.select(F.when(system != "", F.concat(system, F.lit("\n\n"), user)).otherwise(user).alias("instruction"), F.lit("").alias("input"), last_of(F.col("m"), "assistant").alias("output"))


def raw_format(df: DataFrame) -> DataFrame:
    """All columns, with tokens and the task type that was found."""
    kind = task_type(F.col("messages"), F.col("task_type"))
    return df.withColumn("task_type", kind).withColumn("messages", with_token(F.col("messages"), F.col("task_type")))


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Columns in this order; nested values as JSON text."""
    kinds = dict(df.dtypes)
    nested = lambda c: kinds[c].startswith(("array", "map", "struct"))
    df.select(*(F.to_json(c).alias(c) if nested(c) else F.col(c) for c in columns)).write.mode("overwrite").option("header", True).option("escape", "\"").csv(path)


def batched(df: DataFrame, order: list[Column], size: int, repeated: DataFrame | None = None, broadcast_rows: int = 10_000) -> DataFrame:
    """Batch, position and columns; the rows of repeated are added to every batch. They are broadcast if they were counted to be at most broadcast_rows."""
    out = positions(df, order, "position").withColumn("batch", F.floor(F.col("position") / size))
    if repeated is None:
        return out
    few = repeated.count() <= broadcast_rows
    extra = out.select("batch").distinct().crossJoin(F.broadcast(repeated) if few else repeated).withColumn("position", F.lit(None).cast("long"))
    return out.unionByName(extra.select(*out.columns))


def receipt(df: DataFrame, **facts: Column) -> DataFrame:
    """One row of counts and facts about what was written."""
    return df.agg(F.count("*").alias("rows"), *(c.alias(n) for n, c in facts.items()))


def pending(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """K07, ST2: the rows whose keys are not yet in what was written before."""
    return df.join(done.select(*keys).distinct(), keys, "left_anti")


def resume(spark: SparkSession, df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Appends to the Parquet at path what it does not have; gives what was appended."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)
    rest = _kept(pending(df, spark.read.parquet(path), keys) if there else df)
    rest.write.mode("append").parquet(path)
    return rest
