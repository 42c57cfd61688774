"""Labels of several passes: medians, majorities, drift, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def medians(df: DataFrame, by: list[str], value: str, least: int = 2) -> DataFrame:
    """The exact median of values that are there, of groups with enough of them."""
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.median(value).alias("median"), F.count("*").alias("n_passes")).where(F.col("n_passes") >= least)


def majority(df: DataFrame, by: list[str], value: str, seq: str) -> DataFrame:
    """The most frequent value, the one seen first among equals."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"), F.min(seq).alias("first"))
    return counts.groupBy(*by).agg(F.min_by(F.col(value), F.struct(-F.col("n"), F.col("first"))).alias(value), F.max("n").alias("votes"))


def final_labels(df: DataFrame, item: str, value: str, prefix: str = "^SENTINEL::") -> DataFrame:
    """Repeated checks under a prefixed id count for the item itself."""
    return medians(df.withColumn(item, F.regexp_replace(item, prefix, "")), [item], value, least=1)


def disputed(df: DataFrame, item: str, passes: list[str], pass_col: str, score: str, verdict: str, most: float = 15) -> DataFrame:
    """Items that lack a pass, whose scores differ by more than most, or whose verdicts differ; with the reason."""
    per = df.where(F.col(pass_col).isin(passes)).groupBy(item).agg(F.count_distinct(F.when(F.col(score).isNotNull(), F.col(pass_col))).alias("n"), (F.max(score) - F.min(score)).alias("range"), F.count_distinct(verdict).alias("v"))
    reason = F.when(F.col("n") < len(passes), "missing").when(F.col("range") > most, "range").when(F.col("v") > 1, "verdict")
    return per.select(item, reason.alias("reason")).where(F.col("reason").isNotNull())


def still_wide(df: DataFrame, item: str, score: str, least: int = 3, most: float = 25) -> DataFrame:
    """W22."""
    return df.groupBy(item).agg(F.count(score).alias("n"), (F.max(score) - F.min(score)).alias("range")).where((F.col("n") >= least) & (F.col("range") > most))


def drift(df: DataFrame, batch: str, item: str, score: str, most: float = 10) -> DataFrame:
    """C20: of each batch the median distance of its scores from the items' medians over all batches, and whether that is too far."""
    centre = df.groupBy(item).agg(F.median(score).alias("_c"))
    return df.join(centre, item).groupBy(batch).agg(F.median(F.abs(F.col(score) - F.col("_c"))).alias("drift"), F.count(score).alias("n")).withColumn("flagged", F.col("drift") > most)


def paused(df: DataFrame, stream: str, seq: str, ok: str) -> DataFrame:
    """The first place of each stream at which two checks in a row fail."""
    w = Window.partitionBy(stream).orderBy(seq)
    return df.withColumn("_two", ~F.col(ok) & ~F.coalesce(F.lag(ok).over(w), F.lit(True))).where("_two").groupBy(stream).agg(F.min(seq).alias("paused_at"))


def rejudged(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """The second judgement where there is one, and how often a row was judged."""
    again = second.select(key, F.col("verdict").alias("_v"), F.col("score").alias("_s"))
    return first.join(again, key, "left").select(key, F.coalesce("_v", "verdict").alias("verdict"), F.coalesce("_s", "score").alias("score"), F.when(F.col("_v").isNull(), 1).otherwise(2).alias("rounds"))


def paired_change(df: DataFrame, key: str, variant: str, before: str, after: str, value: str, large: float = 10) -> DataFrame:
    """Medians of each key before and after, and over keys mean, mean size, largest change and how many are large."""
    side = lambda v: F.median(F.when(F.col(variant) == v, F.col(value)))
    d = df.groupBy(key).agg((side(after) - side(before)).alias("d")).where(F.col("d").isNotNull())
    return d.agg(F.count("*").alias("pairs"), F.avg("d").alias("mean"), F.avg(F.abs("d")).alias("mean_abs"), F.max(F.abs("d")).alias("largest"), F.count_if(F.abs(F.col("d")) >= large).alias("large"))


def human_overall(dims: Column) -> Column:
    """Ten times the mean of the scores that are there, from a map."""
    known = F.filter(F.map_values(dims), lambda v: v.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, v: a + v) / F.size(known) * 10)


def upserted(rows: DataFrame, keys: list[str], seq: str, union: str | None = None) -> DataFrame:
    """One row for each key: of each column the first value in order of seq that is neither null nor empty; of the union column the sorted distinct values."""
    firsts = []
    for c, kind in rows.dtypes:
        if c in (*keys, seq):
            continue
        if c == union:
            firsts.append(F.array_join(F.array_sort(F.collect_set(c)), ",").alias(c))
        else:
            value = F.when(F.col(c).isNotNull() & (F.trim(F.col(c)) != "" if kind == "string" else F.lit(True)), F.struct(seq, c))
            firsts.append(F.min(value)[c].alias(c) if kind in ("string", "int", "bigint", "double", "boolean", "timestamp") else F.first(c, ignorenulls=True).alias(c))
    return rows.groupBy(*keys).agg(*firsts)
