"""Sampling, quotas, ratios and splits, all in seeded hash order.

Python's random draws cannot be repeated in SQL; sizes, proportions and
determinism are kept, by the order of md5(seed:id). Quotas of strata are exact
and rank only the rows where they end (``order.taken``), so a stratum may hold any share of
all rows; ``threshold_sample`` takes a share without counting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.components import _kept
from tessera.operators.order import hash_order, positions, taken


def _first(df: DataFrame, by: list[str], quotas: DataFrame, seed: int, key: str) -> DataFrame:
    return taken(df, by, quotas, seed, key).where("_in").drop("_in")


def threshold_sample(df: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """About share of all rows, by their hash alone: no shuffle."""
    return df.where(F.conv(F.substring(hash_order(seed, key), 1, 8), 16, 10).cast("long") < int(share * (1 << 32)))


def cap_per_group(df: DataFrame, group: str, caps: dict[str, int], default: int, key: str, seed: int = 42) -> DataFrame:
    """At most caps[group] rows of each group, default where none is given."""
    cap = F.lit(default)
    for name, n in caps.items():
        cap = F.when(F.col(group) == name, n).otherwise(cap)
    return _first(df, [group], df.select(group).distinct().select(group, cap.alias("quota")), seed, key)


def quotas(counts: DataFrame, total: int, small: int) -> DataFrame:
    """Of bucket, n: buckets with at most small rows whole, the rest of total evenly over the others, the first getting what is left over."""
    facts = counts.agg(F.coalesce(F.sum(F.when(F.col("n") <= small, F.col("n"))), F.lit(0)).alias("taken"), F.count(F.when(F.col("n") > small, 1)).alias("large"))
    place = F.row_number().over(Window.partitionBy(F.col("n") > small).orderBy("bucket")) - 1
    left = F.greatest(F.lit(0), F.lit(total) - F.col("taken"))
    each = F.floor(left / F.greatest(F.col("large"), F.lit(1)))
    extra = (F.col("_place") < left % F.greatest(F.col("large"), F.lit(1))).cast("long")
    q = F.when(F.col("n") <= small, F.col("n")).otherwise(F.least(F.col("n"), each + extra))
    return counts.withColumn("_place", place).crossJoin(F.broadcast(facts)).select("bucket", "n", q.cast("long").alias("quota"))


def stratified(df: DataFrame, bucket: str, total: int, small: int, key: str, seed: int = 42) -> DataFrame:
    """W10."""
    counts = df.groupBy(F.col(bucket).alias("bucket")).agg(F.count("*").alias("n"))
    return _first(df, [bucket], quotas(counts, total, small).select(F.col("bucket").alias(bucket), "quota"), seed, key)


def equal_per_bucket(df: DataFrame, bucket: Column, values: list[object], total: int, key: str, seed: int = 42) -> DataFrame:
    """Total // len(values) rows of each listed bucket."""
    out = df.withColumn("bucket", bucket).where(F.col("bucket").isin(values))
    return _first(out, ["bucket"], out.select("bucket").distinct().withColumn("quota", F.lit(total // len(values))), seed, key)


def proportional(df: DataFrame, domain: str, target: int, key: str, seed: int = 42) -> DataFrame:
    """Of each domain in proportion, at least one row (half-even rounding), up to target in all."""
    counts = df.groupBy(domain).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"))
    q = counts.crossJoin(F.broadcast(total)).withColumn("_q", F.least(F.col("_n"), F.greatest(F.lit(1), F.bround(F.col("_n") / F.col("_all") * target).cast("long"))))
    upto = F.sum("_q").over(Window.orderBy(domain).rowsBetween(Window.unboundedPreceding, -1))  # one row for each domain
    q = q.withColumn("quota", F.greatest(F.lit(0), F.least(F.col("_q"), target - F.coalesce(upto, F.lit(0))))).select(domain, "quota")
    return _first(df.where(F.col(domain).isNotNull()), [domain], q, seed, key)


def weighted(df: DataFrame, weight: Column, n: int, key: str, seed: int = 42) -> DataFrame:
    """N rows without replacement with chances by weight: the smallest -ln(u)/w, u from the hash."""
    u = (F.conv(F.substring(hash_order(seed, key), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return df.where(weight > 0).withColumn("_e", -F.log(u) / weight).orderBy("_e", key).limit(n).drop("_e")


def enforce_ratio(df: DataFrame, kind: str, first: str, second: str, ratio: tuple[float, float], key: str, seed: int = 42) -> DataFrame:
    """The class that is too large is cut down to ratio; nothing is cut where one class is missing."""
    of = F.col(kind)
    n = df.agg(F.count(F.when(of == first, 1)).alias("a"), F.count(F.when(of == second, 1)).alias("b"))
    a, b = F.col("a"), F.col("b")
    most_b, most_a = F.bround(a * (ratio[1] / ratio[0])).cast("long"), F.bround(b * (ratio[0] / ratio[1])).cast("long")
    none = (a == 0) | (b == 0)
    pair = F.array(
        F.struct(F.lit(first).alias(kind), F.when(none | (b > most_b), a).otherwise(F.least(a, most_a)).alias("quota")),
        F.struct(F.lit(second).alias(kind), F.when(none, b).otherwise(F.least(b, most_b)).alias("quota")),
    )
    return _first(df.where(of.isin(first, second)), [kind], n.select(F.explode(pair).alias("q")).select("q.*"), seed, key)


def split_by_position(df: DataFrame, key: str, shares: tuple[float, float] = (0.8, 0.1), seed: int = 42) -> DataFrame:
    """Train, val and test by position in hash order; sizes are truncated and the rest is test."""
    out = positions(df.withColumn("_h", hash_order(seed, key)), [F.col("_h"), F.col(key)], "_p")
    n = df.agg(F.count("*").alias("_n"))
    first, second = F.floor(F.col("_n") * shares[0]), F.floor(F.col("_n") * shares[1])
    name = F.when(F.col("_p") < first, "train").when(F.col("_p") < first + second, "val").otherwise("test")
    return out.crossJoin(F.broadcast(n)).withColumn("split", name).drop("_h", "_p", "_n")


def split_stratified(df: DataFrame, stream: str, key: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """Of each stream max(1, round half even of share) rows are train, the others val."""
    counts = df.groupBy(stream).agg(F.count("*").alias("n"))
    q = counts.select(stream, F.greatest(F.lit(1), F.bround(F.col("n") * share).cast("long")).alias("quota"))
    return taken(df, [stream], q, seed, key).withColumn("split", F.when(F.col("_in"), "train").otherwise("val")).drop("_in")


def interleaved(first: DataFrame, second: DataFrame, n: int, share: float, key: str, seed: int = 42) -> DataFrame:
    """N rows, share of them from first; a pool that is too small is gone through again. Adds origin."""
    want = round(n * share)

    def draw(df: DataFrame, k: int, origin: str) -> DataFrame:
        top = df.withColumn("_h", hash_order(seed, key)).orderBy("_h", key).limit(k)
        ranked = top.withColumn("_r", F.row_number().over(Window.orderBy("_h", key)) - 1)  # at most k rows, a batch
        size = ranked.agg(F.greatest(F.count("*"), F.lit(1)).alias("_size"))
        again = ranked.crossJoin(F.broadcast(size)).withColumn("_slot", F.explode(F.sequence(F.col("_r"), F.lit(k - 1), F.col("_size")))) if k else ranked.limit(0).withColumn("_slot", F.lit(0))
        return again.withColumn("origin", F.lit(origin)).select(*df.columns, "origin", F.col("_slot").cast("long").alias("slot"))

    return draw(first, want, "first").unionByName(draw(second, n - want, "second"))


def nearest_to(df: DataFrame, value: str, targets: list[float], key: str) -> DataFrame:
    """For each target the row whose value is nearest, the first by key among equals."""
    diff = lambda t: F.struct(F.abs(F.col(value) - t).alias("d"), F.col(key).alias("k"))
    best = df.agg(*(F.min(diff(t)).alias(f"t{i}") for i, t in enumerate(targets)))
    return best.select(F.explode(F.array(*(F.struct(F.lit(float(t)).alias("target"), F.col(f"t{i}.k").alias(key)) for i, t in enumerate(targets)))).alias("x")).select("x.*")


def tier_mix(df: DataFrame, tier: str, shares: dict[str, float], total: int, key: str, seed: int = 42) -> DataFrame:
    """round(share * total) rows of each tier; small tiers are gone through again (adds copy, from 0)."""
    want = F.lit(0)
    for name, s in shares.items():
        want = F.when(F.col(tier) == name, round(s * total)).otherwise(want)
    rows = df.where(F.col(tier).isin(*shares))
    n = rows.groupBy(tier).agg(F.count("*").alias("_n")).withColumn("_times", F.floor(want / F.col("_n")).cast("int")).withColumn("quota", (want % F.col("_n")).cast("long"))
    n = _kept(n)  # one row for each tier
    marked = taken(rows, [tier], n.select(tier, "quota"), seed, key).join(F.broadcast(n.select(tier, "_times")), tier)
    copies = F.col("_times") + F.col("_in").cast("int")
    return marked.where(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1))).select(*df.columns, "copy")
