"""Sampling, quota, split and top-k queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import GRADES
from tessera.operators import order, sampling
from tessera.plans._registry import query, tables

BUCKET = "CASE WHEN n_chars < 500 THEN 'a' WHEN n_chars < 2000 THEN 'b' WHEN n_chars < 10000 THEN 'c' ELSE 'd' END"


def _bucketed(docs):
    n = F.col("n_chars")
    return docs.select("doc_id", "source", "lang", "n_chars", F.when(n < 500, "a").when(n < 2000, "b").when(n < 10000, "c").otherwise("d").alias("bucket"))


@query(f"""
WITH d AS (SELECT doc_id, {BUCKET} AS bucket FROM documents), c AS (SELECT bucket, count(*) AS n FROM d GROUP BY bucket),
f AS (SELECT coalesce(sum(n) FILTER (n <= 60), 0)::BIGINT AS taken, count(*) FILTER (n > 60) AS large FROM c),
q AS (SELECT bucket, CASE WHEN n <= 60 THEN n ELSE least(n, greatest(0, 200 - taken) // greatest(large, 1) + CASE WHEN row_number() OVER (PARTITION BY n > 60 ORDER BY bucket) - 1 < greatest(0, 200 - taken) % greatest(large, 1) THEN 1 ELSE 0 END) END AS quota FROM c, f),
r AS (SELECT d.*, quota, row_number() OVER (PARTITION BY d.bucket ORDER BY md5('42:' || doc_id), doc_id) AS r FROM d JOIN q USING (bucket))
SELECT doc_id, bucket FROM r WHERE r <= quota
""")
def stratified_sample_quota(spark, sf_dir):
    """W10 P22."""
    (docs,) = tables(spark, sf_dir, "documents")
    return sampling.stratified(_bucketed(docs), "bucket", 200, 60, "doc_id").select("doc_id", "bucket")


@query(f"WITH r AS (SELECT doc_id, {BUCKET} AS bucket, row_number() OVER (PARTITION BY {BUCKET} ORDER BY md5('42:' || doc_id), doc_id) AS r FROM documents WHERE {BUCKET} IN ('a', 'b', 'c')) SELECT doc_id, bucket FROM r WHERE r <= 30")
def equal_sample(spark, sf_dir):
    """W11."""
    (docs,) = tables(spark, sf_dir, "documents")
    rows = _bucketed(docs)
    return sampling.equal_per_bucket(rows, F.col("bucket"), ["a", "b", "c"], 90, "doc_id").select("doc_id", "bucket")


@query("""
WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), q AS (SELECT lang, least(n, greatest(1, round_even(n / sum(n) OVER () * 100, 0)))::BIGINT AS q FROM c),
f AS (SELECT lang, greatest(0, least(q, 100 - coalesce(sum(q) OVER (ORDER BY lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS q FROM q),
r AS (SELECT d.doc_id, d.lang, q, row_number() OVER (PARTITION BY d.lang ORDER BY md5('42:' || doc_id), doc_id) AS r FROM documents d JOIN f USING (lang))
SELECT doc_id, lang FROM r WHERE r <= q
""")
def proportional_sample(spark, sf_dir):
    """W12."""
    (docs,) = tables(spark, sf_dir, "documents")
    return sampling.proportional(docs.select("doc_id", "lang"), "lang", 100, "doc_id").select("doc_id", "lang")


@query("WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) AS r FROM documents) SELECT doc_id, source FROM r WHERE r <= CASE source WHEN 'src0' THEN 20 WHEN 'src1' THEN 5 ELSE 10 END")
def cap_per_source(spark, sf_dir):
    """W09."""
    (docs,) = tables(spark, sf_dir, "documents")
    return sampling.cap_per_group(docs.select("doc_id", "source"), "source", {"src0": 20, "src1": 5}, 10, "doc_id")


@query("""
WITH d AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'judge' ELSE 'gen' END AS kind FROM labels),
r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY md5('42:' || doc_id), doc_id) AS r, count(*) FILTER (kind = 'gen') OVER () AS a, count(*) FILTER (kind = 'judge') OVER () AS b FROM d)
SELECT doc_id, kind FROM r WHERE a = 0 OR b = 0 OR (kind = 'judge' AND (b <= round_even(a * (0.6::DOUBLE / 0.4::DOUBLE), 0) OR r <= round_even(a * (0.6::DOUBLE / 0.4::DOUBLE), 0))) OR (kind = 'gen' AND (b > round_even(a * (0.6::DOUBLE / 0.4::DOUBLE), 0) OR a <= round_even(b * (0.4::DOUBLE / 0.6::DOUBLE), 0) OR r <= round_even(b * (0.4::DOUBLE / 0.6::DOUBLE), 0)))
""")
def ratio_enforce(spark, sf_dir):
    """W14."""
    (labels,) = tables(spark, sf_dir, "labels")
    rows = labels.select("doc_id", F.when(F.col("quality") == 1, "judge").otherwise("gen").alias("kind"))
    return sampling.enforce_ratio(rows, "kind", "gen", "judge", (0.4, 0.6), "doc_id")


@query("SELECT doc_id, lang, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) <= greatest(1, round_even(count(*) OVER (PARTITION BY lang) * 0.8, 0)) THEN 'train' ELSE 'val' END AS split FROM documents")
def split_stratified(spark, sf_dir):
    """W16 W17."""
    (docs,) = tables(spark, sf_dir, "documents")
    return sampling.split_stratified(docs.select("doc_id", "lang"), "lang", "doc_id")


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS p, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN p < floor(n * 0.8) THEN 'train' WHEN p < floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM r")
def split_by_position(spark, sf_dir):
    """W15."""
    (docs,) = tables(spark, sf_dir, "documents")
    return sampling.split_by_position(docs.select("doc_id"), "doc_id")


@query("""
WITH u AS (SELECT doc_id, -ln((('0x' || substr(md5('42:' || doc_id), 1, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE) / CASE WHEN quality = 0 THEN 2.0 ELSE 1.0 END AS e FROM labels)
SELECT doc_id FROM u ORDER BY e, doc_id LIMIT 50
""")
def weighted_sample(spark, sf_dir):
    """W13."""
    (labels,) = tables(spark, sf_dir, "labels")
    return sampling.weighted(labels.select("doc_id", "quality"), F.when(F.col("quality") == 0, 2.0).otherwise(1.0), 50, "doc_id").select("doc_id")


@query("""
WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS r FROM documents WHERE lang = 'es' QUALIFY r < 300), b AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS r FROM documents WHERE lang <> 'es' QUALIFY r < 200)
SELECT a.doc_id, 'first' AS origin, s AS slot FROM range(300) t(s) JOIN a ON s % (SELECT count(*) FROM a) = a.r UNION ALL SELECT b.doc_id, 'second', s FROM range(200) t(s) JOIN b ON s % (SELECT count(*) FROM b) = b.r
""")
def interleaved_batch(spark, sf_dir):
    """60 to 40, the small pool gone through again."""
    (docs,) = tables(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "lang")
    return sampling.interleaved(rows.where("lang = 'es'"), rows.where("lang <> 'es'"), 500, 0.6, "doc_id").select("doc_id", "origin", "slot")


@query("SELECT target::DOUBLE AS target, arg_min(c_custkey, (abs(c_acctbal - target), c_custkey)) AS c_custkey FROM customer, (VALUES (0.0), (3000.0), (9000.0)) t(target) GROUP BY target")
def nearest_targets(spark, sf_dir):
    """J17."""
    (customer,) = tables(spark, sf_dir, "customer")
    return sampling.nearest_to(customer, "c_acctbal", [0.0, 3000.0, 9000.0], "c_custkey")


@query("""
WITH t AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n, CASE lang WHEN 'en' THEN 80 WHEN 'de' THEN 60 WHEN 'fr' THEN 30 WHEN 'es' THEN 200 END AS want FROM documents)
SELECT doc_id, lang, copy::INT AS copy FROM (SELECT *, unnest(range(0, ((want - 1 - r) // n + 1)::BIGINT)) AS copy FROM t WHERE r < want)
""")
def tier_mix(spark, sf_dir):
    """Fixed shares by tier, small tiers oversampled."""
    (docs,) = tables(spark, sf_dir, "documents")
    shares = {"en": 80 / 370, "de": 60 / 370, "fr": 30 / 370, "es": 200 / 370}
    return sampling.tier_mix(docs.select("doc_id", "lang"), "lang", shares, 370, "doc_id").select("doc_id", "lang", "copy")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def topk_orders(spark, sf_dir):
    """W06 W30."""
    (orders,) = tables(spark, sf_dir, "orders")
    return order.top_k(orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 100)


@query("SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 3")
def topk_per_group(spark, sf_dir):
    """W07 W08."""
    (li,) = tables(spark, sf_dir, "lineitem")
    rows = li.select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return order.first_rows(rows, ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 3)


@query("SELECT conv_id, turn, text FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1")
def chat_first_user(spark, sf_dir):
    """P07 W08."""
    (c,) = tables(spark, sf_dir, "conversations")
    return c.where("role = 'user'").groupBy("conv_id").agg(F.min(F.struct("turn", "text")).alias("m")).select("conv_id", "m.turn", "m.text")


@query("SELECT doc_id, ['keep', 'shorten', 'rewrite'][doc_id % 3 + 1] AS variation FROM documents")
def round_robin_variation(spark, sf_dir):
    """W20."""
    (docs,) = tables(spark, sf_dir, "documents")
    return docs.select("doc_id", F.element_at(F.array(*map(F.lit, ("keep", "shorten", "rewrite"))), (F.pmod("doc_id", F.lit(3)) + 1).cast("int")).alias("variation"))


@query("""
WITH g AS (SELECT CASE WHEN q >= 90 THEN 'Excellent' WHEN q >= 75 THEN 'Good' WHEN q >= 60 THEN 'Acceptable' WHEN q >= 40 THEN 'Poor' WHEN q >= 20 THEN 'Bad' ELSE 'Failing' END AS grade FROM (SELECT l_quantity * 2 AS q FROM lineitem))
SELECT grade, count(*) AS n FROM g GROUP BY grade
""")
def grade_bands(spark, sf_dir):
    """P22."""
    from tessera.functions.text import banded

    (li,) = tables(spark, sf_dir, "lineitem")
    return li.select(banded(F.col("l_quantity") * 2, GRADES).alias("grade")).groupBy("grade").agg(F.count("*").alias("n"))
