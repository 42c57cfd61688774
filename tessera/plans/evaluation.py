"""Label aggregation, reliability, evaluation statistics and gates. Suppliers stand in for raters, parts for items."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import resampling, stats
from tessera.operators import labels, metrics
from tessera.plans._registry import query, tables

SIX = lambda df, *cols: df.select(*(F.round(c, 6).alias(c) if c in cols else c for c in df.columns))


@query("SELECT l_partkey, round(median(l_quantity), 6) AS median, count(l_quantity) AS n_passes FROM lineitem GROUP BY 1 HAVING count(l_quantity) >= 2")
def median_pass_labels(spark, sf_dir):
    """A07 C50."""
    (li,) = tables(spark, sf_dir, "lineitem")
    return SIX(labels.medians(li, ["l_partkey"], "l_quantity"), "median")


@query("""
WITH c AS (SELECT l_partkey, l_returnflag, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS f FROM lineitem GROUP BY 1, 2)
SELECT l_partkey, l_returnflag, n AS votes FROM c QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, f) = 1
""")
def majority_verdict(spark, sf_dir):
    """A08."""
    (li,) = tables(spark, sf_dir, "lineitem")
    rows = li.select("l_partkey", "l_returnflag", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return labels.majority(rows, ["l_partkey"], "l_returnflag", "seq")


@query("SELECT l_partkey % 50 AS item, median(l_quantity) AS median, count(*) AS n_passes FROM lineitem GROUP BY 1")
def final_labels(spark, sf_dir):
    """Half of the ids are prefixed."""
    (li,) = tables(spark, sf_dir, "lineitem")
    item = (F.col("l_partkey") % 50).cast("string")
    rows = li.select(F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("SENTINEL::"), item)).otherwise(item).alias("item"), "l_quantity")
    return labels.final_labels(rows, "item", "l_quantity").withColumn("item", F.col("item").cast("long"))


PASSES = "SELECT l_partkey AS item, l_linenumber AS pass, avg(l_quantity) * 2 AS score, CASE WHEN avg(l_quantity) >= 25 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 2"


def _passes(spark, sf_dir):
    (li,) = tables(spark, sf_dir, "lineitem")
    rows = li.where("l_linenumber <= 3").groupBy(F.col("l_partkey").alias("item"), F.col("l_linenumber").alias("pass"))
    return rows.agg((F.avg("l_quantity") * 2).alias("score"), F.when(F.avg("l_quantity") >= 25, "PASS").otherwise("FAIL").alias("verdict"))


@query(f"""
WITH p AS ({PASSES}), g AS (SELECT item, count(DISTINCT pass) AS n, max(score) - min(score) AS r, count(DISTINCT verdict) AS v FROM p GROUP BY item)
SELECT item, CASE WHEN n < 3 THEN 'missing' WHEN r > 15 THEN 'range' ELSE 'verdict' END AS reason FROM g WHERE n < 3 OR r > 15 OR v > 1
""")
def active_selection(spark, sf_dir):
    """W21 D07."""
    return labels.disputed(_passes(spark, sf_dir), "item", [1, 2, 3], "pass", "score", "verdict")


@query(f"WITH p AS ({PASSES}) SELECT item, count(score) AS n, round(max(score) - min(score), 6) AS range FROM p GROUP BY item HAVING count(score) >= 3 AND max(score) - min(score) > 25")
def still_wide(spark, sf_dir):
    """W22."""
    return SIX(labels.still_wide(_passes(spark, sf_dir), "item", "score"), "range")


@query(f"""
WITH p AS ({PASSES}), c AS (SELECT item, median(score) AS c FROM p GROUP BY item)
SELECT pass, round(median(abs(score - c)), 6) AS drift, count(*) AS n, median(abs(score - c)) > 10 AS flagged FROM p JOIN c USING (item) GROUP BY pass
""")
def sentinel_drift(spark, sf_dir):
    """C20."""
    return SIX(labels.drift(_passes(spark, sf_dir), "pass", "item", "score"), "drift")


@query(f"""
WITH p AS ({PASSES}), j AS (SELECT a.pass AS a, b.pass AS b, a.verdict = 'PASS' AS x, b.verdict = 'PASS' AS y FROM p a JOIN p b ON a.item = b.item AND a.pass < b.pass),
s AS (SELECT a, b, count(*) AS n, avg((x = y)::INT) AS po, avg(x::INT) * avg(y::INT) + (1 - avg(x::INT)) * (1 - avg(y::INT)) AS pe FROM j GROUP BY 1, 2)
SELECT a, b, n, round(po, 6) AS observed, round(CASE WHEN pe = 1 THEN 1 ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM s
""")
def rater_agreement_kappa(spark, sf_dir):
    """J11 C18 D06."""
    p = _passes(spark, sf_dir).select("item", "pass", (F.col("verdict") == "PASS").alias("v"))
    pairs = p.select("item", F.col("pass").alias("a"), F.col("v").alias("x")).join(p.select("item", F.col("pass").alias("b"), F.col("v").alias("y")), "item").where("a < b")
    return SIX(stats.kappa(pairs, ["a", "b"], "x", "y"), "observed", "kappa")


@query(f"""
WITH p AS ({PASSES}), j AS (SELECT a.pass AS a, b.pass AS b, a.score AS x, b.score AS y FROM p a JOIN p b ON a.item = b.item AND a.pass < b.pass),
r AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2 AS ry FROM j),
c AS (SELECT a, b, count(*) AS n, corr(rx, ry) AS rho FROM r GROUP BY 1, 2)
SELECT a, b, n, round(rho, 6) AS rho, round(3 * rho / (1 + 2 * rho), 6) AS reliability FROM c
""")
def pairwise_spearman(spark, sf_dir):
    """J11 C15 C19."""
    p = _passes(spark, sf_dir).select("item", "pass", "score")
    pairs = p.select("item", F.col("pass").alias("a"), F.col("score").alias("x")).join(p.select("item", F.col("pass").alias("b"), F.col("score").alias("y")), "item").where("a < b")
    out = stats.spearman(pairs, ["a", "b"], "x", "y").withColumn("reliability", stats.spearman_brown(F.col("rho"), 3))
    return SIX(out, "rho", "reliability")


@query("""
WITH v AS (SELECT l_partkey % 200 AS unit, l_returnflag AS value, count(*) AS c FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1, 2), s AS (SELECT unit, sum(c) AS m FROM v GROUP BY unit HAVING sum(c) > 1),
p AS (SELECT v.*, m FROM v JOIN s USING (unit)), o AS (SELECT sum(d / (m - 1)) AS o, sum(m) AS n FROM (SELECT unit, m, sum(c) * sum(c) - sum(c * c) AS d FROM p GROUP BY unit, m)), t AS (SELECT sum(t * t) AS t2 FROM (SELECT value, sum(c) AS t FROM p GROUP BY value))
SELECT n::BIGINT AS n, round(1 - o / ((n * n - t2) / (n - 1)), 6) AS alpha FROM o, t
""")
def krippendorff_alpha(spark, sf_dir):
    """D06."""
    (li,) = tables(spark, sf_dir, "lineitem")
    rows = li.where("l_linenumber <= 2").select((F.col("l_partkey") % 200).alias("unit"), F.col("l_returnflag").alias("value"))
    return SIX(stats.krippendorff_nominal(rows, "unit", "value"), "alpha")


@query("SELECT lang, count(*) AS n, round(avg(n_chars), 6) AS mean, median(n_chars) AS median, round(quantile_cont(n_chars, 0.95), 6) AS p95, min(n_chars) AS least, max(n_chars) AS most, count(*) FILTER (n_chars < 100) AS short FROM documents GROUP BY lang")
def length_distribution(spark, sf_dir):
    """A12 C50."""
    (docs,) = tables(spark, sf_dir, "documents")
    c = F.col("n_chars")
    return docs.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(c), 6).alias("mean"), F.median(c).alias("median"), F.round(F.percentile(c, F.lit(0.95)), 6).alias("p95"), F.min(c).alias("least"), F.max(c).alias("most"), F.count_if(c < 100).alias("short"))


@query("""
SELECT lang, count(*) AS n, round(avg(quality), 6) AS mean, count(quality) AS applicable, round(avg(CASE WHEN n_chars >= 1000 THEN quality END), 6) AS rate_applicable, round(avg(CASE WHEN n_chars >= 1000 THEN quality ELSE 0 END), 6) AS rate_inclusive, round(avg((n_chars < 1000)::INT), 6) AS na_rate
FROM documents JOIN labels USING (doc_id) GROUP BY lang
""")
def eval_summary(spark, sf_dir):
    """A10: rates with and without rows that do not apply."""
    docs, lab = tables(spark, sf_dir, "documents", "labels")
    on, q = F.col("n_chars") >= 1000, F.col("quality")
    aggs = {"mean": F.avg(q), "rate_applicable": F.avg(F.when(on, q)), "rate_inclusive": F.avg(F.when(on, q).otherwise(0)), "na_rate": F.avg((~on).cast("int"))}
    return docs.join(lab, "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.count(q).alias("applicable"), *(F.round(c, 6).alias(n) for n, c in aggs.items()))


SCORED = "SELECT doc_id, quality AS y, least(100.0, n_chars / 50.0) AS s FROM documents JOIN labels USING (doc_id)"


def _scored(spark, sf_dir):
    docs, lab = tables(spark, sf_dir, "documents", "labels")
    return docs.join(lab, "doc_id").select("doc_id", F.col("quality").alias("y"), "toxic", "lang", F.least(F.lit(100.0), F.col("n_chars") / 50.0).alias("s"))


@query(f"""
WITH d AS ({SCORED}), c AS (SELECT t::DOUBLE AS threshold, count(*) FILTER (s >= t AND y = 1) AS tp, count(*) FILTER (s >= t AND y = 0) AS fp, count(*) FILTER (s < t AND y = 1) AS fn, count(*) FILTER (s < t AND y = 0) AS tn FROM d, (VALUES (10.0), (20.0), (40.0), (80.0)) v(t) GROUP BY t),
m AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1, (tp + tn) / (tp + fp + fn + tn) AS accuracy FROM c)
SELECT threshold, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(accuracy, 6) AS accuracy, row_number() OVER (ORDER BY f1 DESC, threshold) = 1 AS best FROM m
""")
def threshold_sweep(spark, sf_dir):
    """A14."""
    return SIX(metrics.threshold_sweep(_scored(spark, sf_dir), "y", "s", [10.0, 20.0, 40.0, 80.0]), "precision", "recall", "f1", "accuracy")


@query(f"WITH d AS ({SCORED}) SELECT CASE WHEN y = 1 THEN 'PASS' ELSE 'FAIL' END AS truth, CASE WHEN s >= 30 THEN 'PASS' ELSE 'FAIL' END AS model, count(*) AS n FROM d GROUP BY 1, 2")
def confusion(spark, sf_dir):
    """A13 C45."""
    verdict = lambda c: F.when(c, "PASS").otherwise("FAIL")
    return _scored(spark, sf_dir).groupBy(verdict(F.col("y") == 1).alias("truth"), verdict(F.col("s") >= 30).alias("model")).agg(F.count("*").alias("n"))


@query(f"""
WITH d AS ({SCORED}), r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS r FROM d)
SELECT 'all' AS part, sum(y)::BIGINT AS positives, sum(1 - y)::BIGINT AS negatives, round((sum(r * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 6) AS auc FROM r
""")
def auc_mannwhitney(spark, sf_dir):
    """C17."""
    return SIX(stats.auc(_scored(spark, sf_dir).withColumn("part", F.lit("all")), ["part"], "y", "s"), "auc")


@query("""
WITH d AS (SELECT source, n_chars AS v, (doc_id // 20) % 2 AS k FROM documents), e AS (SELECT source, abs(count(*) FILTER (k = 0) OVER w / count(*) FILTER (k = 0) OVER p - count(*) FILTER (k = 1) OVER w / count(*) FILTER (k = 1) OVER p) AS g, k FROM d WINDOW w AS (PARTITION BY source ORDER BY v RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), p AS (PARTITION BY source))
SELECT source, round(max(g), 6) AS d, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1 FROM e GROUP BY source
""")
def ks_two_sample(spark, sf_dir):
    """C21."""
    (docs,) = tables(spark, sf_dir, "documents")
    return SIX(stats.ks_distance(docs.select("source", "n_chars", (F.floor(F.col("doc_id") / 20) % 2).alias("k")), ["source"], "k", "n_chars"), "d")


@query()
def ks_p_values(spark, sf_dir):
    """C21 with Bonferroni."""
    return stats.with_ks_p(ks_two_sample(spark, sf_dir).where("n0 > 0 AND n1 > 0"), tests=20)


@query("""
WITH r AS (SELECT o_orderpriority AS g, o_totalprice AS gain, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey DESC, o_orderkey) AS a, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS b FROM orders)
SELECT g, round(sum(gain / log2(a + 1)) FILTER (a <= 10) / sum(gain / log2(b + 1)) FILTER (b <= 10), 6) AS ndcg FROM r GROUP BY g
""")
def ndcg_at_10(spark, sf_dir):
    """C28."""
    (orders,) = tables(spark, sf_dir, "orders")
    return SIX(stats.ndcg(orders.withColumnRenamed("o_orderpriority", "g"), ["g"], "o_totalprice", "o_custkey", "o_orderkey"), "ndcg")


@query("""
WITH m AS (SELECT l_returnflag, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, avg(q) FILTER (k = 0) AS m0, avg(q) FILTER (k = 1) AS m1, var_samp(q) FILTER (k = 0) AS v0, var_samp(q) FILTER (k = 1) AS v1 FROM (SELECT l_returnflag, l_quantity AS q, l_linenumber % 2 AS k FROM lineitem) GROUP BY 1)
SELECT l_returnflag, n0, n1, round(m0 - m1, 6) AS diff, round(sqrt(v0 / n0 + v1 / n1), 6) AS se, round(power(v0 / n0 + v1 / n1, 2) / (power(v0 / n0, 2) / (n0 - 1) + power(v1 / n1, 2) / (n1 - 1)), 4) AS dof FROM m
""")
def welch_moments(spark, sf_dir):
    """What the tests need."""
    (li,) = tables(spark, sf_dir, "lineitem")
    out = stats.welch_moments(li.select("l_returnflag", "l_quantity", (F.col("l_linenumber") % 2).alias("k")), ["l_returnflag"], "k", "l_quantity")
    return SIX(out, "diff", "se").withColumn("dof", F.round("dof", 4))


@query()
def tost_welch(spark, sf_dir):
    """C24 C25."""
    return stats.tost(welch_moments(spark, sf_dir), margin=1.0)


@query()
def bootstrap_spearman_delta(spark, sf_dir):
    """Does price follow quantity better than discount does; every line item is an item of its own."""
    (li,) = tables(spark, sf_dir, "lineitem")
    rows = li.select("l_suppkey", F.concat_ws(":", "l_orderkey", "l_linenumber").alias("item"), "l_extendedprice", "l_quantity", "l_discount")
    return resampling.intervals(rows, ["l_suppkey"], "item", {"near": ("l_extendedprice", "l_quantity"), "far": ("l_extendedprice", "l_discount")}, {}, {"near": 1.0, "far": -1.0})


_DRAWS, _HASH, _WEIGHT = resampling.weights_sql("doc_id", 200)


@query(f"""
WITH {_DRAWS}, t AS (SELECT source, n_chars::DOUBLE AS v, {_HASH} AS h FROM documents WHERE n_chars IS NOT NULL),
m AS (SELECT source, replicate, sum(w * v) / sum(w) AS m FROM (SELECT source, replicate, v, {_WEIGHT} AS w FROM t, d) GROUP BY ALL)
SELECT source, round(max(m) FILTER (replicate < 0), 6) AS estimate, round(quantile_cont(m, 0.025) FILTER (replicate >= 0), 6) AS low, round(quantile_cont(m, 0.975) FILTER (replicate >= 0), 6) AS high FROM m GROUP BY source
""")
def bootstrap_mean(spark, sf_dir):
    """C22."""
    (docs,) = tables(spark, sf_dir, "documents")
    found = resampling.resampled(docs, ["source"], "doc_id", {}, {"mean": "n_chars"}, resamples=200)
    return SIX(resampling.bounds(found, ["source"], F.col("mean")), "estimate", "low", "high")


_DRAWS, _HASH, _WEIGHT = resampling.weights_sql("l_orderkey", 1000)
_RANK = "sum(sum(w)) OVER (PARTITION BY k, replicate ORDER BY {0}) - (sum(w) - 1) / 2.0"


@query(f"""
WITH {_DRAWS}, common AS (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_linenumber) = 7),
t AS (SELECT l_linenumber AS k, l_extendedprice::DOUBLE AS x, l_quantity::DOUBLE AS y, l_discount::DOUBLE AS z, {_HASH} AS h FROM lineitem SEMI JOIN common USING (l_orderkey)),
e AS (SELECT k, replicate, x, y, z, {_WEIGHT} AS w FROM t, d),
rx AS (SELECT k, replicate, x, {_RANK.format("x")} AS a FROM e WHERE w > 0 GROUP BY k, replicate, x),
ry AS (SELECT k, replicate, y, {_RANK.format("y")} AS b FROM e WHERE w > 0 GROUP BY k, replicate, y),
c AS (SELECT k, replicate, (sum(w * a * b) - n * m * m) / sqrt((sum(w * a * a) - n * m * m) * (sum(w * b * b) - n * m * m)) AS rho, zm AS reward
  FROM (SELECT *, sum(w) OVER g AS n, (sum(w) OVER g + 1) / 2.0 AS m, sum(w * z) OVER g / sum(w) OVER g AS zm FROM e WHERE w > 0 WINDOW g AS (PARTITION BY k, replicate)) JOIN rx USING (k, replicate, x) JOIN ry USING (k, replicate, y) GROUP BY k, replicate, n, m, zm),
o AS (SELECT replicate, coalesce(corr(a, b), 0) AS rho FROM (SELECT replicate, rank() OVER (PARTITION BY replicate ORDER BY round(rho, 9)) + (count(*) OVER (PARTITION BY replicate, round(rho, 9)) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY replicate ORDER BY round(reward, 9)) + (count(*) OVER (PARTITION BY replicate, round(reward, 9)) - 1) / 2.0 AS b FROM c) GROUP BY replicate)
SELECT round(max(rho) FILTER (replicate < 0), 6) AS estimate, round(quantile_cont(rho, 0.025) FILTER (replicate >= 0), 6) AS low, round(quantile_cont(rho, 0.975) FILTER (replicate >= 0), 6) AS high FROM o
""")
def reward_oracle(spark, sf_dir):
    """Does mean reward follow judging quality over checkpoints; items that all have are resampled jointly. A checkpoint is a line number, an item an order with all seven."""
    (li,) = tables(spark, sf_dir, "lineitem")
    common = li.groupBy("l_orderkey").agg(F.count_distinct("l_linenumber").alias("n")).where("n = 7").select("l_orderkey")
    rows = li.join(common, "l_orderkey", "left_semi")
    found = resampling.resampled(rows, ["l_linenumber"], "l_orderkey", {"rho": ("l_extendedprice", "l_quantity")}, {"reward": "l_discount"}, resamples=1000)
    over = stats.spearman(found.withColumns({c: F.round(c, 9) for c in ("rho", "reward")}), ["replicate"], "rho", "reward").select("replicate", "rho")
    return SIX(resampling.bounds(over.withColumn("all", F.lit(0)), ["all"], F.col("rho")).drop("all"), "estimate", "low", "high")


@query("""
WITH t AS (SELECT o_orderpriority AS g, o_orderkey AS k, o_totalprice AS gt, o_custkey AS m FROM orders WHERE o_orderkey <= 400)
SELECT a.g, count(*) AS pairs, round(avg(((a.gt - b.gt) * (a.m - b.m) > 0)::INT), 6) AS agreement FROM t a JOIN t b ON a.g = b.g AND a.k < b.k AND a.gt <> b.gt GROUP BY a.g
""")
def pair_agreement(spark, sf_dir):
    """J13 C27."""
    (orders,) = tables(spark, sf_dir, "orders")
    rows = orders.where("o_orderkey <= 400").select(F.col("o_orderpriority").alias("g"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("gt"), F.col("o_custkey").alias("m"))
    return SIX(stats.pair_agreement(rows, ["g"], "gt", "m", "k"), "agreement")


@query()
def pair_agreement_whole(spark, sf_dir):
    """J13 C27 over all orders; as SQL, a self join with the square of the table."""
    (orders,) = tables(spark, sf_dir, "orders")
    rows = orders.select(F.col("o_orderpriority").alias("g"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("gt"), F.col("o_custkey").alias("m"))
    return SIX(stats.pair_agreement(rows, ["g"], "gt", "m", "k"), "agreement")


@query(f"""
WITH d AS ({SCORED}), j AS (SELECT lang, s, y * 50.0 + doc_id % 7 AS t FROM d JOIN documents USING (doc_id))
SELECT lang, count(*) AS n, round(corr(s, t), 6) AS pearson, round(avg(abs(t - s)), 6) AS mae, round(avg(t - s), 6) AS bias FROM j GROUP BY lang
""")
def pearson_mae_bias(spark, sf_dir):
    """C16 C29."""
    rows = _scored(spark, sf_dir).select("lang", "s", (F.col("y") * 50.0 + F.col("doc_id") % 7).alias("t"))
    return SIX(stats.agreement(rows, ["lang"], "s", "t"), "pearson", "mae", "bias")


@query("""
WITH c AS (SELECT source, sum(toxic) AS h, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY source)
SELECT source, n, round((h / n + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(h / n * (1 - h / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 6) AS upper FROM c
""")
def wilson_upper(spark, sf_dir):
    """C26."""
    docs, lab = tables(spark, sf_dir, "documents", "labels")
    c = docs.join(lab, "doc_id").groupBy("source").agg(F.sum("toxic").alias("h"), F.count("*").alias("n"))
    return c.select("source", "n", F.round(stats.wilson_upper(F.col("h"), F.col("n")), 6).alias("upper"))


@query("""
WITH m AS (SELECT count(*) AS n, avg(quality) AS good, avg(toxic) AS toxic FROM labels)
SELECT 'enough' AS gate, n::DOUBLE AS value, 100.0::DOUBLE AS threshold, n >= 100 AS passed FROM m UNION ALL SELECT 'good', round(good, 6), 0.9, good > 0.9 FROM m UNION ALL SELECT 'toxic', round(toxic, 6), 0.2, toxic <= 0.2 FROM m
""")
def gate_table(spark, sf_dir):
    """C46."""
    (lab,) = tables(spark, sf_dir, "labels")
    row = lab.agg(F.count("*").alias("n"), F.avg("quality").alias("good"), F.avg("toxic").alias("toxic"))
    return SIX(metrics.gates(row, [("enough", "n", ">=", 100), ("good", "good", ">", 0.9), ("toxic", "toxic", "<=", 0.2)]), "value")


@query("""
WITH a AS (SELECT o_orderpriority AS k, avg(o_totalprice) AS v FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_orderpriority AS k, avg(o_totalprice) AS v FROM orders WHERE o_orderkey % 3 = 0 AND o_orderpriority <> '1-URGENT' GROUP BY 1)
SELECT k, CASE WHEN a.v IS NULL THEN 'appeared' WHEN b.v IS NULL THEN 'vanished' ELSE 'both' END AS state, round(coalesce(a.v, 0), 4) AS before, round(coalesce(b.v, 0), 4) AS after, round(abs(coalesce(b.v, 0) - coalesce(a.v, 0)), 4) AS distance FROM a FULL JOIN b USING (k)
""")
def importance_diff(spark, sf_dir):
    """C47 J14."""
    (o,) = tables(spark, sf_dir, "orders")
    mean = lambda df: df.groupBy(F.col("o_orderpriority").alias("k")).agg(F.avg("o_totalprice").alias("v"))
    out = metrics.importance_diff(mean(o.where("o_orderkey % 2 = 0")), mean(o.where("o_orderkey % 3 = 0 AND o_orderpriority <> '1-URGENT'")), "k", "v")
    return out.select("k", "state", *(F.round(c, 4).alias(c) for c in ("before", "after", "distance")))


@query("""
WITH c AS (SELECT source, count(*) AS n, avg(n_chars) AS m, max(n_chars) AS x FROM documents GROUP BY source), g AS (SELECT *, n >= 40 AND m >= 1500 AS ok FROM c)
SELECT source, CASE WHEN ok THEN row_number() OVER (PARTITION BY ok ORDER BY m DESC, source) END AS place, ok AND row_number() OVER (PARTITION BY ok ORDER BY m DESC, source) = 1 AS wins, CASE WHEN n < 40 THEN 1 ELSE 0 END + CASE WHEN m < 1500 THEN 1 ELSE 0 END AS failed FROM g
""")
def winner_selection(spark, sf_dir):
    """W27."""
    (docs,) = tables(spark, sf_dir, "documents")
    c = docs.groupBy("source").agg(F.count("*").alias("n"), F.avg("n_chars").alias("m"))
    out = metrics.winner(c, [], [("rows", F.col("n") >= 40), ("length", F.col("m") >= 1500)], [F.desc("m"), F.col("source")])
    return out.select("source", "place", "wins", F.size("reasons").alias("failed"))


@query("""
WITH c AS (SELECT source, lang, count(*) AS n, avg(n_chars) AS m FROM documents GROUP BY 1, 2), h AS (SELECT *, n < 5 AS hard FROM c)
SELECT source, lang, CASE WHEN hard THEN 'rows' WHEN m < max(m) FILTER (NOT hard) OVER (PARTITION BY lang) - 300 THEN 'behind' END AS reason FROM h
""")
def triage(spark, sf_dir):
    """W28."""
    (docs,) = tables(spark, sf_dir, "documents")
    c = docs.groupBy("source", "lang").agg(F.count("*").alias("n"), F.avg("n_chars").alias("m"))
    return metrics.triaged(c, ["lang"], [("rows", F.col("n") >= 5)], "m", within=300).select("source", "lang", "reason")


@query("""
WITH v AS (SELECT source, stddev_pop(n_chars) AS s, count(DISTINCT n_chars) AS u FROM documents GROUP BY source) SELECT source, s >= 1000 AND u >= 3 AS varies FROM v
""")
def variance_guard(spark, sf_dir):
    """F19."""
    (docs,) = tables(spark, sf_dir, "documents")
    return docs.groupBy("source").agg(stats.varies(F.col("n_chars"), 1000).alias("varies"))


@query(f"WITH d AS ({SCORED}), j AS (SELECT d.*, s >= 30 AS a, s + doc_id % 21 - 10 >= 30 AS b, abs(doc_id % 21 - 10) AS gap FROM d) SELECT count(*) AS n, count(*) FILTER (a <> b) AS flips, count(*) FILTER (a <> b OR gap > 8) AS disagree, round(avg(gap), 6) AS mean_gap FROM j")
def model_disagreement(spark, sf_dir):
    """C48."""
    noise = F.col("doc_id") % 21 - 10
    rows = _scored(spark, sf_dir).select((F.col("s") >= 30).alias("a"), (F.col("s") + noise >= 30).alias("b"), F.abs(noise).alias("gap"))
    flip = F.col("a") != F.col("b")
    return rows.agg(F.count("*").alias("n"), F.count_if(flip).alias("flips"), F.count_if(flip | (F.col("gap") > 8)).alias("disagree"), F.round(F.avg("gap"), 6).alias("mean_gap"))


@query("""
WITH p AS (SELECT l_partkey AS item, median(l_quantity) FILTER (l_linenumber = 2) - median(l_quantity) FILTER (l_linenumber = 1) AS d FROM lineitem GROUP BY 1)
SELECT count(d) AS pairs, round(avg(d), 6) AS mean, round(avg(abs(d)), 6) AS mean_abs, max(abs(d)) AS largest, count(*) FILTER (abs(d) >= 10) AS large FROM p
""")
def paired_change(spark, sf_dir):
    """G17."""
    (li,) = tables(spark, sf_dir, "lineitem")
    rows = li.select("l_partkey", F.col("l_linenumber").cast("string").alias("v"), "l_quantity")
    return SIX(labels.paired_change(rows, "l_partkey", "v", "1", "2", "l_quantity"), "mean", "mean_abs")


@query(f"""
WITH p AS ({PASSES}), a AS (SELECT * FROM p WHERE pass = 1), b AS (SELECT * FROM p WHERE pass = 2)
SELECT a.item, coalesce(b.verdict, a.verdict) AS verdict, round(coalesce(b.score, a.score), 6) AS score, CASE WHEN b.item IS NULL THEN 1 ELSE 2 END AS rounds FROM a LEFT JOIN b USING (item)
""")
def rejudged(spark, sf_dir):
    """G10."""
    p = _passes(spark, sf_dir)
    return SIX(labels.rejudged(p.where("pass = 1"), p.where("pass = 2"), "item"), "score")
