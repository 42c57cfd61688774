"""Queries over training-example operators: features, mechanical filters, context, sentinels, claims, builders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import curation, examples
from tessera.plans._registry import query, tables


@query(r"SELECT page_id, regexp_matches(html, '<(?:div|span|form|input|a|img)\b') AS has_html, regexp_matches(html, 'aria-|role=') AS has_aria, regexp_matches(html, '\bclass\s+\w+') AS has_class, greatest(0, least(100, 60 + CASE WHEN regexp_matches(html, 'aria-|role=') THEN 15 ELSE 0 END - CASE WHEN regexp_matches(html, '\bclass\s+\w+') THEN 80 ELSE 0 END))::DOUBLE AS score FROM pages")
def page_features(spark, sf_dir):
    """P19."""
    (pages,) = tables(spark, sf_dir, "pages")
    names = ("has_html", "has_aria", "has_class")
    rows = pages.select("page_id", *examples.features(F.col("html"), {n: examples.FEATURES[n] for n in names}))
    return rows.withColumn("score", examples.feature_score({n: F.col(n) for n in names}, {"has_aria": 15.0, "has_class": -80.0}))


@query("""
WITH l AS (SELECT doc_id, list_sort(list_transform(string_split(text, chr(10)), lambda x: length(x))) AS n FROM documents)
SELECT CASE WHEN len(n) < 3 THEN 'too_short' WHEN n[floor(0.95 * (len(n) - 1))::INT + 1] > 500 THEN 'minified' ELSE 'kept' END AS reason, count(*) AS n FROM l GROUP BY 1
""")
def mechanical_filters(spark, sf_dir):
    """D01 F02."""
    (docs,) = tables(spark, sf_dir, "documents")
    reason = F.coalesce(examples.mechanical_reason(F.col("text")), F.lit("kept"))
    return docs.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("""
WITH l AS (SELECT doc_id, source, string_split(text, chr(10)) AS x FROM documents)
SELECT doc_id, sha1(concat_ws(chr(31), source, doc_id::VARCHAR)) AS unit_id, array_to_string(x[2:2], chr(10)) AS before, array_to_string(x[4:4], chr(10)) AS after FROM l
""")
def context_windows(spark, sf_dir):
    """A line either side of the third one, and a stable id."""
    (docs,) = tables(spark, sf_dir, "documents")
    before, after = examples.context_lines(F.col("text"), F.lit(3), F.lit(1), 1)
    return docs.select("doc_id", examples.unit_id(F.col("source"), F.col("doc_id").cast("string")).alias("unit_id"), before.alias("before"), after.alias("after"))


@query("""
WITH e AS (SELECT doc_id FROM labels WHERE toxic = 1), a AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN quality = 1 THEN 'PASS' ELSE 'FAIL' END AS verdict, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id % 100 END AS overall FROM labels WHERE doc_id % 3 <> 0),
b AS (SELECT e.doc_id, verdict, overall, verdict IS NOT NULL OR overall IS NOT NULL AS r FROM e LEFT JOIN a USING (doc_id))
SELECT count(*) AS rows, count(*) FILTER (NOT r) AS unparsed, count(*) FILTER (r AND verdict = 'PASS') AS said_pass, count(*) FILTER (r AND verdict = 'PASS' AND overall >= 70) AS policy_pass, count(*) FILTER (r AND NOT (verdict = 'PASS' AND overall >= 70)) AS right FROM b
""")
def sentinel_checks(spark, sf_dir):
    """G05 C45."""
    (lab,) = tables(spark, sf_dir, "labels")
    read = F.col("doc_id") % 5 != 0
    answers = lab.where("doc_id % 3 <> 0").select("doc_id", F.when(read, F.when(F.col("quality") == 1, "PASS").otherwise("FAIL")).alias("verdict"), F.when(read, F.col("doc_id") % 100).alias("overall"))
    return examples.sentinel_check(lab.where("toxic = 1").select("doc_id"), answers, "doc_id")


@query("SELECT source, count(*) AS rows, round(avg((n_chars > 2000)::INT) FILTER (quality = 1), 6) AS kept_share, round(avg((n_chars > 2000)::INT) FILTER (quality <> 1), 6) AS dropped_share FROM documents JOIN labels USING (doc_id) GROUP BY source")
def boundary_skew(spark, sf_dir):
    """A18."""
    docs, lab = tables(spark, sf_dir, "documents", "labels")
    rows = docs.join(lab, "doc_id").select("source", (F.col("quality") == 1).alias("kept"), (F.col("n_chars") > 2000).alias("edge"))
    out = examples.skew(rows, ["source"], "kept", "edge")
    return out.select("source", "rows", F.round("kept_share", 6).alias("kept_share"), F.round("dropped_share", 6).alias("dropped_share"))


@query("SELECT array_to_string(list_sort(list_distinct(list(lang))), ',') AS seen, array_to_string(list_sort(list_filter(['de', 'it', 'pl'], lambda x: NOT list_contains(list(lang), x))), ',') AS missing FROM documents")
def coverage_of_languages(spark, sf_dir):
    """A17 U05."""
    (docs,) = tables(spark, sf_dir, "documents")
    return examples.coverage_missing(docs, "lang", ["de", "it", "pl"]).select(F.array_join("seen", ",").alias("seen"), F.array_join("missing", ",").alias("missing"))


@query("""
WITH f AS (SELECT l_partkey AS k, l_linenumber AS f, arg_min(l_quantity, l_orderkey) * 10 AS s FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 2)
SELECT k, round(avg(s), 6) AS overall, count(*) AS fields FROM f GROUP BY k
""")
def seed_scores(spark, sf_dir):
    """G11 P21."""
    (li,) = tables(spark, sf_dir, "lineitem")
    rows = li.where("l_linenumber <= 3").select(F.col("l_partkey").alias("k"), F.col("l_linenumber").alias("f"), "l_quantity", "l_orderkey")
    return examples.seed_scores(rows, "k", "f", "l_quantity", "l_orderkey").select("k", F.round("overall", 6).alias("overall"), F.size(F.map_keys("scores")).cast("long").alias("fields"))


@query("""
WITH g AS (SELECT l_orderkey AS g, count(*) FILTER (l_quantity >= 10) AS kept, count(*) FILTER (l_quantity < 10) AS dropped, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) FILTER (l_quantity >= 10) AS lines FROM lineitem GROUP BY 1)
SELECT g, kept, dropped, lines FROM g WHERE kept > 0
""")
def grouped_rollouts(spark, sf_dir):
    """G01."""
    (li,) = tables(spark, sf_dir, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("g"), "l_linenumber", "l_quantity")
    out = examples.grouped_rollouts(rows, "g", F.col("l_quantity") >= 10, "l_linenumber")
    return out.select("g", F.size("rows").cast("long").alias("kept"), "dropped", F.array_join(F.transform("rows", lambda r: r["l_linenumber"].cast("string")), ",").alias("lines"))


@query(r"""
WITH t AS (SELECT doc_id, string_split(text, chr(10))[1] AS a, text AS b FROM documents),
w AS (SELECT doc_id, list_distinct(regexp_extract_all(a, '[A-Za-z_]\w*')) AS a, list_distinct(regexp_extract_all(b, '[A-Za-z_]\w*')) AS b FROM t)
SELECT doc_id, round(CASE WHEN len(b) = 0 THEN 1 ELSE len(list_intersect(b, a)) / len(b) END, 6) AS kept FROM w
""")
def token_retention(spark, sf_dir):
    """The share of a text's words that its first line has."""
    (docs,) = tables(spark, sf_dir, "documents")
    return docs.select("doc_id", F.round(X.retention(F.col("text"), F.element_at(F.split("text", "\n"), 1)), 6).alias("kept"))


@query("""
WITH p AS (SELECT p_partkey, CASE WHEN contains(lower(p_type), 'steel') THEN 'a' WHEN contains(lower(p_type), 'brass') OR contains(lower(p_type), 'tin') THEN 'b' ELSE 'z' END AS rule FROM part) SELECT rule, count(*) AS n FROM p GROUP BY rule
""")
def keyword_rules(spark, sf_dir):
    """The first matching keyword decides."""
    (part,) = tables(spark, sf_dir, "part")
    rule = curation.first_match(F.col("p_type"), {"steel": ["a"], "brass": ["b"], "tin": ["b"]}, ["z"])
    return part.groupBy(F.get(rule, 0).alias("rule")).agg(F.count("*").alias("n"))


@query("SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS asked FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'assistant') > 0")
def common_threads(spark, sf_dir):
    """Threads with rows of both roles, by keys in common."""
    (c,) = tables(spark, sf_dir, "conversations")
    turns = c.groupBy("conv_id").agg(F.count("*").alias("turns"))
    asked = c.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("asked"))
    answered = c.where("role = 'assistant'").select("conv_id").distinct()
    return examples.common([turns, asked, answered], "conv_id")
