"""Queries over gates, parsers, builders, formats, coverage and acceptance. What these read is built from the tables' rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import coverage, curation, dedup, examples, labels, matrix, reward, rubric
from tessera.operators.components import _shared_dir
from tessera.plans._registry import query, tables
from tessera.sources import readers, sinks


@query(r"""
WITH d AS (SELECT doc_id, doc_id % 7 AS errors, text || CASE doc_id % 5 WHEN 0 THEN ' Livekit' WHEN 1 THEN ' {{{' WHEN 2 THEN ' Input validation added per code quality review' WHEN 3 THEN ' add_action' ELSE '' END AS code FROM documents)
SELECT doc_id, errors / greatest(length(code) - length(replace(code, chr(10), '')), 1) * 100 <= 5 AS dense_ok,
  CASE WHEN regexp_matches(code, '(?i)Generated from protobuf field|GPBUtil|PlugnmeetProto|Mynaparrot|\bLivekit\b') THEN 'vendor' WHEN abs(length(replace(code, '{', '')) - length(replace(code, '}', ''))) > 2 THEN 'truncated' WHEN contains(code, 'Input validation added per code quality review') THEN 'boilerplate' END AS reason,
  regexp_matches(code, 'add_action|add_filter|register_rest_route|add_shortcode') AND length(code) BETWEEN 60 AND 6000 AS wired,
  NOT ((doc_id % 3 = 0 AND doc_id % 100 < 50) OR (doc_id % 3 = 1 AND doc_id % 100 > 95)) AS expected FROM d
""")
def unit_gates(spark, sf_dir):
    """F03 F08 F09 F16 F17."""
    (docs,) = tables(spark, sf_dir, "documents")
    k = F.col("doc_id") % 5
    tail = F.when(k == 0, " Livekit").when(k == 1, " {{{").when(k == 2, " Input validation added per code quality review").when(k == 3, " add_action").otherwise("")
    rows = docs.select("doc_id", F.concat("text", tail).alias("code"))
    said = F.when(F.col("doc_id") % 3 == 0, "high").when(F.col("doc_id") % 3 == 1, "low").otherwise("none")
    return rows.select("doc_id", curation.error_density_ok(F.col("doc_id") % 7, F.col("code")).alias("dense_ok"), curation.reject_reason(F.col("code")).alias("reason"), examples.wired(F.col("code")).alias("wired"), examples.expectation_ok(said, F.col("doc_id") % 100).alias("expected"))


@query("""
WITH p AS (SELECT p_partkey, p_size % 10 + 1 AS a, p_partkey % 10 + 1 AS b, p_size % 4 = 0 AS bad FROM part)
SELECT p_partkey, CASE WHEN b < 5 THEN 'FAIL' WHEN least(a, b) >= 8 AND NOT bad THEN 'PASS' ELSE 'FAIL' END AS verdict,
  CASE WHEN bad THEN 'x' ELSE '' END || CASE WHEN b < 5 THEN CASE WHEN bad THEN ',' ELSE '' END || 'security_auto_fail' ELSE '' END AS failures,
  CASE WHEN p_partkey % 6 = 0 THEN 'drop' WHEN p_partkey % 6 = 1 THEN 'merge' WHEN p_partkey % 6 = 2 THEN 'merge' WHEN p_partkey % 6 = 3 THEN 'review' ELSE 'keep' END AS disposition FROM p
""")
def verdicts_and_overlaps(spark, sf_dir):
    """F05 F06 D03."""
    (part,) = tables(spark, sf_dir, "part")
    a, b, bad, k = F.col("p_size") % 10 + 1, F.col("p_partkey") % 10 + 1, F.col("p_size") % 4 == 0, F.col("p_partkey") % 6
    failures = F.when(bad, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    verdict, notes = curation.security_override(curation.verdict([a, b], failures), b, failures)
    near = F.when(k == 2, 0.95).when(k == 3, 0.85).otherwise(0.1)
    kind = F.when(k == 1, "exact").otherwise("near")
    return part.select("p_partkey", verdict.alias("verdict"), F.array_join(notes, ",").alias("failures"), examples.overlap_disposition(kind, F.when(k == 0, 0.9).otherwise(near), k == 0).alias("disposition"))


@query("""
SELECT p_partkey, 'Gets the ' || p_name || '.' AS summary, 'Gets the ' || p_name || '.' AS short,
  CASE WHEN p_size % 2 = 0 THEN 'Write a WordPress function that get part, registering WordPress action hooks' ELSE 'Write a WordPress function that get part' END AS ask,
  'repo::' || p_name || '::C::get' AS key, 'get' AS bare, 'get_' || p_partkey AS first_name FROM part
""")
def builders(spark, sf_dir):
    """P10 P11 P12 P26 G04."""
    (part,) = tables(spark, sf_dir, "part")
    doc = F.concat(F.lit("/**\n * Gets the "), F.col("p_name"), F.lit(".\n * @param int $x\n */"))
    none = F.array().cast("array<string>")
    hooks = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("add_action('init'"))).otherwise(none)
    unit = X.unit_key(F.lit("repo"), F.col("p_name"), F.lit("C::get"))
    code = F.concat(F.lit("<?php function get_"), F.col("p_partkey"), F.lit("( $x ) {} function b() {}"))
    return part.select("p_partkey", X.docblock_summary(doc).alias("summary"), examples.short_description(doc).alias("short"), X.instruction(F.lit("get_part"), F.lit(None).cast("string"), hooks, none, none, F.lit("")).alias("ask"), unit.alias("key"), X.bare_name(F.lit("C::get")).alias("bare"), X.first_function(code).alias("first_name"))


@query(r"""
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '    a' || chr(10) || chr(10) || 'b' ELSE '    a' END AS tidy, CASE WHEN p_size % 2 = 0 THEN 'class Wrapper {' || chr(10) || 'public function f() {}' || chr(10) || '}' ELSE 'function f() {}' END AS wrapped,
  '{ { ' || p_name || ' } }' AS neutral, '<?php' || chr(10) || p_name AS opened FROM part
""")
def reformatted_units(spark, sf_dir):
    """P25 T13 T14 T15."""
    (part,) = tables(spark, sf_dir, "part")
    even = F.col("p_size") % 2 == 0
    return part.select("p_partkey", X.reformatted(F.when(even, "\ta  \n\n\n\nb").otherwise("\ta")).alias("tidy"), X.class_wrapped(F.when(even, "public function f() {}").otherwise("function f() {}")).alias("wrapped"), X.neutral_directives(F.concat(F.lit("{{ "), F.col("p_name"), F.lit(" }}"))).alias("neutral"), X.open_tag(F.col("p_name")).alias("opened"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE (doc_id % 11)::DOUBLE END AS score, (doc_id % 10 * 10)::DOUBLE AS prose, 'echo ' || doc_id || ';' AS code, 'after' AS spoken, 'before ' AS reasoning FROM documents
""")
def reply_parsers(spark, sf_dir):
    """C01 C02 C03 C04 C05."""
    (docs,) = tables(spark, sf_dir, "documents")
    n, k = (F.col("doc_id") % 11).cast("string"), F.col("doc_id") % 4
    json_ = F.concat(F.lit('{"score": '), n, F.lit("}"))
    reply = F.when(k == 0, F.concat(F.lit('<think>{"score": 99}</think> {bad} <judge_output>'), json_, F.lit("</judge_output>"))).when(k == 1, F.concat(F.lit("so:\n```json\n"), json_, F.lit("\n```"))).when(k == 2, F.concat(F.lit("it is "), json_, F.lit(" I think"))).otherwise("no score here")
    prose = F.concat(F.lit("Security: score "), (F.col("doc_id") % 10).cast("string"), F.lit("/10\nother text"))
    fenced = F.concat(F.lit("Here:\n```php\necho "), F.col("doc_id"), F.lit(";\n```\nbye"))
    return docs.select("doc_id", X.json_number(X.judged_json(reply), "$.score").alias("score"), F.try_element_at(X.prose_scores(prose), F.lit("security")).alias("prose"), X.code_block(fenced).alias("code"), X.without_thinking(F.lit("<think>x</think> after")).alias("spoken"), X.before_marker(F.lit("before [/REASONING] y")).alias("reasoning"))


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity % 10 AS a, l_suppkey % 10 AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN round(a / 1.0 * 10, 1) ELSE round((a * 0.3 + b * 0.1) / 0.4 * 10, 1) END AS overall, round(CASE WHEN l_linenumber % 3 = 0 THEN a ELSE 0.75 * a + 0.25 * b END, 6) AS blend,
  CASE WHEN l_linenumber % 3 = 0 THEN round(a * 10, 6) ELSE round((a + b) / 2 * 10, 6) END AS human, round(1 - abs(a - b) / 10, 6) AS shared FROM l
""")
def overall_scores(spark, sf_dir):
    """C06 C12 C35 C36 P21."""
    (li,) = tables(spark, sf_dir, "lineitem")
    a, b = (F.col("l_quantity") % 10).cast("double"), (F.col("l_suppkey") % 10).cast("double")
    there = F.when(F.col("l_linenumber") % 3 != 0, b)
    dims = F.create_map(F.lit("x"), a, F.lit("y"), there)
    return li.select("l_orderkey", "l_linenumber", rubric.overall({"x": a, "y": there}, {"x": 0.3, "y": 0.1}).alias("overall"), F.round(reward.blended(a, there, 0.25), 6).alias("blend"), F.round(labels.human_overall(dims), 6).alias("human"), F.round(reward.shared_dims(F.create_map(F.lit("x"), a), F.create_map(F.lit("x"), b, F.lit("z"), a)), 6).alias("shared"))


@query("""
SELECT p_partkey, 'security: score ' || p_size || '/10' || chr(10) || 'weak' || chr(10) || chr(10) || '{"verdict":"FAIL","overall_score":' || p_size || '}' AS reasoning,
  CASE p_size % 6 WHEN 0 THEN 2 WHEN 1 THEN 4 WHEN 2 THEN 6 WHEN 3 THEN 8 WHEN 4 THEN 10 ELSE 5 END AS points, CASE WHEN p_size % 6 IN (0, 1, 5) THEN 'FAIL' ELSE 'PASS' END AS verdict,
  CASE WHEN p_size % 2 = 0 THEN 'why' || chr(10) || '[/REASONING]' || chr(10) || p_name ELSE p_name END AS said, CASE WHEN p_size > 25 THEN 'big' ELSE '' END || CASE WHEN p_size > 25 AND p_size % 2 = 0 THEN ',' ELSE '' END || CASE WHEN p_size % 2 = 0 THEN 'even' ELSE '' END AS notes,
  contains(p_name, 'green') OR p_size > 40 AS reasoned FROM part
""")
def example_texts(spark, sf_dir):
    """P13 P14 P15 P16 P18."""
    (part,) = tables(spark, sf_dir, "part")
    size, even = F.col("p_size"), F.col("p_size") % 2 == 0
    dims = F.create_map(F.lit("security"), F.struct(size.alias("score"), F.lit("weak").alias("analysis")))
    names = F.array(*map(F.lit, ("Critical", "high", "medium ", "low", "none", "odd")))
    graded = F.create_map(F.lit("a"), F.struct(F.element_at(names, (size % 6 + 1).cast("int")).alias("severity")))
    messages = examples.as_messages(F.lit("ask"), F.col("p_name"), F.when(even, "why"))
    tags = F.when(F.col("p_name").contains("green"), F.array(F.lit("g"))).otherwise(F.array(F.lit("n")))
    return part.select("p_partkey", examples.reasoning_text(dims, ["security", "i18n"], F.lit("FAIL"), size).alias("reasoning"), F.element_at(examples.severity_scores(graded), "a").alias("points"), examples.severity_verdict(graded).alias("verdict"), F.element_at(messages, 2)["content"].alias("said"), F.array_join(examples.listed(a=(size > 25, "big"), b=(even, "even")), ",").alias("notes"), curation.needs_reasoning(tags, ["g"], F.array().cast("array<string>"), size).alias("reasoned"))


@query("""
SELECT CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS kind, doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE lang END AS name, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 4 = 0 THEN 'lint' ELSE 'other' END AS category,
  CASE WHEN doc_id % 5 = 0 THEN 'lang' WHEN lang IS NULL THEN NULL ELSE 'source' END AS given_by FROM documents
""")
def seeds(spark, sf_dir):
    """P20 G08 G12."""
    (docs,) = tables(spark, sf_dir, "documents")
    kind = F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b")
    rows = docs.withColumn("kind", kind)
    cols = examples.seed_columns(rows, "kind", {"a": {"name": "source", "doc_id": "doc_id"}, "b": {"name": "lang", "doc_id": "doc_id"}})
    failures = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("SQL Injection"))).when(F.col("doc_id") % 4 == 0, F.array(F.lit("phpcs lint"))).otherwise(F.array(F.lit("misc")))
    first = F.when(F.col("doc_id") % 5 != 0, F.col("source"))
    _, origin = examples.provenance(source=first, lang=F.col("lang"))
    return cols.select("kind", "doc_id", "name", examples.substantive(failures, ["injection"], {"lint": "lint"}).alias("category")).join(docs.select("doc_id", origin.alias("given_by")), "doc_id")


@query("""
WITH d AS (SELECT doc_id, text, sha256(text) AS h FROM documents), held AS (SELECT DISTINCT h FROM d WHERE doc_id % 10 = 0)
SELECT 'only' AS part, count(*) AS rows FROM d WHERE h IN (SELECT h FROM held) UNION ALL SELECT 'without', count(*) FROM d WHERE h NOT IN (SELECT h FROM held) UNION ALL SELECT 'missing', count(*) FROM (SELECT DISTINCT h FROM d) x WHERE h NOT IN (SELECT h FROM held)
UNION ALL SELECT 'first', count(DISTINCT h) FROM d WHERE h NOT IN (SELECT h FROM held) UNION ALL SELECT 'calls', count(DISTINCT 'f' || (doc_id % 9)) FROM d WHERE doc_id % 2 = 0
""")
def key_sets(spark, sf_dir):
    """J03 J04 J06 J07 U04 U08 W04 W05."""
    (docs,) = tables(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.sha2("text", 256).alias("h"))
    held = rows.where("doc_id % 10 = 0")
    left = dedup.without(rows, "h", held)
    calls = dedup.call_sites(docs.select(F.concat(F.lit("f"), F.col("doc_id") % 9, F.lit("( $x )")).alias("code"), "doc_id"), F.col("code"), F.col("doc_id") % 2 == 0)
    parts = {"only": dedup.only(rows, "h", held), "without": left, "missing": matrix.missing(rows.select("h").distinct(), held, ["h"]), "first": dedup.exact(left, F.col("h"), ["doc_id"]), "calls": calls}
    out = None
    for name, df in parts.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("part"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def _path(spark, name: str) -> str:
    return f"{_shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT doc_id, lang, md5(text) AS text_md5 FROM documents")
def json_round_trip(spark, sf_dir):
    """Written as JSON lines and read again."""
    (docs,) = tables(spark, sf_dir, "documents")
    path = _path(spark, "jsonl")
    sinks.write_json_lines(docs.select("doc_id", "lang", "text"), path)
    return readers.json_lines(spark, path, "doc_id long, lang string, text string").select("doc_id", "lang", F.md5("text").alias("text_md5"))


@query("SELECT p_partkey::VARCHAR AS p_partkey, p_name, '[\"' || p_name || '\",\"x\"]' AS tags FROM part")
def csv_round_trip(spark, sf_dir):
    """Written as CSV with nested values as JSON, read as strings."""
    (part,) = tables(spark, sf_dir, "part")
    path = _path(spark, "csv")
    sinks.write_csv(part.withColumn("tags", F.array("p_name", F.lit("x"))), path, ["p_partkey", "p_name", "tags"])
    return readers.csv_catalog(spark, path, ["p_partkey", "p_name", "tags"])


@query("SELECT count(*) AS rows, min(doc_id) AS least, count(DISTINCT lang) AS langs FROM documents WHERE doc_id % 3 <> 0")
def resumed(spark, sf_dir):
    """K07 K09 ST2: a part is written before; the rest is appended once, and a receipt tells what was."""
    (docs,) = tables(spark, sf_dir, "documents")
    path = _path(spark, "resume")
    rows = docs.select("doc_id", "lang")
    rows.where("doc_id % 3 = 0").write.parquet(path)
    return sinks.receipt(sinks.resume(spark, rows, path, ["doc_id"]), least=F.min("doc_id"), langs=F.count_distinct("lang"))


@query("""
WITH d AS (SELECT doc_id, source FROM documents), s AS (SELECT source, count(*) AS n, count(*) FILTER (doc_id % 5 <> 0 OR source = 'src1') AS c FROM d GROUP BY source)
SELECT sum(n)::BIGINT AS ids, sum(c)::BIGINT AS covered_ids, count(*) AS groups, count(*) FILTER (n = c) AS covered_groups FROM s
""")
def coverage_counts(spark, sf_dir):
    """A20."""
    (docs,) = tables(spark, sf_dir, "documents")
    return coverage.covered(docs, docs.where("doc_id % 5 <> 0 OR source = 'src1'"), "doc_id", "source")


@query("SELECT source, CASE WHEN n_chars < 200 THEN 'short' WHEN lang = 'en' THEN 'english' ELSE 'other' END AS state, count(*) AS rows FROM documents GROUP BY 1, 2")
def corpus_status(spark, sf_dir):
    """A21."""
    (docs,) = tables(spark, sf_dir, "documents")
    return coverage.status(docs, "source", [("short", F.col("n_chars") < 200), ("english", F.col("lang") == "en")])


@query("SELECT provenance, count(*) AS rows, count(lang) AS with_lang FROM (SELECT 'documents' AS provenance, lang FROM documents UNION ALL SELECT 'pages', NULL FROM pages UNION ALL SELECT 'benchmark', NULL FROM benchmark) GROUP BY provenance")
def provenance_union(spark, sf_dir):
    """U02."""
    docs, pages, bench = tables(spark, sf_dir, "documents", "pages", "benchmark")
    rows = coverage.stamped({"documents": docs.select("text", "lang"), "pages": pages.select(F.col("html").alias("text")), "benchmark": bench.select("text")})
    return rows.groupBy("provenance").agg(F.count("*").alias("rows"), F.count("lang").alias("with_lang"))


@query("WITH a AS (SELECT text FROM documents WHERE doc_id % 2 = 0), b AS (SELECT text FROM documents WHERE doc_id % 3 = 0) SELECT (SELECT count(*) FROM a) AS first_rows, (SELECT count(*) FROM b) AS second_rows, (SELECT count(*) FROM (SELECT text FROM a INTERSECT SELECT text FROM b)) AS shared_keys")
def concatenation_report(spark, sf_dir):
    """U03."""
    (docs,) = tables(spark, sf_dir, "documents")
    return coverage.concatenated(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 3 = 0"), F.sha2("text", 256))[1].select(*(F.col(c).cast("long").alias(c) for c in ("first_rows", "second_rows", "shared_keys")))


@query("""
WITH p AS (SELECT p_partkey, 0.5 + p_size / 200.0::DOUBLE AS rho, 0.81::DOUBLE AS r FROM part)
SELECT p_partkey, round(sqrt(r) - rho, 6) AS gap, round(rho / sqrt(r), 6) AS corrected, round((p_partkey % 7) / 7.0::DOUBLE, 6) AS parse_rate, sqrt(r) - rho > 0.2 AS beyond_noise FROM p
""")
def ceiling_gaps(spark, sf_dir):
    """C51."""
    (part,) = tables(spark, sf_dir, "part")
    out = coverage.gap_to_ceiling(0.5 + F.col("p_size") / 200.0, F.lit(0.81), F.col("p_partkey") % 7, F.lit(7), F.lit(0.2))
    return part.select("p_partkey", *(F.round(out[c], 6).alias(c) for c in ("gap", "corrected", "parse_rate")), out["beyond_noise"].alias("beyond_noise"))


@query("""
WITH b AS (SELECT source, count(*) AS rows, avg((n_chars > 20)::INT) AS valid, avg((lang IS NOT NULL)::INT) AS filled, avg((doc_id % 17 = 0)::INT) AS abstained FROM documents GROUP BY source)
SELECT source, rows, round(valid, 6) AS valid, round(filled, 6) AS filled, round(abstained, 6) AS abstained, valid >= 0.9 AND filled >= 0.95 AND abstained < 0.06 AS accepted FROM b
""")
def accepted_batches(spark, sf_dir):
    """D09."""
    (docs,) = tables(spark, sf_dir, "documents")
    out = coverage.batch_acceptance(docs, "source", F.col("n_chars") > 20, F.col("lang").isNotNull(), F.col("doc_id") % 17 == 0, least_valid=0.9, most_abstained=0.06)
    return out.select("source", "rows", *(F.round(c, 6).alias(c) for c in ("valid", "filled", "abstained")), "accepted")


@query("""
WITH a AS (SELECT o_orderkey AS k, o_orderpriority AS g, o_totalprice > 150000 AS v, o_totalprice AS s FROM orders), b AS (SELECT o_orderkey AS k, o_totalprice > 160000 AS v, round(o_totalprice / 1000) AS s FROM orders WHERE o_orderkey % 20 <> 0),
j AS (SELECT a.g, a.v = b.v AS same, a.s AS sa, b.s AS sb FROM a JOIN b USING (k)),
r AS (SELECT g, same, rank() OVER (PARTITION BY g ORDER BY sa) + (count(*) OVER (PARTITION BY g, sa) - 1) / 2 AS ra, rank() OVER (PARTITION BY g ORDER BY sb) + (count(*) OVER (PARTITION BY g, sb) - 1) / 2 AS rb FROM j),
m AS (SELECT g, count(*) AS n, avg(same::INT) AS agreement, corr(ra, rb) AS rho FROM r GROUP BY g), t AS (SELECT g, count(*) AS rows FROM a GROUP BY g)
SELECT g, rows, round(n / rows, 6) AS coverage, round(agreement, 6) AS agreement, round(rho, 6) AS rho, n / rows >= 0.9 AND agreement >= 0.9 AND rho >= 0.8 AS passed FROM t JOIN m USING (g)
""")
def fidelity_gate(spark, sf_dir):
    """G06."""
    (o,) = tables(spark, sf_dir, "orders")
    a = o.select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("g"), (F.col("o_totalprice") > 150000).alias("v"), F.col("o_totalprice").alias("s"))
    b = o.where("o_orderkey % 20 <> 0").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") > 160000).alias("v"), F.round(F.col("o_totalprice") / 1000).alias("s"))
    out = coverage.fidelity(a, b, "k", ["g"], "v", "s")
    return out.select("g", "rows", *(F.round(c, 6).alias(c) for c in ("coverage", "agreement", "rho")), "passed")


@query("""
WITH e AS (SELECT l_partkey AS item, l_linenumber::VARCHAR AS seed, (l_partkey % 101)::DOUBLE AS t, CASE WHEN l_quantity % 9 <> 0 THEN avg(l_quantity) END AS s FROM lineitem GROUP BY l_partkey, l_linenumber, l_quantity),
x AS (SELECT item, seed, t, s FROM e UNION ALL SELECT item, 'ensemble', first(t), median(s) FROM e GROUP BY item),
r AS (SELECT seed, rank() OVER (PARTITION BY seed ORDER BY t) + (count(*) OVER (PARTITION BY seed, t) - 1) / 2 AS rt, rank() OVER (PARTITION BY seed ORDER BY s) + (count(*) OVER (PARTITION BY seed, s) - 1) / 2 AS rs FROM x WHERE s IS NOT NULL)
SELECT seed, n, round(parse_rate, 6) AS parse_rate, round(rho, 6) AS rho FROM (SELECT seed, count(*) AS n, avg((s IS NOT NULL)::INT) AS parse_rate FROM x GROUP BY seed) JOIN (SELECT seed, corr(rt, rs) AS rho FROM r GROUP BY seed) USING (seed)
""")
def seed_ensembles(spark, sf_dir):
    """G07 A07."""
    (li,) = tables(spark, sf_dir, "lineitem")
    rows = li.groupBy("l_partkey", "l_linenumber", "l_quantity").agg(F.when(F.col("l_quantity") % 9 != 0, F.avg("l_quantity")).alias("s"))
    out = coverage.seed_ensemble(rows.withColumn("t", F.col("l_partkey") % 101), "l_partkey", "l_linenumber", "t", "s")
    return out.select("seed", "n", F.round("parse_rate", 6).alias("parse_rate"), F.round("rho", 6).alias("rho"))


@query("""
WITH m AS (SELECT l_partkey AS item, dim, median(v) AS s FROM (SELECT l_partkey, unnest(['quantity', 'discount']) AS dim, unnest([CASE WHEN l_quantity % 9 <> 0 THEN l_quantity END, l_discount * 100]) AS v FROM lineitem) WHERE v IS NOT NULL GROUP BY 1, 2)
SELECT dim, count(*) AS items, round(avg(s), 6) AS mean FROM m GROUP BY dim
""")
def dimension_means(spark, sf_dir):
    """Parts are items and line numbers seeds; quantities divisible by nine could not be parsed."""
    (li,) = tables(spark, sf_dir, "lineitem")
    given = F.array(*(F.struct(F.lit(n).alias("dim"), c.alias("v")) for n, c in (("quantity", F.when(F.col("l_quantity") % 9 != 0, F.col("l_quantity"))), ("discount", F.col("l_discount") * 100))))
    out = coverage.dimension_means(li.select("l_partkey", "l_linenumber", F.inline(given)), "l_partkey", "l_linenumber", "dim", "v")
    return out.withColumn("mean", F.round("mean", 6))
