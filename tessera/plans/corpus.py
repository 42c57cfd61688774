"""Curation, tagging, deduplication, decontamination, formats and rubric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import curation, dedup, mutate, order, rubric, sampling
from tessera.operators.labels import upserted
from tessera.operators.rubric_rules import RULES
from tessera.plans._registry import query, tables
from tessera.sources import extract, readers, sinks

SQUEEZE = r"trim(regexp_replace(text, '\s+', ' ', 'g'), ' ')"


@query(rf"""
WITH u AS (SELECT doc_id, text, source, sha256({SQUEEZE}) AS h FROM documents WHERE length(text) >= 50),
f AS (SELECT min(doc_id) AS doc_id FROM u GROUP BY h),
d AS (SELECT f.doc_id, CASE WHEN quality = 1 THEN 'judge' ELSE 'gen' END AS kind, quality FROM f JOIN labels USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY md5('42:' || doc_id), doc_id) AS r,
             count(*) FILTER (kind = 'gen') OVER () AS a, count(*) FILTER (kind = 'judge') OVER () AS b FROM d),
k AS (SELECT * FROM r WHERE a = 0 OR b = 0 OR (kind = 'judge' AND (b <= round_even(a * (0.6::DOUBLE / 0.4::DOUBLE), 0) OR r <= round_even(a * (0.6::DOUBLE / 0.4::DOUBLE), 0)))
      OR (kind = 'gen' AND (b > round_even(a * (0.6::DOUBLE / 0.4::DOUBLE), 0) OR a <= round_even(b * (0.4::DOUBLE / 0.6::DOUBLE), 0) OR r <= round_even(b * (0.4::DOUBLE / 0.6::DOUBLE), 0)))),
p AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS p, count(*) OVER () AS n FROM k),
s AS (SELECT *, CASE WHEN p < floor(n * 0.8) THEN 'train' WHEN p < floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM p)
SELECT split, count(*) AS rows, count(*) FILTER (kind = 'judge') AS judge_rows, sum(doc_id)::BIGINT AS id_sum, sum(CASE WHEN quality = 0 THEN 1.5 ELSE 1.0 END)::DOUBLE AS weight FROM s GROUP BY split
""")
def curate_export(spark, sf_dir):
    """Normalise, keep first of equals, filter, hold a ratio, weigh, split, count."""
    docs, labels = tables(spark, sf_dir, "documents", "labels")
    usable = docs.where(F.length("text") >= 50).select("doc_id", F.sha2(X.squeezed(F.col("text")), 256).alias("h"))
    kept = usable.groupBy("h").agg(F.min("doc_id").alias("doc_id")).select("doc_id").join(labels, "doc_id")
    kept = kept.withColumn("kind", F.when(F.col("quality") == 1, "judge").otherwise("gen"))
    even = sampling.enforce_ratio(kept, "kind", "gen", "judge", (0.4, 0.6), "doc_id")
    split = sampling.split_by_position(even, "doc_id")
    weight = F.when(F.col("quality") == 0, 1.5).otherwise(1.0)
    return split.groupBy("split").agg(F.count("*").alias("rows"), F.count_if(F.col("kind") == "judge").alias("judge_rows"), F.sum("doc_id").alias("id_sum"), F.sum(weight).alias("weight"))


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY sha256(text)")
def dedup_exact_first_wins(spark, sf_dir):
    """W01."""
    (docs,) = tables(spark, sf_dir, "documents")
    return docs.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("h")


@query(rf"""
WITH n AS (SELECT doc_id, source, trim(regexp_replace(regexp_replace(regexp_replace(text, '/\*(.|\n)*?\*/', '', 'g'), '//[^\n]*', '', 'g'), '\s+', ' ', 'g'), ' ') AS t FROM documents)
SELECT doc_id, source FROM n QUALIFY row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1
""")
def dedup_normalized(spark, sf_dir):
    """T11 W03."""
    (docs,) = tables(spark, sf_dir, "documents")
    return dedup.exact(docs, F.sha2(X.without_comments(F.col("text")), 256), ["doc_id"]).select("doc_id", "source")


@query("SELECT DISTINCT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, trim(b.text)) AND length(trim(b.text)) > 0")
def decontaminate_benchmark(spark, sf_dir):
    """Documents that hold a benchmark passage."""
    docs, bench = tables(spark, sf_dir, "documents", "benchmark")
    return dedup.contained(docs, "doc_id", F.col("text"), bench, "item_id", F.trim("text"))


NOISE = ("benchmark_suite", "description")


@query(f"""
WITH n AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z_]+')) AS name FROM documents)
SELECT name, length(name) >= 12 AND contains(name, '_') AND name NOT IN {NOISE} AS genuine FROM n WHERE length(name) >= 7 AND EXISTS (SELECT 1 FROM benchmark b WHERE contains(b.text, n.name))
""")
def names_in_benchmark(spark, sf_dir):
    """Names from texts that the benchmark holds, also inside its words."""
    docs, bench = tables(spark, sf_dir, "documents", "benchmark")
    names = docs.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z_]+"), F.lit(0))).alias("name"))
    return dedup.names_within(names, "name", bench, F.col("text"), noise=NOISE)


@query("""
WITH h AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id % 10 = 0), t AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 0),
r AS (SELECT t.*, CASE WHEN h.h IS NOT NULL THEN 'leak' WHEN row_number() OVER (PARTITION BY t.h ORDER BY doc_id) > 1 THEN 'duplicate' ELSE 'accepted' END AS reason FROM t LEFT JOIN h ON t.h = h.h)
SELECT reason, count(*) AS rows, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM r GROUP BY reason
""")
def leakage_report(spark, sf_dir):
    """Training rows against held-out rows, leaks told before duplicates. The held-out part is every tenth id."""
    (docs,) = tables(spark, sf_dir, "documents")
    held, train = docs.where("doc_id % 10 = 0"), docs.where("doc_id % 10 <> 0")
    key = F.sha2("text", 256)
    return curation.report(dedup.leakage(train.select("doc_id", "text"), key, ["doc_id"], held, key), "reason").withColumn("share", F.round("share", 6))


@query(r"""
WITH c AS (SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)lorem|\bcookies?\b') THEN 'vendor' WHEN abs(length(text) - length(replace(text, '{', '')) - (length(text) - length(replace(text, '}', '')))) > 2 THEN 'truncated'
  WHEN length(text) < 60 THEN 'short' WHEN (length(text) - length(regexp_replace(text, '[%$#&*]', '', 'g'))) * 10 > length(text) THEN 'junk' END AS reason FROM documents)
SELECT coalesce(reason, 'accepted') AS reason, count(*) AS rows, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM c GROUP BY 1
""")
def rejection_report(spark, sf_dir):
    """The first gate that each document fails."""
    (docs,) = tables(spark, sf_dir, "documents")
    t = F.col("text")
    junk = F.length(t) - F.length(F.regexp_replace(t, "[%$#&*]", ""))
    reason = curation.first_failure(("vendor", ~t.rlike(r"(?i)lorem|\bcookies?\b")), ("truncated", X.unclosed_braces(t) <= 2), ("short", F.length(t) >= 60), ("junk", junk * 10 <= F.length(t)))
    return curation.report(docs.select(reason.alias("reason")), "reason").withColumn("share", F.round("share", 6))


@query("SELECT source, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM documents GROUP BY source")
def source_histogram(spark, sf_dir):
    """A05."""
    (docs,) = tables(spark, sf_dir, "documents")
    total = docs.agg(F.count("*").alias("all"))
    return docs.groupBy("source").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("source", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


@query("SELECT lang, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 0) AS poor, round(100.0 * count(*) FILTER (toxic = 1) / count(*), 3) AS toxic_pct FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def lang_quality_mix(spark, sf_dir):
    """A04 A03."""
    docs, labels = tables(spark, sf_dir, "documents", "labels")
    return docs.join(labels, "doc_id").groupBy("lang").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("poor"), F.round(100.0 * F.count_if(F.col("toxic") == 1) / F.count("*"), 3).alias("toxic_pct"))


@query("""
WITH c AS (SELECT tag, count(*) AS have FROM (SELECT unnest([source, lang]) AS tag FROM documents) GROUP BY tag),
t AS (SELECT * FROM (VALUES ('en', 10000), ('de', 100), ('fr', 100000), ('src0', 5000), ('src1', 10), ('nothing', 7)) v(tag, need))
SELECT t.tag, need, coalesce(have, 0) AS have, need - coalesce(have, 0) AS deficit, round(coalesce(have, 0) / need * 100, 1) AS fill_pct FROM t LEFT JOIN c USING (tag) WHERE need > coalesce(have, 0)
""")
def coverage_gap(spark, sf_dir):
    """A01 A02."""
    (docs,) = tables(spark, sf_dir, "documents")
    have = docs.select(F.explode(F.array("source", "lang")).alias("tag")).groupBy("tag").agg(F.count("*").alias("have"))
    need = spark.createDataFrame([("en", 10000), ("de", 100), ("fr", 100000), ("src0", 5000), ("src1", 10), ("nothing", 7)], "tag string, need int")
    return curation.gaps(have, need)


CONVERSATION = """
WITH m AS (SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS messages FROM conversations GROUP BY conv_id),
k AS (SELECT conv_id, messages, CASE WHEN contains(coalesce(list_filter(messages, lambda m: m.role = 'user' AND (contains(m.content, '<wp_judge>') OR contains(m.content, '<wp_gen>')))[1].content, ''), '<wp_judge>') THEN 'judge' ELSE 'gen' END AS kind FROM m)
"""


def _threads(spark, sf_dir):
    (c,) = tables(spark, sf_dir, "conversations")
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    threads = c.groupBy("conv_id").agg(rows.alias("m")).select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))
    return threads.withColumn("task_type", F.lit(None).cast("string"))


@query(CONVERSATION + """
, t AS (SELECT conv_id, list_transform(messages, lambda m: {'role': m.role, 'content': CASE WHEN m.role = 'user' AND NOT contains(m.content, '<wp_gen>') AND NOT contains(m.content, '<wp_judge>') THEN '<wp_' || kind || '> ' || m.content ELSE m.content END}) AS m FROM k),
l AS (SELECT conv_id, coalesce(list_filter(m, lambda x: x.role = 'system')[-1].content, '') AS s, coalesce(list_filter(m, lambda x: x.role = 'user')[-1].content, '') AS u, coalesce(list_filter(m, lambda x: x.role = 'assistant')[-1].content, '') AS a FROM t)
SELECT CASE WHEN s <> '' THEN s || chr(10) || chr(10) || u ELSE u END AS instruction, '' AS input, a AS output FROM l
""")
def conversation_export(spark, sf_dir):
    """K03 P07 P08."""
    return sinks.instruction_format(_threads(spark, sf_dir))


@query(CONVERSATION + "SELECT conv_id, kind AS task_type, len(messages) AS turns, sha256(string_agg(m.content, '' ORDER BY i)) AS answers FROM (SELECT *, unnest(messages) AS m, unnest(range(len(messages))) AS i FROM k) WHERE m.role = 'assistant' GROUP BY 1, 2, 3")
def conversation_raw(spark, sf_dir):
    """Task type and the key by which conversations are deduplicated."""
    raw = sinks.raw_format(_threads(spark, sf_dir))
    said = F.filter("messages", lambda m: m["role"] == "assistant")
    return raw.where(F.size(said) > 0).select("conv_id", "task_type", F.size("messages").cast("long").alias("turns"), F.sha2(F.array_join(F.transform(said, lambda m: m["content"]), ""), 256).alias("answers"))


@query("""
WITH b AS (SELECT *, row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) - 1 AS position FROM documents)
SELECT position // 64 AS batch, count(*) AS n, min(doc_id) AS least, sum(doc_id)::BIGINT AS ids FROM b GROUP BY 1
""")
def batches(spark, sf_dir):
    """K08 W19 W29 G13."""
    (docs,) = tables(spark, sf_dir, "documents")
    rows = sinks.batched(docs.select("doc_id").withColumn("h", order.hash_order(7, "doc_id")), [F.col("h"), F.col("doc_id")], 64)
    return rows.groupBy("batch").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.sum("doc_id").alias("ids"))


#: RE2 has no lookahead; the two rules that use it are left to our own tests.
SQL_RULES = tuple(r for r in RULES if "(?!" not in r[4] and r[1] == "D7_a11y")


def _rule_sql(hit: str) -> str:
    tests = ", ".join(f"CASE WHEN regexp_matches(html, '(?m){p}') OR regexp_matches(replace(html, chr(34), chr(39)), '(?m){p}') THEN '{r}' END" for r, _, _, _, p in ((*x[:4], x[4].replace("'", "''")) for x in SQL_RULES))
    return f"WITH h AS (SELECT page_id, list_filter([{tests}], lambda x: x IS NOT NULL) AS hits FROM pages) {hit}"


@query(_rule_sql("SELECT rule, count(*) AS pages FROM (SELECT unnest(hits) AS rule FROM h) GROUP BY rule"))
def rule_hits_pages(spark, sf_dir):
    """C07."""
    (pages,) = tables(spark, sf_dir, "pages")
    hits = rubric.rule_hits(F.col("html"), SQL_RULES)
    return pages.select(F.explode(hits).alias("rule")).groupBy("rule").agg(F.count("*").alias("pages"))


def _score_sql() -> str:
    neg = [(r, w) for r, _, p, w, _ in SQL_RULES if p == "negative"]
    total = sum(w for _, w in neg)
    score = "10.0::DOUBLE" + "".join(f" - CASE WHEN list_contains(hits, '{r}') THEN {3.0 * w / max(total, w)!r}::DOUBLE ELSE 0 END" for r, w in neg)
    gain = " + ".join(f"CASE WHEN list_contains(hits, '{r}') THEN {w} ELSE 0 END" for r, _, p, w, _ in SQL_RULES if p == "positive")
    return _rule_sql(f", s AS (SELECT page_id, greatest(0, least(10, greatest({score}, ({gain}) / 18.0::DOUBLE * 8))) AS s FROM h) SELECT page_id, round(s, 6) AS score, CASE WHEN s * 10 >= 90 THEN 'Excellent' WHEN s * 10 >= 75 THEN 'Good' WHEN s * 10 >= 60 THEN 'Acceptable' WHEN s * 10 >= 40 THEN 'Poor' WHEN s * 10 >= 20 THEN 'Bad' ELSE 'Failing' END AS grade FROM s")


@query(_score_sql())
def rubric_score_pages(spark, sf_dir):
    """C10 C11 P22."""
    (pages,) = tables(spark, sf_dir, "pages")
    rows = pages.select("page_id", rubric.rule_hits(F.col("html"), SQL_RULES).alias("hits"))
    s = rubric.dimension_scores(F.col("hits"), F.array().cast("array<string>"), SQL_RULES, {"D7_a11y": 18})["D7_a11y"]
    return rows.select("page_id", F.round(s, 6).alias("score"), X.banded(s * 10).alias("grade"))


@query()
def rubric_full_pages(spark, sf_dir):
    """C09-C13 over all rules and dimensions."""
    (pages,) = tables(spark, sf_dir, "pages")
    out = rubric.scored(pages, "page_id", "html")
    return out.select("page_id", F.size("hits").alias("n_hits"), F.size("na").alias("n_na"), "overall", "grade")


@query(r"""
SELECT page_id, len(list_distinct(regexp_extract_all(html, 'href="([^"]+)"', 1)))::BIGINT AS links, len(regexp_extract_all(html, '<p>'))::BIGINT AS paragraphs, contains(html, '<h1>') AS has_heading FROM pages
""")
def page_links_features(spark, sf_dir):
    """C44 P19."""
    (pages,) = tables(spark, sf_dir, "pages")
    links = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)))
    return pages.select("page_id", F.size(links).cast("long").alias("links"), F.regexp_count("html", F.lit("<p>")).cast("long").alias("paragraphs"), F.col("html").contains("<h1>").alias("has_heading"))


@query("SELECT event_type, (props::JSON->>'k')::INT AS k, count(*) AS n FROM events GROUP BY 1, 2")
def event_props_parse(spark, sf_dir):
    """C01."""
    (events,) = tables(spark, sf_dir, "events")
    return events.select("event_type", X.json_number(X.json_in(F.col("props")), "$.k").cast("int").alias("k")).groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query("""
WITH r AS (
  SELECT n_name AS nation, c_name AS best_name, NULLIF(c_mktsegment, 'BUILDING') AS segment, 'customer' AS tier, c_custkey AS seq FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT n_name, s_name, NULL, 'supplier', s_suppkey + 1000000000 FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT nation, min_by(best_name, seq) AS best_name, min_by(segment, seq) FILTER (segment IS NOT NULL AND trim(segment) <> '') AS segment, array_to_string(list_sort(list_distinct(list(tier))), ',') AS tier FROM r GROUP BY nation
""")
def merge_upsert(spark, sf_dir):
    """J16 U01."""
    customer, supplier, nation = tables(spark, sf_dir, "customer", "supplier", "nation")
    a = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("nation"), F.col("c_name").alias("best_name"), F.expr("nullif(c_mktsegment, 'BUILDING')").alias("segment"), F.lit("customer").alias("tier"), F.col("c_custkey").alias("seq"))
    b = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("nation"), F.col("s_name").alias("best_name"), F.lit("supplier").alias("tier"), (F.col("s_suppkey") + 1_000_000_000).alias("seq"))
    return upserted(a.unionByName(b, allowMissingColumns=True), ["nation"], "seq", "tier")


@query(r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct([array_to_string(w[i:i+4], ' ') for i in range(1, greatest(len(w) - 4, 1) + 1)])) AS s FROM w WHERE len(w) > 0),
r AS (SELECT s, min(doc_id) AS k FROM s GROUP BY s),
e AS (SELECT k, len(s) AS n, unnest(s) AS x FROM r),
p AS (SELECT a.k AS a, b.k AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.x = b.x AND a.k < b.k GROUP BY 1, 2)
SELECT a, b, round(c / (na + nb - c), 6) AS jaccard FROM p WHERE c / (na + nb - c) >= 0.8
""")
def neardup_jaccard(spark, sf_dir):
    """Pairs of different texts at 0.8 over five words."""
    (docs,) = tables(spark, sf_dir, "documents")
    return dedup.jaccard_pairs(docs, "doc_id", F.col("text")).withColumn("jaccard", F.round("jaccard", 6))


@query(r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct([array_to_string(w[i:i+4], ' ') for i in range(1, greatest(len(w) - 4, 1) + 1)])) AS s FROM w WHERE len(w) > 0),
r AS (SELECT s, min(doc_id) AS k FROM s GROUP BY s),
e AS (SELECT k, len(s) AS n, unnest(s) AS x FROM r),
p AS (SELECT a.k AS a, b.k AS b FROM e a JOIN e b ON a.x = b.x AND a.k <> b.k GROUP BY 1, 2 HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.8),
t AS (SELECT k AS node, k AS root FROM r UNION SELECT p.b, t.root FROM t JOIN p ON t.node = p.a),
c AS (SELECT node, min(root) AS root FROM t GROUP BY node)
SELECT w.doc_id, coalesce(c.root, w.doc_id) AS cluster_id, w.doc_id = coalesce(c.root, w.doc_id) AS kept
FROM w LEFT JOIN s USING (doc_id) LEFT JOIN r ON r.s = s.s LEFT JOIN c ON c.node = r.k
""")
def neardup_clusters(spark, sf_dir):
    """D02."""
    (docs,) = tables(spark, sf_dir, "documents")
    return dedup.clusters(docs, "doc_id", F.col("text"))


@query("""
WITH RECURSIVE k AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i, sha256(string_split(text, chr(10))[1]) AS a, sha256(string_split(text, chr(10))[-1]) AS b FROM documents),
r AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS seen_a, []::VARCHAR[] AS seen_b, false AS kept
  UNION ALL SELECT k.i, CASE WHEN ok THEN list_append(seen_a, a) ELSE seen_a END, CASE WHEN ok THEN list_append(seen_b, b) ELSE seen_b END, ok
  FROM r JOIN k ON k.i = r.i + 1, LATERAL (SELECT NOT list_contains(seen_a, a) AND NOT list_contains(seen_b, b) AS ok) o)
SELECT doc_id, a, b FROM k JOIN r USING (i) WHERE kept
""")
def dual_key_dedup(spark, sf_dir):
    """First line and last line of a text are its keys."""
    (docs,) = tables(spark, sf_dir, "documents")
    lines = F.split("text", "\n")
    return dedup.dual_key(docs.select("doc_id", F.sha2(F.element_at(lines, 1), 256).alias("a"), F.sha2(F.element_at(lines, -1), 256).alias("b")), "a", "b", "doc_id")


CODE = """concat('if ( ! wp_verify_nonce( $n, ', chr(39), 'x', chr(39), ' ) ) { die; } echo esc_html( $a', doc_id, ' ); SELECT id, name FROM t; $b = absint( $c', doc_id, ' );')"""


@query(f"""
WITH c AS (SELECT doc_id, {CODE} AS code FROM documents), m AS (
  SELECT doc_id, 'csrf' AS mutation_type, regexp_replace(code, 'if\\s*\\(\\s*!\\s*wp_verify_nonce\\s*\\(.*?\\)\\s*\\)\\s*\\{{[^}}]*\\}}\\s*', '') AS bad_code FROM c
  UNION ALL SELECT doc_id, 'xss', regexp_replace(code, 'esc_html\\s*\\(\\s*([^)]+)\\s*\\)', '\\1', 'g') FROM c
  UNION ALL SELECT doc_id, 'input_validation', regexp_replace(code, 'absint\\s*\\(\\s*([^)]+)\\s*\\)', '\\1', 'g') FROM c
  UNION ALL SELECT doc_id, 'performance', regexp_replace(code, 'SELECT id, name FROM', 'SELECT * FROM') FROM c)
SELECT doc_id, mutation_type, bad_code FROM m
""")
def mutation_fan_out(spark, sf_dir):
    """Every mutation of a code made from each id."""
    (docs,) = tables(spark, sf_dir, "documents")
    code = F.concat(F.lit("if ( ! wp_verify_nonce( $n, 'x' ) ) { die; } echo esc_html( $a"), F.col("doc_id"), F.lit(" ); SELECT id, name FROM t; $b = absint( $c"), F.col("doc_id"), F.lit(" );"))
    return mutate.fan_out(docs.select("doc_id", code.alias("code")), "code").select("doc_id", "mutation_type", "bad_code")


@query()
def perturbation_pairs(spark, sf_dir):
    """T09 T10."""
    (docs,) = tables(spark, sf_dir, "documents")
    return mutate.pairs_by_axis(docs, "doc_id", "text").select("pair_id", "axis", "variant", F.length("code").alias("n_chars"))


@query()
def extracted_functions(spark, sf_dir):
    """Functions from a source file around each text's id."""
    (docs,) = tables(spark, sf_dir, "documents")
    code = F.concat(F.lit("<?php\nclass C {\n/** Gives the value of a key. */\npublic function get_"), F.col("doc_id"), F.lit("( $k ) { if ( $k ) { return X::class; } return '}'; }\n}\nfunction plain() { add_action( 'init', 'f' ); }\n"))
    rows = extract.extract_functions(docs.select("doc_id", code.alias("code")), "doc_id", "code")
    return rows.select("doc_id", "function_name", "class_context", X.docblock_summary(F.col("docblock")).alias("summary"), "start_line", "line_count", X.calls(F.col("body")).alias("calls"))


@query("""
SELECT p_name AS path, p_partkey, NOT (contains(p_name, 'vendor/') OR starts_with(p_name, 'red') OR regexp_full_match(p_name, '.*green')) AND (starts_with(p_name, 'P') OR regexp_full_match(p_name, '.*e.*')) AS allowed FROM part
""")
def path_filter(spark, sf_dir):
    """S05 F07."""
    (part,) = tables(spark, sf_dir, "part")
    return part.select(F.col("p_name").alias("path"), "p_partkey", readers.path_allowed(F.col("p_name"), ["P", "**/*e*"], ["red", "*green"]).alias("allowed"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 5 = 0 AND p_size % 3 = 0 AND p_retailprice / 20 >= 90 THEN 'trusted' ELSE 'assessed' END AS tier, p_size * 1000 >= 10000 AND p_retailprice / 20 >= 50 AND p_size % 5 = 0 AS ok FROM part
""")
def catalog_filter(spark, sf_dir):
    """P01 P02 F01."""
    (part,) = tables(spark, sf_dir, "part")
    text = lambda c: c.cast("string")
    installs = F.concat(text(F.col("p_size") * 1000), F.lit("+"))
    rating = text(F.col("p_retailprice") / 20)
    return part.select("p_partkey", curation.tier(text(F.col("p_size") % 3), text(F.col("p_size") % 5), rating).alias("tier"), curation.catalog_ok(installs, rating, text(F.col("p_size") % 5), F.lit("https://github.com/x"), least_rating=50.0).alias("ok"))


@query("""
WITH t AS (SELECT page_id, list_sort(list_filter([CASE WHEN contains(lower(html), 'aria-label') OR contains(lower(html), 'role="') OR contains(lower(html), 'aria-describedby') OR contains(lower(html), 'screen-reader-text') THEN 'a11y:aria_attributes' END,
  CASE WHEN contains(lower(html), '_n(') THEN 'i18n:pluralization' END, CASE WHEN contains(lower(html), '<label') AND contains(lower(html), 'for="') THEN 'a11y:form_labels' END,
  CASE WHEN contains(lower(html), '__(') OR contains(lower(html), '_e(') THEN 'i18n:translation_functions' END], lambda x: x IS NOT NULL)) AS tags FROM pages)
SELECT coalesce(array_to_string(tags, ','), '') AS tags, count(*) AS n FROM t GROUP BY 1
""")
def page_tags(spark, sf_dir):
    """P05 A01."""
    (pages,) = tables(spark, sf_dir, "pages")
    none = F.array().cast("array<string>")
    return pages.select(F.array_join(curation.tags(F.col("html"), none, none), ",").alias("tags")).groupBy("tags").agg(F.count("*").alias("n"))


@query("""
WITH v AS (SELECT doc_id, unnest(list_filter([CASE WHEN length(text) < 60 THEN 'too_short' END, CASE WHEN n_chars <> length(text) THEN 'wrong_length' END, CASE WHEN lang NOT IN ('en', 'de', 'fr', 'es') THEN 'unknown_lang' END, CASE WHEN contains(text, '@') THEN 'has_mail' END], lambda x: x IS NOT NULL)) AS rule FROM documents)
SELECT rule, count(*) AS n FROM v GROUP BY rule
""")
def schema_violations(spark, sf_dir):
    """F15 F18."""
    (docs,) = tables(spark, sf_dir, "documents")
    t = F.col("text")
    return curation.violations(docs, "doc_id", too_short=F.length(t) < 60, wrong_length=F.col("n_chars") != F.length(t), unknown_lang=~F.col("lang").isin("en", "de", "fr", "es"), has_mail=t.contains("@")).groupBy("rule").agg(F.count("*").alias("n"))


@query(rf"""
SELECT d.doc_id, min(e.doc_id) AS match FROM documents d JOIN documents e ON substr(sha256({SQUEEZE.replace("text", "d.text")}), 1, 16) = substr(sha256({SQUEEZE.replace("text", "e.text")}), 1, 16) AND e.doc_id < d.doc_id GROUP BY d.doc_id
""")
def code_hash_join(spark, sf_dir):
    """Each row's earlier equals by canonical hash, by the least of each hash."""
    (docs,) = tables(spark, sf_dir, "documents")
    rows = docs.select("doc_id", X.code_hash(F.col("text")).alias("h"))
    least = rows.groupBy("h").agg(F.min("doc_id").alias("match"))
    return rows.join(least, "h").where(F.col("match") < F.col("doc_id")).select("doc_id", "match")


@query("""
WITH u AS (SELECT sha256(text) AS h FROM documents WHERE doc_id % 10 = 0)
SELECT count(*) AS raw, count(DISTINCT text) AS distinct_texts, count(*) FILTER (sha256(text) IN (SELECT h FROM u)) AS used, count(DISTINCT text) FILTER (sha256(text) NOT IN (SELECT h FROM u)) AS available FROM documents
""")
def pool_count(spark, sf_dir):
    """A23 J03 J04."""
    (docs,) = tables(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.sha2("text", 256).alias("h"))
    used = rows.where("doc_id % 10 = 0").select("h").distinct().withColumn("u", F.lit(True))
    per = rows.groupBy("h").agg(F.count("*").alias("n")).join(used, "h", "left")
    return per.agg(F.sum("n").alias("raw"), F.count("*").alias("distinct_texts"), F.coalesce(F.sum(F.when(F.col("u"), F.col("n"))), F.lit(0)).alias("used"), F.count_if(F.col("u").isNull()).alias("available"))
