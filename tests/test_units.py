import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import stats
from tessera.functions import text as X
from tessera.operators import curation, dedup, examples, matrix, metrics, mutate, order, reward, rubric, sampling
from tessera.operators.components import components
from tessera.operators.labels import medians
from tessera.sources import extract, readers, sinks


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(n) for n, c in cols.items())).first()


def test_effective_counts(spark):
    rows = [("uniform", 5)] * 128 + [("single", 9)] + [("eight", 3)] * 8 + [("none", 0)]
    got = {r.layer: r.effective for r in matrix.concentration(spark.createDataFrame(rows, "layer string, n int"), "layer", "n").collect()}
    assert got["uniform"] == pytest.approx(128) and got["single"] == pytest.approx(1) and got["eight"] == pytest.approx(8) and got["none"] is None


def test_ratio_of_twenty_and_two_hundred(spark):
    df = spark.range(220).select(F.col("id"), F.when(F.col("id") < 20, "gen").otherwise("judge").alias("kind"))
    assert {r.kind: r["count"] for r in sampling.enforce_ratio(df, "kind", "gen", "judge", (0.4, 0.6), "id").groupBy("kind").count().collect()} == {"gen": 20, "judge": 30}
    assert sampling.enforce_ratio(df.where("kind = 'gen'"), "kind", "gen", "judge", (0.4, 0.6), "id").count() == 20


def test_medians_of_passes(spark):
    df = spark.createDataFrame([("a", 80.0), ("a", 70.0), ("a", 90.0), ("b", 60.0), ("b", None), ("b", 62.0), ("c", 1.0)], "i string, v double")
    assert {r.i: r["median"] for r in medians(df, ["i"], "v").collect()} == {"a": 80, "b": 61}


def test_identical_samples_are_equivalent(spark):
    df = spark.createDataFrame([("g", k, v) for k in (0, 1) for v in (1.0, 2.0, 3.0, 4.0)] + [("h", k, 5.0) for k in (0, 1) for _ in range(3)], "g string, k int, v double")
    assert all(r.equivalent for r in stats.tost(stats.welch_moments(df, ["g"], "k", "v"), 4.0).collect())


def test_tails():
    assert stats.t_tail(2.0, 10) == pytest.approx(0.036694, abs=1e-6)
    assert stats.t_tail(-1.0, 5) == pytest.approx(1 - 0.181609, abs=1e-5)
    assert stats.incomplete_beta(2, 3, 0.5) == pytest.approx(0.6875)


def test_dual_key_depends_on_acceptance(spark):
    df = spark.createDataFrame([(1, "p1", "o1"), (2, "p2", "o1"), (3, "p2", "o2")], "seq int, p string, o string")
    assert sorted(r.seq for r in dedup.dual_key(df, "p", "o", "seq").collect()) == [1, 3]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {}
    for r in components(spark.createDataFrame(edges, "a int, b int")).collect():
        got.setdefault(r.root, set()).add(r.node)
    assert sorted(map(sorted, got.values())) == [list(range(1, 61)), list(range(100, 160))]


@pytest.mark.parametrize("parts", ["1", "8"])
def test_positions_do_not_depend_on_partitions(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.range(500).withColumn("h", order.hash_order(1, "id"))
        got = [r.p for r in order.positions(df, [F.col("h"), F.col("id")], "p").orderBy("h", "id").collect()]
        assert got == list(range(500))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_docblocks(spark):
    c = lambda s: X.docblock_summary(F.lit(s))
    r = one(spark, a=c("/**\n * Gets the value of a key.\n * More text.\n * @param x\n */"), b=c("/**\n * Constructor.\n */"), d=c("/**\n * Internationalization\n */"), e=c(None))
    assert tuple(r) == ("Gets the value of a key. More text.", "", "", "")


def test_replies(spark):
    num = lambda s: X.json_number(X.judged_json(F.lit(s)), "$.score")
    r = one(spark, a=num('{"score": 7}'), b=num('so {x}\n```json\n{"score": 8.5}\n```'), c=num('<think>{"score": 1}</think> {bad} <judge_output>{"score": 3}</judge_output>'), d=num('{"score": true}'), e=num("nothing"), f=num('text {"score": 4} text'))
    assert tuple(r) == (7.0, 8.5, 3.0, None, None, 4.0)
    assert one(spark, m=X.prose_scores(F.lit("Security: score 7/10\n**I18n**: score None/10\nSecurity: score 1/10"))).m == {"security": 70.0, "i18n": None}


def test_jaccard_conventions_and_retention(spark):
    assert one(spark, a=X.retention(F.lit("alpha beta"), F.lit("beta gamma")), b=X.retention(F.lit(""), F.lit("x"))) == (0.5, 1.0)


def test_rules_and_scores(spark):
    code = F.lit("<?php\n$wpdb->query( \"SELECT * FROM t WHERE a = $b\" );\ngoto x;\nregister_rest_route( 'a', array( 'permission_callback' => 1 ) ); echo wp_cache_get( 'k' );")
    hits = set(one(spark, h=rubric.rule_hits(code)).h)
    assert {"WPCS-N13", "SQL-N15", "SQL-N01", "STR-P09"} <= hits and not {"STR-N09", "PERF-P01"} & hits
    row = rubric.scored(spark.range(1).select("id", code.alias("c")), "id", "c").first()
    assert row.D3_sql <= 2.0 and 0 < row.overall <= 100 and "D7_a11y" in row.na and row.D7_a11y is None
    empty = rubric.scored(spark.range(1).select("id", F.lit("").alias("c")), "id", "c").first()
    assert empty.overall == 0.0 and empty.grade == "Failing"


def test_heuristic_judge_folds_in_order(spark):
    rules = [("sec", "danger", "", 0.0, 1.0), ("sec", "bad", "fixed", -2.0, None), ("doc", "TODO", "", -3.0, None)]
    s = rubric.folded_scores(F.lit("danger bad TODO"), rules, {"sec": 9, "doc": 9})
    assert tuple(one(spark, **s)) == (1.0, 6.0)
    v = lambda **k: rubric.judged({"i18n": F.lit(7.0), "sec": F.lit(9.0)}, F.array().cast("array<string>"), F.lit(False), **k)
    assert tuple(one(spark, a=v(), b=v(na_exempt=("i18n",)), c=v(bypass=F.lit(True)))) == ("FAIL", "PASS", "PASS")


def test_rescaled_scores(spark):
    weights = dict.fromkeys(("wpcs", "security", "performance", "i18n", "accessibility", "documentation"), 1 / 6)
    scores = {k: F.lit(9.0) for k in ("wpcs", "security", "sql", "performance", "i18n", "accessibility", "documentation")}
    got = one(spark, **curation.rescaled(scores, F.lit("FAIL"), F.array(F.lit("SQL injection in query")), weights))
    assert got.security == 30 and got.wpcs == 90 and got.overall == 65


def test_mutations(spark):
    code = "$wpdb->get_row( $wpdb->prepare( \"SELECT a FROM t WHERE id = %d AND n = %s\", $id, $n ) ); if ( ! current_user_can( 'x' ) ) { return; } check_ajax_referer( 'n' ); check_ajax_referer( 'm' ); _e( 'Hi', 'd' );"
    got = {r.mutation_type: r.bad_code for r in mutate.fan_out(spark.createDataFrame([(code,), ("plain",)], "c string"), "c").collect()}
    assert set(got) == {"sql_injection", "csrf", "authorization", "i18n"}
    assert "' . $id . '" in got["sql_injection"] and "prepare" not in got["sql_injection"]
    assert got["csrf"].count("check_ajax_referer") == 1 and "echo 'Hi'" in got["i18n"]


def test_extractor():
    src = "<?php\nclass A {\n/** Does a thing. */\n  public static function go( $x ) { $f = function() { return '}'; }; return B::class; } // }\n}\nfunction top()\n{\n  /* { */ if (1) { x(); }\n}\nabstract class C { abstract function none(); }\n"
    got = [(n, c, d, s, k) for n, c, d, _, s, k in extract.functions_in(src)]
    assert got == [("go", "A", "/** Does a thing. */", 4, 1), ("top", None, None, 6, 4)]


def test_rewards(spark):
    df = spark.createDataFrame([("a", 1, 1.0, None), ("a", 2, 3.0, 0.5), ("b", 1, 2.0, None), ("b", 2, 2.0, None)], "g string, i int, x double, y double")
    rows = {(r.g, r.i): r for r in reward.composite(df, "g", {"x": 0.5, "y": 0.5}, F.col("i") == 2).collect()}
    assert rows["a", 1].was_imputed and rows["a", 1].reward == pytest.approx(-0.5, abs=1e-6) and rows["a", 2].reward == 0 and rows["b", 1].reward == pytest.approx(0)
    assert reward.centred(df, "g", "x").count() == 2


def test_keep_exactly_k_or_fail(spark):
    df = spark.createDataFrame([("l", e, e) for e in range(6)], "layer string, expert int, n int")
    safe = spark.createDataFrame([("l", 0), ("l", 1)], "layer string, expert int")
    assert sorted(r.expert for r in matrix.keep_mask(df, safe, "layer", "expert", "n", 3, exactly=True).collect()) == [0, 1, 5]
    with pytest.raises(Exception, match="protected"):
        matrix.keep_mask(df, safe, "layer", "expert", "n", 1, exactly=True).collect()


def test_slopes_and_gates(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, 5.0)], "s int, v double").withColumn("k", F.lit(1))
    assert [r.x for r in df.select(metrics.trailing_slope(F.col("v"), F.col("s"), ["k"], "s").alias("x"), "s").orderBy("s").collect()] == [None, 2.0, 2.0]
    got = metrics.gates(df.agg(F.max("v").alias("m"), F.lit(None).cast("double").alias("n")), [("a", "m", ">", 5), ("b", "m", ">=", 5), ("c", "n", "<", 1)]).collect()
    assert [r.passed for r in got] == [False, True, False]


def test_bootstrap_covers(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([("g", float(v)) for v in rng.normal(5, 1, 200)], "g string, v double")
    r = stats.bootstrap(df, ["g"], ["v"], lambda x: float(x.mean()), resamples=300).first()
    assert r.low < r.estimate < r.high and r.high - r.low == pytest.approx(4 / math.sqrt(200), rel=0.3)
    assert r == stats.bootstrap(df.coalesce(1), ["g"], ["v"], lambda x: float(x.mean()), resamples=300).first()
    assert stats.array_spearman(np.array([1, 2, 2, 3]), np.array([1, 5, 5, 9])) == 1 and stats.array_spearman(np.ones(3), np.arange(3)) == 0


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"id": 1, "t": "x"}\n\n{"id": \n{"id": 2, "t": null}\n')
    assert sorted(r.id for r in readers.json_lines(spark, str(tmp_path / "in"), "id long, t string").collect()) == [1, 2]
    (tmp_path / "arr").mkdir()
    (tmp_path / "arr" / "val_p1_000.json").write_text('[{"id": 1}, {"id": 2}]')
    (tmp_path / "arr" / "val_p2_001.json").write_text("not json")
    rows = readers.json_arrays(spark, str(tmp_path / "arr"), "id long")
    assert sorted(tuple(r) for r in rows.select("id", *readers.stem_parts(F.col("source_file"), r"val_(p\d)_(\d+)", ["pass", "n"])).collect()) == [(1, "p1", "000"), (2, "p1", "000")]
    df = spark.createDataFrame([(1, ["a", "b"], "x"), (2, None, 'q"uo')], "id int, tags array<string>, t string")
    sinks.write_csv(df, str(tmp_path / "csv"), ["t", "id", "tags"])
    assert sorted(tuple(r) for r in readers.csv_catalog(spark, str(tmp_path / "csv")).collect()) == [('q"uo', "2", None), ("x", "1", '["a","b"]')]
    sinks.write_json_lines(df, str(tmp_path / "out"))
    assert readers.json_lines(spark, str(tmp_path / "out"), df.schema).count() == 2
    (tmp_path / "tree" / "src").mkdir(parents=True)
    (tmp_path / "tree" / "vendor").mkdir()
    (tmp_path / "tree" / "src" / "a.php").write_text("x")
    (tmp_path / "tree" / "vendor" / "b.php").write_text("x")
    got = readers.file_tree(spark, str(tmp_path / "tree"), "*.php", ["src"]).collect()
    assert [(r.rel_path, r.text) for r in got] == [("src/a.php", "x")]
    assert sinks.resume(spark, df, str(tmp_path / "done"), ["id"]).count() == 2
    assert sinks.resume(spark, df, str(tmp_path / "done"), ["id"]).count() == 0


def test_batches_repeat_sentinels(spark):
    got = sinks.batched(spark.range(10), [F.col("id")], 4, spark.createDataFrame([(99,)], "id long")).groupBy("batch").agg(F.sort_array(F.collect_list("id")).alias("ids")).collect()
    assert sorted((r.batch, r.ids) for r in got) == [(0, [0, 1, 2, 3, 99]), (1, [4, 5, 6, 7, 99]), (2, [8, 9, 99])]


def test_examples(spark):
    dims = F.from_json(F.lit('{"a": {"severity": "High", "fix": "use wp_verify_nonce"}, "b": {"severity": "odd", "fix": ""}}'), "map<string,struct<severity:string,fix:string>>")
    assert one(spark, s=examples.severity_scores(dims), v=examples.severity_verdict(dims), a=examples.alignment(dims, F.lit("x"), F.lit("wp_verify_nonce();"))) == ({"a": 4, "b": 5}, "FAIL", 0.5)
    assert tuple(one(spark, a=examples.mechanical_reason(F.lit("x\ny")), b=examples.mechanical_reason(F.lit("\n".join(["y" * 900] * 9))), c=examples.mechanical_reason(F.lit("a\nb\nc")))) == ("too_short", "minified", None)
    before, after = examples.context_lines(F.lit("1\n2\n3\n4\n5\n6"), F.lit(3), F.lit(2), 1)
    assert tuple(one(spark, b=before, a=after)) == ("2", "5")
    assert tuple(one(spark, **dict(zip("vs", examples.provenance(first=F.lit(None).cast("int"), second=F.lit(3)), strict=True)))) == (3, "second")


def test_streams_equal_batches(spark, tmp_path):
    from tessera.streaming import metrics as stream

    rows = [(k, x, float(x * x + k)) for k in (1, 2) for x in range(1, 8)]
    for n, part in enumerate((rows[:5], rows[5:])):
        spark.createDataFrame(part, "key int, x int, y double").coalesce(1).write.mode("append").json(str(tmp_path / "log" / str(n)))
    log = stream.log_stream(spark, str(tmp_path / "log" / "*"), "key int, x int, y double", 1)
    seen = []
    stream.run_to_end(stream.trailing_slopes(log, "key", "x", "y", 3), str(tmp_path / "ck"), lambda df, _: seen.extend(df.collect()))
    got = {(r.key, int(r.x)): r.slope for r in seen}
    df = spark.createDataFrame(rows, "key int, x int, y double")
    want = df.select("key", "x", metrics.trailing_slope(F.col("y"), F.col("x"), ["key"], "x", 3).alias("s")).collect()
    assert len(got) == 14 and all(got[r.key, r.x] == (None if r.s is None else pytest.approx(r.s)) or (r.s is None and np.isnan(got[r.key, r.x])) for r in want)
    again = []
    stream.run_to_end(stream.trailing_slopes(stream.log_stream(spark, str(tmp_path / "log" / "*"), "key int, x int, y double", 1), "key", "x", "y", 3), str(tmp_path / "ck"), lambda df, _: again.extend(df.collect()))
    assert again == []
    cache = spark.createDataFrame([("a", 1.0)], "k string, score double")
    out = stream.scored_once(spark.createDataFrame([("a",), ("b",), ("b",)], "k string"), cache, "k", lambda d: d.withColumn("score", F.lit(2.0)))
    assert sorted(tuple(r) for r in out.collect()) == [("a", 1.0), ("b", 2.0), ("b", 2.0)]


def test_similar_texts_cluster(spark):
    base = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:-1] + ["z"])), (3, " ".join(base)), (4, "quite another text of its own making here"), (5, ""), (6, None)]
    df = spark.createDataFrame(rows, "id long, t string")
    got = {r.id: r.cluster_id for r in dedup.clusters(df.where("t is not null"), "id", F.col("t")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def _plain_agreement(rows):
    pairs = [(a, b) for i, a in enumerate(rows) for b in rows[:i] if a[0] == b[0] and a[1] != b[1] and a[2] != b[2] and None not in (a[2], b[2])]
    out = {}
    for a, b in pairs:
        n, judged, good = out.get(a[0], (0, 0, 0))
        known = None not in (a[3], b[3])
        out[a[0]] = (n + 1, judged + known, good + (known and (a[2] - b[2]) * (a[3] - b[3]) > 0))
    return {g: (n, good / judged if judged else None) for g, (n, judged, good) in out.items()}


@pytest.mark.parametrize("block_rows", [100_000, 40])
def test_agreement_by_ranks_makes_no_pairs(spark, block_rows):
    rng = np.random.default_rng(5)
    rows = [("ab"[i % 2], i // 2 if i > 20 else 3, float(rng.integers(0, 30)) if i % 17 else None, float(rng.choice([7, *range(40)])) if i % 13 else None) for i in range(400)] + [("c", 1, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, k int, gt double, m double")
    out = stats.pair_agreement(df, ["g"], "gt", "m", "k", block_rows)
    got = {r.g: (r.pairs, r.agreement) for r in out.collect()}
    want = _plain_agreement(rows)
    assert got.keys() == want.keys() and all(got[g] == (n, pytest.approx(a)) for g, (n, a) in want.items())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "LessThan" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("block_rows", [100_000, 40])
def test_concordance_against_brute_force(spark, block_rows):
    rng = np.random.default_rng(6)
    rows = [(i, float(rng.choice([5, *range(60)])) if i % 19 else None, float(rng.integers(0, 50)) if i % 11 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, gt double, m double")
    got = {r.k: r.pairwise for r in reward.concordance(df, df.where("k >= 100"), "k", "gt", "m", block_rows).collect()}
    for k, g, m in rows:
        good = [(g - h) * (m - n) > 0 for j, h, n in rows if j >= 100 and None not in (g, m, h, n) and g != h]
        assert got[k] == (pytest.approx(sum(good) / len(good)) if good else None)


def test_resamples_of_all_suppliers(spark):
    from tessera.plans import evaluation

    d = "/root/testdata/sf0.001"
    suppliers = spark.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey").distinct().count()
    assert evaluation.bootstrap_spearman_delta(spark, d).count() == suppliers > 3


def test_whole_table_agreement(spark):
    from tessera.plans import evaluation

    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/orders.parquet").select("o_orderpriority", "o_orderkey", F.col("o_totalprice").cast("double"), F.col("o_custkey").cast("double")).collect()]
    got = {r.g: (r.pairs, r.agreement) for r in evaluation.pair_agreement_whole(spark, d).collect()}
    want = _plain_agreement(rows)
    assert got.keys() == want.keys() and all(got[g] == (n, pytest.approx(a, abs=1e-6)) for g, (n, a) in want.items())


def test_whole_table_anchors(spark):
    from tessera.plans import rewards

    d = "/root/testdata/sf0.001"
    rows = [(r.k, r.g / 5000, r.c % 100) for r in spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").cast("double").alias("g"), F.col("o_custkey").alias("c")).collect()]
    got = {r.k: r.pairwise for r in rewards.calibration_reward_whole(spark, d).collect()}
    assert got.keys() == {k for k, _, _ in rows}
    for k, g, m in rows[:50]:
        good = [(g - h) * (m - n) > 0 for _, h, n in rows if g != h]
        assert got[k] == pytest.approx(sum(good) / len(good), abs=1e-6)


def test_no_window_sentinel_or_anchor_is_left_out(spark):
    n = 10_020
    log = spark.range(200).select(F.col("id").alias("s"), F.col("id").cast("double").alias("v"))
    windows = spark.range(n).select(F.col("id").cast("string").alias("name"), (F.col("id") % 250 - 20).alias("lo"), (F.col("id") % 250 - 20 + F.col("id") % 7 - 1).alias("hi"))
    got = {r.name: (r.n, r.v, r.x) for r in metrics.window_means(log, "s", windows, ["v", "x"]).collect()}
    assert len(got) == n
    for i in range(n):
        v = [s for s in range(i % 250 - 20, i % 250 - 20 + i % 7) if 0 <= s < 200]
        assert got[str(i)] == (len(v), pytest.approx(sum(v) / len(v)) if v else None, None)
    assert sinks.batched(spark.range(10), [F.col("id")], 4, spark.range(100, 100 + n)).where("position is null").count() == 3 * n
    items = spark.createDataFrame([(1, 0.5, 0.5)], "k long, gt double, m double")
    anchors = spark.range(n).select(F.col("id").alias("k"), (F.col("id") + 1.0).alias("gt"), F.when(F.col("id") < 10_000, 1.0).otherwise(0.0).alias("m"))
    assert reward.concordance(items, anchors, "k", "gt", "m").first().pairwise == pytest.approx(10_000 / n)
