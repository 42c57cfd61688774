"""W02, J08, J18 and D02 against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import dedup


def accepted(rows):
    seen_a, seen_b, out = set(), set(), []
    for s, a, b in sorted(rows):
        if (a is None or a not in seen_a) and (b is None or b not in seen_b):
            seen_a.add(a)
            seen_b.add(b)
            out.append(s)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_dual_key(spark, seed):
    draw = random.Random(seed)
    rows = [(s, draw.choice([None, *(f"k{i}" for i in range(60))]), draw.choice([None, *(f"k{i}" for i in range(80))])) for s in draw.sample(range(1000), 300)]
    rows += [(5000 + s, "hot", f"b{s % 40}") for s in range(200)]
    df = spark.createDataFrame(rows, "s long, a string, b string").repartition(5)
    assert sorted(r.s for r in dedup.dual_key(df, "a", "b", "s").collect()) == accepted(rows)
    assert dedup.dual_key(df.limit(0), "a", "b", "s").collect() == []


def test_dual_key_over_a_long_chain(spark):
    """Each row shares a key with the one before and one with the one after, so every second one is accepted."""
    n = 100_000
    df = spark.range(n).select(F.col("id").alias("s"), F.floor(F.col("id") / 2).alias("a"), F.floor((F.col("id") + 1) / 2).alias("b"))
    out = dedup.dual_key(df, "a", "b", "s")
    assert out.count() == n // 2 and out.where("s % 2 = 1").isEmpty()


def runs(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))) if w else frozenset()


def similar_texts(seed=1):
    """Texts of common paragraphs, near copies in chains, copies, short and empty ones."""
    draw = random.Random(seed)
    paragraphs = [" ".join(f"w{draw.randint(0, 300)}" for _ in range(40)) for _ in range(12)]
    texts = [" ".join(draw.sample(paragraphs, draw.randint(1, 4))) for _ in range(60)]
    for _ in range(80):
        words = draw.choice(texts).split()
        for _ in range(draw.randint(0, 4)):
            words[draw.randrange(len(words))] = f"n{draw.randint(0, 9)}"
        texts.append(" ".join(words))
    return [*texts, *texts[:5], "", None, "one two", "ONE  two", "one two three four five", "one two three four five six"]


@pytest.mark.parametrize("crowd", [2, 50])
def test_similar_sets(spark, crowd):
    texts = similar_texts()
    sets = {}
    for k, t in enumerate(texts):
        if runs(t):
            sets.setdefault(runs(t), k)
    want = {}
    reps = sorted((k, s) for s, k in sets.items())
    for i, (a, x) in enumerate(reps):
        for b, y in reps[i + 1 :]:
            if len(x & y) / len(x | y) >= 0.8:
                want[a, b] = len(x & y) / len(x | y)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found, _ = dedup._representatives(dedup._sets(df, "id", F.col("text"), 5))
    got = {(r.a, r.b): r.jaccard for r in dedup._similar(found, 0.8, crowd=crowd).collect()}
    assert got.keys() == want.keys() and len(want) > 20 and all(abs(got[p] - want[p]) < 1e-9 for p in want)

    def roots(links):
        of = {k: k for k, _ in reps}

        def root(k):
            while of[k] != k:
                k = of[k]
            return k

        for a, b in links:
            a, b = sorted((root(a), root(b)))
            of[b] = a
        return {k: root(k) for k in of}

    links = [(r.a, r.b) for r in dedup._similar(found, 0.8, links_only=True, crowd=crowd).collect()]
    assert set(links) <= want.keys() and roots(links) == roots(want)
    named = {r.id: r.cluster_id for r in dedup.clusters(df, "id", F.col("text")).collect()}
    by_rep = roots(want)
    assert named == {k: by_rep[sets[runs(t)]] if runs(t) else k for k, t in enumerate(texts)}


def test_a_common_run_makes_no_pairs(spark):
    """3,000 texts share one run and nothing else; a crowd of copies with one word changed is linked by its centre."""
    rows = [(k, f"the same five words here a{k} b{k} c{k}") for k in range(3000)]
    long = " ".join(f"w{j}" for j in range(100))
    rows += [(10_000 + k, f"{long} end{k}") for k in range(400)]
    df = spark.createDataFrame(rows, "id long, text string")
    reps, _ = dedup._representatives(dedup._sets(df, "id", F.col("text"), 5))
    links = dedup._similar(reps, 0.8, links_only=True)
    assert links.count() < 1000
    assert dedup.clusters(df, "id", F.col("text")).where("kept").count() == 3001


@pytest.mark.parametrize("most_chars", [10, 1 << 24])
def test_contained_equals_contains(spark, most_chars):
    """Hits inside words, passages within passages, one passage under two ids, nulls, and lists that take turns."""
    draw = random.Random(2)
    texts = ["".join(draw.choice("ab é") for _ in range(30)) for _ in range(80)] + ["", None, "xpassagey"]
    passages = [("p1", "ab"), ("p2", "ab"), ("p3", "b a"), ("p4", "éa"), ("p5", ""), ("p6", None), ("p7", "passage"), ("p8", "abab"), ("p9", "nowhere")]
    df = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "id long, text string")
    p = spark.createDataFrame(passages, "pid string, p string")
    got = sorted(tuple(r) for r in dedup.contained(df, "id", F.col("text"), p, "pid", F.col("p"), most_chars).collect())
    assert got == sorted((i, k) for i, t in enumerate(texts) for k, x in passages if t and x and x in t)
    assert dedup.contained(df, "id", F.col("text"), p.limit(0), "pid", F.col("p")).collect() == []


@pytest.mark.parametrize("most_chars", [10, 1 << 22])
def test_names_within(spark, most_chars):
    names = spark.createDataFrame([("get_user_profile",), ("get_user_profile",), ("add_action",), ("short",), (None,), ("save_post_meta_x",), ("register_script",)], "n string")
    texts = spark.createDataFrame([("calls get_user_profiles( $x )",), ("an add_action and register_script here",), (None,), ("",)], "t string")
    got = {r.name: r.genuine for r in dedup.names_within(names, "n", texts, F.col("t"), most_chars=most_chars, noise=("register_script",)).collect()}
    assert got == {"get_user_profile": True, "add_action": False, "register_script": False}
