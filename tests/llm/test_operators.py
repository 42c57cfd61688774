import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import block_join, kdtree, language_model, line_dedup, mixing, similar, simhash, surrogates, toxicity
from tessera.operators.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """rows: (doc_id, text, source)."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)


# --- 5: SimHash -----------------------------------------------------------


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    runs = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, radius=4):
    left, out = set(prints), []
    while left:
        todo, group = [left.pop()], set()
        while todo:
            x = todo.pop()
            group.add(x)
            near = {y for y in left if (x ^ y).bit_count() <= radius}
            left -= near
            todo += near
        out.append(group)
    return out


@pytest.mark.parametrize("text", ["", " \t", "One", "a B c d e", "Ä b\x0bc\x1cd é", "x " * 200, None])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_masks_cover_every_pair_within_radius():
    rnd = random.Random(0)
    for level in range(4):
        masks = [m & (1 << 64) - 1 for m in simhash.masks(level)]
        assert len(masks) == 31 and all(24 <= m.bit_count() <= 40 for m in masks)
        for _ in range(3000):
            diff = sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 4)))
            assert any(not m & diff for m in masks)


@pytest.mark.parametrize("most", [50_000, 12])
def test_links_connect_what_is_near(spark, most):
    rnd = random.Random(most)
    values = {rnd.getrandbits(64) for _ in range(60)}
    for b in list(values)[:20]:
        x = b
        for _ in range(25):
            for j in rnd.sample(range(64), rnd.randint(1, 5)):
                x ^= 1 << j
            values.add(x)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(v),) for v in sorted(values)], "fp long")
    groups = {}
    for r in components(simhash.links(df, 3, most=most)).collect():
        groups.setdefault(r.root, set()).add(r.node & (1 << 64) - 1)
    want = sorted(sorted(g) for g in plain_components(values) if len(g) > 1)
    assert sorted(sorted(g) for g in groups.values()) == want


def test_op5_against_brute_force(spark):
    from tessera.llm.queries import op5_simhash

    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    prints = {k: plain_fingerprint(t) for k, t in texts.items()}
    name = {p: min(k for k, q in prints.items() if q in g) for g in plain_components(set(prints.values())) for p in g}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op5_simhash(spark, d).collect()}
    assert got == {k: (f"{p:016x}", name[p]) for k, p in prints.items()}


def test_simhash_nulls_copies_and_one_of_each(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(3, text, "a"), (1, text, "b"), (1, text, "b"), (7, None, "a"), (5, "", None), (None, text, "a"), (9, "quite another text with its own words inside", "a")]
    docs = documents(spark, rows)
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(-1, 1), (1, 1), (1, 1), (3, 1), (5, 5), (7, 5), (9, 9)]
    named = docs.withColumns({c: F.lit(7) for c in ("fp", "text_hash", "rid", "row", "node")})
    kept = similar.one_of_each(named)
    assert kept.columns == named.columns and sorted(r.doc_id for r in kept.collect()) == [1, 5, 9]
    assert all(r.text_hash == r.rid == r.row == 7 for r in kept.collect())
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


# --- 7: toxicity ----------------------------------------------------------


def test_op7_on_held_out_rows(spark):
    from tessera.llm.queries import op7_toxicity

    d = "/root/testdata/sf0.1"
    rows = op7_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    wrong = sum(r.predicted != r.toxic for r in rows)
    toxic = [r for r in rows if r.toxic]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert wrong / len(rows) < 0.03 and sum(r.predicted for r in toxic) / len(toxic) > 0.85


def test_pairs_weigh_more_than_their_terms():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (600, 2))
    rows = [np.flatnonzero(np.append(r, 1)) for r in x]
    bias, w, v = toxicity.learn(rows, x[:, 0] ^ x[:, 1], 3, soft=1e-9, epochs=150, batch=64)
    m = toxicity.Machine(bias, w, v)
    assert [m.score(a) >= 0.5 for a in ([2], [0, 2], [1, 2], [0, 1, 2])] == [False, True, True, False]


def test_toxicity_edge_cases(spark):
    docs = documents(spark, [(1, "fine words", "a"), (2, None, "a"), (None, "", "b")])
    labels = spark.createDataFrame([(1, 0), (1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    assert [r.score for r in toxicity.classify(docs, labels).collect()] == pytest.approx([0.0] * 3, abs=1e-9)
    assert toxicity.classify(docs.limit(0), labels).collect() == []
    assert toxicity.without_toxic(docs, labels.limit(0)).columns == docs.columns


# --- 4: surrogates --------------------------------------------------------

KEY = b"k" * 16


def test_surrogates_keep_form_and_coreference():
    text = 'Mr. John Smith met Smith. Foo.Bar@m.example.com foo.bar@m.example.com 4111 1111 1111 1111, 10.1.2.3, +1 (429) 555-5467 token = "0641917ea4e9feb9" Frau Anna Weiß господин Иван Петров'
    new, n = surrogates.replaced(text, KEY, {})
    assert n == 13 and len(new.split()) == len(text.split())
    for gone in ("Smith", "John", "foo.bar", "4111 1111", "555-5467", "0641917ea4e9feb9", "Anna", "Петров"):
        assert gone not in new
    assert re.search(r"Mr\. (\w+) (\w+) met \2\.", new) and re.search(r'token = "[0-9a-f]{16}"', new)
    mails = re.findall(r"\S+@\S+", new)
    assert mails[0].lower() == mails[1] and mails[0] != mails[1]
    first = re.search(r"Mr\. (\w+)", new)[1]
    assert first in surrogates.FIRST_NAMES["m", "latin"] and re.search(r"Frau (\w+)", new)[1] in surrogates.FIRST_NAMES["f", "latin"]
    card = re.search(r"\d{4}(?: \d{4}){3}", new)[0].replace(" ", "")
    assert surrogates._luhn(card[:-1]) == int(card[-1]) and card[0] == "4"


def test_surrogates_are_distinct():
    made = {surrogates.surrogate(KEY, "ssn", f"{a:03d}-{b:02d}-1234") for a in range(1, 60) for b in range(1, 60)}
    assert len(made) == 59 * 59
    assert len({surrogates.surrogate(KEY, "surname", f"B{c}k") for c in "aeiou"}) == 5
    assert len({surrogates.surrogate(KEY, "first", n) for n in surrogates.FIRST_NAMES["f", "latin"]}) == len(surrogates.FIRST_NAMES["f", "latin"])


def test_collisions_with_real_entities_are_drawn_again(spark):
    norm = "ab.12@x.example.com"
    clash = surrogates.surrogate(KEY, "email", norm)
    known = spark.createDataFrame([("email", norm), ("email", clash), ("ip", "9.9.9.9")], "kind string, norm string")
    odd = {r.norm: r.tweak for r in surrogates.exceptions(known, KEY).collect()}
    assert odd.get(norm, 0) >= 1 and surrogates.surrogate(KEY, "email", norm, odd[norm]) not in (norm, clash)


def test_op4_leaves_no_entity(spark):
    from tessera.llm.queries import PSEUDONYM_KEY, op4_surrogates

    d = "/root/testdata/sf0.001"
    old = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    new = {r.doc_id: r for r in op4_surrogates(spark, d).collect()}
    real = {surrogates.normal(k, t[a:b]) for t in old.values() for a, b, k in surrogates.entities(t)}
    assert real and not any(x in r.text for x in real for r in new.values())
    assert all((old[k] != r.text) == (r.entities > 0) for k, r in new.items())
    docs = spark.read.parquet(f"{d}/documents.parquet")
    joined = {r.doc_id: r.text for r in surrogates.pseudonymised(docs, PSEUDONYM_KEY, broadcast_entities=-1).collect()}
    assert joined == {k: r.text for k, r in new.items()}


def test_surrogates_nulls_and_empty(spark):
    docs = documents(spark, [(1, None, "a"), (None, "", "a"), (2, "a@b.example.com", None), (2, "a@b.example.com", None)])
    rows = surrogates.pseudonymised(docs, KEY).collect()
    assert sorted((r.doc_id or 0, r.text is None, r.entities) for r in rows) == [(0, False, 0), (1, True, 0), (2, False, 1), (2, False, 1)]
    assert len({r.text for r in rows if r.doc_id == 2}) == 1
    assert surrogates.pseudonymised(docs.limit(0), KEY).collect() == []


# --- 1, 2, 3: mixing, language model, lines -------------------------------


def test_mixing_meets_its_limits(spark):
    docs = documents(spark, [(i, "w " * (10 + i % 7), s) for i, s in enumerate(["big"] * 300 + ["mid"] * 60 + ["small"] * 20 + [None] * 10)] + [(999, "", "empty"), (1000, None, "empty")])
    target = mixing.Target(entropy=0.95, repeats=3.0, budget=None, block_tokens=200)
    rows = mixing.mix(docs, target).collect()
    seen = {}
    for r in rows:
        seen.setdefault(r.doc_id, []).append(r.epoch)
    assert set(seen) == {r.doc_id for r in docs.collect()} and max(map(len, seen.values())) <= 4
    assert all(len(set(e)) == len(e) for e in seen.values())
    assert sum(map(len, seen.values())) > len(seen)
    fixed = mixing.mix(docs, mixing.Target(entropy=0.5, repeats=3.0, budget=0.5, block_tokens=200)).collect()
    total = sum(len((r.text or "").split()) for r in docs.collect())
    assert 0.4 * total < sum(r.tokens for r in fixed) <= 0.5 * total
    assert mixing.mix(docs.limit(0), target).collect() == []
    assert mixing.mixed(docs, target).columns == docs.columns


def test_exponent_bisects_entropy(spark):
    sources = spark.createDataFrame([("a", 900), ("b", 90), ("c", 10)], "key string, of_source long")
    x = mixing.exponent(sources, mixing.Target(entropy=0.8, repeats=1e9))
    p = np.array([0.9, 0.09, 0.01]) ** x
    p /= p.sum()
    assert -(p * np.log(p)).sum() / math.log(3) == pytest.approx(0.8, abs=1e-6)
    y = mixing.exponent(sources, mixing.Target(entropy=1.0, repeats=2.0))
    w = 0.01**y / (np.array([0.9, 0.09, 0.01]) ** y).sum()
    assert w / 0.01 == pytest.approx(2.0, abs=1e-6)


def test_backoff_of_a_small_corpus(spark):
    docs = documents(spark, [(1, "a b a b", "s"), (2, "a b c", "s"), (3, None, "s"), (4, "", "s")])
    got = {r.doc_id: r for r in language_model.stupid_backoff(docs, leave_one_out=False).collect()}
    want = math.log10(3 / 7) + math.log10(3 / 3) + math.log10(1 / 3)
    assert got[2].log10_score == pytest.approx(want) and got[3].words == 0 and got[4].mean_log10 is None
    assert language_model.stupid_backoff(docs.limit(0)).collect() == []


def test_lines_of_a_host(spark):
    rows = [(i, f"own {i}\n  Menu \nmore {i}", "h") for i in range(30)] + [(100, "Menu", "h"), (101, None, "h"), (102, "Menu\nx", None), (103, "Menu\ny", "small"), (104, "", "h")]
    docs = documents(spark, rows)
    got = {r.doc_id: r for r in line_dedup.marked(docs, "source").collect()}
    assert got[3].kept_text == "own 3\nmore 3" and got[3].dropped_lines == 1 and got[3].line_count == 3
    assert got[100].kept_text == "Menu" and got[101].kept_text is None and got[102].kept_text == "Menu\nx" and got[103].kept_text == "Menu\ny" and got[104].kept_text == ""
    far = {r.doc_id: r.kept_text for r in line_dedup.marked(docs, "source", broadcast_lines=-1).collect()}
    assert far == {k: r.kept_text for k, r in got.items()}
    assert line_dedup.without_boilerplate(docs, "source", length="n_chars").columns == docs.columns
    assert line_dedup.marked(docs.limit(0), "source").collect() == []
    again = line_dedup.marked(docs.withColumn("kept_text", F.lit(1)), "source").collect()
    assert {r.doc_id: r.kept_text for r in again} == far


# --- 6, 8: vectors --------------------------------------------------------


def vectors(spark, seed, n=400, dim=6, odd=True):
    rnd = random.Random(seed)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(dim)]) for i in range(n)] + [(n + 100, [0.5] * dim), (n + 101, [0.5] * dim), (n + 101, [0.5] * dim)]
    if odd:
        rows += [(900, None), (1000, [None] + [1.0] * (dim - 1)), (1100, [float("nan")] * dim), (1200, [float("inf")] + [1.0] * (dim - 1)), (None, [1.0] * dim), (1300, []), (1400, [0.0] * dim), (1500, [1.0, 2.0])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>"), rows


def plain(rows, score, sign, skip_zero, k=10):
    f32 = lambda v: [float(np.float32(x)) for x in v]
    good = [(i, f32(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and not (skip_zero and not any(v))]
    out = []
    for q, qv in {i: v for i, v in good if i % 100 == 0}.items():
        found = sorted((sign * score(qv, v), i) for i, v in good if i != q and len(v) == len(qv))[:k]
        out += [(q, r + 1, i, s * sign) for r, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("shard_bytes", [1 << 22, 1 << 12])
def test_kdtree_against_brute_force(spark, shard_bytes):
    df, rows = vectors(spark, 1)
    whole = lambda v: [math.floor(x * 1024) for x in v]
    want = plain(rows, lambda a, b: sum(x * y for x, y in zip(whole(a), whole(b), strict=True)), -1, False)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in kdtree.top_k(df.coalesce(2), shard_bytes=shard_bytes).collect()) == want


def test_tree_prunes_and_stays_exact():
    rng = np.random.default_rng(0)
    x = np.floor(rng.normal(0, 1, (5000, 3)) * 1024)
    tree = kdtree.Tree(x, np.arange(5000), leaf=32)
    q = np.floor(rng.normal(0, 1, (20, 3)) * 1024)
    bounds = tree.bounds(q)
    for i in range(20):
        ids, scores = tree.search(q[i], bounds[i], -1, 10, -np.inf)
        want = sorted(zip(-(x @ q[i]), range(5000), strict=True))[:10]
        assert [(-s, j) for j, s in zip(ids.tolist(), scores.tolist(), strict=True)] == want
    assert all((tree.sorted_x[a:b] >= lo).all() and (tree.sorted_x[a:b] <= hi).all() for (a, b), lo, hi in zip(tree.span, tree.low, tree.high, strict=True))


@pytest.mark.parametrize("shard_bytes", [1 << 22, 1 << 12])
def test_block_join_against_brute_force(spark, shard_bytes):
    df, rows = vectors(spark, 2)
    want = plain(rows, lambda a, b: math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b, strict=True))), 1, True)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in block_join.nearest(df, shard_bytes=shard_bytes, tile=(2, 50)).collect())
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=1e-12)


def test_intervals_hold():
    rng = np.random.default_rng(3)
    a, b = rng.normal(0, 3, (40, 16)), rng.normal(0, 1, (70, 16)) * rng.exponential(1, (70, 1))
    low, high = block_join.Quantised(a).intervals(block_join.Quantised(b), slice(0, 40), slice(0, 70))
    d = ((a[:, None] - b[None]) ** 2).sum(2)
    assert (low <= d).all() and (d <= high).all()


def test_no_vectors(spark):
    df, _ = vectors(spark, 4)
    assert kdtree.top_k(df.limit(0)).collect() == [] and block_join.nearest(df.limit(0)).collect() == []
    few = spark.createDataFrame([(0, [1.0, 2.0]), (5, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id) for r in kdtree.top_k(few).collect()] == [(0, 1, 5)]
    assert [(r.query_id, r.rank, r.vec_id) for r in block_join.nearest(few).collect()] == [(0, 1, 5)]


def test_short_surnames_never_become_real_ones(spark):
    names = ["Lee", "Kim", "Cruz", "Diaz", *(f"{c}{v}" for c in "BCDFGHJKLMNPQRSTVWXYZ" for v in "aeiou")]  # all of the shape of Li
    known = spark.createDataFrame([("surname", n) for n in names] + [("ip", "9.9.9.9"), ("surname", "Øß")], "kind string, norm string")
    odd = {(r.kind, r.norm): r.tweak for r in surrogates.exceptions(known, KEY).collect()}
    made = [surrogates.surrogate(KEY, r.kind, r.norm, odd.get((r.kind, r.norm), 0)) for r in known.collect()]
    assert len(set(made)) == len(made) and not set(made) & {*names, "Øß", "9.9.9.9"}


def test_surrogates_that_run_out_are_an_error(spark):
    with pytest.raises(RuntimeError, match="collide"):
        surrogates.exceptions(spark.createDataFrame([("key", "----")], "kind string, norm string"), KEY, rounds=2)


def test_no_short_name_keeps_itself(spark):
    names = sorted({f"{a}{b}{c}" for a in "EHAIO" for b in "jqulr" for c in "nuea"})
    docs = documents(spark, [(i, f"Mr. {n} called.", "a") for i, n in enumerate(names)])
    rows = {r.doc_id: r for r in surrogates.pseudonymised(docs, b"a key for tests and benchmarks").collect()}
    made = [rows[i].text.split()[1] for i in range(len(names))]
    assert all(rows[i].entities == 1 for i in rows) and len(set(made)) == len(made) and not set(made) & set(names)


def test_letters_beyond_ascii_and_russian_forms():
    for name in ("Weiß", "Żak", "Ñuñez", "Øster", "Παππάς", "Çelik"):
        new, n = surrogates.replaced(f"Dr {name} came", KEY, {})
        assert n == 1 and name not in new and new.split()[1][0].isupper() and len(new.split()[1]) == len(name)
    new, n = surrogates.replaced("Анна Петрова и Иван Петров и Мария Чайковская", KEY, {})
    woman, man, other = (new.split()[k] for k in (1, 4, 7))
    assert n == 6 and woman == man + "а" and woman.endswith("ова") and other.endswith("ская") and "Петров" not in new


def test_addresses_of_any_length_in_linear_time():
    import time

    long = "x" * 1000 + "@a.example.com"
    (found,) = surrogates.entities(long)
    assert found == (0, len(long), "email")
    text = " ".join(f"user{i}@host.example.com" for i in range(8000))
    began = time.perf_counter()
    assert len(surrogates.entities(text)) == 8000 and time.perf_counter() - began < 2


def test_scores_beyond_64_bits(spark):
    rows = [(0, [1e9, 1e9]), (1, [1e9, 1e9 - 1024]), (2, [1e9, 1e9]), (3, [-1e9, -1e9]), (4, [1.0, 1.0]), (5, [3e38, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    top = 1 << 63
    got = [(r.rank, r.vec_id, r.score) for r in kdtree.top_k(df).orderBy("rank").collect()]
    assert got == [(1, 5, top - 1), (2, 2, top - 1), (3, 1, top - 1), (4, 4, 2 * 10**9 * 1024 * 1024), (5, 3, -top)]


def test_many_dimensions(spark):
    rnd = np.random.default_rng(0)
    rows = [(i, [float(x) for x in np.sign(rnd.normal(0, 1, 4096)) + rnd.normal(0, 1e-4, 4096)]) for i in range(0, 60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = np.array([v for _, v in rows])
    want = sorted((math.sqrt(((x[0] - x[i]) ** 2).sum()), i) for i in range(1, 60))[:10]
    got = [(r.score, r.vec_id) for r in block_join.nearest(df).orderBy("rank").collect()]
    assert [g[1] for g in got] == [w[1] for w in want] and [g[0] for g in got] == pytest.approx([w[0] for w in want])


def test_one_row_for_each_labelled_doc_is_learned_from(spark):
    docs = documents(spark, [(1, f"word{i} bad", "a") for i in range(40)] + [(2, "word good", "a")] * 40)
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    allowed = [r.doc_id for r in labels.where("crc32(cast(doc_id as string)) % 4 <> 2").collect()]
    assert toxicity.fit(docs, labels, sample=2).w.size == (1 << 18 if len(allowed) == 2 else 1)


def test_unsigned_hashes_and_blocks_agree(spark):
    rnd = random.Random(4)
    docs = documents(spark, [(i, " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 40))), "s") for i in range(60)])
    one = {r.doc_id: r.log10_score for r in language_model.stupid_backoff(docs).collect()}
    many = {r.doc_id: r.log10_score for r in language_model.stupid_backoff(docs.repartition(5), block_bytes=200).collect()}
    assert one == pytest.approx(many, abs=1e-9)
