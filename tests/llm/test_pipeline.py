import corpus_pipeline
import public_tokenizers
from tests.llm.test_tokens import BYTE, check_packed

from tessera.llm import packing, similar, simhash
from tessera.llm._common import size_hint, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_plain_versions(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, d))
        if name != "packing":
            assert out.columns == COLUMNS == docs.columns, name
            kept.append((name, out))
            docs = out
    frames = {n: f.toPandas() for n, f in kept}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    before = {r.doc_id for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id").collect()}
    after = set(frames["toxicity"].doc_id)
    toxic = {i for i in before if labels.get(i) == 1}
    assert len(toxic - after) >= 0.6 * len(toxic) and len((before - toxic) - after) < 0.12 * len(before)
    assert set(frames["line_dedup"].doc_id) == after and (frames["line_dedup"].n_chars == frames["line_dedup"].text.str.len()).all()
    prints = {simhash.fingerprint(t): i for i, t in zip(frames["simhash"].doc_id, frames["simhash"].text, strict=True)}
    values = sorted(prints)
    assert len(values) == len(frames["simhash"])
    assert all((a ^ b).bit_count() > 4 for i, a in enumerate(values) for b in values[:i])
    assert set(frames["simhash"].doc_id) <= set(frames["line_dedup"].doc_id)
    assert set(frames["mixing"].doc_id) == set(frames["simhash"].doc_id)
    final = out.collect()
    unique = frames["mixing"].drop_duplicates("doc_id")
    if len(unique) == len(frames["mixing"]):
        check_packed(final, dict(zip(unique.doc_id, unique.text, strict=True)), packing.encoder(*BYTE))
    ids = {r.doc_id: r.doc_tokens for r in final}
    times = frames["mixing"].groupby("doc_id").size()
    assert sum(r.length for r in final) == sum(ids[i] * n for i, n in times.items())
    assert public_tokenizers.path("byte_bpe_50k.json")


def test_empty_corpus(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, d))
    assert docs.count() == 0


def plain_runs(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_no_similar_pair_is_kept(spark):
    import random

    rnd = random.Random(3)
    rows = []
    for g in range(12):
        base = [f"w{rnd.randrange(4000)}" for _ in range(150)]
        rows.append(" ".join(base))
        for edits in (1, 2, 3, 4, 8, 20):
            copy = list(base)
            for at in rnd.sample(range(150), edits):
                copy[at] = f"n{rnd.randrange(10**6)}"
            rows.append(" ".join(copy))
    shuffled = list(enumerate(rows))
    rnd.shuffle(shuffled)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in shuffled] + [(900, None, "en", "s", None), (901, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    runs = {i: plain_runs(t) for i, t in shuffled}
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    far = {(i, j) for i in runs for j in runs if i < j and alike(runs[i], runs[j]) and (simhash.fingerprint(dict(shuffled)[i]) ^ simhash.fingerprint(dict(shuffled)[j])).bit_count() > 4}
    assert far  # the rule of four bits alone would keep both of these
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    kept = {r.doc_id for r in out.collect()}
    assert out.columns == docs.columns and 900 in kept
    texts = dict(shuffled)
    linked = lambda i, j: alike(runs[i], runs[j]) or (simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[j])).bit_count() <= 4
    left, want = sorted(runs), {900}
    while left:
        todo = [left.pop(0)]
        want.add(todo[0])
        while todo:
            i = todo.pop()
            near = [j for j in left if linked(i, j)]
            left = [j for j in left if j not in near]
            todo += near
    assert kept == want
    for stars in (0, 1):
        assert {r.doc_id for r in similar.one_of_each(docs, stars=stars, sample=2).collect()} == want


def test_pairs_do_not_grow_with_the_square_of_a_group(spark, monkeypatch):
    import random

    rnd, asked, plain = random.Random(5), [], similar._verified
    monkeypatch.setattr(similar, "_verified", lambda pairs, *more: asked.append(pairs.count()) or plain(pairs, *more))
    base, rows = [f"w{rnd.randrange(4000)}" for _ in range(150)], []
    for _ in range(600):
        copy = list(base)
        for at in rnd.sample(range(150), rnd.randrange(10)):
            copy[at] = f"n{rnd.randrange(10**6)}"
        rows.append(" ".join(copy))
    kept = {r.doc_id for r in similar.one_of_each(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), sample=2).collect()}
    runs, prints = [plain_runs(t) for t in rows], [simhash.fingerprint(t) for t in rows]
    linked = lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4 or len(runs[i] & runs[j]) >= 0.8 * len(runs[i] | runs[j])
    left, want = list(range(600)), set()
    while left:
        todo = [left.pop(0)]
        want.add(todo[0])
        while todo:
            i = todo.pop()
            near = {j for j in left if linked(i, j)}
            left = [j for j in left if j not in near]
            todo += near
    assert kept == want and len(want) > 50
    assert sum(asked) < 6 * len(rows), asked


def test_rounds_do_not_multiply_expected_sizes_and_are_few_for_few_pairs(spark, monkeypatch):
    plain, digits = similar._verified, []
    monkeypatch.setattr(similar, "_verified", lambda pairs, *more: digits.append(len(str(size_hint(pairs)))) or plain(pairs, *more))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    kept = {r.doc_id for r in similar.one_of_each(docs).select("doc_id").collect()}
    assert len(digits) <= 3  # two rounds with centres, then all others
    digits.clear()
    assert {r.doc_id for r in similar.one_of_each(docs, stars=5).select("doc_id").collect()} == kept
    assert len(digits) == 6 and max(digits) < 30, digits


def test_boilerplate_of_small_and_large_hosts(spark):
    line = "a line of every site"
    rows = [(i, f"own {i}\n" + (line if i < 3 else f"more {i}"), "small") for i in range(10)] + [(100 + i, f"own {i}\n" + (line if i < 8 else f"more {i}"), "large") for i in range(100)]
    rows += [(300, "x\ntwice", "pair"), (301, "y\ntwice", "pair"), (302, "z", "pair")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_boilerplate(spark, docs, "").collect()}
    assert got == {i: t if s == "pair" else t.replace(f"\n{line}", "") for i, t, s in rows}
