"""Operators 11 to 13 against brute force, the library and round trips."""

import hashlib
import random
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F

from tessera.llm import conversation_repair, fill_middle, token_files
from tessera.llm.elias_fano import EliasFano, encoded

WORDS = public_tokenizers.path("word_bpe_49k.json")
CLASHING = ("c", "d", "k", "t", "n", "fim", "head", "digest", "copies", "chunk", "at", "edit", "step", "_h", "_place", "ids", "start", "form", "label", "hit")
LEGAL = ("su", "ua", "au")
WHITE = " \t\n\v\f\r"


def plain_report(rows):
    """rows of one conversation by turn, role and text: strings carried, insertions anywhere, states as the text of initials."""
    seen, kinds = set(), []
    for _, role, text in rows:
        body = text.rstrip(WHITE)
        kinds.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {"": (0, "", ())}

    def better(table, key, value):
        if key not in table or value[:2] < table[key][:2]:
            table[key] = value

    def inserted(table):
        for _ in range(2):
            for at, (cost, audit, out) in list(table.items()):
                role = "assistant" if at == "u" else "user"
                better(table, role[0], (cost + 3, audit + "I", (*out, f"{role}:")))
        return table

    for (_, role, text), kind in zip(rows, kinds, strict=True):
        after = {}
        for at, (cost, audit, out) in inserted(dict(best)).items():
            better(after, at, (cost + 4, audit + "D", out))
            if kind in ("blank", "duplicate"):
                continue
            more = 3 if kind == "truncated" else 0
            if role[:1] and (role[:1] in ("s", "u") if not at else at + role[:1] in LEGAL):
                better(after, role[0], (cost + more, audit + "K", (*out, f"{role}:{text}")))
            new = "assistant" if at == "u" else "user"
            better(after, new[0], (cost + 3 + more, audit + "R", (*out, f"{new}:{text}")))
        best = after
    best = inserted(best)
    cost, audit, out = min(v for at, v in best.items() if at in ("", "a"))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in LEGAL for a, b in zip(rows, rows[1:], strict=False))
    return (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def repaired(spark, rows, kind="conv_id long, turn long, role string, text string"):
    df = spark.createDataFrame(rows, kind).withColumns({c: F.lit("mine") for c in CLASHING})
    got = {r[0]: tuple(r)[1:] for r in conversation_repair.report(df, df).collect()}
    groups = {}
    for c, t, role, text in rows:
        groups.setdefault(c, []).append((t, " " if role is None else role, " " if text is None else text))
    order = lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, r[1], r[2])
    want = {c: plain_report(sorted(g, key=order)) for c, g in groups.items()}
    assert got == want


def test_repair_of_random_conversations(spark):
    draw = random.Random(4)
    roles, texts = ["user", "assistant", "system", "tool", "ufo", "", None, "user", "assistant"], ["One.", "Two", " ", "", "Three! \n", None, "Four?", "Five", "Six.", "é.", "."]
    rows = [(c, draw.choice([None, *range(8)]), draw.choice(roles), draw.choice(texts)) for c in range(300) for _ in range(draw.randint(1, 9))]
    rows += [(None, k, draw.choice(roles), draw.choice(texts)) for k in range(12)]
    repaired(spark, rows)


@pytest.fixture
def uncoalesced(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repair_over_many_chunks(spark, uncoalesced):
    """One conversation of most rows is in several range partitions; copies, ties and a very long text."""
    draw = random.Random(5)
    rows = [(7, k, draw.choice(["user", "assistant", "system", "bot"]), draw.choice(["Yes.", "No", f"Turn {k}.", f"Turn {k}"])) for k in range(3000)]
    rows += [(7, 5, "user", "same.")] * 40 + [(8, 0, "user", "long " * 400_000 + "."), (8, 1, "assistant", "long " * 400_000 + ".")] + [(9, None, "user", " ")] * 3
    repaired(spark, rows)
    edits, _ = conversation_repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    placed = conversation_repair._placed(conversation_repair._clean(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    assert placed.where("conv_id = 7").select("chunk").distinct().count() > 1
    left = [r for r in edits.where("conv_id = 7 AND role IS NOT NULL").orderBy("step").collect()]
    assert regex.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in left))


def test_repair_of_text_ids_and_nothing(spark):
    rows = [("a", 1, "user", "Hi."), ("a", 2, "assistant", "Ho."), ("b", 1, "assistant", "Hi.")]
    repaired(spark, rows, "conv_id string, turn long, role string, text string")
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_repair.report(none, none).collect() == []
    one = spark.createDataFrame([(3, 1, "user", "Hi.")], none.schema)
    row = conversation_repair.report(one, none).first()
    assert (row.conv_id, row.cost, row.audit, row.repaired_sha256) == (3, 0, "", hashlib.sha256().hexdigest())


TEXTS = [(1, "plain words here"), (1, "plain words here"), (2, ""), (3, None), (None, "a text without id"), (4, "with <S> inside"), (5, "né😀\n\tend\r\n" * 5), (6, "x" * 3_000_000), *((k, f"text {k} " * (k % 7 + 1)) for k in range(10, 200))]


def plain_fill(doc_id, text):
    text, digest = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_fill_middle(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumns({c: F.lit("mine") for c in CLASHING})
    rows = fill_middle.transform(docs).collect()
    want = sorted(((i, *plain_fill(i, t)) for i, t in TEXTS), key=repr)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in rows), key=repr) == want
    texts = {i: t or "" for i, t in TEXTS}
    assert all(fill_middle.restored(r.output, r.form) == texts[r.doc_id] and r.restored_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() and r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest() for r in rows)
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    assert fill_middle.transform(docs.limit(0)).collect() == []
    lines = fill_middle.transform(docs.where("doc_id >= 10"), unit=r"\S+\s*").collect()
    assert all(r.n == 2 * (r.doc_id % 7 + 1) and fill_middle.restored(r.output, r.form) == texts[r.doc_id] for r in lines)


def test_fill_middle_text_ids():
    ends = array("I", range(1, 6))
    assert fill_middle.arranged("abcde", ends, [4, 1, 0, 99]) == ("psm", 1, 3, "<P>a<S>e<M>bcd")
    assert fill_middle.arranged("abcde", ends, [4, 4, 0, 0]) == ("spm", 4, 0, "<S>e<P>abcd<M>")
    assert fill_middle.restored("<S>e<P>abcd<M>", "spm") == "abcde"


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 257, 1000, 70_000])
@pytest.mark.parametrize("top", [0, 1, 1000, 10**6, 10**12])
def test_elias_fano(n, top):
    r = np.random.default_rng(n + 1)
    values = np.sort(r.integers(0, top + 1, n))
    code = EliasFano(encoded(values))
    assert len(code) == n and (code.slice(0, n) == values).all() and (code.slice(n // 3, n // 2) == values[n // 3 : n // 2]).all()
    assert all(code.select(int(i)) == values[i] for i in (r.integers(0, n, 30) if n else ()))
    with pytest.raises(IndexError):
        code.select(n)


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 1000, 100_000))
    assert len(encoded(ends)) * 8 < 100_000 * (np.log2(500) + 2.3)


def plain_files(rows, tokenizer):
    """(doc_id, start, n_tokens, crc) with ids of the library."""
    out, at = [], 0
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = [(i, t) for i, t in TEXTS if i not in (1, 6)] + [(900, "Odd\x1fone, don't <|endoftext|> İstanbul ﬁ 12 a_b ...   x"), (-5, "Ünï cödé, Words; words! WORDS?"), (901, "word " * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("mine") for c in CLASHING})
    token_files.write(docs, str(tmp_path / "f"), WORDS, 1, shard_bytes=1 << 20)
    back = token_files.read(spark, str(tmp_path / "f"))
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.crc) for r in back.withColumn("crc", F.crc32("ids")).collect()), key=lambda r: r[1])
    want = plain_files(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), Tokenizer.from_file(WORDS))
    assert got == want
    few = spark.read.format(token_files.SOURCE).option("path", str(tmp_path / "f")).option("documents", 3).load()
    assert sorted((r.start, r.n_tokens) for r in few.collect()) == [w[1:3] for w in want]


def test_token_files_edges(spark, tmp_path):
    docs = spark.createDataFrame([("b", "x"), ("a", "y z"), ("a", "y z"), (None, None)], "doc_id string, text string")
    rows = token_files.round_trip(docs, WORDS, 1, str(tmp_path / "t")).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in rows] == [(None, 0, 1), ("a", 1, 3), ("a", 4, 3), ("b", 7, 2)]
    assert token_files.round_trip(docs.limit(0), WORDS, 1, str(tmp_path / "e")).collect() == []
    byte = public_tokenizers.path("byte_bpe_50k.json")
    assert not token_files.drops_white_space(byte)
    assert [r.n_tokens for r in token_files.round_trip(docs.where("doc_id = 'b'"), byte, 0, str(tmp_path / "b")).collect()] == [2]


def test_words_as_the_library_gives_them():
    draw, enc = random.Random(3), token_files.WordEncoder(WORDS, memory=500)
    letters = "aBé 'sİßſﬁ.,!?<|endoftext|>\n\t 　́中文字 don't we'll 12 3a a3 x_y Ω ŉ\U0001f600 \x1f\x85​"
    for _ in range(3000):
        text = "".join(draw.choice(letters[: draw.choice((5, 40, len(letters)))]) for _ in range(draw.randint(0, 30)))
        assert enc(text) == np.array(enc.whole.encode(text, add_special_tokens=False).ids, "<u2").tobytes(), text


def test_new_words_of_many_texts_are_learned_at_once():
    draw, enc = random.Random(4), token_files.WordEncoder(WORDS, memory=300, stretch=400, together=2000)
    texts = ["", "İ. i̇", "a\x1fb", "Straße, ſo! <|endoftext|>"] + [" ".join("".join(draw.choice("abeéİ.,!1") for _ in range(draw.randint(1, 6))) for _ in range(draw.choice((0, 3, 30, 150)))) for _ in range(400)]
    learned, learn = [], enc._learn
    enc._learn = lambda words: learned.append(len(words)) or learn(words)
    assert list(enc.each(texts)) == [np.array(enc.whole.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
    enc.stretch, learned[:] = 1 << 20, []
    fresh = [f"{'abcdefgh'[k % 8]}{'xyz' * (k % 5)}{chr(97 + k // 8)}" for k in range(200)]
    enc.together = 1 << 17
    assert b"".join(enc.each(fresh)) == b"".join(np.array(enc.whole.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in fresh)
    assert len(learned) == 1
