import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import packing, token_count

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTE = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
ODD = ["", " ", "   ", "a  b", " a", "a ", "▁a ▁▁b", "<s> </s> <unk> <0x0A>", "a\n b\n\n  c\t d", "é中😀ſ", "=" * 300, "x" * 1000, "the " * 50, "<|endoftext|>", "a<|endoftext|> b", "it's we'LL 'd", "\x0b\x85 "]
TEXT = st.text(alphabet=st.sampled_from(list("  \n\tab'sthe é中😀0129ſ.,▁<>|")), max_size=60)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def machine():
    return token_count.transducer(MODEL)


@pytest.mark.parametrize("text", ODD)
@pytest.mark.parametrize("chunk", [1 << 16, 5])
def test_counts_of_odd_texts(machine, library, text, chunk):
    assert machine.count(text, chunk) == len(library.encode(text))


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_counts_are_the_librarys(text):
    import sentencepiece

    assert token_count.transducer(MODEL).count(text, 7) == len(sentencepiece.SentencePieceProcessor(model_file=MODEL).encode(text))


def test_states_may_be_forgotten(library):
    small = token_count.Transducer(token_count.piece_ranks(MODEL), max_states=50, max_units=3)
    texts = ["the quick brown fox", "internationalization of tokenizers", "a  b   c"]
    assert [small.count(t) for t in texts] == [len(library.encode(t)) for t in texts]


def test_chunk_maps_compose_associatively(machine):
    a, b, c = (machine.chunk_map(x) for x in ("▁the▁qu", "ick▁brown▁f", "ox▁▁jumps"))
    assert machine.compose(machine.compose(a, b), c) == machine.compose(a, machine.compose(b, c))


def test_op10_against_library(spark, library):
    from tessera.llm.queries import op10_token_counts

    got = {r.doc_id: r for r in op10_token_counts(spark, "/root/testdata/sf0.001").collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert {k: (len(t.encode()), len(library.encode(t))) for k, t in texts.items()} == {k: (r.n_bytes, r.n_tokens) for k, r in got.items()}
    assert all(r.over_limit == (r.n_tokens > 4096) for r in got.values())


def test_count_nulls_repeats_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, None, 5), (1, None, 5), (None, "the", 6), (2, "", 7)], "doc_id long, text string, n_tokens int")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in token_count.count_tokens(rows, MODEL).collect())
    assert got == [(False, 1, 0, 0), (False, 1, 0, 0), (False, 2, 0, 0), (True, 0, 3, 1)]
    assert token_count.count_tokens(rows.limit(0), MODEL).collect() == []


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(*BYTE)


@pytest.mark.parametrize("text", ODD)
def test_ids_of_odd_texts(encoder, text):
    assert np.frombuffer(encoder(text), encoder.dtype).tolist() == encoder.whole.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_ids_are_the_librarys(text):
    enc = packing.encoder(*BYTE)
    assert np.frombuffer(enc(text), enc.dtype).tolist() == enc.whole.encode(text, add_special_tokens=False).ids


def check_packed(rows, texts, encoder, sequence=1024):
    ids = [np.array([*encoder.whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for t in texts.values()]  # the library, not our own way
    ids = dict(zip(texts, ids, strict=True))
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        assert r.doc_tokens == len(ids[r.doc_id])
    assert set(by_doc) == set(texts)
    for k, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.length > 0
            at += p.length
        assert at == len(ids[k])
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= sequence and (at == sequence or at & (at - 1) == 0)


def test_op9_round_trip(spark, encoder):
    from tessera.llm.queries import op9_packing

    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    check_packed(op9_packing(spark, "/root/testdata/sf0.001").collect(), texts, encoder)


def test_lanes_sources_and_nulls(spark, encoder):
    rnd = random.Random(1)
    data = [(i, " ".join(rnd.choice(["the", "cat", "über", "x1"]) for _ in range(rnd.randint(0, 900))), rnd.choice(["a", "a", "a", "b", None]), 1) for i in range(120)] + [(500, None, "c", 1), (501, "", None, 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, lane int")
    rows = packing.pack(docs, *BYTE).collect()
    check_packed(rows, {d[0]: d[1] for d in data}, encoder)
    assert packing.pack(docs.limit(0), *BYTE).collect() == []


def test_texts_reach_workers_in_small_batches(spark, encoder, monkeypatch, tmp_path):
    data = [(i, f"the cat {i} " * 400, "a") for i in range(3000)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").coalesce(1)
    sizes, real, key = tmp_path / "sizes", packing.tokenised, "spark.sql.execution.arrow.maxBytesPerBatch"

    def noted(batches):
        for b in batches:
            with open(sizes, "a") as f:
                f.write(f"{b.nbytes}\n")
            yield b

    monkeypatch.setattr(packing, "tokenised", lambda d, *how: real(d.mapInArrow(noted, d.schema), *how))
    before = spark.conf.get(key)
    rows = packing.pack(docs, *BYTE)
    assert spark.conf.get(key) == before
    some = [int(n) for n in sizes.read_text().split()]
    assert sum(some) > 12_000_000 and max(some) < 2_200_000
    check_packed(rows.collect(), {i: t for i, t, _ in data}, encoder)


def test_every_window_is_on_target(spark):
    rnd = random.Random(2)
    sizes = {"a": 3, "b": 2, "c": 1}
    data = [(i, "the cat " * rnd.randint(1, 40), s) for i, s in enumerate(rnd.choices(list(sizes), sizes.values(), k=1500))]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").coalesce(1)
    for shares in (None, {"a": 0.5, "b": 0.3, "c": 0.2}):
        rows = packing.pack(docs, *BYTE, shares=shares, lane_bytes=1 << 30).orderBy("sequence_id", "offset").collect()
        total = {s: sum(r.length for r in rows if r.source == s) for s in sizes}
        target = shares or {s: n / sum(total.values()) for s, n in total.items()}
        so_far, all_so_far = dict.fromkeys(sizes, 0), 0
        longest = max(r.doc_tokens for r in rows)
        for r in rows:
            if r.offset == 0 and all(so_far[s] < total[s] for s in sizes) and all_so_far < 0.8 * sum(total.values()):
                assert all(abs(so_far[s] - target[s] * all_so_far) <= longest + 1024 * target[s] for s in sizes), (shares, so_far)
            so_far[r.source] += r.length
            all_so_far += r.length


def test_text_ids(spark, encoder):
    docs = spark.createDataFrame([("", "the cat", "a", 1), ("x", "the", "a", 2), (None, "a dog", "b", 3)], "doc_id string, text string, source string, lane int")
    check_packed(packing.pack(docs, *BYTE).collect(), {"": "the cat", "x": "the", None: "a dog"}, encoder)


def test_round_robin_keeps_proportions_and_carries_deficits():
    queues = {"a": [(("a", i), 10) for i in range(300)], "b": [(("b", i), 10) for i in range(100)]}
    order = list(packing.round_robin(queues, {"a": 0.75, "b": 0.25}, {}, 400))
    assert len(order) == 400
    for k in range(40, 400, 40):
        assert abs(sum(x[0] == "a" for x in order[:k]) / k - 0.75) < 0.06
    first = list(packing.round_robin(queues, {"a": 0.75, "b": 0.25}, {"a": -300.0, "b": 300.0}, 400))
    assert sum(x[0] == "b" for x in first[:40]) == 40
    assert len(list(packing.round_robin({"a": [(0, 5)], "b": [(1, 5)]}, {"a": 0.0, "b": 1.0}, {}, 10))) == 2


def test_sequence_lengths():
    assert packing.sequence_lengths(2048 + 700, 1024) == [1024, 1024, 512, 128, 32, 16, 8, 4]
    assert packing.sequence_lengths(0, 1024) == []
