"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing names, for all ten operators and all stages."""

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm import block_join, kdtree, language_model, line_dedup, mixing, packing, similar, simhash, surrogates, token_count, toxicity

BYTE = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
CLASHING = ("key", "score", "row", "rid", "fp", "block", "lane", "kept_text", "kept_lines", "boiler_g", "text_hash", "n", "ids", "epoch", "held_out", "shard", "n_tokens", "_text", "h", "t")
LONG = "a long line of words\n" * 500_000  # 10 MB


def documents(spark, text_ids=False, long=False):
    rows = [(1, "the same text", "en", "a", 13), (1, "the same text", "en", "a", 13), (2, "the same text", "en", "b", 13), (3, "", None, None, 0), (4, None, "de", "a", None), (None, None, None, None, None), (None, "Mr. Smith wrote to a@b.example.com", "en", None, 5), (5, "tie tie tie tie tie", "en", "b", 19)]
    rows += [(6, LONG, "en", "a", len(LONG))] if long else []
    kind = "string" if text_ids else "long"
    if text_ids:
        rows = [("" if r[0] == 1 else None if r[0] is None else f"d{r[0]}", *r[1:]) for r in rows]
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("mine") for c in CLASHING})


def labels(spark, docs):
    return docs.select("doc_id", F.lit(1).alias("toxic"), F.lit("x").alias("text")).limit(3)


OPERATORS = {
    "mix": lambda spark, d: mixing.mix(d, mixing.Target(budget=None)),  # covers every document
    "language_model": lambda spark, d: language_model.stupid_backoff(d),
    "lines": lambda spark, d: line_dedup.marked(d, "source"),
    "surrogates": lambda spark, d: surrogates.pseudonymised(d, b"key"),
    "simhash": lambda spark, d: simhash.near_duplicates(d),
    "toxicity": lambda spark, d: toxicity.classify(d, labels(spark, d)),
    "packing": lambda spark, d: packing.pack(d, *BYTE),
    "token_count": lambda spark, d: token_count.count_tokens(d, public_tokenizers.path("piece_bpe_32k.model")),
}


@pytest.mark.parametrize("name", OPERATORS)
@pytest.mark.parametrize("text_ids", [False, True])
def test_operator(spark, name, text_ids):
    docs = documents(spark, text_ids)
    rows = OPERATORS[name](spark, docs).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.select("doc_id").collect()}
    if name not in ("packing", "mix"):
        assert len(rows) == docs.count()
    assert OPERATORS[name](spark, docs.limit(0)).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_very_long_text(spark, name):
    docs = documents(spark, long=True)
    assert 6 in {r.doc_id for r in OPERATORS[name](spark, docs).select("doc_id").collect()}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage(spark, name, tmp_path):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = documents(spark)
    docs.select("doc_id", F.lit(0).alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    out = stage(spark, docs, str(tmp_path))
    rows = out.collect()
    if name == "packing":
        assert {r.doc_id for r in rows} == {1, 2, 3, 4, 5, None}
        return
    assert out.columns == docs.columns
    assert all(r[c] == "mine" for r in rows for c in CLASHING)
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in rows)
    every = sorted((r.doc_id is None, r.doc_id or 0) for r in docs.collect())
    if name == "simhash":
        assert [i for _, i in ids] == [1, 3, 5, 0]
    elif name == "mixing":
        assert set(ids) == set(every)
    else:
        assert ids == every
    assert stage(spark, docs.limit(0), str(tmp_path)).columns == docs.columns


@pytest.mark.parametrize("search", [kdtree.top_k, block_join.nearest])
def test_vectors(spark, search):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, []), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (None, [1.0, 1.0]), (100, [5.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("mine") for c in (*CLASHING, "v", "q", "query_id", "side", "dim", "kth")})
    assert [(r.query_id, r.rank, r.vec_id) for r in search(df).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    assert search(df.limit(0)).collect() == []


def test_near_duplicates_keep_rows_told_apart_by_their_nulls(spark):
    docs = spark.createDataFrame([("alpha", None), (None, "alpha"), ("b", "other words stand in this text")], "doc_id string, text string").withColumn("n_chars", F.lit(1))
    rows = similar.one_of_each(docs).select("doc_id", "text").collect()
    assert {tuple(r) for r in rows} == {("alpha", None), (None, "alpha"), ("b", "other words stand in this text")}
