"""The queries of this subpackage by name, with production parameters, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import block_join, conversation_repair, fill_middle, kdtree, language_model, line_dedup, mixing, packing, simhash, surrogates, token_count, token_files, toxicity
from tessera.llm._common import table


MIXTURE = mixing.Target()
BOILERPLATE = {"ratio": 0.06, "least_pages": 1, "least_copies": 3}


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), MIXTURE)


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language_model.stupid_backoff(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "words", F.round("log10_score", 6).alias("log10_score"), F.round("mean_log10", 6).alias("mean_log10"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.marked(docs, "source", **BOILERPLATE).select("doc_id", "source", "line_count", "dropped_lines", F.md5("kept_text").alias("kept_md5"))


#: On a cluster the key comes from its secret store; this one makes runs comparable.
PSEUDONYM_KEY = b"a key for tests and benchmarks"


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.pseudonymised(table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_kdtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.top_k(table(spark, sf_dir, "embeddings"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_block_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_join.nearest(table(spark, sf_dir, "embeddings"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = public_tokenizers.path
    return packing.pack(table(spark, sf_dir, "documents"), at("byte_bpe_50k.json"), at("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversation_repair.report(rows, conversation_repair.damaged(rows))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.transform(table(spark, sf_dir, "documents"), with_output=False)


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_language_model": op2_language_model,
    "op3_line_dedup": op3_line_dedup,
    "op4_surrogates": op4_surrogates,
    "op5_simhash": op5_simhash,
    "op6_kdtree": op6_kdtree,
    "op7_toxicity": op7_toxicity,
    "op8_block_join": op8_block_join,
    "op9_packing": op9_packing,
    "op10_token_counts": op10_token_counts,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_fill_middle": op12_fill_middle,
    "op13_token_files": op13_token_files,
}

#: Vectors as in tessera.llm.vectors.usable.
USABLE = """
WITH e AS (
  SELECT vec_id, {each} AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 {more}
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, {score} AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score {order}, vec_id))::INT AS rank, vec_id, score FROM s QUALIFY rank <= 10
"""

ORACLE_SQL: dict[str, str] = {
    "op1_mixing": mixing.SQL.format(seed=MIXTURE.seed, entropy=MIXTURE.entropy, repeats=MIXTURE.repeats, budget=MIXTURE.budget, block_tokens=MIXTURE.block_tokens),
    "op2_language_model": language_model.SQL.format(backoff=0.4),
    "op3_line_dedup": line_dedup.SQL.format(**BOILERPLATE),
    "op6_kdtree": USABLE.format(each="list_transform(embedding, lambda x: floor(x::DOUBLE * 1024))", more="", score="list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT", order="DESC"),
    "op8_block_join": USABLE.format(each="embedding::DOUBLE[]", more="AND len(list_filter(embedding, lambda x: x <> 0)) > 0", score="sqrt(list_sum(list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))", order="ASC"),
    "op11_conversation_repair": conversation_repair.SQL,
    "op12_fill_middle": fill_middle.SQL,
}
