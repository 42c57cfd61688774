"""The corpus pipeline: toxicity, line dedup, near-duplicates, mixing, packing, each stage over all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import line_dedup, mixing, packing, similar, toxicity
from tessera.llm._common import stored, table

#: Every source is seen whole at least once; small ones are repeated, at most twice.
MIXTURE = mixing.Target(entropy=0.97, repeats=2.0, budget=None)
#: No host is exempt; a line must be in three of its pages, as two may be copies of each other.
BOILERPLATE = {"ratio": 0.06, "least_pages": 1, "least_copies": 3}


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.without_boilerplate(docs, "source", length="n_chars" if "n_chars" in docs.columns else None, **BOILERPLATE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Linked are fingerprints within four bits and texts whose runs of five words have a similarity of 0.8 or more."""
    return similar.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, MIXTURE)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    at = public_tokenizers.path
    return packing.pack(docs, at("byte_bpe_50k.json"), at("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_boilerplate),
    ("simhash", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A trained classifier, fingerprints and token ids are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
