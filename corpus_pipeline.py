"""A corpus made ready for training, in stages that each keep their output as Parquet."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import bpe, exact_dedup, jaccard_join, language, mixing
from ledgerline.llm.common import documents, staged

# A vocabulary file that is the same on every machine.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter and documents of noise go."""
    return language.recognised(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.emitted(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document that the mix has, and digests of them and
    of the text that they decode to; a row for each copy."""
    return bpe.encoding_digests(docs, TOKENIZER)


STAGES = [
    ("language", keep_languages),
    ("exact dedup", drop_copies),
    ("near copies", drop_near_copies),
    ("mixing", mix_sources),
    ("encoding", encode_texts),
]

# Stages with trained models and tokenizers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
