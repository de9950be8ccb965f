"""A corpus pipeline: each stage is one operator of dupspark.llm, reads what its predecessor wrote, and writes its own result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from dupspark.llm import bpe, exact_dedup, language_id, mixing, simhash
from dupspark.llm.common import trimmed, written

#: The vocabulary file is a parameter of the encoder; this is the one the pipeline uses.
RANKS = "byte_bpe_multi_50k.tiktoken"


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; the others go, null texts and those without a letter among them. Repeated rows stay or go together; an empty table stays empty."""
    return language_id.keep_known_language(docs)


def one_of_equal_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id, one row of it; null counts as empty, and a null id stays only where no row has one."""
    return exact_dedup.drop_exact_copies(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group, the document with the smallest id; of rows that tie in it one stays. Null and empty texts are one group."""
    return simhash.keep_one_of_near_copies(docs)


def mix_of_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts of the blocks that the mix takes, a row for each document and turn. Documents without words go; a null source is a source."""
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes of every row; null counts as empty, rows repeat as often as they come."""
    return bpe.digests(docs, bpe.read_ranks(public_tokenizers.path(RANKS)))


STAGES = [
    ("language ID", known_language),
    ("exact dedup", one_of_equal_texts),
    ("SimHash near-dedup", one_of_near_copies),
    ("mixing sources", mix_of_sources),
    ("byte-level BPE", encoded),
]

#: SQL can express neither the trained language net nor the random mix; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents; each result but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
            trimmed(spark)
    return docs
