"""The registered queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, cover_tree, exact_dedup, language_id, lexical, mixing, quality, simhash, substring_dedup, token_counts, toxicity, vector_codes, web_archive


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and the bytes they decode to. Null and empty texts have no ids, texts may be of any length, repeated rows come back as often as they are there, other columns aren't read, an empty table gives no rows."""
    return bpe.digests(table(spark, sf_dir, "documents"), bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text. Null texts and those without a letter are und with score 0, repeated rows predict alike, a null doc_id trains nothing, an empty table gives no rows and one without labels predicts und."""
    return language_id.language_of(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in flat files. Null and empty texts have none, long texts one run, repeated rows are documents of their own, an empty table gives no rows."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return token_counts.document_token_counts(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without the 50-byte strings of smaller doc_ids. Null is empty, a null doc_id the largest, rows of one doc_id don't cut each other, texts may be of any length that a row may have, an empty table gives no rows."""
    return substring_dedup.cut_repeats(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes. A null text has size 0, a null source is the last one, rows that repeat a doc_id are documents of their own, long texts are many blocks, an empty table gives no rows."""
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document. Null and empty texts have fingerprint zero and are linked like any other, repeated rows come back as often, a null doc_id is passed over by the minimum, an empty table gives no rows."""
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op7_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best vectors of every fiftieth. Vectors that are null or hold a null or non-finite component take no part, ties go to the smaller vec_id, each row of a repeated id asks, vectors of other lengths don't meet, an empty table gives no rows."""
    return cover_tree.neighbours(table(spark, sf_dir, "embeddings"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every whole text, the highest of its windows. A null or empty text has one empty window, long texts as many as they fill, repeated rows score alike, of several labels the largest counts, without labels of both kinds the score is their smoothed share, an empty table gives no rows."""
    return toxicity.toxicity_of(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every whole text. Null and empty texts get the bias alone, repeated rows score alike, of several labels the largest counts, without any label the score is near one half, an empty table gives no rows."""
    return quality.quality_of(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who stays of equal texts. Null counts as empty, a null doc_id stays only where no row has one, of rows that repeat text and id one stays, an empty table gives no rows."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings; nulls, ties, repeats and empty tables as vector_codes.compressed states."""
    return vector_codes.compressed(table(spark, sf_dir, "embeddings"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of each benchmark item; nulls, ties, repeats, long texts and empty tables as lexical.ranked states."""
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_web_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through ARC and WARC files; nulls, ties, repeats, long pages and empty tables as web_archive.archived states."""
    return web_archive.archived(table(spark, sf_dir, "pages"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op7_cover_tree": cover_tree.TOP_SQL, "op10_exact_dedup": exact_dedup.EXACT_SQL, "op11_vector_codes": vector_codes.CODES_SQL, "op12_lexical_search": lexical.RANKED_SQL, "op13_web_archive": web_archive.ARCHIVED_SQL}
