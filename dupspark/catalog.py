"""File catalogues: the columns every scan gives, and tables that stand in for files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: A file as a scan lists it, with what the ignore files say of it; content is read only where a plan asks for it.
FILES = "path string, relpath string, subpath string, size bigint, mtime timestamp, ctime timestamp, uid int, gid int, mode int, ftype string, named boolean, verdict string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_files(rows: DataFrame, id: str, path, content: str, subpath=None) -> DataFrame:
    """A catalogue from rows with text: id, path, relpath, subpath, size in bytes, content, prioritized (none is)."""
    return rows.select(
        F.col(id).alias("id"), path.alias("path"), path.alias("relpath"), (subpath if subpath is not None else F.lit(None)).cast("string").alias("subpath"),
        F.octet_length(content).cast("bigint").alias("size"), F.col(content).alias("content"), F.lit(False).alias("prioritized"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_files(table(spark, sf_dir, "documents"), "doc_id", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))), "text")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_files(table(spark, sf_dir, "pages"), "page_id", F.col("url"), "html")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_files(table(spark, sf_dir, "conversations"), "conv_id", F.col("conv_id").cast("string"), "text", F.col("turn").cast("string"))
