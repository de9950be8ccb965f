"""Exact duplicates: by size, then content hash, on request by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.hashing import digest
from . import global_order


def size_histogram(files: DataFrame) -> DataFrame:
    """(size, n): files of each size."""
    return files.groupBy("size").agg(F.count("*").alias("n"))


def size_candidates(files: DataFrame) -> DataFrame:
    """Files that share their size with another: a semi-join that needs sizes alone, so contents of the others are never read."""
    return files.join(size_histogram(files).where("n > 1").select("size"), "size", "left_semi")


def singletons(files: DataFrame) -> DataFrame:
    """Files whose size no other has."""
    return files.join(size_histogram(files).where("n = 1").select("size"), "size", "left_semi")


def with_hash(files: DataFrame, kind: str = "md5") -> DataFrame:
    return files.withColumn("h", digest(F.col("content"), kind))


def groups(files: DataFrame, verify: bool = False) -> DataFrame:
    """(size, h, n, first_path) of the sets of equal files; partial counts come before the only shuffle.

    verify adds the content to the key: no digest collision can join two contents, but contents are shuffled.
    """
    keys = ["size", "h", *(["content"] if verify else [])]
    first = F.min(F.struct((~F.col("prioritized")).alias("late"), "path"))["path"]
    return files.groupBy(*keys).agg(F.count("*").alias("n"), first.alias("first_path")).where("n > 1").drop("content")


def members(files: DataFrame, rank: bool = True, verify: bool = False, spread: bool = False) -> DataFrame:
    """Rows of the sets of equal files, numbered inside their set: prioritized ones first, then by path.

    Files are read and hashed once, and one shuffle brings the rows of a set together, without their content, for both their
    number and their ranks. verify: sets are of equal bytes; contents are shuffled, and where two have
    one hash, the sets but the one with the smallest path have that path behind theirs. spread: a set may be larger than a task can
    rank, and is ranked by several; for that the rows should be a written table, since the sets' keys come from a count of their own.
    """
    keyed = files.drop("content")
    if verify:
        one = files.groupBy("size", "h", "content").agg(F.min("path").alias("_p"), F.count("*").alias("_k"))
        named = one.join(one.groupBy("size", "h").agg(F.min("_p").alias("_least")), ["size", "h"])
        named = named.select("size", "h", "content", F.when(F.col("_p") == F.col("_least"), F.col("h")).otherwise(F.concat("h", F.lit(" "), "_p")).alias("_h"))
        keyed = files.join(named, ["size", "h", "content"]).drop("content", "h").withColumnRenamed("_h", "h")
    ties = [c for c in ("path", "subpath", "id") if c in keyed.columns]
    order = [F.desc("prioritized"), *map(F.col, ties)]
    if rank and not spread:
        own = Window.partitionBy("size", "h").orderBy(*order)
        counted = keyed.withColumn("n", F.count("*").over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        return counted.where("n > 1").withColumn("rank", F.row_number().over(own))
    several = keyed.groupBy("size", "h").agg(F.count("*").alias("n")).where("n > 1")
    out = keyed.join(several, ["size", "h"])
    return global_order.ranked(out, ["size", "h"], order) if rank else out


def verified_pairs(files: DataFrame, key: str = "id") -> DataFrame:
    """(a, b) of equal contents, a below b: hash equality first, then the bytes. For reports on few sets; sets are the scalable form."""
    a = files.select("size", "h", F.col("content").alias("ca"), F.col(key).alias("a"))
    b = files.select("size", "h", F.col("content").alias("cb"), F.col(key).alias("b"))
    return a.join(b, ["size", "h"]).where("a < b and ca = cb").select("a", "b", "size", "h")


def size_changes(files: DataFrame) -> DataFrame:
    """(size, before): each distinct size beside the next larger one."""
    return global_order.neighbours(size_histogram(files).select("size"), "size").select("size", F.col("next_key").alias("before"))


def reclaimable(sets: DataFrame) -> DataFrame:
    """Extension: the bytes that one copy of each set would save."""
    return sets.agg(F.sum(F.col("size") * (F.col("n") - 1)).alias("bytes"), F.count("*").alias("sets"))


def top(files: DataFrame, k: int, by: str = "size", *ties: str) -> DataFrame:
    """The k largest, a partial top-k on each partition before one merge."""
    return files.orderBy(F.desc(by), *ties).limit(k)


def top_per(files: DataFrame, key: str, k: int, order: list[Column]) -> DataFrame:
    """The first k of each key; Spark limits each partition's groups before the shuffle."""
    return files.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)
