"""Ordered access to keyed rows: seeks, ranges, neighbours. Keys compare byte by byte, a prefix before what extends it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from . import global_order


def get(rows: DataFrame, key, k: str = "k") -> DataFrame:
    """The row of a key; the equality reaches the files' statistics."""
    return rows.where(F.col(k) == F.lit(key))


def key_range(rows: DataFrame, low=None, high=None, k: str = "k") -> DataFrame:
    """Rows from low on and below high, in key order; None is open."""
    if low is not None:
        rows = rows.where(F.col(k) >= F.lit(low))
    if high is not None:
        rows = rows.where(F.col(k) < F.lit(high))
    return rows.orderBy(k)


def first(rows: DataFrame, k: str = "k") -> DataFrame:
    return rows.orderBy(k).limit(1)


def last(rows: DataFrame, k: str = "k") -> DataFrame:
    return rows.orderBy(F.desc(k)).limit(1)


def seek(rows: DataFrame, key, k: str = "k") -> DataFrame:
    """The first row whose key is key or above."""
    return first(rows.where(F.col(k) >= F.lit(key)), k)


def seek_many(rows: DataFrame, probes: DataFrame, k: str = "k") -> DataFrame:
    """(probe, k): for every probe the first key at or above it, null if there is none."""
    return global_order.seek_many(rows, probes, k)


def neighbours(rows: DataFrame, k: str = "k", per: str | None = None) -> DataFrame:
    """Each row beside the key before and after it, inside `per` if given, else over the whole table."""
    if per is None:
        return global_order.neighbours(rows, k)
    w = Window.partitionBy(per).orderBy(k)
    return rows.withColumn("prev_key", F.lag(k).over(w)).withColumn("next_key", F.lead(k).over(w))


def latest(log: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    """The last write of every key: a maximum of structs, combined before the shuffle; needs versions without ties."""
    rest = [c for c in log.columns if c not in key]
    last_one = F.max_by(F.struct(*rest), F.struct(*version))
    return log.groupBy(*key).agg(last_one.alias("r")).select(*key, "r.*")
