"""Order over a whole table without one task that sees it all: range partitions, and a row each to stitch their borders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from ..workspace import stored

PART = "_part"


def parts(rows: DataFrame, *order: Column | str) -> DataFrame:
    """rows with the number of their range partition, written, so that the numbers stay what they are: all rows of a part stand before all of the next one's in the order."""
    return stored(rows.repartitionByRange(*order).withColumn(PART, F.spark_partition_id()))


def carried(cut: DataFrame, least: Column, last: Column, kind) -> DataFrame:
    """(_part, before, after): for every part the last value of the parts before it and the least one of those after it, null where these have none. One row a part passes through the driver."""
    ends = cut.groupBy(PART).agg(least.alias("lo"), last.alias("hi")).orderBy(PART).collect()
    before, after, seen = {}, {}, None
    for r in ends:
        before[r[PART]] = seen
        seen = r.hi if r.hi is not None else seen
    seen = None
    for r in reversed(ends):
        after[r[PART]] = seen
        seen = r.lo if r.lo is not None else seen
    schema = StructType([StructField(PART, IntegerType()), StructField("before", kind), StructField("after", kind)])
    return cut.sparkSession.createDataFrame([(p, before[p], after[p]) for p in before], schema)


def neighbours(rows: DataFrame, k: str, previous: str = "prev_key", following: str = "next_key") -> DataFrame:
    """Each row beside the key before and after it, null at the ends. Equal keys are each other's neighbours; null keys come first."""
    cut = parts(rows, k)
    one = StructType([StructField("k", rows.schema[k].dataType)])
    key = F.struct(F.col(k).alias("k"))
    edges = carried(cut, F.min(key), F.max(key), one)
    w = Window.partitionBy(PART).orderBy(k)
    near = cut.withColumn("_lag", F.lag(key).over(w)).withColumn("_lead", F.lead(key).over(w)).join(F.broadcast(edges), PART)
    return near.select(*rows.columns, F.coalesce("_lag", "before")["k"].alias(previous), F.coalesce("_lead", "after")["k"].alias(following))


def seek_many(rows: DataFrame, probes: DataFrame, k: str = "k") -> DataFrame:
    """(probe, k): for every distinct probe the first key at or above it, null if there is none: one sort of both, from the largest key down, and the last key seen inside each part; what a part doesn't have is the least key of the parts after it.

    The frame ends at the probe: Spark carries such a one on from row to row, while it goes through all rows that are left for each row of a frame that is open ahead.
    """
    kind = rows.schema[k].dataType
    both = rows.select(F.col(k).alias("k"), F.lit(False).alias("asks")).unionByName(probes.select(F.col(k).cast(kind).alias("k"), F.lit(True).alias("asks"))).where("k is not null")
    cut = parts(both, "k")
    own = F.when(~F.col("asks"), F.col("k"))
    edges = carried(cut, F.min(own), F.max(own), kind).drop("before")
    down = Window.partitionBy(PART).orderBy(F.desc("k"), "asks").rowsBetween(Window.unboundedPreceding, 0)
    found = cut.withColumn("near", F.last(own, ignorenulls=True).over(down)).where("asks").join(F.broadcast(edges), PART)
    return found.select(F.col("k").alias("probe"), F.coalesce("near", "after").alias("k")).distinct()


def ranked(rows: DataFrame, key: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """rows beside their number in their key's set, from 1, in an order without ties. A set may be larger than a task: it spreads over parts in order, and a part that begins inside a set adds the number of its rows before."""
    cut = parts(rows, *key, *order)
    counts = cut.groupBy(PART, *key).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*key).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1))
    begun = counts.withColumn("_before", before).where("_before > 0").drop("_n")  # at most one set a part
    local = F.row_number().over(Window.partitionBy(PART, *key).orderBy(*order))
    placed = cut.withColumn("_local", local).join(F.broadcast(begun), [PART, *key], "left")
    return placed.select(*rows.columns, (F.col("_local") + F.coalesce("_before", F.lit(0))).cast("int").alias(name))
