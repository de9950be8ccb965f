"""Similar vectors: all pairs below a distance, exactly, block by block inside bands of similar length."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..functions.vectors import norm
from ..workspace import stored

#: Vectors of a small block; blocks that all vectors of a dimension make, as long as these hold at most so many bytes; a task holds two blocks.
BLOCK, SPREAD, MOST = 1024, 16, 64 << 20
#: Rows and columns of a matrix of distances, bytes of differences that are held at once, pairs of a batch.
TILE, GAPS, BATCH = (256, 2048), 16 << 20, 1 << 16
#: Bands, of all vector lengths together, whose sizes are sent to every task; more are joined.
MOST_BANDS = 1 << 16


def band_of(length: Column, threshold: float) -> Column:
    """The number of a band of lengths such that vectors nearer than the threshold lie in one band or in neighbouring ones; null for a zero vector, which only others of its kind are near below a threshold of 1.

    |x - y| is at least the difference of the lengths, so the longer of two near vectors is less than (1 + t) / (1 - t) times as long as
    the other, and that is a band's width. From a threshold of 1 on all lengths are one band.
    """
    if threshold >= 1:
        return F.lit(0)
    length = F.least(length, F.lit(1e300))
    width = math.log((1 + threshold) / (1 - threshold)) * (1 + 1e-9)
    return F.when(length > 0, F.floor(F.log(length) / width + 0.5).cast("int"))


def dealt(rows: DataFrame, threshold: float, block: int | None = None) -> DataFrame:
    """rows(id, v, dim, ...) with the pairs of blocks in which they are compared: (id, v, dim, ..., low, high, lo, hi, side), side 0 in the lower block, 1 in the higher, null where these are one.

    A band is cut into blocks of about `block` vectors by a hash. A vector goes to the pairs of its block with every block of its own band
    and of the two bands beside it, and to no other; with vectors of one length that is every block there is.
    Blocks grow with the table unless their size is given, so a vector is sent some SPREAD times however many there are, and more often only
    once blocks hold MOST bytes.
    """
    placed = rows.withColumn("band", band_of(norm(F.col("v")), threshold))
    counts = placed.groupBy("dim", "band").agg(F.count("*").alias("rows"))
    share, room = F.ceil(F.sum("rows").over(Window.partitionBy("dim")) / SPREAD), F.floor(MOST / (8 * F.greatest("dim", F.lit(1))))
    each = F.lit(block) if block else F.greatest(F.lit(BLOCK), F.least(share, room))
    sizes = stored(counts.select("dim", "band", F.ceil(F.col("rows") / each).cast("int").alias("n")))
    beside = lambda step, name: sizes.select("dim", (F.col("band") + step).alias("band"), F.col("n").alias(name))
    known = sizes.join(beside(-1, "up"), ["dim", "band"], "left").join(beside(1, "down"), ["dim", "band"], "left").select("dim", F.col("band").alias("own"), "n", "up", "down")
    known = F.broadcast(known) if sizes.count() <= MOST_BANDS else known
    at = placed.join(known.withColumnRenamed("dim", "_dim"), (F.col("dim") == F.col("_dim")) & F.col("band").eqNullSafe(F.col("own"))).drop("_dim", "own")
    at = at.withColumn("k", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    to = lambda n, make: F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), make)
    cell = lambda low, high, lo, hi, side: F.struct(low.alias("low"), high.alias("high"), lo.alias("lo"), hi.alias("hi"), side.cast("int").alias("side"))
    band, k = F.col("band"), F.col("k")
    inside = to(F.col("n"), lambda j: cell(band, band, F.least(k, j), F.greatest(k, j), F.when(k < j, 0).when(k > j, 1)))
    above = to(F.coalesce("up", F.lit(0)), lambda j: cell(band, band + 1, k, j, F.lit(0)))
    below = to(F.coalesce("down", F.lit(0)), lambda j: cell(band - 1, band, j, k, F.lit(1)))
    return at.select(*rows.columns, F.explode(F.concat(inside, above, below)).alias("c")).select(*rows.columns, "c.*")


def pairs(vectors: DataFrame, threshold: float, key: str = "id", vector: str = "v", block: int | None = None, size: str | None = None) -> DataFrame:
    """(a, b, distance) with a < b and |x - y| / (|x| + |y|) below the threshold; beside them sa and sb, the values of a bigint column, if size names one.

    Vectors of similar length meet block by block, see dealt(); a task sees two blocks, and hands its pairs on batch by batch. A matrix
    product finds candidates with some slack, and the direct formula in double decides. Rows with a null id or vector, or a null or
    non-finite component, take no part; vectors of different lengths don't compare; two zero vectors have distance 0.
    """
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    single = isinstance(vectors.schema[vector].dataType.elementType, T.FloatType)
    sent = [F.col(key).alias("id"), F.col(vector).cast("array<float>" if single else "array<double>").alias("v"), F.size(vector).alias("dim")]
    rows = vectors.where(F.col(key).isNotNull() & F.coalesce(ok, F.lit(False))).select(*sent, *([F.col(size).cast("bigint").alias("size")] if size else []))
    made = T.StructType([T.StructField("a", rows.schema["id"].dataType), T.StructField("b", rows.schema["id"].dataType), T.StructField("distance", T.DoubleType())])
    for name in ("sa", "sb") if size else ():
        made.add(name, T.LongType())
    kinds = [to_arrow_type(f.dataType) for f in made]

    def near(x, length, r, c):
        """Distances of the pairs (r, c), a few at a time."""
        out, step = np.empty(len(r)), max(1, GAPS // (8 * max(1, x.shape[1])))
        for at in range(0, len(r), step):
            i, j = r[at : at + step], c[at : at + step]
            d, both = np.sqrt(((x[i] - x[j]) ** 2).sum(axis=1)), length[i] + length[j]
            out[at : at + step] = np.divide(d, both, out=np.zeros_like(d), where=both > 0)
        return out

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.Table.from_batches(batches)
        whole = lambda name: part[name].combine_chunks()
        ids, side = whole("id").to_numpy(zero_copy_only=False), whole("side").fill_null(-1).to_numpy()
        x = whole("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), part["dim"][0].as_py())
        told = part["size"].combine_chunks() if size else None
        del part
        one = bool((side < 0).all())
        left, right = (np.arange(len(ids)),) * 2 if one else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        length = np.sqrt((x * x).sum(axis=1))
        found, held = [], 0

        def batch():
            i, j, d = (np.concatenate(f) for f in zip(*found, strict=True))
            columns = [ids[i], ids[j], d, *((told.take(pa.array(k)) for k in (i, j)) if size else ())]
            return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], made.names)

        for at in range(0, len(left), TILE[0]):
            i = left[at : at + TILE[0]]
            for to in range(0, len(right), TILE[1]):
                j = right[to : to + TILE[1]]
                total = length[i][:, None] + length[j][None]
                gap = length[i][:, None] ** 2 + length[j][None] ** 2 - 2 * (x[i] @ x[j].T)
                r, c = np.nonzero(gap <= (threshold * total) ** 2 + 1e-6 * (1 + total**2))
                r, c = i[r], j[c]
                keep = ids[r] < ids[c] if one else ids[r] != ids[c]
                r, c = r[keep], c[keep]
                d = near(x, length, r, c)
                r, c, d = r[d < threshold], c[d < threshold], d[d < threshold]
                turned = ids[r] > ids[c]
                found.append((np.where(turned, c, r), np.where(turned, r, c), d))
                held += len(d)
                if held >= BATCH:
                    yield batch()
                    found, held = [], 0
        if held:
            yield batch()

    return dealt(rows, threshold, block).groupBy("dim", "low", "high", "lo", "hi").applyInArrow(compare, made)


def sided(found: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """(pivot, other) of pairs: the larger member, the smaller id where sizes agree, and the other one. Sizes are those beside the pairs, or
    sizes(id, size); pairs that carry theirs are not shuffled."""
    if sizes is not None:
        a, b = sizes.select(F.col("id").alias("a"), F.col("size").alias("sa")), sizes.select(F.col("id").alias("b"), F.col("size").alias("sb"))
        found = found.join(a, "a").join(b, "b")
    flip = F.col("sb") > F.col("sa")
    return found.select(F.when(flip, F.col("b")).otherwise(F.col("a")).alias("pivot"), F.when(flip, F.col("a")).otherwise(F.col("b")).alias("other"))


def stars(found: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """(pivot, others) as a report lists them, see sided().

    Stars are no classes: a vector is in every star whose pivot is near it.
    """
    return sided(found, sizes).groupBy("pivot").agg(F.sort_array(F.collect_list("other")).alias("others"))
