"""What several operators share: a shared work folder, byte blocks from Arrow batches, word spans, bounded samples, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.window import Window


def work_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; a local one only where that is unset and the master is local, as in tests."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if spark.conf.get("spark.master", "").split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = tempfile.gettempdir() + "/spark-work"
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


#: Options of a writer of long rows: their sizes are asked for row by row, or nearly so, else a hundred of them make one page.
LONG_ROWS = {f"parquet.{kind}.size.row.check.{end}": n for kind in ("page", "block") for end, n in (("min", 1), ("max", 8))}


def written(df: DataFrame, folder: str | None = None, group: int | None = None) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and lost executors cost no recomputation. group: bytes of a row group, for rows that are long."""
    spark = df.sparkSession
    folder = folder or work_folder(spark)
    rows = df.write.mode("overwrite")
    if group:
        rows = rows.options(**LONG_ROWS).option("parquet.block.size", group)
    rows.parquet(folder)
    heap = driver_heap(spark)
    if 2 * heap.totalMemory() > heap.maxMemory():  # many small jobs in a row fill a heap with garbage, which it then keeps from the system
        trimmed(spark)
    else:
        native_trimmed(spark)
    return spark.read.schema(df.schema).parquet(folder)


def driver_heap(spark: SparkSession):
    """The driver's JVM, as it tells of its heap: totalMemory() is what it has taken from the system."""
    return spark._jvm.java.lang.Runtime.getRuntime()


def asked(spark: SparkSession, bean: str, operation: str, *values: str):
    """What an operation of the driver's JVM on strings answers, by its management interface; None if it has no such operation."""
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    named = jvm.java.lang.Class.forName

    def filled(kind, *items):
        out = new(kind, len(items))
        for k, x in enumerate(items):
            out[k] = x
        return out

    objects, text = jvm.java.lang.Object, "java.lang.String"
    kinds = filled(jvm.java.lang.Class, *map(named, ("javax.management.ObjectName", text, "[Ljava.lang.Object;", "[Ljava.lang.String;")))
    told = filled(objects, jvm.javax.management.ObjectName(f"com.sun.management:type={bean}"), operation, filled(objects, *values), filled(jvm.java.lang.String, *[text] * len(values)))
    try:  # py4j finds methods by an object's own class, which is hidden here
        return named("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), told)
    except Py4JJavaError:
        return None


def native_trimmed(spark: SparkSession) -> str | None:
    """The driver's JVM gives free memory outside its heap, such as compilers and codecs leave, back to the system; None where it can't, which is no fault."""
    return asked(spark, "DiagnosticCommand", "systemTrimNativeHeap")


#: Percent of the heap that may stay free where the driver collects: at least, at most. A JVM's own are 40 and 70.
FREE = {"MinHeapFreeRatio": "10", "MaxHeapFreeRatio": "30"}


def collected(spark: SparkSession) -> None:
    """The driver's JVM collects, and gives back what of its heap it has no use for; its own ratios hold again afterwards."""
    own = {flag: found.get("value") for flag in FREE if (found := asked(spark, "HotSpotDiagnostic", "getVMOption", flag)) is not None}
    try:
        for flag in own:
            asked(spark, "HotSpotDiagnostic", "setVMOption", flag, FREE[flag])
        spark._jvm.System.gc()
    finally:
        for flag in reversed(own):  # the least may never be above the most
            asked(spark, "HotSpotDiagnostic", "setVMOption", flag, own[flag])


def plain_names(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with columns _c0, _c1, ... and the new name of each: names that an operator adds can't clash with them."""
    at = {c: f"_c{i}" for i, c in enumerate(df.columns)}
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in at.items()]), at


def extended(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    """df's schema and one more column; the schema that df keeps stays as it is."""
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])


def bounded_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """From now on the session's Arrow batches end after `most` bytes, or one row that is longer: texts may be of any length,
    and a task holds a few batches at once. A smaller bound of the session's stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(key)).rstrip("b")
    if not now.isdigit() or int(now) > most:
        spark.conf.set(key, str(most))


def trimmed(spark: SparkSession | None = None) -> None:
    """Gives this process's free memory back; with a session the driver's JVM collects too, which lets go of broadcasts and plans that nobody holds any more, and gives back its own."""
    if spark:
        collected(spark)
        native_trimmed(spark)
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def released(work: Callable) -> Callable:
    """work(batches) for mapInArrow, whose worker gives free memory back after each task; one that is used again would keep it beside the next job's."""

    def run(batches):
        yield from work(batches)
        trimmed()

    return run


def byte_column(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary or string column, and the n + 1 offsets of its rows; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    if column.null_count:
        lengths = np.where(np.asarray(column.is_null()), 0, np.diff(offsets))
        if lengths.sum() != offsets[-1]:
            keep = np.repeat(~np.asarray(column.is_null()), np.diff(offsets))
            data = data[keep]
        offsets = np.concatenate([[0], np.cumsum(lengths)])
    return data, offsets


def byte_blocks(batch: pa.RecordBatch, name: str, most: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo to hi of a batch with their bytes and offsets, at most `most` bytes at a time, or one row that is longer."""
    data, offsets = byte_column(batch.column(batch.schema.get_field_index(name)))
    lo, rows = 0, len(offsets) - 1
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes, cut at row borders, and the row of each run."""
    if not len(mask):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    begins = mask.copy()
    begins[1:] &= ~mask[:-1]
    ends = mask.copy()
    ends[:-1] &= ~mask[1:]
    borders = offsets[1:-1]
    borders = borders[(borders > 0) & (borders < len(mask))]
    begins[borders] |= mask[borders]
    ends[borders - 1] |= mask[borders - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(offsets, starts, side="right") - 1


#: Odd multipliers of the polynomial and multiplicative hashes below; any odd numbers would do.
BASE, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base ** 0, 1, ... base ** (n - 1) modulo 2**64."""
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n - 1, 0), base, np.uint64)]))[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, page: int = 1 << 18, base: int = BASE) -> np.ndarray:
    """A 64-bit hash of each of the spans, of which both starts and stops ascend: its bytes weighted by powers of base from the span's start, mixed.

    Prefix sums of weighted bytes make every span cost the same, however long it is; about a page of bytes is summed at a time.
    """
    out = np.empty(len(starts), np.uint64)
    up = down = np.zeros(0, np.uint64)
    lo = 0
    while lo < len(starts):
        begin = starts[lo]
        hi = max(lo + 1, int(np.searchsorted(stops, begin + page, side="right")))
        part = data[begin : stops[hi - 1]]
        first, last = starts[lo:hi] - begin, stops[lo:hi] - begin
        if len(up) <= len(part):
            up, down = powers(len(part) + 1, base), powers(len(part) + 1, pow(base, -1, 1 << 64))
        sums = np.zeros(len(part) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
            h = (sums[last] - sums[first]) * down[first]
            h ^= h >> np.uint64(29)
            h *= np.uint64(MIX)
            h ^= h >> np.uint64(32)
        out[lo:hi] = h
        lo = hi
    return out


def fold_of(doc_id: Column | str, n: int) -> Column:
    """crc32 of doc_id as text, modulo n."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")) % n


def bounded_sample(df: DataFrame, label: str, key: str, per_label: int) -> DataFrame:
    """At most per_label rows of each label, the same ones in every run: those with the smallest hash of key.

    Counts come first, so that the window sorts about twice per_label rows of a label and not all of them.
    """
    rate = df.groupBy(label).agg(F.count("*").alias("_n"))
    hashed = df.withColumn("_h", F.xxhash64(F.lit("sample"), F.col(key)))
    share = F.shiftrightunsigned("_h", 11) / F.lit(float(1 << 53))
    few = hashed.join(F.broadcast(rate), label).where(share <= F.lit(2.0 * per_label + 100) / F.col("_n"))
    return few.withColumn("_r", F.row_number().over(Window.partitionBy(label).orderBy("_h", key))).where(F.col("_r") <= per_label).drop("_n", "_h", "_r")


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star forest with the components of the edges (a, b): each node but the smallest with the smallest of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = np.arange(len(nodes))
    u, v = at[: len(a)], at[len(a) :]
    while len(u):
        lo, hi = np.minimum(u, v), np.maximum(u, v)
        np.minimum.at(parent, hi, lo)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        u, v = parent[u], parent[v]
        left = u != v
        u, v = u[left], v[left]
    child = parent != np.arange(len(nodes))
    return nodes[child], nodes[parent[child]]


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 40) -> DataFrame:
    """(node, component) of every node that an edge of two bigint columns touches; component is its smallest node.

    Large-star and small-star rounds by turns until nothing changes. Every round is written to the shared folder,
    so lineage stays short. A star's centre may be huge: both rounds group with a map-side minimum and a join, and
    collect no neighbour list. Null ends and loops are left out.
    """
    spark = edges.sparkSession
    now = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")

    def contract(batches):
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            kept.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
            size += batch.num_rows
            if size > 2_000_000:
                kept = [local_forest(np.concatenate([x for x, _ in kept]), np.concatenate([y for _, y in kept]))]
                if len(kept[0][0]) > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(kept[0][0]), pa.array(kept[0][1])], ["a", "b"])
                    kept = []
                size = sum(len(x) for x, _ in kept)
        if kept:
            x, y = local_forest(np.concatenate([x for x, _ in kept]), np.concatenate([y for _, y in kept]))
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    now = written(now.mapInArrow(released(contract), "a long, b long").distinct())
    before = None
    for _ in range(most_rounds):
        # large-star: every larger neighbour of a node meets the smallest of the node's neighbourhood
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = written(large.mapInArrow(released(contract), "a long, b long").distinct())
        # small-star: a node and its smaller neighbours meet the smallest of them
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b")))
        now = written(small.distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct().join(now.select(F.col("a").alias("node")), "node", "left_anti"))
