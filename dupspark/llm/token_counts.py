"""Token counts: a vectorised scan for end-of-document ids in flat token files, stitched across blocks by a prefix scan."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, work_folder, written

#: Bytes of a block; a file is read in as many tasks as it has blocks.
BLOCK = 8 << 20


def opened(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of a URI; Hadoop's file:/x is file:///x."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def token_counts(spark: SparkSession, folder: str, separator: int, width: int = 2, block: int = BLOCK) -> DataFrame:
    """(file, nth, first, n_tokens) of every document in the flat files of a folder: little-endian ids of `width` bytes, no index.

    A document ends before its separator; tokens after the last separator are a document too, if there are any. Two
    separators in a row hold an empty document; an empty file has none. nth counts from 0 in each file, first is the
    document's place in ids. A block tells its own separators; the running maximum of their places and the running sum
    of their number, over the blocks before, are all that the next block needs, so one file's window sorts two numbers
    a block; the separators themselves are joined to them after.
    """
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "path", (F.col("length") / width).cast("long").alias("ids"))
    each = max(1, block // width)
    blocks = files.where("ids > 0").select("file", "path", "ids", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("ids") - 1) / each))).alias("block"))

    def scan(batches):
        for batch in batches:
            seps = []
            for path, n, k in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                fs, name = opened(path)
                with fs.open_input_file(name) as f:
                    f.seek(k * each * width)
                    ids = np.frombuffer(f.read(min(each, n - k * each) * width), f"<u{width}")
                seps.append(np.flatnonzero(ids == separator) + k * each)
            ends = np.cumsum([0, *(len(s) for s in seps)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*seps, np.zeros(0, np.int64)]).astype(np.int64)))
            top = pa.array([int(s[-1]) if len(s) else None for s in seps], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array([len(s) for s in seps], pa.int64()), top, lists], ["file", "ids", "block", "n", "top", "seps"])

    found = written(blocks.repartition(F.col("file"), F.col("block")).mapInArrow(scan, "file string, ids long, block long, n long, top long, seps array<long>"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    n0, last = F.coalesce(F.sum("n").over(before), F.lit(0)), F.coalesce(F.max("top").over(before), F.lit(-1).cast("long"))
    stitched = found.select("file", "block", n0.alias("n0"), last.alias("last"))
    found = found.select("file", "block", "ids", "seps").join(stitched, ["file", "block"])
    is_last = F.col("block") == F.floor((F.col("ids") - 1) / each)
    tail = is_last & (F.coalesce(F.array_max("seps"), F.col("last")) < F.col("ids") - 1)
    ends = F.when(tail, F.concat("seps", F.array("ids"))).otherwise(F.col("seps"))
    docs = found.withColumn("ends", ends).select("file", "n0", "last", "ends", F.posexplode("ends").alias("k", "end"))
    first = F.when(F.col("k") == 0, F.col("last")).otherwise(F.get("ends", F.col("k") - 1)) + 1
    return docs.select("file", (F.col("n0") + F.col("k")).cast("long").alias("nth"), first.alias("first"), (F.col("end") - first).alias("n_tokens"))


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, pattern: str, separator: int, width: int = 2) -> DataFrame:
    """Writes one flat token file a task below folder, a separator after each text; returns (file, nth, doc_id), written too.

    A task writes under a name of its own attempt and renames at its end, so a task that runs again leaves the same file.
    Null text is an empty document. The separator must be no token's id, and all ids must fit in `width` bytes.
    """
    bounded_batches(docs.sparkSession)
    with open(vocabulary, "rb") as lines:
        known = {int(line.split()[1]) for line in lines}
    if separator in known or max([separator, *known]) >= 1 << 8 * width:
        raise ValueError(f"separator {separator} is a token, or an id needs over {width} bytes")

    def run(batches):
        import base64

        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}.bin"
        fs, top = opened(folder)
        fs.create_dir(top, recursive=True)
        draft, n = f"{top}/.{name}.{task.taskAttemptId()}", 0
        with fs.open_output_stream(draft) as out:
            for batch in batches:
                for text in batch.column(1).to_pylist():
                    out.write(np.array([*coder.encode_ordinary(text or ""), separator], f"<u{width}").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([name] * batch.num_rows, pa.string()), pa.array(np.arange(n, n + batch.num_rows)), batch.column(0)], ["file", "nth", "doc_id"])
                n += batch.num_rows
        if n:
            if fs.get_file_info(f"{top}/{name}").type != pyarrow.fs.FileType.NotFound:  # of an attempt before; not every store moves onto a file
                fs.delete_file(f"{top}/{name}")
            fs.move(draft, f"{top}/{name}")
        else:
            fs.delete_file(draft)

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "file string, nth long, doc_id long"))


def document_token_counts(docs: DataFrame, vocabulary: str, pattern: str, separator: int = 50256) -> DataFrame:
    """doc_id, n_tokens, file, nth, first of every row of docs(doc_id, text), counted in flat token files made from it.

    Null and empty texts have 0 tokens. Repeated rows are documents of their own. An empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = work_folder(spark)
    names = write_tokens(docs, folder, vocabulary, pattern, separator)
    if names.isEmpty():
        return spark.createDataFrame([], "doc_id long, n_tokens long, file string, nth long, first long")
    return names.hint("merge").join(token_counts(spark, folder, separator), ["file", "nth"]).select("doc_id", "n_tokens", "file", "nth", "first")
