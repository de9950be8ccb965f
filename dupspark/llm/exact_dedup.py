"""Exact dedup against a persistent digest index, bucketed and sorted by hash. DataFrame functions only."""

from __future__ import annotations

import hashlib
import string
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import plain_names, work_folder, written

#: Groups of more than HOT rows, or of more than one in BROADCAST rows of a table, are joined by broadcast: fewer than BROADCAST of some 60 bytes.
HOT, BROADCAST = 256, 1 << 18


def text_digest(text: Column) -> Column:
    """SHA-256 (32 bytes) of the text with A-Z lower-cased and nothing else; null counts as empty."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.unhex(F.sha2(lowered.cast("binary"), 256))


class DigestIndex:
    """Digests in a folder, (digest, keep_id, keep_row, n, batch, first), bucketed and sorted by digest, that outlive the session.

    A batch adds a row for each of its digests; `first` tells the batch that brought the digest, whose row stays, and n
    counts the batch's rows of it. The folder says by itself how many buckets it has, so a later session finds it by its
    path; nothing there is ever overwritten. A batch counts once an attempt to add it is noted as done, one row a batch beside the
    folder; what an attempt that failed midway left there is never read. buckets should grow with the corpus: about one for each 10 million texts.
    """

    SCHEMA = "digest BINARY, keep_id BIGINT, keep_row BIGINT, n BIGINT, batch STRING, first BOOLEAN, attempt STRING"

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 48):
        self.spark, self.path = spark, (path or work_folder(spark)).rstrip("/")
        self.table = f"digest_index_{hashlib.md5(self.path.encode()).hexdigest()}"
        about = self.notes("about", "buckets int")
        self.buckets = about.first().buckets if about is not None else buckets
        if about is None:
            self.note("about", buckets=buckets)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.table} ({self.SCHEMA}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")

    def notes(self, kind: str, schema: str) -> DataFrame | None:
        """What is noted beside the folder, None if nothing is."""
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}.{kind}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def note(self, kind: str, **values) -> None:
        self.spark.range(1).select(*[F.lit(v).alias(n) for n, v in values.items()]).write.mode("append").parquet(f"{self.path}.{kind}")

    def rows(self) -> DataFrame:
        """The rows of all batches that were added to the end."""
        done = self.notes("done", "batch string, attempt string")
        rows = self.spark.table(self.table)
        return rows.limit(0) if done is None else rows.join(F.broadcast(done), ["batch", "attempt"], "left_semi").select(*rows.columns)

    def digests(self, digests: DataFrame, run: str | None) -> tuple[str, DataFrame]:
        """The run's name and its digests, those of its first attempt if this isn't the first: rows keep their numbers. Without a name, the run of equal digests and ids is the same."""
        if run is None:
            f = digests.agg(F.count("*").alias("n"), F.sum(F.xxhash64("doc_id", "digest").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64(F.lit(1), "digest", "doc_id")).alias("x")).first()
            run = hashlib.md5(f"{f.n} {f.s} {f.x}".encode()).hexdigest()
        runs = self.notes("runs", "run string, folder string")
        first = runs.where(F.col("run") == run).orderBy("folder").head() if runs is not None else None
        if first is None:
            self.note("runs", run=run, folder=digests.inputFiles()[0].rsplit("/", 1)[0] if digests.inputFiles() else "")
            return run, digests
        return run, self.spark.read.schema(digests.schema).parquet(first.folder) if first.folder else digests

    def append(self, groups: DataFrame, batch: str) -> None:
        """Adds a batch's groups (digest, keep_id, keep_row, n). The anti-join by sort-merge finds the new digests; of the others only
        n counts. A batch whose name is there already, such as that of a job that runs again, isn't added a second time."""
        done = self.notes("done", "batch string, attempt string")
        if done is not None and not done.where(F.col("batch") == batch).isEmpty():
            return
        attempt = uuid.uuid4().hex
        known = self.rows().where("first").select("digest").hint("merge")
        fresh, again = groups.join(known, "digest", "left_anti").withColumn("first", F.lit(True)), groups.join(known, "digest", "left_semi").withColumn("first", F.lit(False))
        rows = fresh.unionByName(again).select("digest", "keep_id", "keep_row", "n", F.lit(batch).alias("batch"), "first", F.lit(attempt).alias("attempt")).repartition(self.buckets, "digest")
        rows.write.mode("append").format("parquet").option("path", self.path).bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table)
        self.spark.catalog.refreshTable(self.table)
        self.note("done", batch=batch, attempt=attempt)

    def groups(self) -> DataFrame:
        """(digest, keep_id, keep_row, batch, group_size) of every text: who stays, and the rows of all batches. The buckets hold a digest's rows together already."""
        own = lambda c: F.max(F.when(F.col("first"), F.col(c))).alias(c)
        return self.rows().groupBy("digest").agg(own("keep_id"), own("keep_row"), own("batch"), F.sum("n").alias("group_size"))

    def close(self) -> None:
        """Takes the table's name out of the catalog; the folder stays."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def groups_of(digests: DataFrame) -> DataFrame:
    """One row a digest: the largest doc_id, the first row that has it, the number of rows. Combined before the shuffle, so a hot text is one row a task."""
    last = F.max(F.struct("doc_id", (-F.col("row")).alias("row")))
    return digests.groupBy("digest").agg(last.alias("last"), F.count("*").alias("n")).select("digest", F.col("last.doc_id").alias("keep_id"), (-F.col("last.row")).alias("keep_row"), "n")


def fill(index: DigestIndex, digests: DataFrame, batches: int, run: str) -> list[str]:
    """Appends digests(row, doc_id, digest) in batches of descending ids, null last, so that the batch that brings a text has its largest id. Returns their names."""
    ends = digests.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    names = [f"{run}-{k}" for k in range(batches)]
    low, high = ends.lo or 0, ends.hi or 0
    floors = [low + (high - low) * (batches - 1 - k) // batches for k in range(batches - 1)]
    number = F.lit(batches - 1)
    for k in reversed(range(batches - 1)):
        number = F.when(F.col("doc_id") > floors[k], k).otherwise(number)
    for k, name in enumerate(names):
        index.append(groups_of(digests.where(number == k)), name)
    return names


def beside_groups(rows: DataFrame, groups: DataFrame, total: int, staying: bool = False, twice: bool = False) -> DataFrame:
    """rows(digest, ...) beside the columns of groups; if staying, only the rows with the group's keep_id, and one of them if there may be two. Large groups are few: they are broadcast and their rows stay where they are; all others meet by sort-merge join."""
    large = F.col("group_size") > max(HOT, total // BROADCAST)
    names = [c for c in groups.columns if c != "digest"]
    marked = rows.join(F.broadcast(groups.where(large).select("digest", F.struct(*names).alias("_g"))), "digest", "left")
    many = marked.where("_g is not null").select(*rows.columns, "_g.*")
    rest = marked.where("_g is null").drop("_g").join(groups.where(~large).hint("merge"), "digest").select(*rows.columns, *names)
    out = many.unionByName(rest)
    if staying:
        out = out.where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return out.dropDuplicates(["digest"]) if twice else out


def entered(spark: SparkSession, digests: DataFrame, index: DigestIndex | None, batches: int, run: str | None) -> tuple[DigestIndex, DataFrame, list[str]]:
    """The index, a new one if none is given, with the digests in it; the digests as their run knows them; the names of its batches."""
    own = index or DigestIndex(spark)
    run, digests = own.digests(digests, run) if index else (uuid.uuid4().hex, digests)
    return own, digests, fill(own, digests, batches, run)


def exact_groups(docs: DataFrame, index: DigestIndex | None = None, batches: int = 2, run: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs(doc_id, text).

    Texts are equal if identical after lower-casing A-Z; the largest doc_id stays. Null text is an empty text. Rows
    with null doc_id count in their group and stay only if no row there has an id; of rows that repeat both text and the
    largest id, one stays. With an index of earlier runs, texts that it has stay there, and group_size counts their rows
    too. The rows enter the index in batches, those of larger ids first. A run that comes again, after a crash or
    after it ended, finds its rows and gives the same answer; run names it, and without a name rows of the same ids and texts
    are the same run. An empty table gives no rows; other columns of docs are not read.
    """
    spark = docs.sparkSession
    digests = written(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_digest(F.col("text")).alias("digest")))
    own, digests, names = entered(spark, digests, index, batches, run)
    groups = written(own.groups())
    if index is None:
        own.close()
    kept = F.col("batch").isin(names) & (F.col("row") == F.col("keep_row"))
    out = beside_groups(digests, groups, digests.count()).withColumn("kept", kept)
    return out.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, index: DigestIndex | None = None, batches: int = 2, run: str | None = None) -> DataFrame:
    """docs without the rows whose text stays elsewhere, all columns kept; rules as in exact_groups, nulls, repeated rows, runs that come again and empty tables too."""
    spark = docs.sparkSession
    plain, at = plain_names(docs)
    rows = plain.select("*", F.col(at["doc_id"]).cast("long").alias("doc_id"), text_digest(F.col(at["text"])).alias("digest"))
    digests = written(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "digest"))
    own, digests, names = entered(spark, digests, index, batches, run)
    groups = written(own.groups().where(F.col("batch").isin(names)).select("digest", "keep_id", "group_size"))
    if index is None:
        own.close()
    twice = not digests.groupBy("digest", "doc_id").count().where("count > 1").isEmpty()  # else texts need no second shuffle
    out = beside_groups(rows, groups, digests.count(), True, twice)
    return out.select(*[F.col(n).alias(c) for c, n in at.items()])


EXACT_SQL = """
WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)
"""
