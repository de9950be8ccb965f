"""A cache of file hashes on a snapshot table: lookups, upserts, and removal of what a scan no longer sees."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from .kv import SnapshotTable

SCHEMA = "path string, mtime timestamp, ctime timestamp, size bigint, h string"


class HashCache:
    """path -> (mtime, ctime, size, h). One process at a time may open it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.table = spark, SnapshotTable(spark, root, SCHEMA, "path")
        self.visited: DataFrame | None = None

    @contextmanager
    def opened(self):
        """Holds the cache for this process; a second opening raises Locked until it is closed."""
        mine = self.table.files.claim("open", self.table.lease)
        try:
            yield self
        finally:
            self.table.files.release("open", mine)

    def lookup(self, files: DataFrame) -> DataFrame:
        """files(path) beside the cached columns, null where the cache has nothing."""
        known = self.table.read().select("path", *[F.col(c).alias(f"cached_{c}") for c in ("mtime", "ctime", "size", "h")])
        return files.join(known, "path", "left")

    def fresh(self, files: DataFrame) -> DataFrame:
        """files(path, mtime, ctime, size) beside h where all three agree with the cache. The rule is this library's own."""
        same = (F.col("cached_mtime") == F.col("mtime")) & (F.col("cached_ctime") == F.col("ctime")) & (F.col("cached_size") == F.col("size"))
        return self.lookup(files).select(*files.columns, F.when(same, F.col("cached_h")).alias("h"))

    def upsert(self, rows: DataFrame) -> None:
        with self.table.writer() as batch:
            batch.upsert(rows.select("path", "mtime", "ctime", "size", "h"))

    def mark(self, files: DataFrame) -> None:
        """Notes the paths of a scan; marking a path again changes nothing."""
        paths = files.select("path").distinct()
        self.visited = paths if self.visited is None else self.visited.unionByName(paths).distinct()

    def sweep(self) -> None:
        """Keeps the marked paths alone, then forgets the marks."""
        marked = self.visited if self.visited is not None else self.spark.createDataFrame([], "path string")
        with self.table.writer() as batch:
            batch.keep(marked)
        self.visited = None
