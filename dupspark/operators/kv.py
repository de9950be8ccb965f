"""A key-value table with snapshots: a sorted base and delta files, merged on read, behind an atomically published manifest."""

from __future__ import annotations

import bisect
import functools
import json
import os
import socket
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

#: The column that marks a key as taken away in delta files; deltas of a version before they are merged; largest share of a base's files that is read apart from the rest; files of a base up to which it is.
DEAD, MOST_DELTAS, APART, MOST_FILES = "_tombstone", 8, 0.5, 10_000


class KeyExists(ValueError):
    """An insert met a key that is there."""


class Locked(RuntimeError):
    """Another writer holds the table."""


class NotFound(KeyError):
    """A key is missing."""


class Files:
    """The few file-system calls that a table needs, on any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        p = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a file that must not be there yet; False if it is."""
        try:
            stream = self.fs.create(self.path(name), False)
        except Exception as e:
            if "AlreadyExists" in str(e):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def rename(self, old: str, new: str) -> bool:
        return not self.fs.exists(self.path(new)) and self.fs.rename(self.path(old), self.path(new))

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def claim(self, folder: str, lease: float) -> int:
        """Takes the lock of a folder and returns its token, a number that grows with every taker; raises Locked while another holds it.

        The newest token tells the holder. It is void once given back, once its process on this host is gone, or once its
        lease has ended; then the next number is free, and its file can be created by one taker only.
        """
        last = self.token(folder)
        if last and not self.void(folder, last, lease):
            raise Locked(self.root)
        mine = json.dumps({"host": socket.gethostname(), "pid": os.getpid(), "until": time.time() + lease, "id": uuid.uuid4().hex})
        if not self.create(f"{folder}/{last + 1:012d}.json", mine):
            raise Locked(self.root)
        for n in self.names(folder):  # what holders before the last one left
            if n[:12].isdigit() and int(n[:12]) < last:
                self.delete(f"{folder}/{n}")
        return last + 1

    def token(self, folder: str) -> int:
        """The newest token that anybody took, 0 if none."""
        return max((int(n[:12]) for n in self.names(folder) if n[:12].isdigit()), default=0)

    def void(self, folder: str, token: int, lease: float) -> bool:
        name = f"{folder}/{token:012d}.json"
        if f"{token:012d}.done" in self.names(folder):
            return True
        try:
            theirs = json.loads(self.read(name))
            return theirs["until"] < time.time() or theirs["host"] == socket.gethostname() and not alive(theirs["pid"])
        except (ValueError, KeyError):  # being written just now, or left half written: its age decides
            return self.fs.getFileStatus(self.path(name)).getModificationTime() / 1000 + lease < time.time()

    def release(self, folder: str, token: int) -> None:
        self.create(f"{folder}/{token:012d}.done", "")


def alive(pid: int) -> bool:
    try:
        os.kill(pid, 0)
    except ProcessLookupError:
        return False
    except PermissionError:
        pass
    return True


def as_json(key):
    """A key as JSON holds it, in an order that Python and Spark agree on; None for types whose order isn't kept."""
    if isinstance(key, bool):
        return None
    if isinstance(key, (int, str)):
        return key
    return {"hex": bytes(key).hex()} if isinstance(key, (bytes, bytearray)) else None


def from_json(key):
    return bytes.fromhex(key["hex"]) if isinstance(key, dict) else key


def touched(files: list[dict], others: list[dict]) -> list[bool]:
    """Which of files have a key range that meets a range of others; a range that isn't known meets all."""
    ranges = [(from_json(f["low"]), from_json(f["high"])) for f in others]
    if any(lo is None for lo, _ in ranges):
        return [True] * len(files)
    ranges.sort()
    lows, tops = [lo for lo, _ in ranges], []
    for _, hi in ranges:
        tops.append(hi if not tops or hi > tops[-1] else tops[-1])
    out = []
    for f in files:
        lo, hi = from_json(f["low"]), from_json(f["high"])
        n = len(ranges) if lo is None else bisect.bisect_right(lows, hi)
        out.append(lo is None or n > 0 and tops[n - 1] >= lo)
    return out


class SnapshotTable:
    """Rows keyed by one column; readers pin a version, one writer at a time publishes the next.

    A version's manifest names its runs: a base of Parquet files sorted by key, and delta files above it, each with the
    rows that a commit put or replaced and the keys that it took away. A commit writes what it changes and no more. A
    read merges: base files whose key range meets no delta are scanned as they are, the others leave out the keys of
    deltas, whose newest rows join them. Statistics and bloom filters of the key let a lookup or a range skip files and
    row groups in all of them. After MOST_DELTAS commits deltas are merged into one or, once they weigh a
    quarter of the base, into a new base, so a row is rewritten a bounded number of times as the table grows fourfold.

    A writer holds a lock with a token that grows; a run is named after it. The manifest of the next version is put in place only if
    that version isn't there and no newer token was taken, so of two writers that both took an expired lease for theirs one publishes.
    The highest manifest whose runs are complete is the table. Nothing in a published run ever changes.
    """

    def __init__(self, spark: SparkSession, root: str, schema: StructType | str, key: str = "k", partitions: int | None = None, lease: float = 86400.0, most_deltas: int = MOST_DELTAS):
        self.spark, self.key, self.files, self.partitions, self.lease, self.most_deltas = spark, key, Files(spark, root), partitions, lease, most_deltas
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        if DEAD in self.schema.names:
            raise ValueError(f"{DEAD} is a name of the table's own")
        self.stored = StructType([*(StructField(f.name, f.dataType) for f in self.schema), StructField(DEAD, BooleanType())])

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names("manifests") if n.endswith(".json") and not n.startswith(".") and self.manifest(int(n[:-5]))]

    def manifest(self, version: int) -> dict | None:
        """What a version consists of, None where its manifest is torn or a run isn't complete."""
        name = f"{version:012d}.json"
        if name not in self.files.names("manifests"):
            return None
        try:
            told = json.loads(self.files.read(f"manifests/{name}"))
            complete = told["version"] == version and all("_SUCCESS" in self.files.names(f"data/{r['folder']}") for r in told["runs"])
        except (ValueError, KeyError, TypeError):
            return None
        return told if complete else None

    def live(self) -> int:
        """The newest valid version, 0 for a table without one."""
        for n in sorted(self.files.names("manifests"), reverse=True):
            if n.endswith(".json") and not n.startswith(".") and self.manifest(int(n[:-5])):
                return int(n[:-5])
        return 0

    def following(self) -> int:
        """The number of the next version, above every manifest there is, torn ones too."""
        return 1 + max((int(n[:-5]) for n in self.files.names("manifests") if n.endswith(".json") and not n.startswith(".")), default=0)

    def runs(self, version: int) -> list[dict]:
        return (self.manifest(version) or {"runs": []})["runs"] if version else []

    def read(self, version: int | None = None) -> DataFrame:
        """A snapshot, the newest if no version is named; later commits don't reach it."""
        return self.merged(self.runs(self.live() if version is None else version))

    def scan(self, run: dict, files: list[dict] | None = None) -> DataFrame:
        """The rows of a run as they are stored, of some of its files if these are given."""
        top = f"{self.files.root}/data/{run['folder']}"
        return self.spark.read.schema(self.stored).parquet(*([top] if files is None else [f"{top}/{f['name']}" for f in files]))

    def newest(self, deltas: list[dict]) -> DataFrame:
        """One row a key of deltas in order of time, the last one's; taken away keys too."""
        if len(deltas) == 1:
            return self.scan(deltas[0])
        rest = [n for n in self.stored.names if n != self.key]
        both = functools.reduce(DataFrame.unionByName, [self.scan(d).select(self.key, F.struct(F.lit(n).alias("n"), F.struct(*rest).alias("r")).alias("s")) for n, d in enumerate(deltas)])
        return both.groupBy(self.key).agg(F.max_by("s.r", "s.n").alias("r")).select(self.key, "r.*").select(*self.stored.names)

    def merged(self, runs: list[dict]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        base, deltas = runs[0], [r for r in runs[1:] if r["files"]]
        if not deltas:
            return self.scan(base).select(*self.schema.names)
        met = touched(base["files"], [f for d in deltas for f in d["files"]])
        few = sum(met) <= APART * len(met) and len(met) <= MOST_FILES
        under = [f for f, m in zip(base["files"], met, strict=True) if m] if few else None
        keys = functools.reduce(DataFrame.unionByName, [self.scan(d).select(self.key) for d in deltas])
        parts = [self.newest(deltas).where(~F.col(DEAD))]
        if under is None or under:
            parts.append(self.scan(base, under).join(keys, self.key, "left_anti"))
        if few and not all(met):
            parts.append(self.scan(base, [f for f, m in zip(base["files"], met, strict=True) if not m]))
        return functools.reduce(DataFrame.unionByName, [p.select(*self.schema.names) for p in parts])

    def get(self, key) -> DataFrame:
        return self.read().where(F.col(self.key) == F.lit(key))

    @contextmanager
    def reader(self):
        """Pins the newest version: retention leaves it alone until the block ends."""
        while True:
            version = self.live()
            runs = self.runs(version)
            name = f"readers/{version:012d}-{uuid.uuid4().hex}"
            self.files.create(name, "")
            if version == 0 or self.manifest(version):  # else retention was faster
                break
            self.files.delete(name)
        try:
            yield self.merged(runs)
        finally:
            self.files.delete(name)

    def oldest_reader(self) -> int:
        """The smallest version that a reader has pinned, 0 if none."""
        return min((int(n.split("-")[0]) for n in self.files.names("readers") if n[0].isdigit()), default=0)

    @contextmanager
    def writer(self):
        """A write batch. It is published when the block ends well and left unpublished when it fails."""
        token = self.files.claim("writer", self.lease)
        try:
            self.clear(token)
            batch = Batch(self, token)
            yield batch
            if batch.commit() and len(self.runs(self.live())) > self.most_deltas + 1:
                self.merge(token)
        finally:
            self.files.release("writer", token)

    def write(self, rows: DataFrame, token: int, whole: bool) -> dict:
        """Rows as a new run, sorted and with bloom filters on the key; what a manifest says of it: files with their key ranges, rows, taken away keys, bytes."""
        folder = f"{token:012d}-{uuid.uuid4().hex}"
        top = f"{self.files.root}/data/{folder}"
        ordered = rows.repartitionByRange(self.partitions, self.key) if self.partitions and whole else rows.repartitionByRange(self.key)
        bloom = {f"parquet.bloom.filter.enabled#{self.key}": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
        ordered.sortWithinPartitions(self.key).write.options(**bloom).parquet(top)
        told = self.spark.read.schema(self.stored).parquet(top).groupBy(F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_size").alias("bytes"))
        told = told.agg(F.min(self.key).alias("low"), F.max(self.key).alias("high"), F.count("*").alias("rows"), F.count_if(DEAD).alias("dead")).collect()
        files = [{"name": r.name, "low": as_json(r.low), "high": as_json(r.high)} for r in sorted(told, key=lambda r: r.name)]
        return {"folder": folder, "files": files} | {n: sum(r[n] for r in told) for n in ("rows", "dead", "bytes")}

    def publish(self, version: int, base: int, runs: list[dict], token: int) -> None:
        """Puts the manifest of a version in place: only if nobody has put one there and no newer token was taken."""
        draft = f"manifests/.{uuid.uuid4().hex}"
        self.files.create(draft, json.dumps({"version": version, "base": base, "token": token, "runs": runs}))
        if self.files.token("writer") != token or not self.files.rename(draft, f"manifests/{version:012d}.json"):
            self.files.delete(draft)
            raise Locked(f"version {version} is another's")

    def merge(self, token: int, whole: bool | None = None) -> bool:
        """Publishes the newest version again with fewer runs: one base if whole, else one delta above the base; by itself, whole once deltas weigh a quarter of the base."""
        version, following = self.live(), self.following()
        runs = self.runs(version)
        if len(runs) < 2:
            return False
        if whole is None:
            whole = 4 * sum(r["bytes"] for r in runs[1:]) >= runs[0]["bytes"]
        if whole:
            kept = [self.write(self.merged(runs).withColumn(DEAD, F.lit(False)), token, True)]
        else:
            kept = [runs[0], self.write(self.newest([r for r in runs[1:] if r["files"]] or runs[1:2]), token, False)]
        self.publish(following, version, kept, token)
        return True

    def compact(self, whole: bool = True) -> bool:
        """merge() under the writer's lock; False if there was nothing to merge."""
        token = self.files.claim("writer", self.lease)
        try:
            return self.merge(token, whole)
        finally:
            self.files.release("writer", token)

    def retain(self, keep: int = 1) -> list[int]:
        """Deletes versions that are below both the newest `keep` and the oldest reader; returns them. Runs go with the last version that has them."""
        versions, oldest = self.versions(), self.oldest_reader()
        old = [v for v in versions[:-keep] if oldest == 0 or v < oldest] if keep else []
        runs = {r["folder"] for v in old for r in self.runs(v)}
        for v in old:
            self.files.delete(f"manifests/{v:012d}.json")
        if (late := self.oldest_reader()) and old and late <= old[-1]:  # pinned meanwhile; a later writer clears its runs
            return old
        for folder in runs - {r["folder"] for v in self.versions() for r in self.runs(v)}:
            self.files.delete(f"data/{folder}")
        return old

    def clear(self, token: int) -> None:
        """Deletes runs of older tokens that no version has: their writers can't publish any more. Nothing is deleted while a reader is there."""
        if self.files.names("readers"):
            return
        known = {r["folder"] for v in self.versions() for r in self.runs(v)}
        for folder in self.files.names("data"):
            if folder not in known and folder[:12].isdigit() and int(folder[:12]) < token:
                self.files.delete(f"data/{folder}")


class Batch:
    """Changes on top of the version that was live when the batch began: at most one row a key, put or taken away."""

    def __init__(self, table: SnapshotTable, token: int):
        self.table, self.token, self.following, self.base = table, token, table.following(), table.live()
        self.runs = table.runs(self.base)
        self.before, self.delta = table.merged(self.runs), None

    @property
    def rows(self) -> DataFrame:
        """The table as this batch leaves it so far."""
        if self.delta is None:
            return self.before
        key, names = self.table.key, self.table.schema.names
        return self.before.join(self.delta, key, "left_anti").select(*names).unionByName(self.delta.where(~F.col(DEAD)).select(*names))

    def change(self, rows: DataFrame, dead: bool) -> None:
        """Rows, one a key, stand above what the batch has changed before."""
        names = self.table.schema.names
        known = [F.col(n) if n in rows.columns else F.lit(None).cast(self.table.schema[n].dataType).alias(n) for n in names]
        rows = rows.select(*known, F.lit(dead).alias(DEAD))
        self.delta = rows if self.delta is None else self.delta.join(rows, self.table.key, "left_anti").select(*names, DEAD).unionByName(rows)

    def checked(self, changes: DataFrame) -> DataFrame:
        if [(f.name, f.dataType) for f in changes.schema] != [(f.name, f.dataType) for f in self.table.schema]:
            raise ValueError(f"schema {changes.schema.simpleString()} is not {self.table.schema.simpleString()}")
        if not changes.where(F.col(self.table.key).isNull()).isEmpty():
            raise ValueError("a key is null")
        return changes

    def insert(self, changes: DataFrame) -> None:
        """Adds rows; a key that is there, or twice in the changes, raises KeyExists."""
        key = self.table.key
        changes = self.checked(changes)
        twice = changes.groupBy(key).count().where("count > 1").select(key).unionByName(changes.join(self.rows, key, "left_semi").select(key))
        if found := twice.head():
            raise KeyExists(found[0])
        self.change(changes, False)

    def upsert(self, changes: DataFrame) -> None:
        """Adds or replaces rows, without a look at the table; of repeated keys in the changes the largest row wins."""
        key, rest = self.table.key, [f.name for f in self.table.schema if f.name != self.table.key]
        self.change(self.checked(changes).groupBy(key).agg(F.max(F.struct(*rest)).alias("r")).select(key, "r.*") if rest else self.checked(changes).distinct(), False)

    def delete(self, keys: DataFrame) -> DataFrame:
        """Takes the keys away; returns those that weren't there, a null one among them."""
        key = self.table.key
        keys, rows = keys.select(key).distinct(), self.rows
        missing = keys.join(rows, key, "left_anti")
        self.change(keys.join(rows, key, "left_semi"), True)
        return missing

    def keep(self, keys: DataFrame) -> None:
        """Takes all other keys away."""
        key = self.table.key
        self.change(self.rows.select(key).join(keys.select(key), key, "left_anti"), True)

    def commit(self) -> bool:
        """Writes what changed and publishes the next version; False if nothing was asked for."""
        if self.delta is None:
            return False
        t = self.table
        if self.runs:
            run = t.write(self.delta, self.token, False)
        else:
            run = t.write(self.delta.where(~F.col(DEAD)), self.token, True)
        t.publish(self.following, self.base, [*self.runs, run], self.token)
        self.delta = None
        return True
