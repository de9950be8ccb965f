"""Archive members as rows: tar in its compressions, zip, and single compressed files."""

from __future__ import annotations

import bz2
import contextlib
import gzip
import io
import lzma
import tarfile
import zipfile
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..options import ARCHIVES
from ..operators.rules import java_regex

#: What reading an archive or a file may raise.
UNREADABLE = (ValueError, OSError, EOFError, RuntimeError, NotImplementedError, zlib.error, lzma.LZMAError, tarfile.TarError, zipfile.BadZipFile)
#: Formats of a single compressed file by their ending.
SINGLE = {".gz": gzip.open, ".bz2": bz2.open, ".xz": lzma.open}


def members_of(path: str, content: bytes):
    """(name, bytes) of each regular member; raises ValueError for what is no archive that can be read here."""
    stream = io.BytesIO(content)
    if zipfile.is_zipfile(stream):
        with zipfile.ZipFile(stream) as z:
            yield from ((i.filename, z.read(i)) for i in z.infolist() if not i.is_dir())
        return
    stream.seek(0)
    try:
        with tarfile.open(fileobj=stream) as t:
            yield from ((m.name, t.extractfile(m).read()) for m in t if m.isfile())
        return
    except tarfile.ReadError:
        pass
    name = path.rsplit("/", 1)[-1]
    for ending, opener in ((".gz", gzip.decompress), (".bz2", bz2.decompress), (".xz", lzma.decompress)):
        if name.endswith(ending):
            yield name[: -len(ending)], opener(content)
            return
    raise ValueError("not an archive of a known format")


def told(e: Exception) -> str:
    return f"{type(e).__name__}: {getattr(e, 'strerror', None) or e}"


def open_file(path: str) -> BinaryIO:
    """Every file of a search is opened here."""
    return open(path, "rb")


def single(path: str):
    """The opener of a single compressed file and the name of its member."""
    name = path.rsplit("/", 1)[-1]
    for ending, opener in SINGLE.items():
        if name.endswith(ending):
            return opener, name[: -len(ending)]
    raise ValueError("not an archive of a known format")


@contextlib.contextmanager
def tar_of(f: BinaryIO) -> Iterator[tarfile.TarFile | None]:
    """An open file as a tar, None if it is none; what is read of it is forgotten."""
    f.seek(0)
    try:
        t = tarfile.open(fileobj=f, mode="r:*")
    except tarfile.ReadError:
        f.seek(0)
        yield None
        return
    with t:
        yield t


def listed(path: str, kind: str, hasher: Callable) -> Iterator[tuple[str, int, int, str | None]]:
    """(name, nth, size, h) of an archive's regular members, the archive opened once. h is null for a zip, whose directory is all that is read; other archives are read through, a piece at a time."""

    def hashed(stream: BinaryIO) -> tuple[int, str]:
        state, size = hasher(kind), 0
        while part := stream.read(1 << 20):
            state.update(part)
            size += len(part)
        return size, state.hexdigest()

    with open_file(path) as f:
        if zipfile.is_zipfile(f):
            with zipfile.ZipFile(f) as z:
                yield from ((i.filename, n, i.file_size, None) for n, i in enumerate(z.infolist()) if not i.is_dir())
            return
        with tar_of(f) as t:
            if t is not None:
                n = 0
                while (m := t.next()) is not None:
                    if m.isfile():
                        size, h = hashed(t.extractfile(m))
                        yield m.name, n, size, h
                    n += 1
                    t.members = []  # else the headers of all members stay in memory
                return
        opener, name = single(path)
        with opener(f) as stream:
            size, h = hashed(stream)
        yield name, 0, size, h


@contextlib.contextmanager
def member_stream(path: str, f: BinaryIO, nth: int) -> Iterator[BinaryIO]:
    """The nth member of an open archive as a stream: a zip's by its place, a tar's after those before it."""
    if zipfile.is_zipfile(f):
        with zipfile.ZipFile(f) as z, z.open(z.infolist()[nth]) as stream:
            yield stream
        return
    with tar_of(f) as t:
        if t is not None:
            for _ in range(nth):
                t.next()
                t.members = []
            yield t.extractfile(t.next())
            return
    with single(path)[0](f) as stream:
        yield stream


def expand(archives: DataFrame) -> DataFrame:
    """(path, subpath, size, content, error) of archives(path, content): a row a member, and one with the error where reading ends early."""

    kinds = (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string())

    def row(*values):
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["path", "subpath", "size", "content", "error"])

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:  # a member at a time; those before an error stay
                    for name, data in members_of(path, content):
                        yield row(path, name, len(data), data, None)
                except UNREADABLE as e:
                    yield row(path, None, None, None, f"{type(e).__name__}: {e}")

    return archives.select("path", "content").mapInArrow(run, "path string, subpath string, size long, content binary, error string")


def packed(rows: DataFrame, path: str, name: str, content: str) -> DataFrame:
    """(path, content): a zip archive of each path's rows, members ordered by name; null content is an empty member. An archive is built in one task."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        stream = io.BytesIO()
        with zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED) as z:
            for n, c in sorted(zip(part["name"], part["content"], strict=True)):
                z.writestr(zipfile.ZipInfo(n), c)
        return pd.DataFrame({"path": part["path"].iloc[:1], "content": [stream.getvalue()]})

    named = rows.select(F.col(path).cast("string").alias("path"), F.coalesce(F.col(name).cast("string"), F.lit("null")).alias("name"), F.coalesce(F.col(content).cast("binary"), F.lit(b"")).alias("content"))
    return named.groupBy("path").applyInPandas(run, "path string, content binary")


def read_archives(spark: SparkSession, *paths: str) -> DataFrame:
    """Members of the archives at paths, told by their names."""
    files = spark.read.format("binaryFile").load(list(paths)).where(F.col("path").rlike(java_regex(ARCHIVES, True)))
    return expand(files)


def member(archives: DataFrame, name: str) -> DataFrame:
    """The members of exactly this name; none is an empty frame."""
    return expand(archives).where(F.col("subpath") == name)
