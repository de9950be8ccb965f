"""Entries of a search, plain files and archive members: read as streams, hashed and compared a piece at a time."""

from __future__ import annotations

import contextlib
import hashlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from ..workspace import stored
from . import archives

#: Bytes that are read at a time; bytes of a file that one task compares; entries that are open at once; entries of a task.
PIECE, SPAN, TOGETHER, EACH = 1 << 20, 1 << 30, 128, 64

KEY = ("path", "subpath", "nth")


def hasher(kind: str):
    """A digest of the kind, fed by update()."""
    import xxhash

    return xxhash.xxh3_128() if kind == "xxh128" else hashlib.new(kind)


@contextlib.contextmanager
def opened(path: str, nth: int | None = None) -> Iterator[BinaryIO]:
    """A plain file, or the nth member of an archive, as a stream."""
    with archives.open_file(path) as f:
        if nth is None:
            yield f
        else:
            with archives.member_stream(path, f, nth) as inside:
                yield inside


def spread(rows: DataFrame, tasks: int | None = None) -> DataFrame:
    """Rows dealt evenly: to so many tasks, or a few dozen rows each."""
    return rows.repartition(tasks or max(1, -(-rows.count() // EACH)))


def with_hash(entries: DataFrame, kind: str = "md5", piece: int = PIECE) -> DataFrame:
    """entries(path, nth, ...) beside h and error, each opened once: contents never travel, and none has to fit in memory. An entry that can't be read has a null h and says why."""
    schema = StructType([*entries.schema.fields, StructField("h", StringType()), StructField("error", StringType())])

    def one(path: str, nth: int | None) -> tuple[str | None, str | None]:
        state = hasher(kind)
        try:
            with opened(path, nth) as f:
                while part := f.read(piece):
                    state.update(part)
        except archives.UNREADABLE as e:
            return None, archives.told(e)
        return state.hexdigest(), None

    def run(batches):
        for batch in batches:
            found = [one(p, n) for p, n in zip(batch.column("path").to_pylist(), batch.column("nth").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([h for h, _ in found], pa.string()), pa.array([e for _, e in found], pa.string())], [*batch.schema.names, "h", "error"])

    return entries.mapInArrow(run, schema)


def members(packed: DataFrame, kind: str = "md5") -> DataFrame:
    """(path, subpath, nth, size, h, error) of the members of archives(path). A zip's directory tells its members, whose h is null as yet, so that tasks can share them; a tar is read in one go and hashed on the way."""
    schema = "path string, subpath string, nth int, size long, h string, error string"
    names = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                try:
                    for row in archives.listed(path, kind, hasher):
                        rows.append((path, *row, None))
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), names, strict=True)], schema=names)
                            rows = []
                except archives.UNREADABLE as e:  # the members before it stay
                    rows.append((path, None, None, None, None, archives.told(e)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), names, strict=True)], schema=names)

    return packed.select("path").mapInArrow(run, schema)


def same_as_first(first: tuple, others: list[tuple], begin: int, span: int, piece: int) -> list[bool | None]:
    """For each entry whether its bytes from begin on, at most span of them, are the first one's; None if it can't be read. All are open at once and read side by side."""
    out: list[bool | None] = [True] * len(others)
    with contextlib.ExitStack() as stack:

        def start(path, nth):
            f = stack.enter_context(opened(path, nth))
            f.seek(begin)
            return f

        try:
            lead = start(first[0], first[2])
        except archives.UNREADABLE:
            return [None] * len(others)
        open_ones = {}
        for k, other in enumerate(others):
            if other != first:
                try:
                    open_ones[k] = start(other[0], other[2])
                except archives.UNREADABLE:
                    out[k] = None
        left = span
        while left > 0 and open_ones:
            try:
                want = lead.read(min(piece, left))
            except archives.UNREADABLE:
                return [None] * len(others)
            left -= len(want) or left
            for k, f in list(open_ones.items()):
                try:
                    out[k] = f.read(len(want) or 1) == want
                except archives.UNREADABLE:
                    out[k] = None
                if not out[k]:
                    del open_ones[k]
    return out


def verified(entries: DataFrame, together: int = TOGETHER, span: int = SPAN, piece: int = PIECE) -> DataFrame:
    """entries(path, subpath, nth, size, h, ...) of the sets of equal size and h, told apart by their bytes.

    Entries of a set are compared with its smallest one, `together` at a time and `span` bytes a task; each is opened once for a span,
    and no content leaves its task. What differs from the smallest one is a set of its own, whose smallest entry has its path
    appended to h, and is compared in another round; there is one round unless a digest has collided. Entries that can't
    be read any more leave their set.
    """
    rest, parts, later = entries, [], False
    while True:
        key = F.struct(*KEY)
        sets = rest.groupBy("size", "h").agg(F.count("*").alias("n"), F.min(key).alias("first")).where("n > 1")
        work = stored(rest.join(sets, ["size", "h"]))
        dealt = work.withColumn("part", F.pmod(F.xxhash64(*KEY), F.ceil(F.col("n") / together)))
        groups = dealt.groupBy("size", "h", "part").agg(F.min("first").alias("first"), F.collect_list(key).alias("others"))
        spans = groups.select("first", "others", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("size") / span) - 1, F.lit(0)))).alias("k"))
        found = stored(spread(spans).mapInArrow(comparing(span, piece), "path string, subpath string, nth int, same boolean"))
        told = found.groupBy(*[F.col(c).alias(f"_{c}") for c in KEY]).agg(F.bool_and("same").alias("same"), F.count_if(F.col("same").isNull()).alias("lost"))
        on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in KEY]
        judged = stored(work.join(told, on).where("lost = 0"))
        named = F.concat("h", F.lit(" "), "first.path") if later else F.col("h")
        parts.append(judged.where("same").withColumn("h", named).select(*entries.columns))
        rest, later = judged.where("not same").select(*entries.columns), True
        if rest.isEmpty():
            break
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def comparing(span: int, piece: int):
    def run(batches):
        for batch in batches:
            for first, others, k in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                first, others = tuple(first.values()), [tuple(o.values()) for o in others]
                same = same_as_first(first, others, k * span, span, piece)
                columns = [pa.array(c, t) for c, t in zip(zip(*others, strict=True), (pa.string(), pa.string(), pa.int32()), strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(same, pa.bool_())], [*KEY, "same"])

    return run
