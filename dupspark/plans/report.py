"""Reports of duplicate sets: text and JSON, made of rows that Spark has already ordered."""

from __future__ import annotations

import json
import textwrap
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import iso_utc
from ..functions.sizes import human_size


def shown_path(separator: str = "\n") -> Column:
    """path, or path:subpath for a member of an archive; path|subpath where a colon separates the entries."""
    joint = "|" if separator == ":" else ":"
    return F.when(F.col("subpath").isNotNull(), F.concat("path", F.lit(joint), "subpath")).otherwise(F.col("path"))


def sets(members: DataFrame, separator: str = "\n") -> DataFrame:
    """(size, h, n, shown, human) a set, its members' names joined in rank order; a set is as large as its report's line."""
    entries = F.sort_array(F.collect_list(F.struct("rank", shown_path(separator).alias("p"))))
    one = members.groupBy("size", "h").agg(F.count("*").alias("n"), F.array_join(F.transform(entries, lambda e: e["p"]), separator).alias("shown"))
    return one.withColumn("human", human_size(F.col("size")))


#: Terminal codes of a size line, a path, and the end of both.
SIZE_STYLE, PATH_STYLE, PLAIN = "\x1b[1m\x1b[36m", "\x1b[34m", "\x1b[0m"


#: Members of a set that stand in one row of a report.
CHUNK = 1000


def chunks(members: DataFrame, entry: Column, per: int = CHUNK) -> DataFrame:
    """(size, h, first, chunk, last, entries) of ranked members with n, their set's number: a set is as many rows as its members fill, entries in rank order; first is its first member's name, last marks its last row."""
    first = members.where("rank = 1").select("size", "h", shown_path().alias("first"))
    chunk = F.floor((F.col("rank") - 1) / per).cast("int").alias("chunk")
    listed = F.sort_array(F.collect_list(F.struct("rank", entry.alias("e"))))
    rows = members.groupBy("size", "h", chunk).agg(F.transform(listed, lambda x: x["e"]).alias("entries"), (F.max("rank") == F.max("n")).alias("last"))
    return rows.join(first, ["size", "h"])


def text_lines(members: DataFrame, separator: str = "\n", show_size: bool = False, colour: bool = False, per: int = CHUNK) -> Iterator[str]:
    """Sets by descending size, then by their first member, each ended by an empty line; read from Spark one partition at a time, a large set in several pieces."""
    found = chunks(members, shown_path(separator), per).withColumn("human", human_size(F.col("size")))
    for r in found.orderBy(F.desc("size"), "first", "h", "chunk").toLocalIterator():
        human, shown = f"Size: {r.human}", separator.join(r.entries)
        if colour:
            human, shown = f"{SIZE_STYLE}{human}{PLAIN}", f"{PATH_STYLE}{shown}{PLAIN}"
        yield (separator if r.chunk else f"{human}\n" if show_size else "") + shown + ("\n\n" if r.last else "")


def dry_run_notes(members: DataFrame) -> DataFrame:
    """One note for each member of a set but the first; nothing is ever deleted, with or without them."""
    first = members.where("rank = 1").select("size", "h", shown_path().alias("a"))
    pairs = members.where("rank > 1").select("size", "h", shown_path().alias("b")).join(first, ["size", "h"])
    return pairs.select(F.format_string("Dry run: would report %s and %s as duplicates.", "a", "b").alias("note"))


def json_sets(members: DataFrame, archives: bool = False) -> DataFrame:
    """(size_bytes, hash_xxh128, duplicates) a set; members need h in XXH3-128, path, mtime, prioritized and rank."""
    fields = [F.col("rank"), F.col("path"), *([F.col("subpath").alias("archive_subpath")] if archives else []), iso_utc(F.col("mtime")).alias("mtime_utc"), F.col("prioritized")]
    listed = F.sort_array(F.collect_list(F.struct(*fields)))
    inner = [f for f in ("path", "archive_subpath", "mtime_utc", "prioritized") if archives or f != "archive_subpath"]
    return members.groupBy(F.col("size").alias("size_bytes"), F.col("h").alias("hash_xxh128")).agg(F.transform(listed, lambda e: F.struct(*[e[f].alias(f) for f in inner])).alias("duplicates"))


def json_pieces(members: DataFrame, archives: bool = False, per: int = CHUNK) -> Iterator[str]:
    """The report of json_sets() as text, sets by descending size, then by hash; a large set comes in several pieces, so none has to fit in memory."""
    fields = [F.col("path"), *([F.col("subpath").alias("archive_subpath")] if archives else []), iso_utc(F.col("mtime")).alias("mtime_utc"), F.col("prioritized")]
    begun = False
    for r in chunks(members, F.struct(*fields), per).orderBy(F.desc("size"), "h", "chunk").toLocalIterator():
        head = f'{",\n" if begun else "[\n"}  {{\n    "size_bytes": {r.size},\n    "hash_xxh128": {json.dumps(r.h)},\n    "duplicates": [\n'
        entries = [textwrap.indent(json.dumps(e.asDict(), indent=2, ensure_ascii=True), " " * 6) for e in r.entries]
        yield (",\n" if r.chunk else head) + ",\n".join(entries) + ("\n    ]\n  }" if r.last else "")
        begun = True
    yield "\n]" if begun else "[]"
