"""The whole search: scan, filter, hash what shares its size, rank the sets, report."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import exact, filters, rules, similar
from ..options import ARCHIVES, Options
from ..sources import entries as streams, files, images
from ..workspace import stored
from . import report

VERSION = "0.1"
HELP = """dupspark [options] path ...
-a hidden files too      -c patterns ignore case   -d sizes before sets      -e REGEX leave out paths   -f follow links
-h this text             -i A,B leave out names    -I similar images         -J JSON                    -j N workers, 1 to 256
-m SIZE at least         -M SIZE at most           -n notes only, no change  -o accepted, no effect     -p PATH first in its set
-r subfolders (default)  -R no subfolders          -s C between entries      -t archive members         -T 1..5 image threshold
-v skipped files         -V version                -w REGEX these paths only -x SIZE accepted, no effect
--verify compare bytes   --hash md5|sha256|xxh128  --dedupe-paths            --strict-ignore --strict-whitelist
"""


def listing(spark: SparkSession, o: Options) -> tuple[DataFrame, DataFrame]:
    """(files, errors) of one walk over the roots, written: what passes every predicate, with prioritized, and (path, error) of folders that couldn't be read."""
    found = files.scan(spark, o.roots, o.recurse, o.follow_links, o.hidden, o.deny, absolute=o.json or o.images, ignore=True, strict=o.strict_ignore, ftype=None, sizes=(o.min_size, o.max_size))
    readable = filters.permitted(F.col("uid"), F.col("gid"), F.col("mode"), os.getuid(), os.getgroups())
    closed = found.where("ftype = 'unreadable'").select("path", F.lit("the folder can't be read").alias("error"))
    passed = filters.scan_filter(found.where("ftype = 'file'").where(readable), o).where((F.col("verdict") != rules.IGNORED) | F.col("named")).drop("verdict")
    return passed.dropDuplicates(["path"]) if o.dedupe_paths else passed, closed


def listed(spark: SparkSession, o: Options) -> DataFrame:
    """The files that pass every predicate, with prioritized."""
    return listing(spark, o)[0]


def some(found: DataFrame) -> DataFrame:
    """No file at all is an error, as is a missing root."""
    if found.isEmpty():
        raise ValueError("please submit at least one file")
    return found


def duplicates(spark: SparkSession, o: Options) -> tuple[DataFrame, DataFrame]:
    """(members, errors): the ranked members of the sets, and files and folders that couldn't be read.

    Folders are walked once, and what shares its size with another entry is hashed once, archive members too; a file whose size
    nobody shares isn't opened. With verify, members of a set are opened once more, for their bytes.
    """
    found, closed = listing(spark, o)
    kind = "xxh128" if o.json else o.hash_kind
    entries = some(found).select("path", "subpath", F.lit(None).cast("int").alias("nth"), "size", "mtime", "prioritized", F.lit(None).cast("string").alias("h"))
    errors = closed
    if o.archives:
        packed = found.where(F.col("path").rlike(rules.java_regex(ARCHIVES, True)))
        inside = stored(streams.members(streams.spread(packed.select("path").distinct(), o.threads), kind))
        errors = errors.unionByName(inside.where("error is not null").select("path", "error"))
        entries = entries.unionByName(inside.where("error is null").join(packed.select("path", "mtime", "prioritized"), "path").select(*entries.columns))
        entries = stored(entries)
    candidates = exact.size_candidates(entries)
    hashed = stored(streams.with_hash(streams.spread(candidates.where("h is null").drop("h"), o.threads), kind))
    errors = errors.unionByName(hashed.where("error is not null").select("path", "error"))
    good = hashed.where("error is null").drop("error")
    if o.archives:
        good = good.unionByName(candidates.where("h is not null").select(*good.columns))
    return stored(exact.members(streams.verified(good) if o.verify else good, spread=True)), errors


def similar_images(spark: SparkSession, o: Options) -> DataFrame:
    """(pivot, others) of images nearer than the threshold."""
    sizes = some(listed(spark, o)).select(F.col("path").alias("id"), "size")
    plain = F.regexp_replace("path", "^file:/+", "/")
    signed = images.read_signatures(spark, *map(os.path.abspath, o.roots)).select(plain.alias("id"), "v").join(sizes.dropDuplicates(["id"]), "id")
    return similar.stars(similar.pairs(signed, o.threshold, size="size"))


def main(argv: list[str], spark: SparkSession | None = None, out=sys.stdout) -> int:
    """The command line; 0 if the search ran, or help or the version was asked for."""
    if asked := [a for a in argv if a in ("-h", "--help", "-V", "--version")]:
        out.write(f"dupspark {VERSION}\n" if asked[0] in ("-V", "--version") else HELP)
        return 0
    o = Options.parse(argv)
    builder = SparkSession.builder.appName("dupspark").config("spark.sql.session.timeZone", "UTC")
    spark = spark or (builder.config("spark.default.parallelism", str(o.threads)) if o.threads else builder).getOrCreate()
    if o.images:
        for r in similar_images(spark, o).orderBy("pivot").toLocalIterator():
            out.write(o.separator.join([r.pivot, *r.others]) + "\n\n")
        return 0
    members, errors = duplicates(spark, o)
    if o.json:
        for piece in report.json_pieces(members, o.archives):
            out.write(piece)
        out.write("\n")
    else:
        for line in report.text_lines(members, o.separator, o.show_size, colour=out.isatty()):
            out.write(line)
    if o.dry_run:
        for r in report.dry_run_notes(members).toLocalIterator():
            sys.stderr.write(r.note + "\n")
    if o.verbose:
        for r in errors.toLocalIterator():
            sys.stderr.write(f"skipping {r.path}: {r.error}\n")
    return 0
