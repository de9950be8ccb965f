"""A file-tree source: what Spark's own listing leaves out are dot files, empty files, owners, modes and link cycles."""

from __future__ import annotations

import functools
import json
import operator
import os
import re
import stat
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime, timezone

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..catalog import FILES
from ..operators import rules
from ..workspace import stored

#: Entries that a task of a round lists before it leaves folders to the next round, in the first round and at most; names of one folder that a task looks up; partitions that a plain read of the source aims at.
FIRST, MOST, WIDE, PARTS = 1_000, 100_000, 20_000, 64
#: What a round gives: files, and folders (or names in one) that are still to be listed.
FOUND = FILES + ", root string, names array<string>"


def kind_of(mode: int) -> str:
    return "file" if stat.S_ISREG(mode) else "dir" if stat.S_ISDIR(mode) else "link" if stat.S_ISLNK(mode) else "other"


def compiled(own: list[rules.Rule]) -> list[tuple[re.Pattern, bool, bool]]:
    """The rules for Python's engine, which writes the end of the text another way."""
    return [(re.compile(re.sub(r"\\z(\)?)\Z", r"\\Z\1", r.regex)), r.negated, r.only_directories) for r in own]


class Part(InputPartition):
    """A subtree, the files that lie directly in a folder, or a root that is a file itself."""

    def __init__(self, root: str, start: str, deep: bool, named: bool = False):
        self.root, self.start, self.deep, self.named = root, start, deep, named


class Walk:
    """How folders are listed: which ones are entered, what their ignore files say, and which entries are given."""

    def __init__(self, recurse: bool = True, follow: bool = False, hidden: bool = False, deny: Iterable[str] = (), ignore: bool = False, strict: bool = False):
        self.recurse, self.follow, self.hidden, self.deny, self.ignore, self.strict = recurse, follow, hidden, set(deny), ignore, strict
        self.by_name: list[Callable[[str, str], bool]] = []  # of path and relpath, asked before an entry is looked up
        self.by_row: list[Callable[[tuple], bool]] = []
        self.known: dict[str, list] = {}
        self.user, self.groups = os.getuid(), frozenset(os.getgroups())

    @staticmethod
    def entries(folder: str) -> list[os.DirEntry] | None:
        """What lies in a folder, by name; None if it can't be read."""
        try:
            return sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            return None

    def contexts(self, folder: str, above: list) -> list:
        """The rules that hold in a folder: those of the folders above it up to the root, then its own ignore file's."""
        if not self.ignore:
            return above
        if folder not in self.known:
            try:
                with open(os.path.join(folder, ".gitignore"), errors="replace") as lines:
                    self.known[folder] = [(folder, compiled(rules.parse_rules(lines)))]
            except OSError:
                self.known[folder] = []
            if len(self.known) > 100_000:
                self.known.clear()
                return self.contexts(folder, above)
        return [*above, *self.known[folder]]

    def verdict(self, path: str, is_dir: bool, contexts: list) -> str:
        """As rules.verdict(): the last matching rule of the deepest context, or if strict of the topmost."""
        said = rules.NONE
        for base, own in reversed(contexts) if self.strict else contexts:
            below = path[len(base.rstrip("/")) :].lstrip("/")
            for regex, negated, only_directories in own:
                if (is_dir or not only_directories) and regex.search(below):
                    said = rules.WHITELISTED if negated else rules.IGNORED
        return said

    def permits(self, info: os.stat_result, bit: int) -> bool:
        """As filters.permitted(): whether the user of the search may read (4) or enter (1), as owner, else as member of the group, else as anyone; root may."""
        shift = 6 if info.st_uid == self.user else 3 if info.st_gid in self.groups else 0
        return self.user == 0 or bool(info.st_mode >> shift & bit)

    def enters(self, entry) -> bool:
        named_off = entry.name in self.deny or (not self.hidden and entry.name.startswith("."))
        return not named_off and entry.is_dir(follow_symlinks=self.follow)

    def row(self, root: str, path: str, info: os.stat_result, verdict: str = rules.NONE, kind: str | None = None, named: bool = False):
        at = lambda t: datetime.fromtimestamp(t, timezone.utc)
        below = os.path.basename(path) if named else os.path.relpath(path, root)
        return (path, below, None, info.st_size, at(info.st_mtime), at(info.st_ctime), info.st_uid, info.st_gid, stat.S_IMODE(info.st_mode), kind or kind_of(info.st_mode), named, verdict)

    def named(self, root: str):
        """The row of a root that is a file."""
        row = self.row(root, root, os.stat(root) if self.follow else os.lstat(root), named=True)
        return [row] if all(f(row[0], row[1]) for f in self.by_name) and all(f(row) for f in self.by_row) else []

    def standing(self, root: str, folder: str) -> tuple[frozenset, list] | None:
        """The folders above a folder, and the rules that hold in it but for its own; None if it is gone, ignored, or a link that leads back up."""
        contexts = [(root, compiled(rules.parse_rules(rules.DEFAULTS)))] if self.ignore else []
        above: frozenset = frozenset()
        steps = [] if folder == root else os.path.relpath(folder, root).split("/")
        place = root
        for step in [None, *steps]:
            if step is not None:
                contexts = self.contexts(place, contexts)
                place = os.path.join(place, step)
                if self.verdict(place, True, contexts) == rules.IGNORED:
                    return None
            try:
                own = os.stat(place)
            except OSError:
                return None
            if (own.st_dev, own.st_ino) in above:
                return None
            above = above | {(own.st_dev, own.st_ino)}
        return above, contexts

    def listed(self, root: str, folder: str, contexts: list, names: list[str] | None = None, wide: int | None = None) -> Iterator[tuple | str | list[str]]:
        """Rows of a folder's entries, the paths of folders in it that are entered and, where it has more than `wide` other entries, lists of their names for others to look up."""
        own = os.stat(folder)
        entries = self.entries(folder) if names is None and self.permits(own, 4) and self.permits(own, 1) else None
        if names is None and entries is None:
            yield self.row(root, folder, own, kind="unreadable")
            return
        contexts = self.contexts(folder, contexts)
        plain = []
        for entry in entries or ():
            if self.enters(entry):
                if self.recurse and self.verdict(entry.path, True, contexts) != rules.IGNORED:  # else the whole subtree stays unread
                    yield entry.path
            elif not entry.is_dir(follow_symlinks=self.follow):
                plain.append(entry)
        if wide and len(plain) > wide:
            yield from ([e.name for e in plain[k : k + wide]] for k in range(0, len(plain), wide))
            return
        for path, look in [(e.path, e.stat) for e in plain] + [(p, functools.partial(os.stat, p)) for p in (os.path.join(folder, n) for n in names or ())]:
            if self.by_name and not all(f(path, os.path.relpath(path, root)) for f in self.by_name):
                continue
            try:
                info = look(follow_symlinks=self.follow)
            except FileNotFoundError:  # a link to nothing
                continue
            row = self.row(root, path, info, self.verdict(path, False, contexts))
            if all(f(row) for f in self.by_row):
                yield row


def pushed(filter: Filter) -> tuple[str, Callable] | None:
    """A predicate that the lister applies itself: bounds of size, kinds, parts of paths; None for all others."""
    column = filter.attribute[0] if len(getattr(filter, "attribute", ())) == 1 else None
    compare = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}.get(type(filter))
    place = {"size": 3, "ftype": 9, "uid": 6, "gid": 7, "mode": 8}.get(column)
    if isinstance(filter, IsNotNull) and column not in (None, "subpath"):
        return "row", lambda row: True  # the lister knows all of these
    if place is not None and compare and filter.value is not None:
        return "row", lambda row, value=filter.value: compare(row[place], value)
    if place is not None and isinstance(filter, In):
        return "row", lambda row, values=frozenset(filter.value): row[place] in values
    part = {StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: operator.contains}.get(type(filter))
    if column in ("path", "relpath") and part:
        return "name", lambda path, below, value=filter.value: part(path if column == "path" else below, value)
    return None


class FileTreeReader(Walk, DataSourceReader):
    """One read of trees, planned by the driver: it opens the widest levels until there are PARTS folders to deal out. scan() deals out the work again as it grows."""

    def __init__(self, options: dict):
        told = lambda name, otherwise: options.get(name, otherwise) == "true"
        super().__init__(told("recurse", "true"), told("followsymlinks", "false"), told("hidden", "false"), json.loads(options.get("deny", "[]")), told("ignore", "false"), told("strict", "false"))
        self.roots = json.loads(options["roots"])

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if (own := pushed(f)) is None:
                yield f
            else:
                (self.by_row if own[0] == "row" else self.by_name).append(own[1])

    def partitions(self):
        """A root that is a file, the files of folders that the driver opened, and the subtrees below these."""
        parts, deep = [], []
        for root in self.roots:
            info = os.stat(root) if self.follow else os.lstat(root)  # a missing root is an error
            if stat.S_ISDIR(info.st_mode):
                deep.append(Part(root, root, True))
            else:
                parts.append(Part(root, root, False, True))
        while deep and len(deep) < PARTS:
            level, deep = deep, []
            for part in level:
                parts.append(Part(part.root, part.start, False))
                found = self.standing(part.root, part.start)
                if self.recurse and found is not None:
                    contexts = self.contexts(part.start, found[1])
                    deep += [Part(part.root, e.path, True) for e in self.entries(part.start) or [] if self.enters(e) and self.verdict(e.path, True, contexts) != rules.IGNORED]
        return parts + deep

    def read(self, part: Part):
        if part.named:
            yield from self.named(part.start)
            return
        todo = [part.start]
        while todo:
            folder = todo.pop()
            if (found := self.standing(part.root, folder)) is not None:
                for entry in self.listed(part.root, folder, found[1]):
                    if isinstance(entry, tuple):
                        yield entry
                    elif part.deep:
                        todo.append(entry)


class FileTree(DataSource):
    @classmethod
    def name(cls):
        return "filetree"

    def schema(self):
        return FILES

    def reader(self, schema):
        return FileTreeReader(self.options)


def tree(spark: SparkSession, roots, **options) -> DataFrame:
    """The source as Spark reads it: filters on size, kind, owner, mode and parts of paths go to the lister, which drops what they reject before it looks it up or sends it."""
    spark.dataSource.register(FileTree)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("filetree").option("roots", json.dumps(list(roots)))
    for name, value in options.items():
        reader = reader.option({"follow": "followSymlinks"}.get(name, name), json.dumps(list(value)) if name == "deny" else str(value).lower())
    return reader.load()


def rounds(spark: SparkSession, walk: Walk, roots: list[str], first: int = FIRST, most: int = MOST, wide: int = WIDE) -> tuple[DataFrame, int]:
    """(FOUND rows, rounds): a walk in rounds. A task lists folders until it has seen its share of entries and leaves the others to the
    next round, where they are dealt out again; a folder of many entries is looked up by several tasks. Every round is written.
    """
    names = to_arrow_schema(StructType.fromDDL(FOUND))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), names, strict=True)], schema=names)

    def left(root: str, folder: str, some: list[str] | None = None) -> tuple:
        return (folder, *[None] * 8, "pending", None, None, root, some)

    def run(share: int):
        def task(batches):
            seen, rows = 0, []
            for part in batches:
                for folder, root, some in zip(part.column("path").to_pylist(), part.column("root").to_pylist(), part.column("names").to_pylist(), strict=True):
                    todo = [folder]
                    while todo:
                        now = todo.pop()
                        if seen >= share:
                            rows.append(left(root, now, some if now == folder else None))
                            continue
                        if (found := walk.standing(root, now)) is None:
                            continue
                        for entry in walk.listed(root, now, found[1], some if now == folder else None, wide):
                            seen += 1
                            if isinstance(entry, str):
                                todo.append(entry)
                            else:
                                rows.append((*entry, root, None) if isinstance(entry, tuple) else left(root, now, entry))
                            if len(rows) >= 10_000:
                                yield batch(rows)
                                rows = []
            if rows:
                yield batch(rows)

        return task

    begin, direct = [], []
    for root in roots:
        info = os.stat(root) if walk.follow else os.lstat(root)  # a missing root is an error
        if stat.S_ISDIR(info.st_mode):
            begin.append(left(root, root))
        else:
            direct += [(*row, root, None) for row in walk.named(root)]
    out = [spark.createDataFrame(direct, FOUND)] if direct else []
    todo, n, share = spark.createDataFrame(begin, FOUND), len(begin), first
    while n:
        found = stored(todo.repartition(min(n, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(run(share), FOUND))
        out.append(found.where("ftype <> 'pending'"))
        todo = found.where("ftype = 'pending'")
        n, share = todo.count(), min(most, 4 * share)
    return functools.reduce(DataFrame.unionByName, out or [spark.createDataFrame([], FOUND)]), len(out) - bool(direct)


def scan(spark: SparkSession, roots, recurse: bool = True, follow: bool = False, hidden: bool = False, deny=(".", ".."), absolute: bool = False, ignore: bool = False, strict: bool = False, ftype: str | None = "file", sizes: tuple[int, int] = (0, 0)) -> DataFrame:
    """Every file below the roots once for each root that holds it: regular files, and links' targets if followed. The walk is done when this returns.

    ignore: the built-in rules hold at every root and each .gitignore in and below its folder, for no other root; the
    verdict column tells what they say of a file, and folders that they ignore aren't entered. ftype 'unreadable' gives the
    folders that couldn't be listed, None both. Files outside sizes (at least, at most; 0 is no bound) stay in the lister.
    """
    walk = Walk(recurse, follow, hidden, deny, ignore, strict)
    kinds = (ftype,) if ftype else ("file", "unreadable")
    walk.by_row = [lambda row: row[9] in kinds, lambda row: row[9] != "file" or sizes[0] <= row[3] and (not sizes[1] or row[3] <= sizes[1])]
    found, _ = rounds(spark, walk, [os.path.abspath(r) if absolute else r for r in roots])
    return found.where(F.col("ftype").isin(*kinds)).drop("root", "names")


def with_content(files: DataFrame) -> DataFrame:
    """files beside content (binary) and error: a file that can't be read has a null content and says why."""
    def read(paths: pd.Series) -> pd.DataFrame:
        out = []
        for p in paths:
            try:
                with open(p, "rb") as f:
                    out.append((f.read(), None))
            except OSError as e:
                out.append((None, f"{type(e).__name__}: {e.strerror}"))
        return pd.DataFrame(out, columns=["content", "error"])

    both = F.pandas_udf(read, "content binary, error string")(F.col("path"))
    return files.withColumn("_r", both).select(*files.columns, "_r.content", "_r.error")


def with_file_hash(files: DataFrame, kind: str = "md5", chunk: int = 1 << 20) -> DataFrame:
    """files beside h and error, hashed a chunk at a time: contents never travel, and no file has to fit in memory."""
    def run(paths: pd.Series) -> pd.DataFrame:
        import hashlib

        import xxhash

        out = []
        for p in paths:
            state = xxhash.xxh3_128() if kind == "xxh128" else hashlib.new(kind)
            try:
                with open(p, "rb") as f:
                    while piece := f.read(chunk):
                        state.update(piece)
                out.append((state.hexdigest(), None))
            except OSError as e:
                out.append((None, f"{type(e).__name__}: {e.strerror}"))
        return pd.DataFrame(out, columns=["h", "error"])

    return files.withColumn("_r", F.pandas_udf(run, "h string, error string")(F.col("path"))).select(*files.columns, "_r.h", "_r.error")
