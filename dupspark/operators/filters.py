"""Predicates of a scan, as columns that push into the source where it can use them."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, functions as F

from ..options import Options
from .rules import java_regex


def size_between(size: Column, least: int = 0, most: int = 0) -> Column:
    """Both bounds hold themselves; a largest size of 0 is none."""
    return (size >= least) & (size <= most) if most > 0 else size >= least


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def visible(path: Column) -> Column:
    """No component of a path below the root starts with a dot."""
    return ~F.exists(F.split(path, "/"), lambda name: F.startswith(name, F.lit(".")))


def not_denied(path: Column, names: tuple[str, ...]) -> Column:
    """No component of a path below the root is one of the names; case counts always."""
    return ~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, names))) if names else F.lit(True)


def not_ignored(path: Column, pattern: str | None, ignore_case: bool = False) -> Column:
    """The pattern is found nowhere in the path."""
    return ~path.rlike(java_regex(pattern, ignore_case)) if pattern is not None else F.lit(True)


def whitelisted(path: Column, pattern: str | None, ignore_case: bool = False) -> Column:
    return path.rlike(java_regex(pattern, ignore_case)) if pattern is not None else F.lit(True)


def prioritized(path: Column, prefix: str | None, ignore_case: bool = False) -> Column:
    """The path starts with the prefix, letter by letter, be it inside a name."""
    if prefix is None:
        return F.lit(False)
    return F.startswith(F.lower(path), F.lower(F.lit(prefix))) if ignore_case else F.startswith(path, F.lit(prefix))


def permitted(uid: Column, gid: Column, mode: Column, user: int, groups: list[int], bit: int = 4) -> Column:
    """Whether the user may read (4) or enter (1): as owner, else as member of the group, else as anyone; root may."""
    if user == 0:
        return F.lit(True)
    shift = F.when(uid == user, 6).when(gid.isin(*groups) if groups else F.lit(False), 3).otherwise(0)
    return functools.reduce(operator.or_, [(shift == s) & (F.shiftright(mode, s).bitwiseAND(F.lit(bit)) != 0) for s in (6, 3, 0)])


def scan_filter(files: DataFrame, o: Options) -> DataFrame:
    """All name, pattern and size predicates over files(relpath, path, size). A file named as a root skips the name ones."""
    below, path = F.col("relpath"), F.col("path")
    named = F.col("named") if "named" in files.columns else F.lit(False)
    by_name = not_denied(below, o.deny) & not_ignored(path, o.ignore_regex, o.ignore_case) & whitelisted(path, o.whitelist_regex, o.ignore_case)
    if not o.hidden:
        by_name = by_name & visible(below)
    if o.strict_whitelist and o.whitelist_regex:
        by_name = by_name & ~F.contains(below, F.lit("/"))
    out = files.where(size_between(F.col("size"), o.min_size, o.max_size)).where(named | by_name)
    return out.withColumn("prioritized", prioritized(path, o.priority, o.ignore_case))
