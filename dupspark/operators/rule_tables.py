"""Ignore rules as rows: thousands of rule files judge paths by joins on folders, with a plan that doesn't grow with the rules."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .rules import IGNORED, NONE, WHITELISTED, parse_rule

RULES = "base string, ord int, regex string, negated boolean, only_directories boolean"


def parsed(lines: DataFrame) -> DataFrame:
    """Rules from lines(base, ord, line) of ignore files: base is the folder in which a file lies, "" the scan's root, ord the place of the line. Comments, empty and null lines give none."""

    def run(batches):
        for batch in batches:
            found = [(b, o, r) for b, o, line in zip(batch["base"], batch["ord"], batch["line"], strict=True) if line is not None and (r := parse_rule(line))]
            yield pd.DataFrame([(b, o, r.regex, r.negated, r.only_directories) for b, o, r in found], columns=["base", "ord", "regex", "negated", "only_directories"])

    base = F.regexp_replace(F.coalesce(F.col("base"), F.lit("")), "/+$", "")
    return lines.select(base.alias("base"), F.col("ord").cast("int").alias("ord"), F.col("line").cast("string").alias("line")).mapInPandas(run, RULES)


def parent(path: Column) -> Column:
    """The folder of a path, "" where it has none."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def above(folder: Column) -> Column:
    """A folder and all folders above it, "" among them: a/b gives "", a, a/b, and /a gives "", /a."""
    parts = F.split(folder, "/")
    return F.array_distinct(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))))


def chains(folders: DataFrame, table: DataFrame, strict: bool) -> DataFrame:
    """(folder, rules): the rules that hold in each of folders(folder), in the order in which they are asked, the last match deciding: from the root down, from the deepest up if strict."""
    own = table.groupBy("base").agg(F.sort_array(F.collect_list(F.struct("ord", "regex", "negated", "only_directories"))).alias("own"))
    held = folders.select("folder", F.explode(above(F.col("folder"))).alias("base")).join(own, "base")
    chain = F.sort_array(F.collect_list(F.struct(F.length("base").alias("deep"), "base", "own")), asc=not strict)
    each = F.flatten(F.transform("chain", lambda c: F.transform(c["own"], lambda r: F.struct(c["base"].alias("base"), r["regex"].alias("regex"), r["negated"].alias("negated"), r["only_directories"].alias("only_directories")))))
    return held.groupBy("folder").agg(chain.alias("chain")).select("folder", each.alias("rules"))


def verdicts(paths: DataFrame, table: DataFrame, strict: bool = False) -> DataFrame:
    """paths(path, is_dir, ...) beside verdict: NONE, IGNORED or WHITELISTED, as rules.verdict() says with the same rules.

    Folders, far fewer than paths, meet the rule folders above them by equality; a path then meets its folder's chain, and its
    verdict is a fold over that. A null path has no verdict but NONE. Rules hold below their base alone.
    """
    keyed = paths.withColumn("_folder", parent(F.col("path")))
    held = chains(keyed.where("_folder is not null").select(F.col("_folder").alias("folder")).distinct(), table, strict).select(F.col("folder").alias("_folder"), F.col("rules").alias("_rules"))

    def step(said: Column, r: Column) -> Column:
        below = F.regexp_replace(F.substr(F.col("path"), F.length(r["base"]) + 1), "^/+", "")
        hit = F.coalesce(F.rlike(below, r["regex"]), F.lit(False)) & (~r["only_directories"] | F.col("is_dir"))
        return F.when(hit, F.when(r["negated"], F.lit(WHITELISTED)).otherwise(F.lit(IGNORED))).otherwise(said)

    said = F.coalesce(F.aggregate("_rules", F.lit(NONE), step), F.lit(NONE))
    return keyed.join(held, "_folder", "left").select(*paths.columns, said.alias("verdict"))


def surviving(paths: DataFrame, table: DataFrame, strict: bool = False) -> DataFrame:
    """Files of paths(path, ...) that neither are ignored nor lie below a folder that is; paths are relative to the scan's root."""
    marked = paths.withColumn("_in", parent(F.col("path")))
    own = marked.select(F.col("_in").alias("folder")).distinct()
    steps = own.select("folder", F.explode(above(F.col("folder"))).alias("path")).where("path <> ''")
    said = verdicts(steps.select("path", F.lit(True).alias("is_dir")).distinct(), table, strict)
    gone = steps.join(said.where(F.col("verdict") == IGNORED).select("path"), "path", "left_semi").select(F.col("folder").alias("_in")).distinct()
    judged = verdicts(marked.join(gone, "_in", "left_anti").withColumn("is_dir", F.lit(False)), table, strict)
    return judged.where(F.col("verdict") != IGNORED).select(*paths.columns)
