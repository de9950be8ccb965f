"""Human-readable byte sizes, as columns and at plan time."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

#: The units of sizes, each 1024 times the one before.
UNITS = ("B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB")
SUFFIXES = {"K": 1, "M": 2, "G": 3, "T": 4}
_SIZE = r"^[ \t\n\x0B\f\r]*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)[ \t\n\x0B\f\r]*(.?)"


def human_size(size: Column, largest: str = UNITS[-1]) -> Column:
    """Bytes as an integer below 1 KiB, else one decimal of the largest unit, up to the one named, that leaves at least 1; ties go to the even digit."""
    out = F.concat(size.cast("bigint").cast("string"), F.lit(" B"))
    for power in range(1, UNITS.index(largest) + 1):
        shown = F.bround(size.cast("double") / float(1024**power), 1).cast("decimal(20,1)").cast("string")
        out = F.when(size.cast("double") >= float(1024**power), F.concat(shown, F.lit(f" {UNITS[power]}"))).otherwise(out)
    return out


def parse_size(text: str) -> int:
    """A number and perhaps K, M, G or T in either case, cut to whole bytes; -1 if it is no size. What follows the suffix letter is ignored."""
    found = re.match(_SIZE, text, re.DOTALL)
    if not found or (found[2] and found[2].upper() not in SUFFIXES):
        return -1
    return int(float(found[1]) * 1024 ** SUFFIXES.get(found[2].upper(), 0))


def parsed_size(text: Column) -> Column:
    """parse_size of a string column; null stays null."""
    number, suffix = F.regexp_extract(text, "(?s)" + _SIZE, 1), F.upper(F.regexp_extract(text, "(?s)" + _SIZE, 2))
    factor = F.when(suffix == "", F.lit(1.0))
    for letter, power in SUFFIXES.items():
        factor = factor.when(suffix == letter, F.lit(float(1024**power)))
    return F.when(text.isNotNull(), F.coalesce((number.try_cast("double") * factor).cast("bigint"), F.lit(-1))).cast("bigint")
