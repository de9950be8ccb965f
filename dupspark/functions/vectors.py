"""Distances of numeric vectors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The thresholds of similarity levels 1 to 5.
LEVELS = {1: 0.2, 2: 0.3, 3: 0.5, 4: 0.6, 5: 0.7}


def level(n: int) -> float:
    if n not in LEVELS:
        raise ValueError(f"similarity level {n}: 1 to 5 are known")
    return LEVELS[n]


def norm(v: Column) -> Column:
    """Euclidean length, summed in double."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized_distance(a: Column, b: Column) -> Column:
    """|a - b| / (|a| + |b|), 0 for two zero vectors; null where lengths differ."""
    gap = norm(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")))
    total = norm(a) + norm(b)
    return F.when(F.size(a) == F.size(b), F.when(total == 0, F.lit(0.0)).otherwise(gap / total))
