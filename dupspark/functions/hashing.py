"""Content hashes. Grouping keys are built-in digests; XXH3-128 serves reports alone."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def digest(content: Column, kind: str = "md5") -> Column:
    """Hex digest of a string or binary column that stays inside generated code: md5, or sha256 where inputs may be hostile."""
    content = content.cast("binary")
    return F.md5(content) if kind == "md5" else F.sha2(content, 256)


@F.pandas_udf(T.StringType())
def xxh128(content: pd.Series) -> pd.Series:
    """XXH3-128 of a binary column as 32 hex digits, the high half first; null stays null."""
    import xxhash

    return content.map(lambda b: None if b is None else xxhash.xxh3_128_hexdigest(bytes(b)))


def iso_utc(ts: Column) -> Column:
    """YYYY-MM-DDTHH:MM:SSZ in UTC whatever the session's time zone; fractions of a second are cut."""
    return F.date_format(F.to_utc_timestamp(ts.cast("timestamp"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
