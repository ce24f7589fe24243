"""Deterministic randomness.

Every random choice (shuffles, samples, folds, feature masks) ranks rows by
``md5(seed | key...)``.  The result is the same on any partitioning, any
number of executors and after task retries, which ``rand()`` does not give
once a stage is recomputed; and an SQL oracle can reproduce it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(seed: int | str, *cols: Column | str) -> Column:
    """Hex md5 of ``seed|col1|col2...`` (nulls as empty strings)."""
    parts = [F.lit(str(seed))] + [F.coalesce(F.col(c).cast("string") if isinstance(c, str)
                                             else c.cast("string"), F.lit("")) for c in cols]
    return F.md5(F.concat_ws("|", *parts))


def hash_unit(seed: int | str, *cols: Column | str) -> Column:
    """A uniform number in [0, 1) derived from the md5 key (first 13 hex)."""
    h = hash_key(seed, *cols)
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(16 ** 13))
