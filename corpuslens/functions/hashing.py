"""Seeded, engine-independent pseudo-random order.

Rows have no position in Spark, so every seeded choice is a function of
`(seed, id)` alone: the same rows are chosen for any number of partitions and
after any retry.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def hash_key(ident: str | Column, seed: int | str = 42) -> Column:
    """32 hex digits; sorting by it shuffles the rows."""
    ident = F.col(ident) if isinstance(ident, str) else ident
    return F.md5(F.concat(F.lit(f"{seed}:"), ident.cast("string")))


def hash_unit(ident: str | Column, seed: int | str = 42) -> Column:
    """Uniform double in [0, 1)."""
    return hash_int(ident, seed) / F.lit(float(1 << 32))


def hash_int(ident: str | Column, seed: int | str = 42) -> Column:
    """Uniform BIGINT in [0, 2^32)."""
    return F.conv(F.substring(hash_key(ident, seed), 1, 8), 16, 10).cast("bigint")
