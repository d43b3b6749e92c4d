"""Join of a large fact table to a keyed lookup table, safe against hot keys."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

BROADCAST_ROWS = 500_000
HEAVY_KEYS = 1_000


def lookup_join(
    facts: DataFrame,
    table: DataFrame,
    key: str,
    weight: str | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
    how: str = "left",
) -> DataFrame:
    """`facts JOIN table USING (key)`; `table` has one row per key.

    A table of at most `broadcast_rows` rows is broadcast. A larger one is
    shuffled, except for its heaviest keys: with `weight` (rows per key in the
    facts) the keys that hold at least 1/1000 of all facts - by arithmetic at
    most 1,000 of them - are broadcast, and their facts never meet in one task.
    """
    size = table.limit(broadcast_rows + 1).count()
    if size <= broadcast_rows:
        return facts.join(F.broadcast(table), key, how)
    values = [c for c in table.columns if c != key]
    if weight is None:
        return facts.join(table, key, how)
    total = table.agg(F.sum(weight)).first()[0]
    heavy = table.where(F.col(weight) * HEAVY_KEYS >= F.lit(total)).select(
        key, *[F.col(v).alias(f"_heavy_{v}") for v in values]
    )
    marked = facts.join(F.broadcast(heavy), key, "left")
    found = F.col(f"_heavy_{weight}").isNotNull()
    # Facts that already have their row get a spread-out key that matches nothing.
    spread_key = F.when(found, F.concat(F.lit("\u0000"), F.xxhash64(*facts.columns).cast("string"))).otherwise(
        F.col(key).cast("string")
    )
    rest = table.select(F.col(key).cast("string").alias("_key"), *values)
    joined = marked.withColumn("_key", spread_key).join(rest, "_key", "left")
    out = joined.select(
        *facts.columns,
        *[F.coalesce(F.col(f"_heavy_{v}"), F.col(v)).alias(v) for v in values],
    )
    return out if how == "left" else out.where(F.col(weight).isNotNull())


def send_table(table: DataFrame, key: str, value: str, rows: int = BROADCAST_ROWS) -> Broadcast | None:
    """A checked small table (string key, integer value) for look-ups inside a row; None if it is larger."""
    found = table.select(key, value).where(F.col(key).isNotNull()).limit(rows + 1).collect()
    if len(found) > rows:
        return None
    keys, values = [r[0] for r in found], np.array([r[1] for r in found], dtype=np.int64)
    return table.sparkSession.sparkContext.broadcast((pa.array(keys, pa.string()), values))


def look_up(words: pa.Array, sent: tuple[pa.Array, np.ndarray], missing: int | np.ndarray) -> np.ndarray:
    """The values of a flat array of words; `missing` where the table has none."""
    keys, values = sent
    place = pc.fill_null(pc.index_in(words, value_set=keys), -1).to_numpy(zero_copy_only=False)
    if not len(values):
        return np.broadcast_to(np.asarray(missing, dtype=np.int64), len(place)).copy()
    return np.where(place >= 0, values[place], missing)


def list_sizes(lists: pa.Array) -> np.ndarray:
    """Elements of each list; a null list has none."""
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
