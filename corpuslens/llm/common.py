"""Reading the tables and cutting Arrow batches into pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_slices(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 4 << 20
) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about `limit` text bytes (one longer text stands alone)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if i > start and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def free_name(taken: list[str], name: str) -> str:
    """`name` with underscores before it until no column is called so."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name
