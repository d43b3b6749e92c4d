"""Feature vectors in and out of Arrow batches without inflating sparse rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, functions as F


def is_vector(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, VectorUDT)


def as_array(df: DataFrame, name: str) -> Column:
    """The column as ARRAY<DOUBLE>, dense."""
    return vector_to_array(name) if is_vector(df, name) else F.col(name).cast("array<double>")


def packed(df: DataFrame, name: str) -> Column:
    """`struct<indices, values>`: a sparse vector travels as its non-zero entries, a dense one without indices.

    No indices are an empty list: Spark takes ten times as long to send lists that are null to Python.
    """
    none = F.array().cast("array<int>")
    if is_vector(df, name):
        raw = F.unwrap_udt(F.col(name))
        return F.struct(F.coalesce(raw["indices"], none).alias("indices"), raw["values"].alias("values"))
    return F.struct(none.alias("indices"), F.col(name).cast("array<double>").alias("values"))


def vector_size(df: DataFrame, name: str) -> Column:
    """Number of features of each row."""
    if not is_vector(df, name):
        return F.size(name)
    raw = F.unwrap_udt(F.col(name))
    return F.coalesce(raw["size"], F.size(raw["values"]))


def vector_width(df: DataFrame, name: str) -> int | None:
    """Number of features (the largest over the rows), None without rows."""
    return df.agg(F.max(vector_size(df, name))).first()[0]


def dense(batch: pd.DataFrame, width: int) -> np.ndarray:
    """Rows of an Arrow batch of `packed` vectors as one matrix."""
    if (rows := stacked(batch, width)) is not None:
        return rows
    rows = np.zeros((len(batch), width))
    for i, (where, values) in enumerate(zip(batch["indices"], batch["values"], strict=True)):
        if where is not None and len(where):
            rows[i, where] = values
        elif values is None or len(values):
            rows[i] = values
    return rows


def stacked(batch: pd.DataFrame, width: int) -> np.ndarray | None:
    """`dense` of rows that are all dense, in one step; None if one is not."""
    values = batch["values"].to_numpy()
    if not len(values) or any(v is None or len(v) != width for v in values) or any(w is not None and len(w) for w in batch["indices"]):
        return None
    return np.stack(values).astype(np.float64, copy=False)
