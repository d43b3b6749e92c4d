"""Kernel values of every row against a bounded set of landmark rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, functions as F

from corpuslens.functions.vectors import as_array, dense, packed, stacked, vector_size
from corpuslens.operators.relational import sample_n
from corpuslens.schema import ID

KERNELS = ("rbf", "sigmoid", "poly")
MAX_LANDMARKS = 2_000
MARGIN_CELLS = 1 << 21


def landmarks(df: DataFrame, m: int, vec: str = "features", seed: int = 42, id_col: str = ID) -> np.ndarray:
    """`m` rows chosen by hash order: the only rows that come to the driver."""
    if m > MAX_LANDMARKS:
        raise ValueError(f"at most {MAX_LANDMARKS} landmarks")
    rows = sample_n(df.select(id_col, as_array(df, vec).alias("v")), m, seed, id_col)
    return np.array([r.v for r in rows.select("v").collect()], dtype=np.float64)


def kernel_matrix(rows: np.ndarray, marks: np.ndarray, kind: str, gamma: float) -> np.ndarray:
    return kernel_values(rows @ marks.T, rows, marks, kind, gamma)


def kernel_values(product: np.ndarray, rows: np.ndarray, marks: np.ndarray, kind: str, gamma: float) -> np.ndarray:
    """Kernel values where `product`, rows times landmarks, is known."""
    if kind == "rbf":
        d = (rows * rows).sum(1)[:, None] + (marks * marks).sum(1)[None, :] - 2.0 * product
        return np.exp(-gamma * np.maximum(d, 0.0))
    if kind == "sigmoid":
        return np.tanh(gamma * product)
    if kind == "poly":
        return (gamma * product) ** 3
    raise ValueError(f"unknown kernel {kind}")


def kernel_column(rows: Column, marks: np.ndarray, kind: str, gamma: float) -> Column:
    """ARRAY<DOUBLE> of the kernel values of `packed` rows with each landmark.

    One matrix product per Arrow batch.
    """

    @F.pandas_udf("array<double>")
    def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in batches:
            matrix = kernel_matrix(dense(batch, marks.shape[1]), marks, kind, gamma)
            yield pd.Series(list(matrix), dtype=object)

    return values(rows)


class KernelFeatures(
    Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable
):
    """Pipeline stage: vector in, vector of kernel values out."""

    kind = Param(Params._dummy(), "kind", "rbf, sigmoid or poly", TypeConverters.toString)
    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    marks = Param(Params._dummy(), "marks", "landmark rows", TypeConverters.identity)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, kind="rbf", gamma=1.0, marks=None):
        super().__init__()
        self._setDefault(kind="rbf", gamma=1.0, marks=[])
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        column = kernel_column(
            packed(dataset, self.getInputCol()),
            np.array(self.getOrDefault(self.marks), dtype=np.float64),
            self.getOrDefault(self.kind),
            self.getOrDefault(self.gamma),
        )
        return dataset.withColumn(self.getOutputCol(), array_to_vector(column))


def margins_column(
    rows: Column, coef: np.ndarray, marks: np.ndarray | None, kind: str, gamma: float, after=None
) -> Column:
    """ARRAY<DOUBLE> of `packed` rows: features (raw, or kernel values) times `coef`, its last row added.

    `after` maps the matrix of margins of some rows to what is returned instead.
    """

    @F.pandas_udf("array<double>")
    def margins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in batches:
            parts = []
            width = len(coef) - 1 if kind == "linear" else marks.shape[1]
            step = len(batch) if kind == "linear" else max(1, MARGIN_CELLS // width)
            for low in range(0, len(batch), max(step, 1)):
                part = batch.iloc[low : low + step]
                if kind == "linear":
                    found = _times(part, coef[:-1])
                else:
                    found = kernel_matrix(dense(part, width), marks, kind, gamma) @ coef[:-1]
                found = found + coef[-1]
                parts.append(found if after is None else after(found))
            yield pd.Series([row for part in parts for row in part], dtype=object)

    return margins(rows)


def _times(batch: pd.DataFrame, coef: np.ndarray) -> np.ndarray:
    """Rows of `packed` vectors times a matrix, without filling sparse rows up."""
    if (rows := stacked(batch, len(coef))) is not None:
        return rows @ coef
    out = np.zeros((len(batch), coef.shape[1]))
    for i, (where, values) in enumerate(zip(batch["indices"], batch["values"], strict=True)):
        if where is not None and len(where):
            out[i] = values @ coef[where]
        elif values is None or len(values):
            out[i] = values @ coef
    return out


class KernelMargins(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Pipeline stage: vector in, array of the margins of several linear models on its (kernel) features out."""

    kind = Param(Params._dummy(), "kind", "linear, rbf, sigmoid or poly", TypeConverters.toString)
    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    marks = Param(Params._dummy(), "marks", "landmark rows", TypeConverters.identity)
    coef = Param(Params._dummy(), "coef", "weights of each model, its intercept last", TypeConverters.identity)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, kind="linear", gamma=1.0, marks=None, coef=None):
        super().__init__()
        self._setDefault(kind="linear", gamma=1.0, marks=[], coef=[])
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    @property
    def n_models(self) -> int:
        return len(self.getOrDefault(self.coef))

    def kind_key(self) -> tuple:
        """Equal for those that compute their margins from the same features."""
        kind = self.getOrDefault(self.kind)
        if kind == "linear":
            return (kind,)
        marks = np.array(self.getOrDefault(self.marks), dtype=np.float64)
        return kind, self.getOrDefault(self.gamma), marks.shape, marks.tobytes()

    def matrix(self) -> np.ndarray:
        """(features + 1) x models."""
        return np.array(self.getOrDefault(self.coef), dtype=np.float64).T

    def of(self, rows: Column, coef: np.ndarray | None = None, after=None) -> Column:
        marks = np.array(self.getOrDefault(self.marks), dtype=np.float64)
        matrix = self.matrix() if coef is None else coef
        return margins_column(rows, matrix, marks, self.getOrDefault(self.kind), self.getOrDefault(self.gamma), after)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOutputCol(), self.of(packed(dataset, self.getInputCol())))


def kernel_table(
    df: DataFrame, marks: DataFrame, kind: str, gamma: float, vec: str, id_col: str = ID
) -> DataFrame:
    """Long form `(id, landmark, value)`; `marks` holds at most `MAX_LANDMARKS` rows."""
    rows = marks.select(id_col, as_array(marks, vec).alias("v")).orderBy(id_col).limit(MAX_LANDMARKS + 1).collect()
    if len(rows) > MAX_LANDMARKS:
        raise ValueError(f"at most {MAX_LANDMARKS} landmarks")
    ids = F.array(*[F.lit(r[id_col]).cast(marks.schema[id_col].dataType) for r in rows])
    matrix = np.array([r.v for r in rows], dtype=np.float64)
    values = kernel_column(packed(df, vec), matrix, kind, gamma)
    return df.select(
        id_col, F.explode(F.arrays_zip(ids.alias("landmark"), values.alias("value"))).alias("_k")
    ).select(id_col, "_k.landmark", "_k.value")


def gamma_scale(df: DataFrame, vec: str) -> DataFrame:
    """1 / (features * variance of all entries), from one aggregate over the non-zero entries; 1 on constant data."""
    value = packed(df, vec)["values"]
    sums = df.select(
        vector_size(df, vec).alias("d"),
        F.aggregate(value, F.lit(0.0), lambda a, x: a + x).alias("s"),
        F.aggregate(value, F.lit(0.0), lambda a, x: a + x * x).alias("q"),
    ).agg(F.max("d").alias("d"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("d").alias("n"))
    variance = F.col("q") / F.col("n") - (F.col("s") / F.col("n")) ** 2
    return sums.select(F.when(variance > 0, 1.0 / (F.col("d") * variance)).otherwise(F.lit(1.0)).alias("gamma"))
