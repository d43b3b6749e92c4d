"""Truncated SVD of a feature table (no centring) and its projection.

Subspace iteration with a random start: each pass over the table multiplies it
with a narrow matrix on the executors and adds up `features x (k + 10)` numbers,
so a few passes give the top components whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from corpuslens.functions.vectors import dense, packed, vector_width

MAX_FEATURES = 50_000
OVERSAMPLING = 10
BATCH_CELLS = 10_000_000


@dataclass
class SvdModel:
    components: np.ndarray  # features x k, orthonormal columns
    singular_values: np.ndarray

    def project(self, df: DataFrame, vec: str = "features", out: str = "svd") -> DataFrame:
        """Adds ARRAY<DOUBLE> `out` of length k."""
        return df.withColumn(out, _product(packed(df, vec), self.components))


def _product(rows: Column, components: np.ndarray) -> Column:
    @F.pandas_udf("array<double>")
    def product(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in batches:
            step = max(1, BATCH_CELLS // len(components))
            found = []
            for start in range(0, len(batch), step):
                found.extend(dense(batch.iloc[start : start + step], len(components)) @ components)
            yield pd.Series(found, dtype=object)

    return product(rows)


def _gram_times(rows: DataFrame, q: np.ndarray) -> np.ndarray:
    """A'A q in one pass: each task adds up its own rows, one aggregate adds the tasks."""
    width, cols = q.shape
    shared = rows.sparkSession.sparkContext.broadcast(q)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, cols))
        step = max(1, BATCH_CELLS // width)
        for batch in batches:
            for start in range(0, len(batch), step):
                part = dense(batch.iloc[start : start + step], width)
                total += part.T @ (part @ shared.value)
        for start in range(0, width, 2048):
            chunk = total[start : start + 2048]
            yield pd.DataFrame({"idx": np.arange(start, start + len(chunk)), "part": list(chunk)})

    sums = (
        rows.mapInPandas(partial, "idx int, part array<double>")
        .groupBy("idx")
        .agg(*[F.sum(F.col("part")[i]).alias(f"c{i}") for i in range(cols)])
        .toArrow()
    )
    shared.unpersist()
    out = np.zeros((width, cols))
    where = sums.column("idx").to_numpy()
    for i in range(cols):
        out[where, i] = sums.column(f"c{i}").to_numpy()
    return out


def fit_svd(
    df: DataFrame, k: int = 100, vec: str = "features", n_iter: int = 5, seed: int = 42
) -> SvdModel:
    """Top `k` right singular vectors of a stored table.

    `k` is cut to the number of features. Each vector's sign is fixed so that its
    entry of largest magnitude is positive. Matrices of features x (k + 10) live
    on the driver, hence the limit on features.
    """
    width = vector_width(df, vec)
    if width is None:
        raise ValueError("no rows")
    if width > MAX_FEATURES:
        raise ValueError(f"{width} features: prune the vocabulary below {MAX_FEATURES}")
    k = min(k, width)
    rows = df.select(packed(df, vec).alias("v")).select("v.*")
    parallelism = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < parallelism:
        rows = rows.repartition(parallelism)
    start = np.random.default_rng(seed).normal(size=(width, min(width, k + OVERSAMPLING)))
    q = np.linalg.qr(start)[0]
    for _ in range(n_iter):
        q = np.linalg.qr(_gram_times(rows, q))[0]
    # Best vectors inside the subspace, from the small matrix q'A'Aq.
    small = q.T @ _gram_times(rows, q)
    values, rotation = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values)[:k]
    v = q @ rotation[:, order]
    sign = np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
    return SvdModel(v * np.where(sign == 0, 1.0, sign), np.sqrt(np.maximum(values[order], 0.0)))
