"""Column scalers: statistics from one aggregate, applied as plain arithmetic."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from corpuslens.operators.lookup import lookup_join
from corpuslens.session import stage


MAX_GROUPS = 1_000


@dataclass(frozen=True)
class MinMaxModel:
    """Bounded by the number of columns, so it travels as literals."""

    ranges: dict[str, tuple[float, float]]

    def scaled(self, name: str) -> Column:
        low, high = self.ranges[name]
        if low is None or low == high:
            # A constant column scales to 0; values off the constant keep their distance.
            return (F.col(name) - F.lit(low)).cast("double")
        return (F.col(name) - F.lit(low)) / F.lit(high - low)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({name: self.scaled(name) for name in self.ranges})


def fit_min_max(df: DataFrame, cols: list[str]) -> MinMaxModel:
    stats = df.agg(
        *[F.min(c).cast("double").alias(f"lo_{c}") for c in cols],
        *[F.max(c).cast("double").alias(f"hi_{c}") for c in cols],
    ).first()
    return MinMaxModel({c: (stats[f"lo_{c}"], stats[f"hi_{c}"]) for c in cols})


def min_max(df: DataFrame, cols: list[str]) -> DataFrame:
    """(x - min) / (max - min) per column, fitted on the same rows."""
    return fit_min_max(df, cols).transform(df)


def min_max_by(df: DataFrame, cols: list[str], group: str) -> DataFrame:
    """Each group (split) scaled with its own minimum and maximum.

    There are few groups and each may hold most rows, so their statistics go to
    the rows, never the rows to their group.
    """
    stats = df.groupBy(group).agg(
        *[F.min(c).cast("double").alias(f"_lo_{c}") for c in cols],
        *[F.max(c).cast("double").alias(f"_hi_{c}") for c in cols],
    )
    rows = stats.limit(MAX_GROUPS + 1).collect()
    if len(rows) > MAX_GROUPS:
        raise ValueError(f"{group} has more than {MAX_GROUPS} values")
    small = df.sparkSession.createDataFrame(rows, stats.schema)
    joined = df.join(F.broadcast(small), group)
    scaled = {
        c: F.when(F.col(f"_lo_{c}") == F.col(f"_hi_{c}"), F.lit(0.0)).otherwise(
            (F.col(c) - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}"))
        )
        for c in cols
    }
    return joined.withColumns(scaled).select(*df.columns)


@dataclass(frozen=True)
class MaxAbsModel:
    """Column scales of a numeric table."""

    scales: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c) / F.lit(s or 1.0) for c, s in self.scales.items()})


def fit_max_abs(df: DataFrame, cols: list[str]) -> MaxAbsModel:
    stats = df.agg(*[F.max(F.abs(c)).cast("double").alias(c) for c in cols]).first()
    return MaxAbsModel({c: stats[c] for c in cols})


def max_abs_terms(train: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """Long form: `value` over the largest absolute value of its term in `train`."""
    scale = train.groupBy("term").agg(
        F.max(F.abs("value")).alias("scale"), F.count("*").alias("docs")
    )
    target = train if other is None else other
    # The fitted scales are small next to the rows and are read several times.
    joined = lookup_join(target, stage(scale, "scales"), "term", weight="docs", how="inner")
    return joined.withColumn(
        "value", F.when(F.col("scale") == 0, F.col("value")).otherwise(F.col("value") / F.col("scale"))
    ).drop("scale", "docs")
