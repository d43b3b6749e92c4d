"""Projections, filters, unions, joins and samples of feature tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpuslens.functions.hashing import hash_key
from corpuslens.schema import FEATURES, ID, LABEL, TRUTH_LABELS


def features_label(
    df: DataFrame, features: list[str] | None = None, label: str = LABEL
) -> tuple[DataFrame, DataFrame]:
    """The feature block (text and numbers) and the label block, both keyed."""
    features = features or ["text", *FEATURES]
    return df.select(ID, *features), df.select(ID, label)


def linguistic_set(df: DataFrame) -> DataFrame:
    """The numeric features without the text."""
    return df.drop("text")


def map_label(label: Column, codes: dict[str, int] = TRUTH_LABELS) -> Column:
    """String label to its code; an unknown label stops the job."""
    rule = None
    for name, code in codes.items():
        rule = F.when(label == name, code) if rule is None else rule.when(label == name, code)
    unknown = F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(label, F.lit("NULL"))))
    return rule.otherwise(unknown.cast("int"))


def one_hot(df: DataFrame, names: dict[str, int], label: str = LABEL) -> DataFrame:
    """One BOOLEAN column per class instead of the label."""
    flags = [(F.col(label) == code).alias(name) for name, code in names.items()]
    return df.select("*", *flags).drop(label)


def by_class(df: DataFrame, value, label: str = LABEL) -> DataFrame:
    """The rows of one class without the label."""
    return df.where(F.col(label) == value).drop(label)


def class_stats(df: DataFrame, features: list[str], label: str = LABEL) -> DataFrame:
    """All per-class tables summarised in one pass: count, mean, min, max per feature."""
    stats = [F.count("*").alias("n")]
    for name in features:
        stats += [
            F.avg(name).alias(f"{name}_mean"),
            F.min(name).alias(f"{name}_min"),
            F.max(name).alias(f"{name}_max"),
        ]
    return df.groupBy(label).agg(*stats)


def feature_points(
    df: DataFrame, *features: str, label: str = LABEL, n: int | None = None, seed: int = 42
) -> DataFrame:
    """The table behind a scatter plot of two or three features per class."""
    if not 2 <= len(features) <= 3:
        raise ValueError("two or three features")
    points = df if n is None else sample_n(df, n, seed)
    return points.select(ID, label, *features)


def union_holdout(test: DataFrame, valid: DataFrame) -> DataFrame:
    """Test and validation rows as one hold-out set (UNION ALL by name)."""
    return test.unionByName(valid)


def attach(df: DataFrame, other: DataFrame, key: str = ID) -> DataFrame:
    """Columns of `other` next to the rows of `df`, by key instead of by position."""
    return df.join(other, key)


def sample_n(df: DataFrame, n: int, seed: int = 42, id_col: str = ID) -> DataFrame:
    """Exactly `n` rows without replacement (all rows if there are fewer)."""
    return df.orderBy(hash_key(id_col, seed), id_col).limit(n)


def head_n(df: DataFrame, n: int, id_col: str = ID) -> DataFrame:
    """The first `n` rows by id."""
    return df.orderBy(id_col).limit(n)


def shape_report(**tables: DataFrame) -> DataFrame:
    """Rows and columns of each named table."""
    parts = [
        df.agg(F.count("*").alias("n_rows")).select(
            F.lit(name).alias("name"), "n_rows", F.lit(len(df.columns)).alias("n_columns")
        )
        for name, df in tables.items()
    ]
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report
