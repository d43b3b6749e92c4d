"""Train/test splits and folds: exact sizes, no class ever sorted in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from corpuslens.functions.hashing import hash_unit
from corpuslens.operators.ranking import by_class, class_counts, hash_below, hash_bounds, ordered_bounds
from corpuslens.schema import ID, LABEL


def exact_fraction(fraction: float, n: int) -> int:
    """ceil(fraction * n) without the rounding noise of the product."""
    return math.ceil(round(fraction * n, 9))


def train_quotas(counts: dict, test_fraction: float) -> dict:
    """Train rows per class by largest remainder; ties go to the smaller label."""
    n = sum(counts.values())
    train = n - exact_fraction(test_fraction, n)
    if any(c < 2 for c in counts.values()):
        raise ValueError("a class of one row cannot be split")
    quota = {k: train * c // n for k, c in counts.items()}
    left = train - sum(quota.values())
    by_remainder = sorted(counts, key=lambda k: (-(train * counts[k] % n), k))
    for k in by_remainder[:left]:
        quota[k] += 1
    return quota


def stratified_split(
    df: DataFrame, test_fraction: float = 0.2, seed: int = 42, label: str = LABEL, id_col: str = ID
) -> DataFrame:
    """Adds `split` (train/test) with the class proportions kept. Ids are unique; no row moves."""
    train = first_of_class(df, train_quotas(class_counts(df, label), test_fraction), seed, label, id_col)
    return df.withColumn("split", F.when(train, "train").otherwise("test"))


def first_of_class(df: DataFrame, quotas: dict, seed: int, label: str = LABEL, id_col: str = ID) -> Column:
    """Whether a row is among the first `quotas[class]` rows of its class in hash order."""
    last = hash_bounds(df, {c: [q - 1] if q else [] for c, q in quotas.items()}, label, id_col, seed)
    return by_class(label, {c: hash_below(bound, id_col, seed) for (c, _), bound in last.items()}, False)


def random_split3(
    df: DataFrame, held_out: float = 0.2, seed: int = 42, id_col: str = ID, exact: bool = True
) -> DataFrame:
    """Adds `split` (train/test/validation); `held_out` is halved into test and validation.

    0.2 gives 80/10/10 and 0.3 gives 70/15/15. `exact=False` needs no shuffle:
    each row decides from its own hash and the sizes are only expected sizes. `exact=True`
    ranks the ids alone, which are unique, to find the two rows where the parts meet.
    """
    if not exact:
        u = hash_unit(id_col, seed)
        return df.withColumn(
            "split",
            F.when(u >= held_out, "train").when(u < held_out / 2, "test").otherwise("validation"),
        )
    n = df.count()
    held = exact_fraction(held_out, n)
    validation = exact_fraction(0.5, held)
    ends = [n - held, n - validation]
    last = hash_bounds(df, {None: [e - 1 for e in ends if e]}, None, id_col, seed)
    before = [hash_below(last[None, e - 1], id_col, seed) if e else F.lit(False) for e in ends]
    return df.withColumn(
        "split", F.when(before[0], "train").when(before[1], "test").otherwise("validation")
    )


def fold_sizes(counts: dict, k: int = 5) -> dict[object, list[int]]:
    """Rows of each class in each fold: positions of the label-sorted list, dealt modulo k."""
    sizes, start = {}, 0
    for label, n in counts.items():
        first = [(i - start) % k for i in range(k)]
        sizes[label] = [max(0, (n - f + k - 1) // k) for f in first]
        start += n
    return sizes


def fold_column(df: DataFrame, k: int, label: str = LABEL, id_col: str = ID) -> Column:
    """The fold of each row of `df`, as a rule on its label and id alone.

    The rows of a class are cut in id order, unshuffled. Only ids and labels are ranked, to
    find the first id of each fold; no row moves.
    """
    sizes = fold_sizes(class_counts(df, label), k)
    # Places where a fold begins; one that begins behind the last row of its class is empty.
    starts = {c: [p for i in range(1, k) if (p := sum(s[:i])) < sum(s)] for c, s in sizes.items()}
    first = ordered_bounds(df, id_col, starts, label)
    kind = df.schema[id_col].dataType
    bounds = {c: F.array(*[F.lit(first[c, p][0]).cast(kind) for p in ps]) for c, ps in starts.items() if ps}
    if not bounds:
        return F.lit(0)
    below = F.filter(by_class(label, bounds), lambda start: start <= F.col(id_col))
    return F.coalesce(F.size(below), F.lit(0)).cast("int")


def stratified_kfold(
    df: DataFrame, k: int = 5, label: str = LABEL, id_col: str = ID, out: str = "fold"
) -> DataFrame:
    """Adds the fold number of `fold_column`."""
    return df.withColumn(out, fold_column(df, k, label, id_col))


def split_counts(df: DataFrame, label: str = LABEL) -> DataFrame:
    return df.groupBy("split", label).agg(F.count("*").alias("n"))


def split_table(train: DataFrame, test: DataFrame, validation: DataFrame) -> DataFrame:
    """The named three-way dictionary as one table with a `split` column."""
    named = {"train": train, "test": test, "validation": validation}
    parts = [df.withColumn("split", F.lit(name)) for name, df in named.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
