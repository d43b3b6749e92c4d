"""Class balancing: under-sampling, synthetic over-sampling, weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpuslens.functions.hashing import hash_int, hash_unit
from corpuslens.operators.neighbors import knn_join
from corpuslens.operators.ranking import by_class, class_counts, hash_rank
from corpuslens.operators.splits import first_of_class
from corpuslens.schema import ID, LABEL


def under_sample(
    df: DataFrame, seed: int = 42, label: str = LABEL, id_col: str = ID
) -> DataFrame:
    """Every class cut to the size of the smallest one, without replacement. Ids are unique; no row moves."""
    counts = class_counts(df, label)
    least = min(counts.values())
    return df.where(first_of_class(df, dict.fromkeys(counts, least), seed, label, id_col))


def drawn(
    minority: DataFrame, counts: dict, k: int, seed: int, label: str = LABEL, id_col: str = ID
) -> tuple[DataFrame, DataFrame]:
    """The base rows of all new points, and a row a point: its number `_j`, neighbour `_nb` and position `_u`."""
    top = max(counts.values())
    need = {c: top - n for c, n in counts.items() if n < top}
    single = [c for c in need if counts[c] == 1]
    if single:
        raise ValueError(f"classes with a single row have no neighbour: {single}")
    ranked = hash_rank(minority, [label], id_col, f"{seed}:base", "_rn")
    size = by_class(label, {c: counts[c] for c in need})
    every = by_class(label, {c: n // counts[c] for c, n in need.items()})
    extra = by_class(label, {c: n % counts[c] for c, n in need.items()})
    copies = every + F.when(F.col("_rn") < extra, 1).otherwise(0)
    bases = ranked.withColumn("_copies", copies).where(F.col("_copies") > 0)
    near = by_class(label, {c: min(k, counts[c] - 1) for c in need})
    draws = bases.withColumn("_c", F.explode(F.expr("sequence(0, int(_copies) - 1)"))).withColumn(
        "_j", F.col("_rn") + F.col("_c") * size
    )
    name = F.concat(F.col(label).cast("string"), F.lit(":"), F.col("_j").cast("string"))
    draws = draws.withColumns(
        {
            "_nb": (F.pmod(hash_int(name, f"{seed}:neighbour"), near) + 1).cast("int"),
            "_u": hash_unit(name, f"{seed}:position"),
        }
    )
    return bases, draws


def smote(
    df: DataFrame,
    vec: str = "features",
    k: int = 5,
    seed: int = 42,
    label: str = LABEL,
    id_col: str = ID,
    **knn_opts,
) -> DataFrame:
    """`id, label, vector, synthetic`: every class grown to the size of the largest.

    A new point lies between a row and one of its `k` nearest rows of the same
    class (fewer in a class of `k` rows or less). Base row j of a class is hash
    rank j modulo the class size; neighbour and position come from the hash of
    (label, j). Ids become strings; new rows are named `smote-<label>-<j>`.
    """
    counts = class_counts(df, label)
    top = max(counts.values())
    need = {c: top - n for c, n in counts.items() if n < top}
    originals = df.select(
        F.col(id_col).cast("string").alias(id_col),
        label,
        F.col(vec).cast("array<double>").alias(vec),
        F.lit(False).alias("synthetic"),
    )
    if not need:
        return originals
    minority = df.where(F.col(label).isin(list(need))).select(
        id_col, label, F.col(vec).cast("array<double>").alias(vec)
    )
    bases, draws = drawn(minority, counts, k, seed, label, id_col)
    neighbours = knn_join(
        bases,
        minority,
        k,
        query_id=id_col,
        base_id=id_col,
        vec=vec,
        by=label,
        metric="euclidean",
        exclude_self=True,
        with_vector=True,
        **knn_opts,
    ).select(F.col("query_id").alias(id_col), F.col("rank").alias("_nb"), F.col("vector").alias("_to"))

    made = draws.join(neighbours, [id_col, "_nb"]).select(
        F.concat(
            F.lit("smote-"), F.col(label).cast("string"), F.lit("-"), F.col("_j").cast("string")
        ).alias(id_col),
        label,
        F.zip_with(
            F.arrays_zip(F.col(vec).alias("a"), F.col("_to").alias("b")),
            F.array_repeat("_u", F.size(vec)),
            lambda p, u: p["a"] + u * (p["b"] - p["a"]),
        ).alias(vec),
        F.lit(True).alias("synthetic"),
    )
    return originals.unionByName(made)


def class_weights(df: DataFrame, label: str = LABEL, out: str = "weight") -> DataFrame:
    """Adds the balanced weight n / (classes * rows of the class)."""
    counts = class_counts(df, label)
    n = sum(counts.values())
    return df.withColumn(
        out, by_class(label, {c: n / (len(counts) * m) for c, m in counts.items()})
    )
