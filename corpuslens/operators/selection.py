"""Chi-square feature scores and top-k selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from corpuslens.schema import LABEL


def chi2_scores(df: DataFrame, features: list[str], label: str = LABEL) -> DataFrame:
    """`feature, idx, score`: sum over classes of (O - E)^2 / E.

    The wide table collapses to one row per class before anything is unpivoted,
    so the shuffle carries classes x features numbers.
    """
    sums = df.groupBy(label).agg(
        F.count("*").alias("_n"), *[F.sum(F.col(f).cast("double")).alias(f) for f in features]
    )
    cells = sums.select(
        label,
        "_n",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(f).alias("feature"), F.lit(i).alias("idx"), F.col(f).alias("observed"))
                    for i, f in enumerate(features)
                ]
            )
        ).alias("c"),
    ).select(label, "_n", "c.*")
    return _score(cells)


def chi2_terms(df: DataFrame, class_sizes: DataFrame, label: str = LABEL) -> DataFrame:
    """The same score over a long table `(label, term, idx, value)`.

    `class_sizes` (label, n) counts documents, including those without any term.
    """
    cells = (
        df.groupBy(label, F.col("term").alias("feature"), "idx")
        .agg(F.sum("value").alias("observed"))
        .join(F.broadcast(class_sizes.withColumnRenamed("n", "_n")), label)
    )
    # Classes in which a term never occurs still add E to the statistic.
    total = class_sizes.agg(F.sum("n")).first()[0]
    per = cells.groupBy("feature", "idx").agg(
        F.sum("observed").alias("all"), F.sum(F.col("observed") ** 2 / F.col("_n")).alias("s")
    )
    # sum (O-E)^2/E = sum O^2/E - all, with E = all * n_c / n.
    score = F.when(F.col("all") != 0, F.col("s") * float(total) / F.col("all") - F.col("all"))
    return per.select("feature", "idx", score.alias("score"))


def _score(cells: DataFrame) -> DataFrame:
    everything = Window.partitionBy("feature")
    expected = (
        F.sum("observed").over(everything) * F.col("_n") / F.sum("_n").over(everything)
    )
    part = cells.withColumn("_e", expected).withColumn(
        "_part", F.when(F.col("_e") != 0, (F.col("observed") - F.col("_e")) ** 2 / F.col("_e"))
    )
    return part.groupBy("feature", "idx").agg(F.sum("_part").alias("score"))


def select_k_best(scores: DataFrame, k: int) -> DataFrame:
    """The `k` best features in column order; of equal scores the later column wins."""
    best = scores.orderBy(F.desc_nulls_last("score"), F.desc("idx")).limit(k)
    return best.select("feature", "idx", "score").orderBy("idx")
