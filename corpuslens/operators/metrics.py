"""Evaluation tables. Every metric starts from the small (truth, prediction) count table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpuslens.schema import LABEL

MAX_CLASSES = 10_000


def accuracy(df: DataFrame, label: str = LABEL, prediction: str = "prediction") -> DataFrame:
    """Share of correct rows, in percent with two decimals."""
    hit = F.sum(F.when(F.col(label) == F.col(prediction), 1).otherwise(0))
    return df.agg(
        F.round(100.0 * hit / F.count("*"), 2).alias("accuracy"), F.count("*").alias("n")
    )


def pair_counts(df: DataFrame, label: str = LABEL, prediction: str = "prediction") -> DataFrame:
    return df.groupBy(F.col(label).alias("truth"), F.col(prediction).alias("predicted")).agg(
        F.count("*").alias("n")
    )


def confusion_matrix(
    df: DataFrame, label: str = LABEL, prediction: str = "prediction"
) -> DataFrame:
    """One row per (truth, predicted), zeros included, over the union of labels."""
    pairs = pair_counts(df, label, prediction)
    # a bounded number of labels is taken before any set of them is built in one task
    seen = pairs.select(F.col("truth").alias("truth")).union(pairs.select("predicted")).distinct().limit(MAX_CLASSES + 1)
    labels = F.array_sort(F.collect_set("truth"))
    checked = F.when(F.size("labels") <= MAX_CLASSES, F.col("labels")).otherwise(
        F.raise_error(F.lit("too many classes for a confusion matrix")).cast(
            f"array<{dict(pairs.dtypes)['truth']}>"
        )
    )
    grid = (
        seen.agg(labels.alias("labels"))
        .select(checked.alias("labels"))
        .select(F.explode("labels").alias("truth"), "labels")
        .select("truth", F.explode("labels").alias("predicted"))
    )
    return grid.join(pairs, ["truth", "predicted"], "left").select(
        "truth", "predicted", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def confusion_pivot(
    df: DataFrame, classes: list, label: str = LABEL, prediction: str = "prediction"
) -> DataFrame:
    """The same matrix with one column per predicted class."""
    long = confusion_matrix(df, label, prediction)
    return long.groupBy("truth").pivot("predicted", classes).agg(F.sum("n")).na.fill(0)


def _share(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def class_scores(df: DataFrame, label: str = LABEL, prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support of every class seen in truth or prediction."""
    hit = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = (
        pair_counts(df, label, prediction)
        .select(
            F.explode(
                F.array(
                    F.struct(
                        F.col("truth").alias("class"),
                        hit.alias("tp"),
                        F.col("n").alias("actual"),
                        F.lit(0).cast("bigint").alias("claimed"),
                    ),
                    F.struct(
                        F.col("predicted").alias("class"),
                        F.lit(0).cast("bigint").alias("tp"),
                        F.lit(0).cast("bigint").alias("actual"),
                        F.col("n").alias("claimed"),
                    ),
                )
            ).alias("s")
        )
        .select("s.*")
        .groupBy("class")
        .agg(F.sum("tp").alias("tp"), F.sum("actual").alias("support"), F.sum("claimed").alias("claimed"))
    )
    tp = F.col("tp")
    return sides.select(
        "class",
        _share(tp, F.col("claimed")).alias("precision"),
        _share(tp, F.col("support")).alias("recall"),
        _share(2.0 * tp, F.col("claimed") + F.col("support")).alias("f1"),
        "support",
        "tp",
    )


def class_report(df: DataFrame, label: str = LABEL, prediction: str = "prediction") -> DataFrame:
    """Per-class scores and the accuracy, macro and weighted average lines in one aggregate."""
    cells = {m: F.avg(m) for m in ("precision", "recall", "f1")}
    weighted = {m: _share(F.sum(F.col(m) * F.col("support")), F.sum("support")) for m in cells}
    share = _share(F.sum("tp"), F.sum("support"))
    scores = class_scores(df, label, prediction)
    lines = scores.agg(
        F.sum("support").alias("support"),
        F.struct(share.alias("precision"), share.alias("recall"), share.alias("f1")).alias("accuracy"),
        F.struct(*[c.alias(m) for m, c in cells.items()]).alias("macro avg"),
        F.struct(*[c.alias(m) for m, c in weighted.items()]).alias("weighted avg"),
    )
    averages = lines.select(
        "support",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(name).alias("line"), F.col(f"`{name}`").alias("v"))
                    for name in ("accuracy", "macro avg", "weighted avg")
                ]
            )
        ).alias("e"),
    ).select("e.line", "e.v.precision", "e.v.recall", "e.v.f1", "support")
    classes = scores.select(
        F.col("class").cast("string").alias("line"), "precision", "recall", "f1", "support"
    )
    return classes.unionByName(averages)


def f1_macro(df: DataFrame, label: str = LABEL, prediction: str = "prediction") -> DataFrame:
    """Unweighted mean of the class F1 values."""
    return class_scores(df, label, prediction).agg(F.avg("f1").alias("f1_macro"))


def multilabel_metrics(
    df: DataFrame,
    scores: list[str],
    truths: list[str],
    threshold: float = 0.5,
    on: str = "prediction",
) -> DataFrame:
    """Micro F1, micro ROC-AUC and exact-match accuracy of sigmoid-thresholded scores.

    The AUC is that of the 0/1 predictions, (TPR + TNR) / 2, as the metric is
    defined here. `on="score"` ranks the probabilities instead (area under the
    curve from counts per distinct probability).
    """
    pairs = [
        F.struct(
            F.col(t).cast("int").alias("y"),
            (1.0 / (1.0 + F.exp(-F.col(s)))).alias("p"),
        )
        for s, t in zip(scores, truths, strict=True)
    ]
    rows = df.select(F.array(*pairs).alias("pairs"))
    exact = F.forall("pairs", lambda e: e.y == (e.p >= threshold).cast("int"))
    right = rows.agg(
        F.avg(exact.cast("int")).alias("accuracy"),
        *[
            F.sum(
                F.aggregate(
                    F.transform(
                        "pairs",
                        _cell(y, p, threshold),
                    ),
                    F.lit(0),
                    lambda a, b: a + b,
                )
            ).alias(name)
            for name, y, p in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))
        ],
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = right.select(
        _share(2.0 * tp, 2.0 * tp + fp + fn).alias("f1"),
        ((_share(tp, tp + fn) + _share(tn, tn + fp)) / 2.0).alias("roc_auc"),
        "accuracy",
    )
    if on == "prediction":
        return out
    auc = score_auc(rows.select(F.explode("pairs").alias("e")).select("e.y", "e.p"))
    return out.drop("roc_auc").withColumn("roc_auc", F.lit(auc))


def _cell(y: int, p: int, threshold: float):
    return lambda e: ((e.y == y) & ((e.p >= threshold).cast("int") == p)).cast("int")


def score_auc(df: DataFrame, label: str = "y", score: str = "p") -> float:
    """Area under the ROC curve of a score column, by the library's distributed curve."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    pairs = df.select(F.col(label).cast("double").alias("label"), F.col(score).alias("raw"))
    return BinaryClassificationEvaluator(
        rawPredictionCol="raw", labelCol="label", metricName="areaUnderROC", numBins=0
    ).evaluate(pairs)


def label_distribution(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Rows per label, most frequent first."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), label)
