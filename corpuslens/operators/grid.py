"""Cross-validated parameter search and the tuned parameters per corpus."""

from __future__ import annotations

from dataclasses import replace
from itertools import product

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from corpuslens.operators.batched import held_out_counts, train, training_table
from corpuslens.operators.ranking import class_counts
from corpuslens.operators.splits import stratified_kfold
from corpuslens.operators.svm import MAX_CLASSES, SvmModel, SvmSpec, spec_gammas, spec_marks
from corpuslens.schema import ID, LABEL

# The full search grid.
GRID = {
    "C": [0.01, 0.1, 1.0, 10.0, 100.0, 1000.0],
    "gamma": [0.01, 0.1, 1.0, 10.0, 100.0, 1000.0],
    "kernel": ["linear", "rbf", "sigmoid"],
}

# Tuned (kernel, C, gamma) per corpus.
PRESETS = {
    "liar_dataset": [("linear", 1000.0, 0.01), ("rbf", 100.0, 0.1), ("sigmoid", 1000.0, 0.01)],
    "isot_titles_dataset": [("linear", 100.0, 0.01), ("rbf", 10.0, 1.0), ("sigmoid", 1000.0, 0.01)],
    "isot_texts_dataset": [("linear", 1000.0, 0.01), ("rbf", 10.0, 1.0), ("sigmoid", 1000.0, 0.01)],
}
DEFAULT_PRESET = [("linear", 1.0, None), ("rbf", 1.0, None), ("sigmoid", 1.0, None)]


def preset_table(spark: SparkSession) -> DataFrame:
    """`dataset, kernel, C, gamma` (a NULL gamma is the scaled default)."""
    rows = [(d, *p) for d, ps in PRESETS.items() for p in ps]
    rows += [("default", *p) for p in DEFAULT_PRESET]
    return spark.createDataFrame(rows, "dataset string, kernel string, C double, gamma double")


def presets(dataset: str, **overrides) -> dict[str, SvmSpec]:
    """The three calibrated base models of a corpus, by kernel."""
    return {
        kernel: SvmSpec(kernel=kernel, C=c, gamma=gamma, **{"probability": True, **overrides})
        for kernel, c, gamma in PRESETS.get(dataset, DEFAULT_PRESET)
    }


def grid_points(grid: dict[str, list]) -> list[dict]:
    """All points in grid order: parameter names sorted, the last one varies fastest."""
    names = sorted(grid)
    return [dict(zip(names, values, strict=True)) for values in product(*[grid[n] for n in names])]


def _work_key(point: dict) -> tuple:
    """Points that train the same model: a linear kernel has no gamma."""
    return tuple(
        (k, v) for k, v in sorted(point.items()) if not (k == "gamma" and point.get("kernel") == "linear")
    )


def count_metrics(counts: np.ndarray) -> tuple[float, float]:
    """(accuracy, macro F1 over the classes seen) of a table of rows by truth and choice."""
    hit, truth, claimed = np.diag(counts), counts.sum(axis=1), counts.sum(axis=0)
    seen = truth + claimed > 0
    f1 = 2 * hit[seen] / (truth + claimed)[seen]
    return float(hit.sum() / max(counts.sum(), 1)), float(f1.mean()) if seen.any() else 0.0


def grid_search(
    df: DataFrame,
    grid: dict[str, list] | None = None,
    folds: int = 5,
    vec: str = "features",
    label: str = LABEL,
    id_col: str = ID,
    base: SvmSpec | None = None,
) -> DataFrame:
    """`grid_idx, C, gamma, kernel, fold, accuracy, f1_macro` for every point and fold.

    All distinct models of all folds are trained side by side: a pass over the rows computes
    the values of each kernel once and serves every C and fold. One more pass counts truth and
    choice on the rows that a model has not seen. Landmarks are chosen by hash from all rows,
    without a look at their labels.
    """
    spark, base = df.sparkSession, replace(base or SvmSpec(), probability=False)
    points = grid_points(grid or GRID)
    specs = {key: replace(base, **dict(key)) for key in dict.fromkeys(map(_work_key, points))}
    data = stratified_kfold(df.select(id_col, label, vec), folds, label, id_col)
    counts = class_counts(data, label, MAX_CLASSES)
    if len(counts) < 2:
        raise ValueError("training needs at least two classes")
    list_ = list(specs.values())
    marks, gammas = spec_marks(list_, data, vec, id_col), spec_gammas(list_, data, vec)
    parts = 1 if len(counts) == 2 else len(counts)
    table = training_table(data, vec, label, counts, id_col, marks, ["fold"], work=len(specs) * folds * parts)
    tasks = [(key, fold) for key in specs for fold in range(folds)]
    gamma_of = dict(zip(specs, gammas))
    todo = [p for key, fold in tasks for p in replace(specs[key], multiclass="ovr").problems(table, gamma_of[key], ((0, fold),))]
    coefs = train(table, todo, base.max_iter)
    judged = held_out_counts(table, todo, coefs, len(todo) // len(tasks))
    scores = {task: count_metrics(counts) for task, counts in zip(tasks, judged, strict=True)}
    rows = [
        (i, float(p["C"]), float(p.get("gamma") or 0.0), p["kernel"], f, *scores[(_work_key(p), f)])
        for i, p in enumerate(points)
        for f in range(folds)
    ]
    return spark.createDataFrame(
        rows,
        "grid_idx int, C double, gamma double, kernel string, fold int, accuracy double, f1_macro double",
    )


def grid_rank(scores: DataFrame, metric: str, params: list[str] | None = None) -> DataFrame:
    """Mean fold score per point and its place; ties go to the first point of the grid."""
    keys = ["grid_idx", *(params or [])]
    mean = scores.groupBy(*keys).agg(F.avg(metric).alias("mean_score"))
    order = Window.orderBy(F.desc("mean_score"), "grid_idx")
    return mean.withColumn("place", F.row_number().over(order))


def best_model(
    df: DataFrame, scores: DataFrame, metric: str, base: SvmSpec | None = None, **fit_args
) -> SvmModel:
    """Refit of the best point of `scores` on all rows."""
    top = (
        grid_rank(scores, metric, ["C", "gamma", "kernel"]).where(F.col("place") == 1).first()
    )
    spec = replace(base or SvmSpec(), C=top.C, gamma=top.gamma, kernel=top.kernel)
    return spec.fit(df, **fit_args)


