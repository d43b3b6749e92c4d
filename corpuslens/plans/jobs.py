"""End-to-end studies: compositions of the operators, one function per study.

Every study takes DataFrames and returns a dictionary of DataFrames (or writes
them); nothing but class counts, model parameters and a few bounded samples is
ever on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

from corpuslens.functions.vectors import as_array
from corpuslens.operators import metrics as E
from corpuslens.operators.attribution import kernel_shap, shap_points, shap_summary
from corpuslens.operators.encode import encode_fixed, token_vocabulary
from corpuslens.operators.ensemble import (
    fit_or_load_ensemble,
    fit_stacking,
    fit_voting,
)
from corpuslens.operators.features import drop_missing, linguistic_features
from corpuslens.operators.grid import GRID, best_model, grid_search, presets
from corpuslens.operators.neighbors import knn_label
from corpuslens.operators.relational import class_stats, linguistic_set, one_hot, sample_n, shape_report
from corpuslens.operators.resample import smote, under_sample
from corpuslens.operators.scaling import fit_min_max, min_max_by
from corpuslens.operators.selection import chi2_scores, select_k_best
from corpuslens.operators.sparse import ROW, Blocks, blocks_of, fit_sparse_svd, sparse_smote, sparse_tfidf
from corpuslens.operators.splits import random_split3
from corpuslens.operators.svd import fit_svd
from corpuslens.operators.svm import SvmSpec
from corpuslens.operators.tfidf import fit_tfidf_vectors
from corpuslens.schema import FEATURES, ID, LABEL
from corpuslens.session import stage
from corpuslens.sources.files import columns_in_order, write_features
from corpuslens.sources.vectors import VectorCollection


def feature_job(
    corpus: DataFrame,
    split: str | None = None,
    fit_per_split: bool = False,
    path: str | None = None,
    fmt: str = "parquet",
    **feature_args,
) -> DataFrame:
    """Raw texts (`doc_id, text, label[, split]`) to the scaled processed table.

    Text features are computed once and stored; the scaler then reads 21 numeric
    columns. With a `split` column the scaler is fitted on the train rows, or on
    each split by itself with `fit_per_split`. All rows are scaled and written;
    rows without content text are dropped where the table is read.
    """
    keep = (ID, LABEL, split) if split else (ID, LABEL)
    features = stage(linguistic_features(corpus, keep=keep, **feature_args), "features")
    if split and fit_per_split:
        scaled = min_max_by(features, FEATURES, split)
    else:
        train = features.where(F.col(split) == "train") if split else features
        scaled = fit_min_max(train, FEATURES).transform(features)
    if LABEL in scaled.columns:
        scaled = columns_in_order(scaled)
    if path:
        write_features(scaled, path, fmt, split)
    return drop_missing(scaled)


# --- feature sets ---------------------------------------------------------------------


@dataclass
class FeatureSet:
    train: DataFrame  # doc_id, label, features
    test: DataFrame
    names: list[str]


def tfidf_set(train: DataFrame, test: DataFrame, ngram_range=(1, 1), use_min_df: bool = True) -> FeatureSet:
    vectors = fit_tfidf_vectors(train, ngram_range=ngram_range, min_df=0.01 if use_min_df else 1)
    return FeatureSet(
        *[
            stage(vectors.transform(df.select(ID, LABEL, "text")).drop("text"), "tfidf")
            for df in (train, test)
        ],
        vectors.names,
    )


def linguistic_vectors(train: DataFrame, test: DataFrame, **_) -> FeatureSet:
    parts = [
        linguistic_set(df).select(ID, LABEL, F.array(*FEATURES).cast("array<double>").alias("features"))
        for df in (train, test)
    ]
    return FeatureSet(*[stage(p, "linguistic") for p in parts], FEATURES)


FEATURE_SETS = {"tfidf": tfidf_set, "linguistic": linguistic_vectors}


def feature_set(name: str, train: DataFrame, test: DataFrame, **args) -> FeatureSet:
    return FEATURE_SETS[name](train, test, **args)


def reduce_set(features: FeatureSet, k: int = 100) -> FeatureSet:
    """SVD fitted on train, both sides projected, then min-max fitted on train."""
    svd = fit_svd(features.train, k)
    k = svd.components.shape[1]
    names = [f"svd{i}" for i in range(k)]

    def widen(df: DataFrame) -> DataFrame:
        projected = svd.project(df.select(ID, LABEL, "features"), out="_p")
        return projected.select(ID, LABEL, *[F.col("_p")[i].alias(n) for i, n in enumerate(names)])

    return _ranged(stage(widen(features.train), "svd"), widen(features.test), names)


def _ranged(train: DataFrame, test: DataFrame, names: list[str]) -> FeatureSet:
    """The columns `names` of both sides, min-max scaled as fitted on train, as vectors."""
    scaler = fit_min_max(train, names)
    pack = F.array(*names).alias("features")
    return FeatureSet(
        *[
            stage(scaler.transform(df).select(ID, LABEL, pack), "reduced")
            for df in (train, test)
        ],
        names,
    )


def oversampled_reduction(train: DataFrame, test: DataFrame, k: int, min_df: int | float, seed: int = 42) -> FeatureSet:
    """TF-IDF of a vocabulary of any size, over-sampling, then the reduction, all on sparse rows."""
    grown, asked, terms = sparse_tfidf(train, test, min_df=min_df)
    grown = sparse_smote(grown, seed=seed)
    blocks = blocks_of(grown, grown.count())
    svd = fit_sparse_svd(blocks, terms.count(), k)
    names = [f"svd{i}" for i in range(svd.turn.shape[1])]

    def widen(df: DataFrame, own: Blocks) -> DataFrame:
        found = svd.project(df.select(ROW, ID, LABEL), own, "_p")
        return stage(found.select(ID, LABEL, *[F.col("_p")[i].alias(n) for i, n in enumerate(names)]), "svd")

    return _ranged(widen(grown, blocks), widen(asked, blocks_of(asked, asked.count())), names)


def resample_train(features: FeatureSet, how: str, seed: int = 42) -> FeatureSet:
    """Only the training side is ever resampled."""
    if how == "undersample":
        return replace(features, train=stage(under_sample(features.train, seed), "under"))
    if how == "oversample":
        dense = features.train.withColumn("features", as_array(features.train, "features"))
        return replace(features, train=stage(smote(dense, seed=seed).drop("synthetic"), "smote"))
    if how != "none":
        raise ValueError(how)
    return features


def reports(predictions: DataFrame) -> dict[str, DataFrame]:
    scored = stage(predictions.select(ID, LABEL, "prediction"), "predictions")
    return {
        "predictions": scored,
        "accuracy": E.accuracy(scored),
        "confusion": E.confusion_matrix(scored),
        "report": E.class_report(scored),
    }


# --- studies --------------------------------------------------------------------------


def grid_experiment(
    train: DataFrame,
    test: DataFrame,
    ngram_range: tuple[int, int] = (1, 1),
    metrics: tuple[str, ...] = ("accuracy", "f1_macro"),
    grid: dict[str, list] | None = None,
    feature_set_name: str = "tfidf",
    resampling: str = "oversample",
    use_min_df: bool = True,
    svd_k: int | None = None,
    folds: int = 5,
    base: SvmSpec | None = None,
) -> dict[str, DataFrame]:
    """The single-model study. `svd_k` (long texts) reduces before resampling."""
    args = {"ngram_range": ngram_range, "use_min_df": use_min_df}
    features = feature_set(feature_set_name, train, test, **args)
    if svd_k:
        features = reduce_set(features, svd_k)
    features = resample_train(features, resampling)
    scores = grid_search(features.train, grid or GRID, folds, base=base)
    out = {
        "shapes": shape_report(train=features.train, test=features.test),
        "train_labels": E.label_distribution(features.train),
        "test_labels": E.label_distribution(features.test),
        "scores": scores,
    }
    for metric in metrics:
        model = best_model(features.train, scores, metric, base)
        tables = reports(model.transform(features.test))
        tables["train_report"] = reports(model.transform(features.train))["report"]
        out |= {f"{metric}_{name}": table for name, table in tables.items()}
    return out


def experiment_name(dataset: str, feature_set_name: str, ensemble: str, final: str) -> str:
    return f"{dataset}_{feature_set_name}_{ensemble.title()}Ensemble_{final}_Final"


# (explained rows, background rows) by (statements corpus?, feature set).
SHAP_ROWS = {
    (True, "tfidf"): (100, 50),
    (False, "tfidf"): (10, 10),
    (False, "linguistic"): (50, 25),
}


def ensemble_experiment(
    train: DataFrame,
    test: DataFrame,
    dataset: str = "liar_dataset",
    feature_set_name: str = "tfidf",
    ensemble: str = "stacking",
    final: str = "none",
    folder: str | None = None,
    folds: int = 5,
    shap_rows: tuple[int, int] | None = None,
    n_coalitions: int | None = None,
    **overrides,
) -> dict[str, DataFrame]:
    """The ensemble study with attributions. A stored ensemble in `folder` is reused."""
    statements = dataset == "liar_dataset"
    if statements and feature_set_name == "linguistic":
        raise ValueError("no study is set up for the statements corpus with linguistic features")
    name = experiment_name(dataset, feature_set_name, ensemble, final)
    features = feature_set(feature_set_name, train, test)
    if statements and feature_set_name == "tfidf":
        features = resample_train(features, "oversample")
    specs = presets(dataset, **overrides)

    def fit():
        if ensemble == "stacking":
            return fit_stacking(features.train, specs, final, folds)
        return fit_voting(features.train, specs, "hard")

    spark = train.sparkSession
    model = fit_or_load_ensemble(spark, f"{folder}/{name}", fit) if folder else fit()
    out = reports(model.transform(features.test))
    n_rows, n_background = shap_rows or SHAP_ROWS[(statements, feature_set_name)]
    phi = stage(
        kernel_shap(
            model.transform,
            sample_n(features.test, n_rows),
            sample_n(features.train, n_background),
            n_coalitions=n_coalitions,
        ),
        "shap",
    )
    values = features.test.select(
        ID, F.posexplode(as_array(features.test, "features")).alias("feature", "value")
    )
    return out | {
        "shap": phi,
        "shap_summary": shap_summary(phi),
        "shap_class_summary": shap_summary(phi, per_class=True),
        "shap_points": shap_points(phi, values),
    }


def voting_experiment(
    train: DataFrame,
    test: DataFrame,
    kind: str = "hard",
    C: float = 1.0,
    gamma: float = 0.1,
    svd_k: int | None = None,
    min_df: bool = False,
    **overrides,
) -> dict[str, DataFrame]:
    """TF-IDF, over-sampling, then (here after it) the optional reduction, then a vote.

    With the reduction the vocabulary may have any size: rows stay sparse until they are reduced.
    """
    if svd_k:
        features = oversampled_reduction(train, test, svd_k, 0.01 if min_df else 1)
    else:
        features = resample_train(tfidf_set(train, test, use_min_df=min_df), "oversample")
    specs = {
        kernel: SvmSpec(kernel=kernel, C=C, gamma=gamma, **overrides)
        for kernel in ("rbf", "linear", "sigmoid")
    }
    model = fit_voting(features.train, specs, kind)
    seen = reports(model.transform(features.train))
    return reports(model.transform(features.test)) | {"train_report": seen["report"]}


def knn_experiment(
    store: DataFrame, test: DataFrame, id_col: str = "vec_id", vec: str = "embedding", folder: str | None = None, **opts
) -> dict[str, DataFrame]:
    """Label every test vector by its nearest stored vector and report.

    With `folder`, the stored vectors are first written to the collection there (version 1 where
    they have none), and the search runs on what the collection then holds.
    """
    if folder:
        versioned = store if "version" in store.columns else store.withColumn("version", F.lit(1))
        store = VectorCollection(store.sparkSession, folder, id_col).upsert(versioned)
    found = stage(knn_label(test, store, id_col, vec, **opts), "knn")
    return {
        "predictions": found,
        "accuracy": E.accuracy(found),
        "confusion": E.confusion_matrix(found),
    }


def selection_job(df: DataFrame, k: int, features: list[str] | None = None) -> dict[str, DataFrame]:
    """Chi-square top-k of a processed table and its per-class summary."""
    features = features or FEATURES
    numbers = linguistic_set(df)
    return {
        "selected": select_k_best(chi2_scores(numbers, features), k),
        "classes": class_stats(numbers, features),
    }


def multilabel_job(
    df: DataFrame,
    names: dict[str, int],
    held_out: float = 0.2,
    max_len: int = 512,
    vocab_size: int = 30_522,
) -> DataFrame:
    """One-hot labels, three-way split and fixed-length encoding in one table.

    The vocabulary is learned from the training split.
    """
    split = random_split3(one_hot(df.select(ID, "text", LABEL), names), held_out)
    vocabulary = stage(token_vocabulary(split.where(F.col("split") == "train"), size=vocab_size), "vocab")
    encoded = encode_fixed(split, vocabulary, labels=list(names), max_len=max_len)
    return split.select(ID, "split").join(encoded, ID)


def multilabel_experiment(
    df: DataFrame, names: list[str], held_out: float = 0.2, base: SvmSpec | None = None, use_min_df: bool = True
) -> dict[str, DataFrame]:
    """One classifier a class over TF-IDF of the training split, and the multi-label metrics of each split.

    `df` has the id, `text` and a 0/1 column for each of `names`. A margin is the logit of a class:
    `train`, `validation` and `test` hold micro F1, ROC-AUC and exact-match accuracy, `..._scores` the margins.
    """
    split = stage(random_split3(df.select(ID, "text", *names), held_out), "split")
    parts = {p: split.where(F.col("split") == p).withColumn(LABEL, F.lit(0)) for p in ("train", "test", "validation")}
    vectors = fit_tfidf_vectors(parts["train"].select(ID, "text"), min_df=0.01 if use_min_df else 1)
    rows = {p: stage(vectors.transform(part.select(ID, "text", *names)).drop("text"), "tfidf") for p, part in parts.items()}
    out, scored = {}, dict(rows)
    for name in names:
        model = (base or SvmSpec()).fit(rows["train"].withColumn(LABEL, F.col(name).cast("int")))
        for p, part in scored.items():
            scored[p] = model.transform(part).select(*part.columns, F.col("margins")[1].alias(f"s_{name}"))
    for p, part in scored.items():
        out[p] = E.multilabel_metrics(part, [f"s_{n}" for n in names], list(names))
        out[f"{p}_scores"] = part.drop("features")
    return out
