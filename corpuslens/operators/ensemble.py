"""Voting, stacking, bagging and boosting over SVM base models."""

from __future__ import annotations

import json
import math
import os
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpuslens.functions.hashing import hash_unit
from corpuslens.functions.vectors import packed
from corpuslens.operators.batched import Boosted, boost_sums, train, training_table
from corpuslens.operators.ranking import class_counts
from corpuslens.operators.splits import stratified_kfold
from corpuslens.operators.svm import (
    MAX_CLASSES,
    ROWS_PER_TASK,
    SvmModel,
    SvmSpec,
    fit_many,
    fit_parts,
    linear_model,
    side_by_side_raws,
    spec_gammas,
    spec_marks,
)
from corpuslens.schema import ID, LABEL
from corpuslens.session import stage


# --- votes over a long table of predictions -------------------------------------------


def vote_hard(predictions: DataFrame, id_col: str = ID, prediction: str = "prediction") -> DataFrame:
    """Majority label per row of `(id, model, prediction)`; ties go to the smallest label."""
    return predictions.groupBy(id_col).agg(F.mode(prediction, True).alias(prediction))


def vote_soft(probabilities: DataFrame, id_col: str = ID) -> DataFrame:
    """Class of the highest mean probability of `(id, model, class, probability)`.

    Placing by id once serves both aggregates.
    """
    mean = probabilities.repartition(id_col).groupBy(id_col, "class").agg(F.avg("probability").alias("p"))
    # Rounding lets equal means tie in spite of summation order; the smaller class wins.
    best = F.max(F.struct(F.round("p", 12).alias("p"), (-F.col("class")).alias("neg"), F.col("class").alias("v")))
    return mean.groupBy(id_col).agg(best.alias("b")).select(
        id_col, F.col("b.v").alias("prediction"), F.col("b.p").alias("probability")
    )


# --- ensembles ------------------------------------------------------------------------


def argmax_label(scores: Column, classes: list) -> Column:
    """The class of the highest score; the first of equal scores."""
    place = F.array_position(scores, F.array_max(scores)).cast("int")
    return F.element_at(F.array(*[F.lit(c) for c in classes]), place)


@dataclass(frozen=True)
class VotingModel:
    """Base models next to each other in one row: no shuffle to predict."""

    members: dict[str, SvmModel]
    kind: str  # hard or soft

    @property
    def classes(self) -> list:
        return next(iter(self.members.values())).classes

    def transform(self, df: DataFrame, vec: str = "features") -> DataFrame:
        out, raws, columns = side_by_side_raws(df, self.members, vec)
        for name, model in self.members.items():
            out = model.transform(out, vec, f"_{name}_", raws.get(name))
            columns += [f"_{name}_{c}" for c in ("margins", "prediction", "probability")]
        shares = [F.col(f"_{n}_probability") for n, m in self.members.items() if m.curves]
        if shares:
            total = shares[0]
            for p in shares[1:]:
                total = F.zip_with(total, p, lambda a, b: a + b)
            out = out.withColumn("probability", F.transform(total, lambda x: x / len(shares)))
        if self.kind == "soft":
            choice = argmax_label(F.col("probability"), self.classes)
        else:
            votes = [
                sum((F.col(f"_{n}_prediction") == F.lit(c)).cast("int") for n in self.members)
                for c in self.classes
            ]
            choice = argmax_label(F.array(*votes), self.classes)
        return out.withColumn("prediction", choice).drop(*columns)


def fit_voting(
    df: DataFrame, specs: dict[str, SvmSpec], kind: str = "hard", vec: str = "features", label: str = LABEL, id_col: str = ID
) -> VotingModel:
    specs = {n: replace(s, probability=s.probability or kind == "soft") for n, s in specs.items()}
    return VotingModel(_fit_members(specs, df, vec, label, id_col), kind)


def _fit_members(specs: dict[str, SvmSpec], *args) -> dict[str, SvmModel]:
    return fit_many(specs, *args)


def _meta_features(df: DataFrame, members: dict[str, SvmModel], vec: str) -> DataFrame:
    """Base probabilities side by side in `meta`; a two-class model adds one number."""
    out, raws, columns = side_by_side_raws(df, members, vec)
    parts = []
    for name, model in members.items():
        out = model.transform(out, vec, f"_{name}_", raws.get(name))
        columns += [f"_{name}_{c}" for c in ("margins", "prediction", "probability")]
        share = F.col(f"_{name}_probability")
        parts.append(F.slice(share, 2, 1) if len(model.classes) == 2 else share)
    return out.withColumn("meta", array_to_vector(F.concat(*parts))).drop(*columns)


def out_of_fold(
    df: DataFrame,
    specs: dict[str, SvmSpec],
    folds: int = 5,
    vec: str = "features",
    label: str = LABEL,
    id_col: str = ID,
) -> DataFrame:
    """Each training row once, with base probabilities of models that never saw it.

    The models of all folds, and those that calibrate them inside their training rows, are one batch.
    """
    folded = stage(stratified_kfold(df.select(id_col, label, vec), folds, label, id_col), "folds")
    fitted = fit_parts(specs, folded, list(range(folds)), vec, label, id_col)
    return _held_out_meta(folded, fitted, vec).select(id_col, label, "fold", "meta")


def _held_out_meta(folded: DataFrame, fitted: list[dict[str, SvmModel]], vec: str) -> DataFrame:
    """`meta` of the rows of each fold by that fold's models."""
    parts = [
        _meta_features(folded.where(F.col("fold") == fold), members, vec) for fold, members in enumerate(fitted)
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows


@dataclass(frozen=True)
class StackingModel:
    members: dict[str, SvmModel]
    final: SvmModel | LogisticRegressionModel
    classes: list

    def transform(self, df: DataFrame, vec: str = "features") -> DataFrame:
        meta = _meta_features(df, self.members, vec)
        if isinstance(self.final, SvmModel):
            return self.final.transform(meta, "meta").drop("meta", "margins")
        scored = self.final.copy(
            {self.final.probabilityCol: "_p", self.final.predictionCol: "_c", self.final.rawPredictionCol: "_r"}
        ).transform(meta)
        scored = scored.withColumn("probability", vector_to_array("_p"))
        choice = argmax_label(F.col("probability"), self.classes)
        return scored.withColumn("prediction", choice).drop("_p", "_c", "_r", "meta")


def logistic_final(rows: DataFrame, classes: list, vec: str = "meta", label: str = LABEL) -> LogisticRegressionModel:
    """Multinomial logistic regression with the usual unit ridge penalty."""
    index = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1
    n = rows.count()
    return LogisticRegression(
        featuresCol=vec, labelCol="_y", family="multinomial", maxIter=100, regParam=1.0 / n, standardization=False
    ).fit(rows.coalesce(n // ROWS_PER_TASK + 1).withColumn("_y", index.cast("double")))


# Which base models feed which final model.
STACK_BASES = {
    "linear": ["sigmoid", "rbf"],
    "rbf": ["sigmoid", "linear"],
    "sigmoid": ["rbf", "linear"],
    "none": ["sigmoid", "rbf", "linear"],
}


def fit_stacking(
    df: DataFrame,
    specs: dict[str, SvmSpec],
    final: str = "none",
    folds: int = 5,
    vec: str = "features",
    label: str = LABEL,
    id_col: str = ID,
    bases: list[str] | None = None,
) -> StackingModel:
    """`final` is one of the kernels (that model combines the other two) or `none` (logistic).

    `bases` names other base models of `specs`.
    """
    bases = {n: replace(specs[n], probability=True) for n in bases or STACK_BASES[final]}
    folded = stage(stratified_kfold(df.select(id_col, label, vec), folds, label, id_col), "folds")
    *fitted, members = fit_parts(bases, folded, [*range(folds), None], vec, label, id_col)
    meta = stage(_held_out_meta(folded, fitted, vec).select(id_col, label, "meta"), "meta")
    classes = list(class_counts(meta, label))
    if final == "none":
        combiner = logistic_final(meta, classes, label=label)
    else:
        combiner = replace(specs[final], probability=True).fit(meta, "meta", label, id_col)
    return StackingModel(members, combiner, classes)


# --- bagging and boosting -------------------------------------------------------------


def poisson_weight(id_col: str, seed: str) -> Column:
    """Poisson(1) draw per row: the number of times a bootstrap of a large table picks it."""
    u = hash_unit(id_col, seed)
    below, rule = 0.0, None
    for k in range(9):
        below += math.exp(-1) / math.factorial(k)
        rule = F.when(u < below, float(k)) if rule is None else rule.when(u < below, float(k))
    return rule.otherwise(9.0)


def fit_bagging(
    df: DataFrame,
    spec: SvmSpec,
    n_estimators: int = 10,
    vec: str = "features",
    label: str = LABEL,
    id_col: str = ID,
    seed: int = 42,
) -> VotingModel:
    """Members trained on bootstrap weights; their mean probability decides."""
    calibrated = replace(spec, probability=True)
    names = {f"bag{i}": f"_w{i}" for i in range(n_estimators)}
    drawn = df.select(
        id_col, label, vec, *[poisson_weight(id_col, f"{seed}:bag:{i}").alias(f"_w{i}") for i in range(n_estimators)]
    )
    return VotingModel(fit_many({n: calibrated for n in names}, drawn, vec, label, id_col, names), "soft")


def adaboost_step(weight: Column, wrong: Column, error: Column, n_classes: int) -> tuple[Column, Column]:
    """(alpha, unnormalised new weight) of one boosting round."""
    alpha = F.log((1.0 - error) / error) + F.lit(math.log(n_classes - 1))
    return alpha, weight * F.exp(F.when(wrong, alpha).otherwise(F.lit(0.0)))


def adaboost_round(
    df: DataFrame, label: str, prediction: str, weight: str, n_classes: int
) -> DataFrame:
    """One reweighting of a table of predictions: adds `alpha` and `new_weight` (sum 1).

    Without a wrong row alpha is 1, as in `fit_adaboost`, and the weights stay as they are.

    The two totals come from one aggregate over the table.
    """
    wrong = F.col(label) != F.col(prediction)
    sums = df.agg(
        F.sum(weight).alias("all"), F.sum(F.when(wrong, F.col(weight)).otherwise(0.0)).alias("bad")
    ).first()
    if not sums["bad"]:
        total = sums["all"] or 1.0
        return df.withColumns({"alpha": F.lit(1.0), "new_weight": F.col(weight) / F.lit(float(total))})
    error = sums["bad"] / sums["all"]
    alpha, updated = adaboost_step(F.col(weight), wrong, F.lit(error), n_classes)
    total = (sums["all"] - sums["bad"]) + sums["bad"] * (1.0 - error) / error * (n_classes - 1)
    return df.withColumns({"alpha": alpha, "new_weight": updated / F.lit(total)})


@dataclass(frozen=True)
class BoostModel:
    """Members share their features, so a row's are computed once for all of them."""

    members: list[tuple[float, SvmModel]]
    classes: list

    def transform(self, df: DataFrame, vec: str = "features") -> DataFrame:
        first = self.members[0][1]
        coef = np.concatenate([m.models[0].matrix() for _, m in self.members], axis=1)
        alphas, raws, k = np.array([a for a, _ in self.members]), first.n_raws, len(self.classes)

        def scores(margins: np.ndarray) -> np.ndarray:
            chosen = (margins > 0).astype(int) if raws == 1 else margins.reshape(len(margins), -1, raws).argmax(axis=2)
            out = np.zeros((len(margins), k))
            np.add.at(out, (np.arange(len(margins))[:, None], chosen), alphas[None])
            return out

        scored = df.withColumn("_scores", first.models[0].of(packed(df, vec), coef, scores))
        return scored.withColumn("prediction", argmax_label(F.col("_scores"), self.classes)).drop("_scores")


def fit_adaboost(
    df: DataFrame,
    spec: SvmSpec,
    n_estimators: int = 100,
    vec: str = "features",
    label: str = LABEL,
    id_col: str = ID,
) -> BoostModel:
    """Multi-class boosting: wrong rows weigh more in the next round.

    The state of a round is the members so far: a task rebuilds the weights of its rows from
    them, so no plan and no table grows with the rounds. Each fit starts from the last one.
    """
    counts = class_counts(df, label, MAX_CLASSES)
    if len(counts) < 2:
        raise ValueError("training needs at least two classes")
    classes, k, members = list(counts), len(counts), []
    marks, (gamma,) = spec_marks([spec], df, vec, id_col), spec_gammas([spec], df, vec)
    table = training_table(df, vec, label, counts, id_col, marks, work=k)
    todo = replace(spec, probability=False, multiclass="ovr").problems(table, gamma)
    coef, alphas, start, n = None, [], None, float(sum(counts.values()))
    boosted = Boosted(todo[0].map, np.zeros((0, 0)), len(todo), np.zeros(0))
    total = n
    for _ in range(n_estimators):
        fitted = train(table, todo, spec.max_iter, start=start, boosted=boosted, total=total)
        start, last = fitted, np.stack(fitted, axis=1)
        total, bad = boost_sums(table, boosted, last)
        error = bad / total
        if error >= 1.0 - 1.0 / k:
            if not members:
                raise ValueError("the base model is no better than chance")
            break
        alpha = math.log((1.0 - error) / error) + math.log(k - 1) if error > 0 else 1.0
        members.append((alpha, linear_model(spec, classes, gamma, marks[0] if marks else None, fitted)))
        if error <= 0:
            break
        coef = last if coef is None else np.concatenate([coef, last], axis=1)
        alphas.append(alpha)
        boosted = Boosted(todo[0].map, coef, len(todo), np.array(alphas))
        total = (total - bad) + bad * math.exp(alpha)
    return BoostModel(members, classes)


# --- storage --------------------------------------------------------------------------


def save_ensemble(spark: SparkSession, model: VotingModel | StackingModel, path: str) -> None:
    """Member models, then one line of facts: a folder without it was cut off by a failure."""
    for name, member in model.members.items():
        member.save(spark, os.path.join(path, "members", name))
    facts = {"members": list(model.members), "type": type(model).__name__}
    if isinstance(model, VotingModel):
        facts["kind"] = model.kind
    else:
        facts["classes"] = model.classes
        facts["final"] = "svm" if isinstance(model.final, SvmModel) else "logistic"
        target = os.path.join(path, "final")
        if facts["final"] == "svm":
            model.final.save(spark, target)
        else:
            model.final.write().overwrite().save(target)
    spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode(
        "overwrite"
    ).text(os.path.join(path, "facts"))


def load_ensemble(spark: SparkSession, path: str) -> VotingModel | StackingModel:
    facts = json.loads(spark.read.text(os.path.join(path, "facts")).first().value)
    members = {n: SvmModel.load(spark, os.path.join(path, "members", n)) for n in facts["members"]}
    if facts["type"] == "VotingModel":
        return VotingModel(members, facts["kind"])
    target = os.path.join(path, "final")
    if facts["final"] == "svm":
        return StackingModel(members, SvmModel.load(spark, target), facts["classes"])
    return StackingModel(members, LogisticRegressionModel.load(target), facts["classes"])


def fit_or_load_ensemble(
    spark: SparkSession, path: str, fit: Callable[[], VotingModel | StackingModel]
) -> VotingModel | StackingModel:
    """The stored ensemble if it is complete, else a fitted one that is stored first."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(os.path.join(path, "facts", "_SUCCESS"))
    files = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(done):
        return load_ensemble(spark, path)
    model = fit()
    save_ensemble(spark, model, path)
    return model
