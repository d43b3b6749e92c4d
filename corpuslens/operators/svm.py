"""Support-vector classifiers: hinge-loss linear models over raw or kernel features.

An exact kernel solver needs all pairs of rows. Here a kernel model is a linear
one over the kernel values against a few landmark rows, so cost grows linearly
with the rows. A plain linear model is trained by MLlib's distributed optimiser,
kernel models and all that a calibration needs by the batched one.
"""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, replace
from functools import partial
from itertools import combinations

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LinearSVC, LinearSVCModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpuslens.functions.vectors import packed
from corpuslens.operators.batched import Problem, TrainingTable, cross_margins, logistic_curves, train, training_table
from corpuslens.operators.kernels import KernelMargins, gamma_scale, landmarks
from corpuslens.operators.ranking import by_class, class_counts
from corpuslens.operators.splits import fold_column
from corpuslens.schema import ID, LABEL
from corpuslens.session import side_by_side

MAX_CLASSES = 100
ROWS_PER_TASK = 10_000
CALIBRATION_FOLDS = 5


def _few_tasks(df: DataFrame, n: int) -> DataFrame:
    """Every optimiser step is one job: tasks of a few rows would only be scheduling."""
    return df.coalesce(n // ROWS_PER_TASK + 1)


@dataclass(frozen=True)
class SvmSpec:
    """Parameters of one classifier.

    `gamma=None` means 1 / (features * variance); `balanced` weighs the rows of a
    class by the inverse of its size.
    """

    kernel: str = "linear"
    C: float = 1.0
    gamma: float | None = None
    probability: bool = False
    balanced: bool = False
    multiclass: str = "ovr"  # or "ovo": one model per pair of classes
    n_landmarks: int = 100
    max_iter: int = 50
    seed: int = 42

    def fit(
        self,
        df: DataFrame,
        vec: str = "features",
        label: str = LABEL,
        id_col: str = ID,
        weight: str | None = None,
    ) -> SvmModel:
        """`df` should be a stored or cached table: training passes over it many times."""
        if self.kernel != "linear" or self.probability:
            weights = {"model": weight} if weight else None
            return fit_many({"model": self}, df, vec, label, id_col, weights)["model"]
        data = df.select(id_col, label, vec, *([weight] if weight else []))
        if not isinstance(data.schema[vec].dataType, VectorUDT):
            data = data.withColumn(vec, array_to_vector(F.col(vec).cast("array<double>")))
        counts = class_counts(data, label, MAX_CLASSES)
        if len(counts) < 2:
            raise ValueError("training needs at least two classes")
        if self.balanced:
            rows = sum(counts.values())
            share = by_class(label, {c: rows / (len(counts) * m) for c, m in counts.items()})
            data = data.withColumn("_share", share * F.col(weight) if weight else share)
            weight = "_share"
        classes = list(counts)
        n = sum(counts.values())
        if len(classes) == 2 or self.multiclass == "ovo":
            tasks = [
                (data.where(F.col(label).isin([a, b])), b, counts[a] + counts[b])
                for a, b in combinations(classes, 2)
            ]
        else:
            tasks = [(data, c, n) for c in classes]
        models = side_by_side(
            [partial(self._fit_one, rows, c, size, vec, label, weight) for rows, c, size in tasks]
        )
        return SvmModel(self, classes, [], models)

    def _fit_one(self, rows, positive, n, features, label, weight) -> LinearSVCModel:
        target = rows.withColumn("_y", (F.col(label) == F.lit(positive)).cast("double"))
        # Same objective as hinge loss summed with factor C: average loss, penalty 1 / (n C).
        learner = LinearSVC(
            featuresCol=features,
            labelCol="_y",
            regParam=1.0 / (n * self.C),
            maxIter=self.max_iter,
            tol=1e-3,
            standardization=False,
        )
        if weight:
            learner = learner.setWeightCol(weight)
        return learner.fit(_few_tasks(target, n))

    def _pairs(self, classes: list) -> list[tuple[int, tuple[int, ...] | None]]:
        """(positive class, classes that take part) of each of the models, by class places."""
        if len(classes) == 2 or self.multiclass == "ovo":
            return [(b, (a, b)) for a, b in combinations(range(len(classes)), 2)]
        return [(c, None) for c in range(len(classes))]

    def problems(
        self,
        table: TrainingTable,
        gamma: float,
        held: tuple = (),
        marks: int = 0,
        weight: int = -1,
        sizes: list[int] | None = None,
    ) -> list[Problem]:
        """`sizes`: rows of each class to balance by, if not those of the table."""
        shares = None
        if self.balanced:
            sizes = sizes or table.counts
            shares = tuple(sum(sizes) / (len(sizes) * n) for n in sizes)
        return [
            Problem(self.kernel, gamma, self.C, positive, among, held, marks, weight, shares)
            for positive, among in self._pairs(table.classes)
        ]


def spec_gammas(specs: list[SvmSpec], data: DataFrame, vec: str) -> list[float]:
    """The kernel width of each; the scaled default is computed once."""
    scaled = None
    if any(s.gamma is None and s.kernel != "linear" for s in specs):
        scaled = float(gamma_scale(data, vec).first().gamma)
    return [float(s.gamma) if s.gamma is not None else scaled or 1.0 for s in specs]


def spec_marks(specs: list[SvmSpec], data: DataFrame, vec: str, id_col: str) -> list[np.ndarray]:
    """The landmark rows, if a kernel needs them."""
    return [landmarks(data, m, vec, seed, id_col) for m, seed in _mark_kinds(specs)]


def _mark_kinds(specs: list[SvmSpec]) -> set[tuple[int, int]]:
    return {(s.n_landmarks, s.seed) for s in specs if s.kernel != "linear"}


def fit_many(
    specs: dict[str, SvmSpec],
    df: DataFrame,
    vec: str = "features",
    label: str = LABEL,
    id_col: str = ID,
    weights: dict[str, str] | None = None,
    folds: int = CALIBRATION_FOLDS,
) -> dict[str, SvmModel]:
    """All models, and the fold models that their calibration needs, trained side by side.

    Probabilities come from logistic curves over margins of rows that the margin's model has
    not seen: rows fall into stratified folds, each scored by a model of the others. A class
    of fewer rows than `folds` lowers their number; one of a single row is an error. `weights`
    names the row weights of a spec. Ids are unique. Specs of different landmarks go one by one.
    """
    return fit_parts(specs, df, [None], vec, label, id_col, weights, folds)[0]


def fit_parts(
    specs: dict[str, SvmSpec],
    df: DataFrame,
    parts: list[int | None],
    vec: str = "features",
    label: str = LABEL,
    id_col: str = ID,
    weights: dict[str, str] | None = None,
    folds: int = CALIBRATION_FOLDS,
) -> list[dict[str, SvmModel]]:
    """`fit_many` on the rows outside of fold `p` (column `fold`) for each p of `parts`; None: on all rows.

    All parts are one batch, yet nothing of a part's models - landmarks, kernel width, weights,
    calibration folds, curves - comes from the rows that it leaves out.
    """
    list_ = list(specs.values())
    if len(_mark_kinds(list_)) > 1:
        each = [fit_parts({n: s}, df, parts, vec, label, id_col, weights, folds) for n, s in specs.items()]
        return [{n: m for found in each for n, m in found[i].items()} for i in range(len(parts))]
    names = list(dict.fromkeys((weights or {}).values()))
    data = df.select(id_col, label, vec, *(["fold"] if parts != [None] else []), *names)
    counts = class_counts(data, label, MAX_CLASSES)
    if len(counts) < 2:
        raise ValueError("training needs at least two classes")
    classes, calibrated = list(counts), [n for n, s in specs.items() if s.probability]
    outer = [F.col("fold").alias("_f0")] if parts != [None] else [F.lit(-1).alias("_f0")]
    marks, gammas, inner, numbers, balance = [], [], [], [], []
    for part in parts:
        own = data if part is None else data.where(F.col("fold") != part)
        sizes = counts if part is None else class_counts(own, label, MAX_CLASSES)
        balance.append([max(sizes.get(c, 0), 1) for c in classes])
        if calibrated:
            thin = [c for c in classes if sizes.get(c, 0) < 2]
            if thin:
                raise ValueError(f"too few rows to calibrate probabilities for {thin}")
            numbers.append(min(folds, *sizes.values()))
            inner.append(fold_column(own, numbers[-1], label, id_col).alias(f"_f{len(inner) + 1}"))
        marks += spec_marks(list_, own, vec, id_col)
        gammas.append(spec_gammas(list_, own, vec))
    place = {n: names.index(w) for n, w in (weights or {}).items()}
    work = len(specs) * len(classes) * len(parts) * (folds + 1 if calibrated else 1)
    columns = [f"_f{i}" for i in range(len(inner) + 1)]
    table = training_table(data.select("*", *outer, *inner), vec, label, counts, id_col, marks, columns, names, work)
    todo, where = [], {}
    for i, part in enumerate(parts):
        away = () if part is None else ((0, part),)
        for (name, spec), gamma in zip(specs.items(), gammas[i]):
            for held in [None, *(range(numbers[i]) if spec.probability else [])]:
                out = away if held is None else (*away, (i + 1, held))
                own = spec.problems(table, gamma, out, i if marks else 0, place.get(name, -1), balance[i])
                where[i, name, held] = range(len(todo), len(todo) + len(own))
                todo += own
    coefs = train(table, todo, max(s.max_iter for s in list_))
    models = [
        {
            name: linear_model(spec, classes, gamma, marks[i] if marks else None, [coefs[k] for k in where[i, name, None]])
            for (name, spec), gamma in zip(specs.items(), gammas[i])
        }
        for i in range(len(parts))
    ]
    if not calibrated:
        return models
    by_part = [
        (i + 1, {held: [k for n in calibrated for k in where[i, n, held]] for held in range(numbers[i])})
        for i in range(len(parts))
    ]
    margins = cross_margins(table, by_part, todo, coefs)
    targets, owner, at = [], [], 0
    for i, part in enumerate(parts):
        for name in calibrated:
            model = models[i][name]
            each = model.margins_of([F.col("raw")[at + k] for k in range(model.n_raws)])
            at += model.n_raws
            weight = F.col("_w")[place[name]] if name in place else F.lit(1.0)
            if part is not None:
                weight = F.when(F.col("_folds")[0] == part, 0.0).otherwise(weight)
            for c in range(1, 2) if len(classes) == 2 else range(len(classes)):
                targets.append((each[c], (F.col("_y") == c).cast("double"), weight))
                owner.append((i, name))
    curves: dict[tuple[int, str], list] = {}
    for key, curve in zip(owner, logistic_curves(margins, targets)):
        curves.setdefault(key, []).append(curve)
    return [
        {n: replace(m, curves=curves[i, n]) if (i, n) in curves else m for n, m in found.items()}
        for i, found in enumerate(models)
    ]


def side_by_side_raws(df: DataFrame, members: dict[str, SvmModel], vec: str) -> tuple[DataFrame, dict[str, list[Column]], list[str]]:
    """`df` with the margins of all members that share their features in one column, where each finds its own, and these columns.

    One pass through Python serves all of them, not one (and a worker) for each.
    """
    kinds: dict[tuple, list[str]] = {}
    for name, model in members.items():
        if isinstance(model.models[0], KernelMargins):
            kinds.setdefault(model.models[0].kind_key(), []).append(name)
    rows, found, columns = packed(df, vec), {}, []
    for own in kinds.values():
        matrices = [members[n].models[0].matrix() for n in own]
        columns.append(f"_raws{len(columns)}")
        df = df.withColumn(columns[-1], members[own[0]].models[0].of(rows, np.concatenate(matrices, axis=1)))
        low = 0
        for name, matrix in zip(own, matrices):
            found[name] = [F.col(columns[-1])[low + i] for i in range(matrix.shape[1])]
            low += matrix.shape[1]
    return df, found, columns


def linear_model(
    spec: SvmSpec, classes: list, gamma: float, marks: np.ndarray | None, coefs: list[np.ndarray]
) -> SvmModel:
    """A model from trained weights (the intercept last) of its two-class parts."""
    stage_ = KernelMargins(
        kind=spec.kernel,
        gamma=gamma,
        marks=[] if spec.kernel == "linear" or marks is None else marks.tolist(),
        coef=[c.tolist() for c in coefs],
    )
    return SvmModel(spec, classes, [], [stage_])


@dataclass(frozen=True)
class SvmModel:
    spec: SvmSpec
    classes: list
    maps: list
    models: list
    curves: list = field(default_factory=list)

    @property
    def n_raws(self) -> int:
        return self.models[0].n_models if isinstance(self.models[0], KernelMargins) else len(self.models)

    def transform(self, df: DataFrame, vec: str = "features", prefix: str = "", raws: list[Column] | None = None) -> DataFrame:
        """Adds `margins`, `prediction` and, if calibrated, `probability` (class order). `raws`: its margins, if known."""
        out, features = df, vec
        if raws is not None:
            pass
        elif isinstance(self.models[0], KernelMargins):
            out = self.models[0].copy({self.models[0].inputCol: vec, self.models[0].outputCol: "_raws"}).transform(out)
            raws = [F.col("_raws")[i] for i in range(self.n_raws)]
        else:
            if not isinstance(df.schema[vec].dataType, VectorUDT):
                features = "_vec"
                out = out.withColumn(features, array_to_vector(F.col(vec).cast("array<double>")))
            raws = []
            for i, model in enumerate(self.models):
                scorer = model.copy(
                    {
                        model.featuresCol: features,
                        model.rawPredictionCol: f"_raw{i}",
                        model.predictionCol: f"_pred{i}",
                    }
                )
                out = scorer.transform(out)
                raws.append(vector_to_array(F.col(f"_raw{i}"))[1])
        out = out.withColumn(f"{prefix}margins", F.array(*self.margins_of(raws)))
        best = F.array_position(f"{prefix}margins", F.array_max(f"{prefix}margins"))
        names = F.array(*[F.lit(c) for c in self.classes])
        out = out.withColumn(f"{prefix}prediction", F.element_at(names, best.cast("int")))
        if self.curves:
            out = out.withColumn(f"{prefix}probability", self._probability(f"{prefix}margins"))
        drop = [f"_raw{i}" for i in range(len(self.models))]
        drop += [f"_pred{i}" for i in range(len(self.models))] + ["_vec", "_raws"]
        return out.drop(*drop)

    def margins_of(self, raws: list[Column]) -> list[Column]:
        """The margin of each class from those of the two-class parts."""
        if len(self.classes) == 2:
            return [-raws[0], raws[0]]
        if self.spec.multiclass != "ovo":
            return raws
        votes = {c: F.lit(0.0) for c in self.classes}
        trust = {c: F.lit(0.0) for c in self.classes}
        for (a, b), raw in zip(combinations(self.classes, 2), raws, strict=True):
            votes[b] = votes[b] + F.when(raw > 0, 1.0).otherwise(0.0)
            votes[a] = votes[a] + F.when(raw > 0, 0.0).otherwise(1.0)
            trust[b], trust[a] = trust[b] + raw, trust[a] - raw
        # Votes decide; summed margins, squeezed below one half, only break ties.
        return [votes[c] + trust[c] / (3.0 * (F.abs(trust[c]) + 1.0)) for c in self.classes]

    def _probability(self, margins: str) -> Column:
        def curve(i: int, a: float, b: float) -> Column:
            return 1.0 / (1.0 + F.exp(-(F.lit(a) * F.col(margins)[i] + F.lit(b))))

        if len(self.classes) == 2:
            p = curve(1, *self.curves[0])
            return F.array(1.0 - p, p)
        each = F.array(*[curve(i, a, b) for i, (a, b) in enumerate(self.curves)])
        total = F.aggregate(each, F.lit(0.0), lambda s, x: s + x)
        even = F.array(*[F.lit(1.0 / len(self.classes))] * len(self.classes))
        scaled = F.transform(each, lambda x: x / total)
        return F.when(total > 0, scaled).otherwise(even)

    def save(self, spark: SparkSession, path: str) -> None:
        PipelineModel([*self.maps, *self.models]).write().overwrite().save(os.path.join(path, "stages"))
        facts = {
            "spec": asdict(self.spec),
            "classes": self.classes,
            "maps": len(self.maps),
            "curves": self.curves,
        }
        spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode(
            "overwrite"
        ).text(os.path.join(path, "facts"))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SvmModel:
        facts = json.loads(spark.read.text(os.path.join(path, "facts")).first().value)
        stages = PipelineModel.load(os.path.join(path, "stages")).stages
        n = facts["maps"]
        curves = [tuple(c) for c in facts["curves"]]
        return cls(
            SvmSpec(**facts["spec"]), facts["classes"], stages[:n], stages[n:], curves
        )
