import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from corpuslens.operators import attribution as A, ensemble as V
from corpuslens.operators.grid import best_model, grid_points, grid_rank, grid_search, presets
from corpuslens.operators.kernels import gamma_scale, kernel_matrix, kernel_table
from corpuslens.operators.svm import SvmModel, SvmSpec


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(150):
        label = i % 3
        centre = [(0, 0), (4, 0), (0, 4)][label]
        rows.append((i, label, [float(v) for v in rng.normal(centre, 0.7)]))
    return spark.createDataFrame(rows, "doc_id bigint, label int, features array<double>").repartition(2).cache()


@pytest.fixture(scope="module")
def ring(spark):
    """Not linearly separable: a disc inside a ring."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(200):
        r, t = (0.5 if i % 2 else 2.0) + 0.1 * rng.normal(), rng.uniform(0, 2 * math.pi)
        rows.append((i, i % 2, [r * math.cos(t), r * math.sin(t)]))
    return spark.createDataFrame(rows, "doc_id bigint, label int, features array<double>").repartition(2).cache()


def hit_rate(model, df):
    return model.transform(df).agg(F.avg((F.col("label") == F.col("prediction")).cast("int"))).first()[0]


@pytest.mark.parametrize("multiclass", ["ovr", "ovo"])
def test_linear_multiclass(blobs, multiclass):
    assert hit_rate(SvmSpec(multiclass=multiclass, max_iter=20).fit(blobs), blobs) > 0.95


def test_balanced_weights_help_the_rare_class(spark):
    rng = np.random.default_rng(8)
    rows = [(i, int(i % 20 == 0), [float(rng.normal(1.0 if i % 20 == 0 else 0.0, 0.8))]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, label int, features array<double>").coalesce(1).cache()

    def recall(spec):
        hit = (F.col("prediction") == 1).cast("int")
        return spec.fit(df).transform(df).where("label = 1").agg(F.avg(hit)).first()[0]

    assert recall(SvmSpec(balanced=True, max_iter=15)) > recall(SvmSpec(max_iter=15))


def test_kernel_beats_linear_on_ring(ring):
    linear = hit_rate(SvmSpec(max_iter=10).fit(ring), ring)
    rbf = hit_rate(SvmSpec(kernel="rbf", C=10.0, gamma=1.0, n_landmarks=30, max_iter=20).fit(ring), ring)
    assert rbf > 0.97 > linear


def test_probabilities(blobs, ring):
    three = SvmSpec(probability=True, max_iter=15).fit(blobs).transform(blobs)
    for r in three.collect():
        assert sum(r.probability) == pytest.approx(1.0) and min(r.probability) >= 0
    two = SvmSpec(kernel="rbf", gamma=1.0, n_landmarks=20, probability=True, max_iter=15).fit(ring).transform(ring)
    pairs = sorted((r.margins[1], r.probability[1]) for r in two.collect())
    assert all(a[1] <= b[1] + 1e-12 for a, b in zip(pairs, pairs[1:]))


def test_calibration_refuses_a_thin_class(ring):
    one = ring.where("label = 1").limit(1).unionByName(ring.where("label <> 1"))
    with pytest.raises(ValueError, match="too few rows to calibrate"):
        SvmSpec(probability=True, max_iter=5).fit(one)


def test_model_roundtrip(spark, ring, tmp_path):
    model = SvmSpec(kernel="rbf", gamma=1.0, n_landmarks=10, probability=True, max_iter=10).fit(ring)
    model.save(spark, str(tmp_path / "m"))
    again = SvmModel.load(spark, str(tmp_path / "m"))
    want = model.transform(ring).select("doc_id", "prediction", "probability").collect()
    assert sorted(want) == sorted(again.transform(ring).select("doc_id", "prediction", "probability").collect())


def test_kernels(spark):
    rows, marks = np.array([[1.0, 2.0]]), np.array([[0.0, 1.0]])
    assert kernel_matrix(rows, marks, "rbf", 0.5)[0, 0] == pytest.approx(math.exp(-0.5 * 2))
    assert kernel_matrix(rows, marks, "sigmoid", 0.5)[0, 0] == pytest.approx(math.tanh(1.0))
    assert kernel_matrix(rows, marks, "poly", 0.5)[0, 0] == pytest.approx(1.0)
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 6.0])], "doc_id int, features array<double>")
    assert gamma_scale(df, "features").first().gamma == pytest.approx(1 / (2 * np.var([1, 2, 3, 6])))
    sparse = spark.createDataFrame([(1, Vectors.sparse(4, [1], [2.0])), (2, Vectors.dense([1, 0, 3, 0]))], ["doc_id", "v"])
    assert gamma_scale(sparse, "v").first().gamma == pytest.approx(1 / (4 * np.var([0, 2, 0, 0, 1, 0, 3, 0])))
    same = spark.createDataFrame([(1, [2.0, 2.0]), (2, [2.0, 2.0])], "doc_id int, features array<double>")
    assert gamma_scale(same, "features").first().gamma == 1.0
    table = kernel_table(df, df.where("doc_id = 2"), "sigmoid", 0.01, "features").collect()
    assert {(r.doc_id, r.landmark) for r in table} == {(1, 2), (2, 2)}


def test_grid_order_and_distinct_points():
    points = grid_points({"C": [1, 2], "gamma": [3, 4], "kernel": ["linear", "rbf"]})
    assert points[0] == {"C": 1, "gamma": 3, "kernel": "linear"} and points[1]["kernel"] == "rbf"
    from corpuslens.operators.grid import GRID, _work_key

    every = grid_points(GRID)
    assert len(every) == 108 and len(set(map(_work_key, every))) == 78


def test_grid_search(spark, blobs):
    grid = {"C": [0.001, 1.0], "gamma": [0.1, 1.0], "kernel": ["linear"]}
    scores = grid_search(blobs, grid, folds=2, base=SvmSpec(max_iter=10))
    assert scores.count() == 8
    ranked = grid_rank(scores, "accuracy", ["C"]).orderBy("place").collect()
    assert [r.place for r in ranked] == [1, 2, 3, 4]
    # gamma does not matter to a linear kernel, so the first point of the pair wins the tie
    assert ranked[0].mean_score == ranked[1].mean_score and ranked[0].grid_idx < ranked[1].grid_idx
    assert hit_rate(best_model(blobs, scores, "f1_macro", SvmSpec(max_iter=10)), blobs) > 0.9


def test_presets():
    specs = presets("isot_titles_dataset")
    assert (specs["rbf"].C, specs["rbf"].gamma, specs["rbf"].probability) == (10.0, 1.0, True)
    assert presets("other")["sigmoid"].gamma is None


def test_votes(spark):
    rows = [(1, "a", 2), (1, "b", 0), (1, "c", 1), (2, "a", 1), (2, "b", 1), (2, "c", 0)]
    df = spark.createDataFrame(rows, "doc_id int, model string, prediction int")
    assert {(r.doc_id, r.prediction) for r in V.vote_hard(df).collect()} == {(1, 0), (2, 1)}
    soft = spark.createDataFrame(
        [(1, 0, 0.5), (1, 1, 0.5), (2, 0, 0.2), (2, 1, 0.8)], "doc_id int, class int, probability double"
    )
    assert {(r.doc_id, r.prediction) for r in V.vote_soft(soft).collect()} == {(1, 0), (2, 1)}


def test_voting_and_storage(spark, ring, tmp_path):
    specs = {k: SvmSpec(kernel=k, gamma=1.0, n_landmarks=20, max_iter=10) for k in ("rbf", "sigmoid", "linear")}
    calls = []

    def fit():
        calls.append(1)
        return V.fit_voting(ring, specs, "soft")

    first = V.fit_or_load_ensemble(spark, str(tmp_path / "e"), fit)
    again = V.fit_or_load_ensemble(spark, str(tmp_path / "e"), fit)
    assert len(calls) == 1
    columns = ("doc_id", "prediction", "probability")
    assert sorted(first.transform(ring).select(*columns).collect()) == sorted(
        again.transform(ring).select(*columns).collect()
    )
    hard = V.VotingModel(first.members, "hard").transform(ring)
    parts = [m.transform(ring).select("doc_id", "prediction") for m in first.members.values()]
    long = parts[0].unionByName(parts[1]).unionByName(parts[2])
    want = {r.doc_id: r.prediction for r in V.vote_hard(long).collect()}
    assert {r.doc_id: r.prediction for r in hard.collect()} == want


def test_out_of_fold_covers_rows_once_without_leak(ring):
    specs = {"rbf": SvmSpec(kernel="rbf", gamma=1.0, n_landmarks=15, probability=True, max_iter=10)}
    rows = V.out_of_fold(ring, specs, folds=2).collect()
    assert sorted(r.doc_id for r in rows) == list(range(200))
    folds = {r.doc_id: r.fold for r in rows}
    train = ring.where(F.col("doc_id").isin([i for i, f in folds.items() if f != 0]))
    model = specs["rbf"].fit(train)
    held = ring.where(F.col("doc_id").isin([i for i, f in folds.items() if f == 0]))
    want = {r.doc_id: r.probability[1] for r in model.transform(held).collect()}
    got = {r.doc_id: r.meta[0] for r in rows if r.fold == 0}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


@pytest.mark.parametrize("final", ["none", "linear"])
def test_stacking(ring, final):
    specs = {k: SvmSpec(kernel=k, gamma=1.0, n_landmarks=15, max_iter=8) for k in ("rbf", "sigmoid", "linear")}
    assert hit_rate(V.fit_stacking(ring, specs, final, folds=2), ring) > 0.9


def test_bagging_and_boosting(spark, ring):
    weight = spark.range(4000).select(V.poisson_weight("id", "s").alias("w")).agg(F.avg("w"), F.variance("w")).first()
    assert abs(weight[0] - 1) < 0.06 and abs(weight[1] - 1) < 0.12
    spec = SvmSpec(kernel="rbf", gamma=1.0, n_landmarks=15, max_iter=8)
    assert hit_rate(V.fit_bagging(ring, spec, 2), ring) > 0.9
    assert hit_rate(V.fit_adaboost(ring, spec, 3), ring) > 0.9


def test_boost_round_weights(spark):
    df = spark.createDataFrame(
        [(1, 0, 0, 1.0), (2, 1, 1, 1.0), (3, 2, 2, 2.0), (4, 0, 1, 1.0)], "doc_id int, label int, prediction int, w double"
    )
    rows = V.adaboost_round(df, "label", "prediction", "w", 3).collect()
    alpha = math.log(0.8 / 0.2) + math.log(2)
    assert rows[0].alpha == pytest.approx(alpha)
    raw = [1.0, 1.0, 2.0, math.exp(alpha)]
    assert [r.new_weight for r in rows] == pytest.approx([w / sum(raw) for w in raw])


def test_boost_round_without_a_wrong_row(spark):
    df = spark.createDataFrame([(1, 0, 0, 1.0), (2, 1, 1, 3.0)], "doc_id int, label int, prediction int, w double")
    rows = V.adaboost_round(df, "label", "prediction", "w", 2).orderBy("doc_id").collect()
    assert [(r.alpha, r.new_weight) for r in rows] == [(1.0, 0.25), (1.0, 0.75)]


def test_linear_shap_and_tables(spark):
    df = spark.createDataFrame([(1, 1.0, 10.0), (2, 3.0, 30.0)], "doc_id int, a double, b double")
    phi = A.linear_shap(df, {"a": 2.0, "b": -0.1})
    got = {(r.doc_id, r.feature): r.phi for r in phi.collect()}
    assert got == pytest.approx({(1, "a"): -2.0, (2, "a"): 2.0, (1, "b"): 1.0, (2, "b"): -1.0})
    summary = A.shap_summary(phi).orderBy("place").collect()
    assert [(r.feature, r.importance) for r in summary] == [("a", 2.0), ("b", 1.0)]
    path = {(r.doc_id, r.feature): r.running for r in A.decision_path(phi, base=5.0).collect()}
    assert path[1, "b"] == pytest.approx(6.0) and path[1, "a"] == pytest.approx(4.0)
    values = df.selectExpr("doc_id", "stack(2, 'a', a, 'b', b) as (feature, value)")
    assert A.shap_points(phi.drop("value"), values).count() == 4


def test_coalition_weights():
    masks, weights = A.coalitions(5, 1000, 0)
    assert len(masks) == 2**5 - 2 and weights.sum() == pytest.approx(1.0)
    masks, weights = A.coalitions(20, 300, 0)
    assert weights.sum() == pytest.approx(1.0)
    assert {m.sum() for m in masks} >= {1, 19}
    keys = {m.tobytes() for m in masks}
    assert all((~m).tobytes() in keys for m in masks)


def sigmoid_model(weights, bias):
    score = F.lit(bias)
    for i, w in enumerate(weights):
        score = score + F.col("features")[i] * w
    p = 1.0 / (1.0 + F.exp(-score))
    return lambda df: df.withColumn("probability", F.array(1.0 - p, p))


def test_kernel_shap_is_exact_for_logistic_model(spark):
    weights = [0.7, -1.2, 0.3, 0.0, 2.0]
    rows = spark.createDataFrame([(1, [1.0, 2.0, -1.0, 5.0, 0.3]), (2, [0.0, 1.0, 1.0, 1.0, 1.0])], "doc_id int, features array<double>")
    ground = spark.createDataFrame([(9, [0.5, 0.5, 0.5, 5.0, 0.5])], "doc_id int, features array<double>")
    out = A.kernel_shap(sigmoid_model(weights, 0.1), rows, ground).collect()
    x = {1: [1.0, 2.0, -1.0, 5.0, 0.3], 2: [0.0, 1.0, 1.0, 1.0, 1.0]}
    g = [0.5, 0.5, 0.5, 5.0, 0.5]
    for r in out:
        sign = 1 if r["class"] == 1 else -1
        want = sign * weights[r.feature] * (x[r.doc_id][r.feature] - g[r.feature])
        assert r.phi == pytest.approx(want, abs=1e-8)


def test_kernel_shap_sums_to_link(spark, ring):
    model = SvmSpec(kernel="rbf", gamma=1.0, n_landmarks=10, probability=True, max_iter=8).fit(ring)
    out = A.kernel_shap(model.transform, ring.where("doc_id < 4"), ring.where("doc_id between 10 and 14"))
    for r in out.groupBy("doc_id", "class").agg(
        F.sum("phi").alias("s"), F.first("base").alias("b"), F.first("output").alias("o")
    ).collect():
        assert r.s + r.b == pytest.approx(r.o, abs=1e-9)
    with pytest.raises(ValueError, match="predictions"):
        A.kernel_shap(model.transform, ring, ring, max_evaluations=10)
