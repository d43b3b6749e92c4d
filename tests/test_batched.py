import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from corpuslens.functions.vectors import packed
from corpuslens.operators import batched as B
from corpuslens.operators.batched import Problem, train, training_table


def sides(spark, n=600):
    """Five features that say little of the label, so that early steps are far too long."""
    rng = np.random.default_rng(3)
    x, y = rng.random((n, 5)), (rng.random(n) < 0.4).astype(int)
    rows = [(i, int(y[i]), [float(v) for v in x[i]], i % 3) for i in range(n)]
    return x, y, spark.createDataFrame(rows, "doc_id bigint, label int, features array<double>, fold int").repartition(3)


def test_shorter_steps_share_a_pass(spark, monkeypatch):
    x, y, df = sides(spark)
    passes, summed = [], B._summed
    monkeypatch.setattr(B, "_summed", lambda *args: passes.append(args[1]) or summed(*args))
    n_rows = {c: int((y == c).sum()) for c in (0, 1)}
    table = training_table(df, "features", "label", n_rows, "doc_id", [])
    (w,) = train(table, [Problem("linear", 0.0, 1000.0, 1, (0, 1))], max_iter=8)
    assert len(passes) <= 1 + 1 + 3 * 8  # sizes, the start, and at most three passes a step
    side = np.where(y == 1, 1.0, -1.0)
    short = 1 - side * (x @ w[:-1] + w[-1])
    slope = np.clip(short / B.ROUNDING, 0, 1)
    loss = np.where(short >= B.ROUNDING, short - B.ROUNDING / 2, slope * slope * B.ROUNDING / 2).mean()
    assert loss < 0.4 * 2 - B.ROUNDING / 2 + 0.01  # no worse than the model of one class


def test_too_long_a_step_ends_where_halving_ends():
    state = B._State(np.array([0.0]))
    state.f, state.g, state.d, state.t = 1.0, np.array([-1.0]), np.array([1.0]), 1.0
    state.feed(np.inf, np.array([1.0]), 50, 1e-4)
    assert state.scans and not state.done
    losses = np.where(np.arange(1, B.HALVINGS + 1) >= 7, 0.5, 2.0)
    state.shorter(losses)
    assert (state.t, state.halvings, state.trial[0], state.scans) == (2.0**-7, 7, 2.0**-7, False)
    state.scans = True
    state.shorter(np.full(B.HALVINGS, 2.0))
    assert state.done


@pytest.mark.parametrize("wide", [False, True])
def test_blocks_hold_the_rows(spark, wide):
    width = B.DENSE_FEATURES + 5 if wide else 4
    rows = [(i, i % 2, Vectors.sparse(width, [i % 4, width - 1], [1.0 + i, 2.0]) if i % 4 < 3 else Vectors.sparse(width, [0], [5.0]), i % 3) for i in range(40)]
    df = spark.createDataFrame([(a, b, c, d, float(a)) for a, b, c, d in rows], ["doc_id", "label", "features", "fold", "heavy"])
    table = training_table(df, "features", "label", {0: 20, 1: 20}, "doc_id", [], ["fold"], ["heavy"])
    want = np.zeros(width)
    for _, _, v, _ in rows:
        want += v.toArray()
    for dense in (True, False):
        got = B._summed(table, width, lambda b: b.raw.back(np.ones((len(b.y), 1)))[:, 0], dense, 1)
        assert got == pytest.approx(want)
    problem = Problem("linear", 0.0, 1.0, 1, (0, 1), ((0, 2),), weight=0)
    kept = [i for i in range(40) if i % 3 != 2]
    assert table.sizes([problem]) == [(len(kept), pytest.approx(sum(kept)))]


def test_curves_of_many_rows_with_equal_margins(spark):
    """Equations that are singular to rounding: margins that (nearly) agree, of rows that weigh much."""
    rows = [(-0.9333 + i % 7 * step, float(i % 5 < 2), 3.3e7) for step in (0.0, 1e-9) for i in range(35)]
    for part in (rows[:35], rows[35:]):
        table = spark.createDataFrame(part, "m double, t double, w double")
        ((a, b),) = B.logistic_curves(table, [(F.col("m"), F.col("t"), F.col("w"))])
        for m, _, _ in part:
            assert 1 / (1 + np.exp(-(a * m + b))) == pytest.approx(0.4, abs=1e-3)


def test_rows_without_weights_or_indices_travel_without_null_lists(spark):
    """Spark takes ten times as long to send a list that is null to Python."""
    df = spark.createDataFrame([(1, [1.0, 2.0])], "doc_id bigint, features array<double>")
    assert df.select(packed(df, "features")["indices"].alias("i")).first().i == []
