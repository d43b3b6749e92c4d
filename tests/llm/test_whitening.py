"""Whitening against a dense eigenvalue solver, and on awkward tables."""

import math

import numpy as np
import pytest

from corpuslens.llm import whitening
from corpuslens.llm.common import table
from corpuslens.llm.queries import op11_embedding_whitening

SCHEMA = "x int, n string, vec_id bigint, component string, embedding array<float>"


def made(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(1, "n", i, "c", v) for i, v in zip(ids, vectors)], SCHEMA)


def brute(rows, k=8):
    """(n, sums, deviation by row, components, eigenvalues, trace) of valid vectors."""
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in rows], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    deviation = [int(sum((n * a - s) ** 2 for a, s in zip(row, sums))) for row in x]
    centred = np.array([[float(n * a - s) / n for a, s in zip(row, sums)] for row in x])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return n, deviation, centred, vectors[:, ::-1][:, :k], values[::-1][:k], values.sum()


def check(out, ids, rows):
    n, deviation, centred, vectors, values, trace = brute(rows)
    held = values > 1e-10 * trace
    c = int(held.sum())
    z = centred @ vectors[:, held] / np.sqrt(values[held])
    found = {(r.vec_id, r.component): r for r in out}
    assert len(out) == len(rows) * c
    signs = np.sign([found[ids[0], j + 1].whitened * z[0, j] for j in range(c)])
    for i, vec_id in enumerate(ids):
        for j in range(c):
            r = found[vec_id, j + 1]
            assert (r.n, r.deviation) == (n, deviation[i])
            assert r.whitened == pytest.approx(signs[j] * z[i, j], abs=1e-8)
            assert r.explained == pytest.approx(values[j] / trace, rel=1e-9)
            assert 0 <= r.identity_error < 1e-9


def test_query_equals_a_dense_solver(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").collect()]
    check(op11_embedding_whitening(spark, sf).collect(), [i for i, _ in rows], [v for _, v in rows])


def test_narrow_vectors_and_awkward_rows(spark):
    rng = np.random.default_rng(1)
    good = (rng.standard_normal((40, 5)) * [3, 2, 1, 0.5, 0.1] + 7).tolist()
    bad = [None, [], [1.0, None, 1.0, 1.0, 1.0], [1.0, math.nan, 1.0, 1.0, 1.0], [math.inf] * 5]
    out = whitening.whiten_embeddings(made(spark, good + bad)).collect()
    check(out, list(range(40)), good)


def test_repeated_rows_count_and_directions_without_variance_go(spark):
    good = [[1.0, 2.0, 0.0], [2.0, 2.0, 1.0], [2.0, 2.0, 1.0], [5.0, 2.0, -1.0]]
    out = whitening.whiten_embeddings(made(spark, good, [1, 2, 2, None])).collect()
    assert len(out) == 8 and {r.component for r in out} == {1, 2} and {r.n for r in out} == {4}
    twice = [sorted((r.component, r.whitened, r.deviation) for r in out if r.vec_id == 2)]
    assert twice[0][0] == twice[0][1] and twice[0][2] == twice[0][3]


def test_nothing_to_whiten(spark):
    for rows in ([], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 3):
        out = whitening.whiten_embeddings(made(spark, rows))
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        assert out.collect() == []


def test_unequal_lengths_are_an_error(spark):
    with pytest.raises(ValueError, match="length"):
        whitening.whiten_embeddings(made(spark, [[1.0], [1.0, 2.0]]))


@pytest.mark.parametrize("top", [1.05, 2.0, 50.0])
def test_filter_damps_the_unwanted_spectrum(top):
    values = np.concatenate([[top], np.linspace(1.0, 0.1, 30)])
    out = whitening.chebyshev_filter(lambda q: values[:, None] * q, np.ones((31, 1)), 0.1, 1.0, top)[:, 0]
    assert np.abs(out[1:]).max() < 0.25 * out[0]


def test_pairs_of_a_flat_spectrum_are_certified():
    rng = np.random.default_rng(2)
    turn, _ = np.linalg.qr(rng.standard_normal((200, 200)))
    values = np.sort(1 + 0.3 * rng.random(200))[::-1]
    passes = []

    def multiply(q):
        passes.append(1)
        return turn @ (values[:, None] * (turn.T @ q))

    found, vectors, residual = whitening.leading_pairs(multiply, 200, 8, values.sum())
    assert residual <= 1e-11 and len(passes) < 400
    assert np.abs(found - values[:8]).max() < 1e-10
    assert np.abs(np.abs((turn[:, :8] * vectors).sum(axis=0)) - 1).max() < 1e-9
