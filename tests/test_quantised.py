"""The quantised index: recall, work, exactness at full settings, copies, edges."""

import numpy as np
import pytest

from corpuslens.operators.neighbors import cosine_topk, recall_share
from corpuslens.operators.quantised import QuantisedIndex, _blocks, fit_centroids
from corpuslens.plans import catalog
from tests.test_neighbors import collected

SCHEMA = "vec_id bigint, embedding array<double>"


def table(spark, x, start=0):
    return spark.createDataFrame([(start + i, [float(v) for v in r]) for i, r in enumerate(x)], SCHEMA)


def test_all_cells_and_rows_are_exact(spark):
    x = np.random.default_rng(1).normal(size=(500, 6))
    x[200:360] = x[0]  # a third of all rows are copies of one row
    base = table(spark, x).cache()
    index = QuantisedIndex(base, block_rows=64)  # a large cell has several blocks, a block several chunks
    assert index.rows.sum() == 500 and index.copies
    exact = collected(cosine_topk(base, base, 3, exclude_self=True))
    assert collected(index.topk(base, 3, shortlist=500, exclude_self=True)) == exact


def test_recall_with_a_small_part_scored(spark):
    rng = np.random.default_rng(2)
    base, queries = table(spark, rng.normal(size=(3000, 32))).cache(), table(spark, rng.normal(size=(150, 32)), 10_000).cache()
    index = QuantisedIndex(base)
    settings = index.settings_for(queries, 0.9)
    near = index.candidates(queries, **settings).cache()
    exact = cosine_topk(queries, base, 1)
    assert recall_share(index.rerank(near, queries), exact).first().recall >= 0.9
    assert near.count() < 0.2 * 150 * 3000
    scores = {r.query_id: r.score for r in exact.collect()}
    assert all(r.score <= scores[r.query_id] + 1e-8 for r in index.rerank(near, queries).collect())


def test_a_cell_not_visited_holds_no_candidate(spark):
    rng = np.random.default_rng(3)
    centres = np.eye(8) * 10
    base = table(spark, np.repeat(centres, 50, axis=0) + rng.normal(size=(400, 8)) * 0.1).cache()
    index = QuantisedIndex(base)
    found = index.candidates(base.where("vec_id = 3"), probe=1, shortlist=400).collect()
    assert found and all(r.base_id < 50 for r in found)


def test_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, []), (6, [None, 1.0]), (None, [1.0, 1.0])]
    base = spark.createDataFrame(rows, SCHEMA)
    index = QuantisedIndex(base)
    assert index.n == 2
    found = index.topk(base, 2).collect()
    assert sorted((r.query_id, r["rank"], r.base_id, r.score) for r in found) == [
        (1, 1, 1, 1.0), (1, 2, 2, 0.0), (2, 1, 1, 0.0), (2, 2, 2, 0.0),
    ]
    empty = QuantisedIndex(base.where("vec_id > 9"))
    assert empty.topk(base).count() == 0 and empty.settings_for(base, 0.9) == {"probe": 1, "shortlist": 1}
    assert index.topk(base.where("vec_id > 9")).count() == 0
    with pytest.raises(ValueError, match="length"):
        QuantisedIndex(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], SCHEMA))


def test_blocks_hold_every_row_once():
    rows = np.array([5, 0, 130, 40, 70, 64, 1])
    first, parts = _blocks(rows, 64)
    assert parts.tolist() == [1, 1, 3, 1, 2, 1, 1]
    large = [set(range(f, f + p)) for f, p in zip(first, parts) if p > 1]
    small = {f for f, p in zip(first.tolist(), parts) if p == 1}
    assert not large[0] & large[1] and not small & (large[0] | large[1])


def test_centroids_of_few_rows_are_the_rows():
    x = np.array([[0.0, 1.0], [2.0, 3.0], [0.0, 1.0]])
    assert np.array_equal(np.unique(fit_centroids(x), axis=0), np.unique(x, axis=0))


def test_queries_find_nine_in_ten(spark, sf):
    (row,) = catalog.ann_index_recall(spark, sf).collect()
    stored, queries = catalog.vectors(spark, sf)
    assert row.asDict() == {"n": queries.count(), "recall_holds": True, "few_scored": True}
    exact = {r.query_id: r.base_id for r in cosine_topk(queries, stored, 1).collect()}
    found = catalog.ann_index_neighbours(spark, sf).collect()
    assert {r.query_id for r in found} == set(exact)
    assert sum(r.base_id == exact[r.query_id] for r in found) >= 0.9 * len(exact)
