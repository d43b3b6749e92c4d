"""The approximate search finds nine in ten nearest vectors, at the catalogue's own settings."""

import os

import pytest

from corpuslens.operators.neighbors import ann_topk, cosine_topk, recall_share
from corpuslens.plans import catalog
from tests.conftest import DATA


@pytest.mark.parametrize("size", [DATA, os.path.join(os.path.dirname(DATA), "sf0.1")])
def test_recall_of_the_query(spark, size):
    if not os.path.isdir(size):
        pytest.skip(f"no tables in {size}")
    rows = spark.read.parquet(f"{size}/embeddings.parquet")
    queries, base = rows.where("vec_id % 5 = 0"), rows.where("vec_id % 5 <> 0")
    exact = {r.query_id: r.base_id for r in cosine_topk(queries, base, 1).collect()}
    found = catalog.ann_neighbours(spark, size).collect()
    assert {r.query_id for r in found} == set(exact) and {r["rank"] for r in found} == {1}
    assert sum(r.base_id == exact[r.query_id] for r in found) >= 0.9 * len(exact)


def test_recall_counts_wrong_and_missing_answers(spark):
    exact = spark.createDataFrame([(i, 100 + i, 0.5) for i in range(4)], "query_id int, base_id int, score double")
    found = spark.createDataFrame(
        [(0, 100, 0.5, 1), (1, 7, 0.5, 1), (2, 7, 0.4, 1)], "query_id int, base_id int, score double, rank int"
    )
    row = recall_share(found, exact).first()
    assert (row.n, row.recall) == (4, 0.5)
