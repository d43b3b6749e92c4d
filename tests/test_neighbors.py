import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpuslens.operators import neighbors
from corpuslens.operators.neighbors import ann_topk, cosine_topk, knn_join, knn_label
from corpuslens.operators.resample import class_weights, smote, under_sample
from corpuslens.sources.vectors import VectorCollection, upsert_vectors

N = 600


@pytest.fixture(scope="module")
def points(spark):
    x = np.random.default_rng(0).normal(size=(N, 5))
    x[200:400] = x[0]  # a third of all rows are copies of one row
    x[400:405] = 0
    df = spark.createDataFrame(
        [(i, [float(v) for v in r], i % 3) for i, r in enumerate(x)],
        "vec_id bigint, embedding array<double>, label int",
    )
    return x, df.cache()


def brute(x, k, metric, by, exclude):
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    unit = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    out = {}
    for i in range(len(x)):
        s = unit @ unit[i] if metric == "cosine" else -np.sqrt(((x - x[i]) ** 2).sum(1))
        s = np.round(s, 6)
        chosen = [j for j in range(len(x)) if not (exclude and i == j) and (not by or j % 3 == i % 3)]
        out[i] = sorted(chosen, key=lambda j: (-s[j], j))[:k]
    return out


def collected(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.base_id)
    return out


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("by", [None, "label"])
@pytest.mark.parametrize("opts", [{}, {"cell_rows": 20, "block_rows": 32}])
def test_exact_against_brute_force(points, metric, by, opts):
    x, df = points
    found = knn_join(
        df, df, 4, query_id="vec_id", base_id="vec_id", vec="embedding", by=by, metric=metric, exclude_self=True, **opts
    )
    assert collected(found) == brute(x, 4, metric, by, True)


def test_zero_vector_has_cosine_zero(points):
    _, df = points
    row = cosine_topk(df.where("vec_id = 400"), df, 1).first()
    assert (row.base_id, row.score) == (0, 0.0)


def test_fewer_vectors_than_k(points):
    _, df = points
    found = cosine_topk(df.where("vec_id < 5"), df.where("vec_id < 3"), 10)
    assert found.count() == 15


def test_approximate_recall(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    queries, base = rows.where("vec_id % 5 = 0"), rows.where("vec_id % 5 <> 0")
    exact = collected(cosine_topk(queries, base, 1))
    near = collected(ann_topk(queries, base, 1, probe=4, cell_rows=50))
    hits = sum(near.get(q) == b for q, b in exact.items()) / len(exact)
    assert hits >= 0.6
    full = collected(ann_topk(queries, base, 1, probe=8, cell_rows=50))
    assert full == exact


def test_label_of_nearest(spark):
    base = spark.createDataFrame([(1, [1.0, 0.0], 7), (2, [0.0, 1.0], 8)], "vec_id int, embedding array<double>, label int")
    asked = spark.createDataFrame([(9, [0.2, 3.0], 8)], "vec_id int, embedding array<double>, label int")
    assert knn_label(asked, base).first().prediction == 8


def test_upsert_keeps_the_last_version(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "vec_id int, v string, version int")
    new = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 1)], "vec_id int, v string, version int")
    got = sorted((r.vec_id, r.v) for r in upsert_vectors(old, new).collect())
    assert got == [(1, "a"), (2, "d"), (3, "e")]


def test_equal_versions_follow_the_rule(spark):
    row = "vec_id int, v string, version int"
    old = spark.createDataFrame([(1, "z", 1), (2, "z", 2)], row)
    new = spark.createDataFrame([(1, "a", 1), (1, "b", 1), (2, "a", 1), (3, "c", 1), (3, "c", 1)], row)
    got = sorted(tuple(r) for r in upsert_vectors(old, new).collect())
    assert got == [(1, "b", 1), (2, "z", 2), (3, "c", 1)]


def test_an_upsert_rewrites_only_its_buckets(spark, tmp_path):
    row = "vec_id int, e array<float>, version int"
    store = VectorCollection(spark, str(tmp_path / "db"), buckets=16)
    assert store.read() is None
    store.upsert(spark.createDataFrame([(i, [float(i)], 1) for i in range(200)], row))
    before = store.manifest()["folders"]
    assert len(before) == 16
    store.upsert(spark.createDataFrame([(7, [70.0], 2)], row))
    after = store.manifest()["folders"]
    assert sum(before[b] != after[b] for b in before) == 1
    now = {r.vec_id: r.e[0] for r in store.read().collect()}
    assert len(now) == 200 and now[7] == 70.0 and now[8] == 8.0
    assert {r.vec_id: r.e[0] for r in store.read(back=1).collect()}[7] == 7.0
    assert store.expire() == 1 and store.read(back=1) is None
    assert {r.vec_id: r.e[0] for r in store.read().collect()} == now
    store.upsert(spark.createDataFrame([], row))
    assert store.manifest()["folders"] == after and store.read().count() == 200
    with pytest.raises(ValueError, match="columns"):
        store.upsert(spark.createDataFrame([(1, 2)], "vec_id int, version int"))


def test_two_writers_at_once(spark, tmp_path):
    row = "vec_id int, version int"
    store = VectorCollection(spark, str(tmp_path / "db"))
    store.upsert(spark.createDataFrame([(1, 1)], row))
    late = store.manifest()
    store.upsert(spark.createDataFrame([(2, 1)], row))
    with pytest.raises(RuntimeError, match="another writer"):
        store._publish(late | {"number": late["number"] + 1})
    assert store.read().count() == 2


def test_collection_snapshots(spark, tmp_path):
    store = VectorCollection(spark, str(tmp_path / "db"))
    assert store.read() is None
    row = "vec_id int, v string, version int"
    store.upsert(spark.createDataFrame([(1, "a", 1)], row))
    assert store.upsert(spark.createDataFrame([(1, "b", 2), (4, "x", 1)], row)).count() == 2
    again = VectorCollection(spark, str(tmp_path / "db")).read()
    assert sorted(r.v for r in again.collect()) == ["b", "x"]


def classed(spark, sizes):
    rng = np.random.default_rng(3)
    rows, i = [], 0
    for label, n in sizes.items():
        for _ in range(n):
            rows.append((i, label, [float(v) for v in rng.normal(label * 5, 1, 3)]))
            i += 1
    return spark.createDataFrame(rows, "doc_id bigint, label int, features array<double>")


@pytest.mark.parametrize("opts", [{}, {"cell_rows": 5, "block_rows": 8}])
def test_smote(spark, opts):
    df = classed(spark, {0: 40, 1: 7, 2: 3})
    out = smote(df, **opts).collect()
    assert {c: sum(r.label == c for r in out) for c in (0, 1, 2)} == {0: 40, 1: 40, 2: 40}
    assert len({r.doc_id for r in out}) == 120
    real = {c: np.array([r.features for r in out if r.label == c and not r.synthetic]) for c in (1, 2)}
    for r in out:
        if not r.synthetic:
            continue
        p, members = np.array(r.features), real[r.label]
        # the point lies on a segment between two members of its class
        best = min(
            np.linalg.norm(a - p) + np.linalg.norm(b - p) - np.linalg.norm(a - b)
            for i, a in enumerate(members)
            for b in members[i + 1 :]
        )
        assert best < 1e-9


def test_smote_edges(spark):
    assert smote(classed(spark, {0: 5, 1: 5})).where("synthetic").count() == 0
    with pytest.raises(ValueError, match="single row"):
        smote(classed(spark, {0: 5, 1: 1}))


def test_under_sample_and_weights(spark):
    df = classed(spark, {0: 40, 1: 7})
    assert {r.label: r["count"] for r in under_sample(df).groupBy("label").count().collect()} == {0: 7, 1: 7}
    weights = {r.label: r.weight for r in class_weights(df).collect()}
    assert weights == {0: pytest.approx(47 / 80), 1: pytest.approx(47 / 14)}
    total = class_weights(df).agg(F.sum("weight")).first()[0]
    assert total == pytest.approx(47)


def test_small_cells_share_a_block(spark, monkeypatch):
    """A query travels once to a block, however many cells it visits there, and the answers stay exact."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, 3))
    rows = [(i, [float(v) for v in x[i]]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    base, queries = df.where("vec_id % 4 <> 0"), df.where("vec_id % 4 = 0")
    met, search = spark.sparkContext.accumulator(0), neighbors._block_topk

    def counting(*args):
        inner = search(*args)

        def run(asked, stored):
            met.add(len(asked))
            return inner(asked, stored)

        return run

    monkeypatch.setattr(neighbors, "_block_topk", counting)
    got = knn_join(queries, base, 2, query_id="vec_id", base_id="vec_id", vec="embedding", metric="euclidean", cell_rows=5)
    found = {(r.query_id, r["rank"]): r.base_id for r in got.collect()}
    assert met.value <= 2 * 100  # one block: the nearest cell's visit, then one for all other open cells
    ids = np.array([i for i in range(400) if i % 4])
    for q in range(0, 400, 4):
        near = ids[np.argsort(((x[ids] - x[q]) ** 2).sum(axis=1), kind="stable")[:2]]
        assert [found[q, 1], found[q, 2]] == near.tolist()


def test_distances_to_many_pivots_are_made_in_slices(monkeypatch):
    sizes, squared = [], neighbors._squared
    monkeypatch.setattr(neighbors, "_squared", lambda a, b: sizes.append(len(a) * len(b)) or squared(a, b))
    rng = np.random.default_rng(1)
    vectors, pivots = pd.Series(list(rng.normal(size=(5000, 40)))), rng.normal(size=(2048, 40))
    cells, distance = neighbors._nearest(vectors, pivots, False, 3)
    assert max(sizes) <= neighbors.MATRIX_CELLS and cells.shape == (5000, 3) and len(distance) == 5000
