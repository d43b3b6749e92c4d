import math
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from corpuslens.operators import tfidf
from corpuslens.operators.encode import END, PAD, START, UNKNOWN, encode_fixed, token_vocabulary
from corpuslens.operators.features import pos_counts
from corpuslens.operators.lookup import lookup_join
from corpuslens.operators.scaling import fit_max_abs, fit_min_max, max_abs_terms, min_max, min_max_by
from corpuslens.operators.selection import chi2_scores, chi2_terms, select_k_best
from corpuslens.operators.svd import fit_svd
from corpuslens.operators.tfidf import fit_tfidf, fit_tfidf_vectors

TEXTS = ["red cat red", "cat dog", "", "blue dog dog sky x", "red sky"]


def corpus(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def by_hand(texts, min_count=1):
    words = [[w for w in t.split() if len(w) >= 2] for t in texts]
    df = Counter(w for ws in words for w in set(ws))
    out = {}
    for i, ws in enumerate(words):
        v = {
            w: c * (math.log((1 + len(texts)) / (1 + df[w])) + 1)
            for w, c in Counter(ws).items()
            if df[w] >= min_count
        }
        norm = math.sqrt(sum(x * x for x in v.values()))
        out |= {(i, w): x / norm for w, x in v.items()}
    return out


def test_tfidf_values(spark):
    df = corpus(spark)
    got = {(r.doc_id, r.term): r.value for r in fit_tfidf(df).transform(df).collect()}
    want = by_hand(TEXTS)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_tfidf_min_df_boundary_and_unseen(spark):
    df = corpus(spark)
    model = fit_tfidf(df, min_df=0.4)  # exactly 2 of 5 documents is kept
    got = {(r.doc_id, r.term) for r in model.transform(df).collect()}
    assert got == by_hand(TEXTS, 2).keys()
    unseen = corpus(spark, ["green", "red green"])
    assert [(r.doc_id, r.term, r.value) for r in model.transform(unseen).collect()] == [(1, "red", 1.0)]


def test_bigrams(spark):
    df = corpus(spark, ["aa bb cc", "zz"])
    terms = {r.term for r in fit_tfidf(df, ngram_range=(1, 2)).transform(df).collect()}
    assert terms == {"aa", "bb", "cc", "zz", "aa bb", "bb cc"}
    only = {r.term for r in fit_tfidf(df, ngram_range=(2, 3)).transform(df).collect()}
    assert only == {"aa bb", "bb cc", "aa bb cc"}


def test_feature_names(spark):
    names = fit_tfidf(corpus(spark)).feature_names().orderBy("idx").collect()
    assert [(r.term, r.idx) for r in names] == list(zip(["blue", "cat", "dog", "red", "sky"], range(5)))


def test_vectors_equal_long_form(spark):
    df = corpus(spark).withColumn("label", F.lit(0))
    vectors = fit_tfidf_vectors(df, min_df=1)
    rows = vectors.transform(df).select("doc_id", vector_to_array("features").alias("v")).collect()
    got = {(r.doc_id, vectors.names[i]): x for r in rows for i, x in enumerate(r.v) if x}
    long = max_abs_terms(fit_tfidf(df).transform(df)).collect()
    want = {(r.doc_id, r.term): r.value for r in long}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_lookup_join_paths_agree(spark):
    facts = spark.createDataFrame(
        [(i, "hot" if i % 3 else f"k{i % 50}") for i in range(600)], "id int, key string"
    )
    table = facts.groupBy("key").agg(F.count("*").alias("n")).where("key <> 'k3'")
    small = sorted(map(tuple, lookup_join(facts, table, "key", "n").select("id", "key", "n").collect()), key=str)
    large = sorted(
        map(tuple, lookup_join(facts, table, "key", "n", broadcast_rows=1).select("id", "key", "n").collect()), key=str
    )
    assert small == large
    inner = lookup_join(facts, table, "key", "n", broadcast_rows=1, how="inner")
    assert inner.count() == sum(1 for r in small if r[2] is not None)


def test_min_max(spark):
    df = spark.createDataFrame([(1, 2.0, 5.0), (2, 4.0, 5.0), (3, 3.0, 5.0)], "doc_id int, a double, c double")
    rows = {r.doc_id: (r.a, r.c) for r in min_max(df, ["a", "c"]).collect()}
    assert rows == {1: (0.0, 0.0), 2: (1.0, 0.0), 3: (0.5, 0.0)}
    single = min_max(df.where("doc_id = 1"), ["a"]).first()
    assert single.a == 0.0
    test = fit_min_max(df, ["a"]).transform(spark.createDataFrame([(9, 6.0)], "doc_id int, a double"))
    assert test.first().a == 2.0


def test_min_max_by_group(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", 3.0), ("y", 10.0), ("y", 20.0), ("z", 7.0)], "split string, a double")
    got = sorted(map(tuple, min_max_by(df, ["a"], "split").collect()))
    assert got == [("x", 0.0), ("x", 1.0), ("y", 0.0), ("y", 1.0), ("z", 0.0)]


def test_max_abs_may_exceed_one(spark):
    train = spark.createDataFrame([(1, -4.0), (2, 2.0)], "doc_id int, a double")
    test = spark.createDataFrame([(3, 6.0)], "doc_id int, a double")
    assert fit_max_abs(train, ["a"]).transform(test).first().a == 1.5


def test_chi2_against_numpy(spark):
    rng = np.random.default_rng(1)
    x, y = rng.random((60, 3)), rng.integers(0, 3, 60)
    x[:, 2] = 0
    df = spark.createDataFrame([(*map(float, r), int(c)) for r, c in zip(x, y)], "a double, b double, z double, label int")
    got = {r.feature: r.score for r in chi2_scores(df, ["a", "b", "z"]).collect()}
    onehot = np.eye(3)[y]
    observed, expected = onehot.T @ x, np.outer(onehot.mean(0), x.sum(0))
    want = ((observed[:, :2] - expected[:, :2]) ** 2 / expected[:, :2]).sum(0)
    assert got["z"] is None
    assert [got["a"], got["b"]] == pytest.approx(list(want))
    long = df.withColumn("doc_id", F.monotonically_increasing_id()).selectExpr(
        "doc_id", "label", "stack(3, 'a', 0, a, 'b', 1, b, 'z', 2, z) as (term, idx, value)"
    )
    sizes = df.groupBy("label").agg(F.count("*").alias("n"))
    terms = {r.feature: r.score for r in chi2_terms(long, sizes).collect()}
    assert terms["a"] == pytest.approx(got["a"]) and terms["z"] is None


def test_select_k_best_ties(spark):
    scores = spark.createDataFrame(
        [("a", 0, 1.0), ("b", 1, 2.0), ("c", 2, 1.0), ("d", 3, None)], "feature string, idx int, score double"
    )
    assert [r.feature for r in select_k_best(scores, 2).collect()] == ["b", "c"]
    assert [r.feature for r in select_k_best(scores, 4).collect()] == ["a", "b", "c", "d"]


def test_svd_against_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 4)) @ rng.normal(size=(4, 30)) + 0.01 * rng.normal(size=(120, 30))
    df = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "doc_id int, features array<double>")
    model = fit_svd(df, 4)
    v, s = model.components, model.singular_values
    assert np.allclose(v.T @ v, np.eye(4), atol=1e-8)
    assert np.allclose(s, np.linalg.svd(x)[1][:4], rtol=1e-6)
    assert list(s) == sorted(s, reverse=True)
    assert (v[np.abs(v).argmax(0), range(4)] > 0).all()
    best = np.linalg.norm(np.linalg.svd(x)[1][4:])
    assert np.linalg.norm(x - x @ v @ v.T) == pytest.approx(best, rel=1e-3)
    projected = np.array([r.svd for r in model.project(df).orderBy("doc_id").collect()])
    assert np.allclose(projected, x @ v)
    assert fit_svd(df, 500).components.shape[1] == 30


def test_encoding(spark):
    df = spark.createDataFrame([(1, "red cat red", 1), (2, "", 0), (3, "red " * 20, 1)], "doc_id int, text string, fake int")
    vocabulary = token_vocabulary(df, size=1)
    assert [(r.token, r.n, r.token_id) for r in vocabulary.collect()] == [("red", 22, 4)]
    rows = {r.doc_id: r for r in encode_fixed(df, vocabulary, labels=["fake"], max_len=8).collect()}
    assert rows[1].input_ids == [START, 4, UNKNOWN, 4, END, PAD, PAD, PAD]
    assert rows[1].attention_mask == [1] * 5 + [0] * 3 and rows[1].labels == [1.0]
    assert rows[2].input_ids == [START, END] + [PAD] * 6
    assert rows[3].input_ids == [START] + [4] * 6 + [END]


def test_vocabulary_order(spark):
    df = spark.createDataFrame([(1, "bb aa cc aa dd bb aa")], "doc_id int, text string")
    assert [r.token for r in token_vocabulary(df, size=3).orderBy("token_id").collect()] == ["aa", "bb", "cc"]
    assert token_vocabulary(df, size=100).count() == 4


def test_vocabulary_is_counted_without_moving_texts(spark, monkeypatch):
    """A document's repeated term counts once; no exchange of the fitted plan carries a text."""
    plans = []
    monkeypatch.setattr(
        tfidf, "stage", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    )
    df = spark.createDataFrame([(1, "aa bb aa"), (2, "bb cc"), (3, None), (4, "")], "doc_id int, text string")
    model = tfidf.fit_tfidf(df)
    assert {r.term: r.docs for r in model.vocabulary.collect()} == {"aa": 1, "bb": 2, "cc": 1} and model.n_docs == 4
    exchanges = [line for line in plans[0].splitlines() if "Exchange" in line]
    assert exchanges and all("term" in line and "text" not in line for line in exchanges)


def test_encoding_and_lexicon_move_no_row(spark):
    df = spark.createDataFrame([(1, "aa bb"), (2, None), (3, "cc " * 20)], "doc_id int, text string")
    vocabulary = spark.createDataFrame([("aa", 4), ("cc", 5)], "token string, token_id int")
    encoded = encode_fixed(df, vocabulary, max_len=6)
    tagged = pos_counts(df, lexicon=spark.createDataFrame([("aa", "JJ")], "word string, tag string"))
    for out in (encoded, tagged):
        text = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in text and "Generate" not in text and "Join" not in text
    got = {r.doc_id: (r.input_ids, sum(r.attention_mask)) for r in encoded.collect()}
    assert got == {
        1: ([START, 4, UNKNOWN, END, PAD, PAD], 4),
        2: ([START, END, PAD, PAD, PAD, PAD], 2),
        3: ([START, 5, 5, 5, 5, END], 6),
    }
    assert {r.doc_id: r.adjective_count for r in tagged.collect()}[1] >= 1


def test_terms_are_weighed_inside_their_row(spark):
    """Unique ids: no exchange, and the same values as by the grouped way, which ids that come twice still need."""
    from corpuslens.operators.tfidf import fit_tfidf

    rows = [(i, i % 2, " ".join(["aa"] * (i % 3) + ["bb", f"cc{i % 4}", "dd bb"])) for i in range(40)] + [(40, 0, None), (41, 1, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, label int, text string")
    model = fit_tfidf(df, ngram_range=(1, 2), min_df=2)
    got = model.transform(df, keep=("label",))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    found = {(r.doc_id, r.term): r.value for r in got.collect()}
    want = {(r.doc_id, r.term): r.value for r in model._joined(df, "text").collect()}
    assert found.keys() == want.keys() and all(found[key] == pytest.approx(want[key], abs=1e-12) for key in want)
    assert {(r.doc_id, r.label) for r in got.collect()} == {(a, b) for a, b, _ in rows[:40]}
    twice = df.unionByName(df)
    again = {(r.doc_id, r.term): r.value for r in model.transform(twice).collect()}
    assert len(again) == model.transform(twice).count() and all(again[key] == pytest.approx(want[key], abs=1e-12) for key in want)
