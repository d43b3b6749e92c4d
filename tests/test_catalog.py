"""Every query with an SQL twin gives the same rows; plans have the intended shape."""

import os

import duckdb
import pytest

from corpuslens.plans.catalog import QUERIES
from corpuslens.plans.oracles import oracles
from tools.check import TABLES, digest

ORACLES = oracles()


@pytest.fixture(scope="module")
def db(sf):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{os.path.join(sf, name)}.parquet'")
    return connection


def test_names():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    cursor = db.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = [tuple(r[i] for i in order) for r in cursor.fetchall()]
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    assert digest(got) == digest(want)


@pytest.mark.parametrize("partitions", ["1", "16"])
@pytest.mark.parametrize(
    "name", ["tfidf_max_abs", "stratified_folds", "smote_2d", "cosine_top5_cells", "class_report", "decision_path", "vocabulary"]
)
def test_any_number_of_partitions(spark, sf, db, name, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        test_equals_sql(spark, sf, db, name)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


TEXT = ["clean_tokens", "linguistic_features_raw", "part_of_speech_counts", "gunning_fog_scale"]


@pytest.mark.parametrize("name", TEXT)
def test_text_features_stay_in_the_jvm_without_joins(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert "Python" not in text and "Join" not in text and "Window" not in text
    assert text.count("Exchange") <= 1  # only the spread of the single small file


@pytest.mark.parametrize(
    "name", ["stratified_train_test", "random_split_80_10_10", "under_sampled", "tfidf", "cosine_top5", "confusion_matrix"]
)
def test_no_cross_joins(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_scan_reads_only_what_it_needs(spark, sf):
    text = plan(QUERIES["min_max_numeric"](spark, sf))
    assert "l_shipdate" not in text and "o_totalprice" not in text
