from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpuslens.functions.hashing import hash_key, hash_unit
from corpuslens.operators.ranking import hash_rank, ordered_rank
from corpuslens.operators.resample import under_sample
from corpuslens.operators.relational import map_label, one_hot, sample_n
from corpuslens.operators.splits import (
    fold_sizes,
    random_split3,
    stratified_kfold,
    stratified_split,
    train_quotas,
)
from corpuslens.schema import TRUTH_LABELS


def corpus(spark, sizes):
    rows = [(i * 7, label) for i, label in enumerate([c for c, n in sizes.items() for _ in range(n)])]
    return spark.createDataFrame(rows, "doc_id bigint, label int")


def test_hash_rank_equals_plain_window(spark):
    df = corpus(spark, {0: 3000, 1: 20})
    rows = hash_rank(df, ["label"]).withColumn("k", hash_key("doc_id")).collect()
    for label in (0, 1):
        order = sorted((r for r in rows if r.label == label), key=lambda r: (r.k, r.doc_id))
        assert [r.rn for r in order] == list(range(len(order)))


def test_ordered_rank_equals_sort(spark):
    df = corpus(spark, {0: 700, 1: 333})
    rows = ordered_rank(df, "doc_id", ["label"]).collect()
    for label in (0, 1):
        order = sorted((r for r in rows if r.label == label), key=lambda r: r.doc_id)
        assert [r.rn for r in order] == list(range(len(order)))
    words = spark.createDataFrame([(f"w{i}",) for i in range(600)], "term string")
    ranked = sorted(ordered_rank(words, "term").collect(), key=lambda r: r.rn)
    assert [r.term for r in ranked] == sorted(f"w{i}" for i in range(600))


def test_train_quotas():
    # 0.8 * 10 rows: shares 4.0, 2.4, 1.6; the larger remainder gets the last row.
    assert train_quotas({0: 5, 1: 3, 2: 2}, 0.2) == {0: 4, 1: 2, 2: 2}
    # equal remainders: the smaller label wins.
    assert train_quotas({0: 3, 1: 3}, 0.5) == {0: 2, 1: 1}
    with pytest.raises(ValueError):
        train_quotas({0: 5, 1: 1}, 0.2)


def test_stratified_split_sizes(spark):
    rows = stratified_split(corpus(spark, {0: 70, 1: 20, 2: 11})).collect()
    count = Counter((r.split, r.label) for r in rows)
    quota = train_quotas({0: 70, 1: 20, 2: 11}, 0.2)
    assert sum(n for (s, _), n in count.items() if s == "test") == 21
    assert all(count["train", c] == quota[c] for c in quota)


@pytest.mark.parametrize("held, sizes", [(0.2, (83, 10, 11)), (0.3, (72, 16, 16))])
def test_three_way_sizes(spark, held, sizes):
    rows = random_split3(corpus(spark, {0: 104}), held).collect()
    count = Counter(r.split for r in rows)
    assert (count["train"], count["test"], count["validation"]) == sizes


def test_approximate_split_is_local(spark):
    df = random_split3(corpus(spark, {0: 2000}), exact=False)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    count = Counter(r.split for r in df.collect())
    assert abs(count["train"] - 1600) < 100 and abs(count["test"] - 200) < 60


def test_fold_sizes_against_dealing():
    counts = {0: 13, 1: 4, 2: 28}
    got = fold_sizes(counts, 5)
    start = 0
    for label, n in counts.items():
        dealt = Counter(p % 5 for p in range(start, start + n))
        assert got[label] == [dealt[i] for i in range(5)]
        start += n


def test_kfold_blocks(spark):
    counts = {0: 13, 1: 3, 2: 28}
    rows = stratified_kfold(corpus(spark, counts)).collect()
    for label, sizes in fold_sizes(counts, 5).items():
        folds = [r.fold for r in sorted((r for r in rows if r.label == label), key=lambda r: r.doc_id)]
        assert folds == [i for i, n in enumerate(sizes) for _ in range(n)]


def test_sample_is_exact_and_repeatable(spark):
    df = corpus(spark, {0: 500})
    first = {r.doc_id for r in sample_n(df, 40).collect()}
    again = {r.doc_id for r in sample_n(df.repartition(13), 40).collect()}
    assert len(first) == 40 and first == again
    assert sample_n(df, 900).count() == 500


def test_unit_hash_range(spark):
    row = spark.range(3000).agg(F.min(hash_unit("id")), F.max(hash_unit("id")), F.avg(hash_unit("id"))).first()
    assert 0 <= row[0] and row[1] < 1 and abs(row[2] - 0.5) < 0.03


def test_labels(spark):
    df = spark.createDataFrame([(1, "false"), (2, "pants-fire")], "doc_id int, name string")
    assert [r.c for r in df.select(map_label(F.col("name")).alias("c")).collect()] == [4, 5]
    bad = spark.createDataFrame([(1, "maybe")], "doc_id int, name string")
    with pytest.raises(Exception, match="unknown label"):
        bad.select(map_label(F.col("name"))).collect()
    hot = one_hot(spark.createDataFrame([(1, 3)], "doc_id int, label int"), TRUTH_LABELS).first()
    assert "label" not in hot.asDict() and hot["barely-true"] and sum(map(bool, hot[1:])) == 1


@pytest.mark.parametrize("partitions", ["1", "16"])
def test_same_choice_for_any_partitioning(spark, partitions):
    df = corpus(spark, {0: 300, 1: 77})
    want = sorted(map(tuple, stratified_split(df).collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = sorted(map(tuple, stratified_split(df.repartition(7)).collect()))
        folds = sorted(map(tuple, stratified_kfold(df.repartition(5)).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == want
    assert folds == sorted(map(tuple, stratified_kfold(df).collect()))


def test_cuts_move_no_row(spark):
    df = corpus(spark, {0: 70, 1: 20, 2: 11}).withColumn("text", F.lit("a wide column"))
    for out in (stratified_split(df), random_split3(df), stratified_kfold(df), under_sample(df)):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_cuts_equal_ranks(spark):
    sizes = {0: 70, 1: 20, 2: 3}
    df = corpus(spark, sizes)
    rank = {r.doc_id: r.rn for r in hash_rank(df, ["label"]).collect()}
    quota = train_quotas(sizes, 0.2)
    assert all((r.split == "train") == (rank[r.doc_id] < quota[r.label]) for r in stratified_split(df).collect())
    kept = {r.doc_id for r in under_sample(df).collect()}
    assert kept == {i for i, n in rank.items() if n < 3}


def test_more_digits_for_more_rows(spark):
    df = corpus(spark, {0: 500})
    plain = {r.doc_id: r.rn for r in hash_rank(df).collect()}
    assert plain == {r.doc_id: r.rn for r in hash_rank(df, rows=10**9).collect()}


def test_three_way_of_few_rows(spark):
    assert random_split3(corpus(spark, {0: 0})).count() == 0
    assert [r.split for r in random_split3(corpus(spark, {0: 1})).collect()] == ["validation"]
