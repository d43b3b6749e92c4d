import math

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import metrics as E

PAIRS = [(0, 0), (0, 0), (0, 1), (1, 1), (1, 2), (2, 2), (2, 2), (3, 0)]


@pytest.fixture(scope="module")
def scored(spark):
    return spark.createDataFrame(PAIRS, "label int, prediction int")


def test_accuracy(scored):
    assert tuple(E.accuracy(scored).first()) == (62.5, 8)


def test_confusion_has_zeros_and_union_of_labels(spark, scored):
    rows = {(r.truth, r.predicted): r.n for r in E.confusion_matrix(scored).collect()}
    assert len(rows) == 16 and rows[0, 0] == 2 and rows[3, 3] == 0 and sum(rows.values()) == 8
    extra = spark.createDataFrame([(0, 9)], "label int, prediction int")
    assert {(r.truth, r.predicted, r.n) for r in E.confusion_matrix(extra).collect()} == {
        (0, 0, 0),
        (0, 9, 1),
        (9, 0, 0),
        (9, 9, 0),
    }


def test_report(scored):
    rows = {r.line: r for r in E.class_report(scored).collect()}
    assert rows["0"].precision == pytest.approx(2 / 3) and rows["0"].recall == pytest.approx(2 / 3)
    assert rows["3"].precision == 0.0 and rows["3"].f1 == 0.0 and rows["3"].support == 1
    f1 = [2 / 3, 0.5, 0.8, 0.0]
    assert rows["macro avg"].f1 == pytest.approx(sum(f1) / 4)
    assert rows["weighted avg"].f1 == pytest.approx(sum(a * b for a, b in zip(f1, (3, 2, 2, 1))) / 8)
    assert rows["accuracy"].f1 == pytest.approx(5 / 8) and rows["accuracy"].support == 8
    assert E.f1_macro(scored).first()[0] == pytest.approx(sum(f1) / 4)


def test_label_predicted_but_absent(spark):
    rows = {r["class"]: r for r in E.class_scores(spark.createDataFrame([(0, 5)], "label int, prediction int")).collect()}
    assert rows[5].support == 0 and rows[5].recall == 0.0


def test_multilabel(spark):
    data = [(0.0, -1.0, 1, 0), (2.0, 3.0, 0, 1), (-2.0, -2.0, 1, 1)]
    df = spark.createDataFrame(data, "s0 double, s1 double, y0 int, y1 int")
    row = E.multilabel_metrics(df, ["s0", "s1"], ["y0", "y1"]).first()
    # predictions: (1,0) (1,1) (0,0): tp 2, fp 1, fn 2, tn 1; a score of 0 counts as predicted
    assert row.f1 == pytest.approx(4 / 7)
    assert row.roc_auc == pytest.approx((2 / 4 + 1 / 2) / 2)
    assert row.accuracy == pytest.approx(1 / 3)
    ranked = E.multilabel_metrics(df, ["s0", "s1"], ["y0", "y1"], on="score").first().roc_auc
    flat = [(1 / (1 + math.exp(-s)), y) for a in data for s, y in ((a[0], a[2]), (a[1], a[3]))]
    pos, neg = [p for p, y in flat if y], [p for p, y in flat if not y]
    want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / len(pos) / len(neg)
    assert ranked == pytest.approx(want)


def test_label_distribution(scored):
    assert [tuple(r) for r in E.label_distribution(scored).collect()][0] == (0, 3)


def test_pivot(scored):
    row = E.confusion_pivot(scored, [0, 1, 2, 3]).where(F.col("truth") == 1).first()
    assert tuple(row) == (1, 0, 1, 1, 0)
