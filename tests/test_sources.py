import pytest
from pyspark.ml.feature import MaxAbsScaler, VectorAssembler
from pyspark.ml import Pipeline

from corpuslens.operators.features import linguistic_features, rename_reorder
from corpuslens.operators.scaling import MinMaxModel
from corpuslens.plans import jobs as J
from corpuslens.schema import COLUMNS, FEATURES
from corpuslens.sources.files import (
    DatasetRegistry,
    fit_or_load,
    read_articles,
    read_features,
    read_statements,
    read_tree,
    write_features,
)
from corpuslens.streaming.features import stream_features


def statement(ident, label, text):
    return "\t".join([ident, label, text, "s", "p", "j", "st", "party", "0", "1", "2", "3", "4", "ctx"])


def test_statements(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "train.tsv").write_text(
        statement("1.json", "half-true", '"He said ""no"" twice"') + "\n"
        + statement("2.json", "false", 'A 5" pipe stays') + "\n"
        + statement("2.json", "false", 'A 5" pipe stays') + "\n"
    )
    (tmp_path / "sub" / "valid.tsv").write_text(statement("3.json", "true", "plain") + "\n")
    (tmp_path / "README").write_text("not data")
    rows = read_statements(spark, str(tmp_path)).collect()
    assert sorted((r.split, r.label, r.statement) for r in rows) == [
        ("train", 2, 'He said "no" twice'),
        ("train", 4, 'A 5" pipe stays'),
        ("train", 4, 'A 5" pipe stays'),
        ("valid", 0, "plain"),
    ]
    assert len({r.doc_id for r in rows}) == 4
    assert rows[0].context == "ctx" and rows[0].pants_on_fire_counts == 4


def test_unknown_statement_label(spark, tmp_path):
    (tmp_path / "train.tsv").write_text(statement("1.json", "maybe", "x") + "\n")
    with pytest.raises(Exception, match="unknown label"):
        read_statements(spark, str(tmp_path)).collect()


def test_articles(spark, tmp_path):
    (tmp_path / "Fake.csv").write_text('title,text,subject\nT1,"Body, with\nnewline and ""quotes""",news\n')
    (tmp_path / "True.csv").write_text("title,text,subject\nT2,Body two,news\n")
    rows = {(r.part, r.label): r.text for r in read_articles(spark, str(tmp_path)).collect()}
    assert rows == {
        ("title", 1): "T1",
        ("text", 1): 'Body, with\nnewline and "quotes"',
        ("title", 0): "T2",
        ("text", 0): "Body two",
    }


def test_articles_with_other_header_fail(spark, tmp_path):
    (tmp_path / "Fake.csv").write_text("title,text\nT1,Body\n")
    (tmp_path / "True.csv").write_text("text,title\nBody,T2\n")
    with pytest.raises(Exception, match="header"):
        read_articles(spark, str(tmp_path)).collect()


def test_tree_reads_only_the_extension(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.csv").write_text("1\n")
    (tmp_path / "y.tsv").write_text("2\n")
    (tmp_path / "z.csvx").write_text("3\n")
    assert {r.file_name for r in read_tree(spark, str(tmp_path), ".csv").collect()} == {"x.csv"}


def small(spark):
    return spark.createDataFrame(
        [(1, "Cats and dogs run quickly. They were happy!", 0, "train"), (2, "", 1, "train"), (3, "A famous big story, told today.", 1, "test")],
        "doc_id bigint, text string, label int, split string",
    )


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_features_roundtrip(spark, tmp_path, fmt):
    df = rename_reorder(linguistic_features(small(spark)))
    write_features(df, str(tmp_path / fmt), fmt)
    back = read_features(spark, str(tmp_path / fmt), fmt)
    assert back.columns == COLUMNS and back.count() == 2
    want = {r.text: r for r in df.collect()}
    for r in back.collect():
        assert all(r[f] == pytest.approx(want[r.text][f]) for f in FEATURES)


def test_feature_job_fits_on_train(spark, tmp_path):
    scaled = J.feature_job(small(spark), split="split", path=str(tmp_path / "f"))
    assert scaled.columns == ["doc_id", "split", *COLUMNS]
    assert {r.split for r in spark.read.parquet(str(tmp_path / "f")).select("split").distinct().collect()} == {"train", "test"}
    train = scaled.where("split = 'train'").first()
    assert all(train[f] in (0.0, 1.0) for f in FEATURES)
    each = J.feature_job(small(spark), split="split", fit_per_split=True)
    assert all(each.where("split = 'test'").first()[f] == 0.0 for f in FEATURES)


def test_registry():
    registry = DatasetRegistry({"a": lambda: "A"})
    assert registry.load("a") == "A"
    with pytest.raises(KeyError):
        registry.load("b")
    assert DatasetRegistry({"a": lambda: "A"}, default="a").load("b") == "A"


def test_fit_or_load(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, -4.0)], "a double, b double")
    stages = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="v"), MaxAbsScaler(inputCol="v", outputCol="s")])
    path = str(tmp_path / "model")
    first = fit_or_load(path, stages, df).transform(df).select("s").collect()
    other = spark.createDataFrame([(100.0, 100.0)], "a double, b double")
    assert fit_or_load(path, stages, other).transform(df).select("s").collect() == first
    (tmp_path / "model" / "_COMPLETE").unlink()  # as if the writer had been cut off
    assert fit_or_load(path, stages, other).transform(df).select("s").collect() != first


def test_stream_equals_batch(spark, tmp_path):
    docs = small(spark).select("doc_id", "text", "label")
    docs.write.parquet(str(tmp_path / "in"))
    scaler = MinMaxModel({"lexicon_count": (0.0, 10.0)})
    source = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    run = stream_features(source, str(tmp_path / "out"), str(tmp_path / "cp"), scaler)
    run.awaitTermination(120)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(tuple, scaler.transform(linguistic_features(docs)).collect()))


def test_unknown_study_combination(spark):
    with pytest.raises(ValueError, match="no study"):
        J.ensemble_experiment(None, None, "liar_dataset", "linguistic")
    assert J.experiment_name("d", "tfidf", "stacking", "none") == "d_tfidf_StackingEnsemble_none_Final"


def test_resample_only_train(spark):
    rows = [(i, int(i < 12), [float(i), 1.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, label int, features array<double>")
    features = J.FeatureSet(df, df, ["a", "b"])
    out = J.resample_train(features, "oversample")
    assert out.test.count() == 60 and out.train.groupBy("label").count().select("count").distinct().count() == 1
    under = J.resample_train(features, "undersample")
    assert under.train.count() == 24
    assert J.resample_train(features, "none") is features
