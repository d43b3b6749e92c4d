"""The query catalogue over the driver tables: one callable per operator.

Corpora built from the tables:

* binary    - documents with a quality label;
* six-class - documents, label from the source number modulo 6;
* numeric   - lineitem measures by return flag (no row key);
* orders    - lineitem summed per order, keyed by order;
* vectors   - embeddings, every fifth one a query.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from functools import lru_cache

from pyspark.ml import Pipeline
from pyspark.ml.feature import MaxAbsScaler, VectorAssembler
import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpuslens.functions import text as X
from corpuslens.operators import attribution as A, ensemble as V, metrics as E, relational as P
from corpuslens.operators.encode import encode_fixed, token_vocabulary
from corpuslens.operators.features import (
    drop_missing,
    linguistic_features,
    pos_counts,
    readability_scores,
    rename_reorder,
    with_counts,
    with_tokens,
)
from corpuslens.operators.grid import grid_rank, grid_search, preset_table
from corpuslens.operators.kernels import gamma_scale, kernel_table
from corpuslens.operators.lookup import lookup_join
from corpuslens.operators.neighbors import ann_topk, cosine_topk, knn_label, probe_for, recall_share
from corpuslens.operators.quantised import QuantisedIndex
from corpuslens.operators.resample import class_weights, smote, under_sample
from corpuslens.operators.scaling import fit_max_abs, max_abs_terms, min_max
from corpuslens.operators.selection import chi2_scores, chi2_terms, select_k_best
from corpuslens.operators.splits import (
    random_split3,
    split_counts,
    split_table,
    stratified_kfold,
    stratified_split,
)
from corpuslens.operators.svd import fit_svd
from corpuslens.operators.svm import SvmSpec
from corpuslens.operators.tfidf import fit_tfidf, fit_tfidf_vectors
from corpuslens.plans import jobs as J
from corpuslens.schema import FEATURES, ID, LABEL, TRUTH_LABELS
from corpuslens.session import spread, stage, stage_dir
from corpuslens.sources.files import (
    DatasetRegistry,
    fit_or_load,
    read_articles,
    read_features,
    read_statements,
    read_tree,
    write_features,
)
from corpuslens.sources.vectors import VectorCollection, upsert_vectors

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ORDER_FEATURES = ["n_lines", "sum_qty", "sum_price", "sum_discount", "sum_tax"]
ORDER_WEIGHTS = {
    "n_lines": 0.5,
    "sum_qty": -0.02,
    "sum_price": 0.00001,
    "sum_discount": 1.5,
    "sum_tax": -2.0,
}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r(value: Column | str, digits: int = 6) -> Column:
    """Rounded by plain double arithmetic, which is the same in every engine."""
    value = F.col(value) if isinstance(value, str) else value
    scale = float(10**digits)
    return F.floor(value.cast("double") * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


# --- corpora --------------------------------------------------------------------------


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf, f"{name}.parquet"))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"), ID)


def binary(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select(ID, "text", "n_chars")
    return docs.join(table(spark, sf, "labels").withColumnRenamed("quality", LABEL), ID)


def six_class(spark: SparkSession, sf: str) -> DataFrame:
    label = F.expr("int(int(substr(source, 4)) % 6)")
    return documents(spark, sf).select(ID, "text", "n_chars", label.alias(LABEL))


def six_labels(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """The six-class labels without the texts, straight from the scan."""
    label = F.expr("int(int(substr(source, 4)) % 6)")
    return table(spark, sf, "documents").select(ID, *columns, label.alias(LABEL))


def binary_labels(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").select(ID, F.col("quality").alias(LABEL))
    return table(spark, sf, "documents").select(ID).join(labels, ID)


def content(df: DataFrame) -> DataFrame:
    """Content text in place of the raw text."""
    return df.select(ID, LABEL, X.content_text(X.tokens(F.col("text"))).alias("text"))


def numeric(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(*MEASURES, F.col("l_returnflag").alias(LABEL))


def orders(spark: SparkSession, sf: str) -> DataFrame:
    lines = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias(ID))
        .agg(
            F.count("*").cast("double").alias("n_lines"),
            F.sum("l_quantity").alias("sum_qty"),
            F.sum("l_extendedprice").alias("sum_price"),
            F.sum("l_discount").alias("sum_discount"),
            F.sum("l_tax").alias("sum_tax"),
        )
    )
    keys = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias(ID),
        F.expr("int(substr(o_orderpriority, 1, 1)) - 1").alias(LABEL),
    )
    return lines.join(keys, ID)


def vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(stored, queries)."""
    rows = table(spark, sf, "embeddings")
    return rows.where("vec_id % 5 <> 0"), rows.where("vec_id % 5 = 0")


def judged(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem with a rule-made prediction of the return flag."""
    rule = (
        F.when(F.col("l_quantity") < 17, "A").when(F.col("l_quantity") < 34, "N").otherwise("R")
    )
    return numeric(spark, sf).withColumn("prediction", rule)


def binary_split(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    corpus = content(binary(spark, sf))
    split = stage(stratified_split(corpus), "split")
    return split.where("split = 'train'").drop("split"), split.where("split = 'test'").drop("split")


def order_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Scaled order features as vectors; label 1 for urgent and high priority."""
    scaled = min_max(stage(orders(spark, sf), "orders"), ORDER_FEATURES)
    return scaled.select(
        ID,
        (F.col(LABEL) <= 1).cast("int").alias(LABEL),
        F.array(*ORDER_FEATURES).alias("features"),
    )


def scratch(spark: SparkSession, name: str) -> str:
    return os.path.join(stage_dir(spark), f"{name}-{uuid.uuid4().hex}")


# --- text -----------------------------------------------------------------------------


@query
def clean_tokens(spark, sf):
    docs = documents(spark, sf).withColumn("clean", X.clean_text(F.col("text")))
    return docs.select(ID, "clean", F.size(X.tokens_of_clean(F.col("clean"))).alias("n_tokens"))


@query
def content_text(spark, sf):
    return with_tokens(documents(spark, sf)).select(
        ID, X.content_text(F.col("tokens")).alias("content")
    )


@query
def stopword_counts(spark, sf):
    return with_tokens(documents(spark, sf)).select(
        ID, X.stopword_count(F.col("tokens")).alias("stopword_count")
    )


@query
def word_sentence_syllable_counts(spark, sf):
    return with_counts(documents(spark, sf)).select(
        ID, "words", "sentences", "syllables", "polysyllables", "monosyllables"
    )


def _readability(name: str) -> Query:
    def run(spark, sf):
        counted = with_counts(documents(spark, sf))
        return counted.select(ID, r(readability_scores()[name]).alias(name))

    return run


for _name in (
    "flesch_reading_ease",
    "flesch_kincaid_grade_level",
    "gunning_fog_scale",
    "coleman_liau_index",
    "linsear_write_formula",
    "dale_chall_readability",
    "mcalpine_eflaw_readability",
    "reading_time",
):
    QUERIES[_name] = _readability(_name)


@query
def part_of_speech_counts(spark, sf):
    return pos_counts(documents(spark, sf)).drop("present_tense_count", "past_tense_count")


@query
def tense_counts(spark, sf):
    return pos_counts(documents(spark, sf)).select(ID, "present_tense_count", "past_tense_count")


@query
def lexicon_table_counts(spark, sf):
    """Tags from a (word, tag) table: here the words of the benchmark, all as adjectives."""
    lexicon = (
        table(spark, sf, "benchmark")
        .select(F.explode(X.tokens(F.col("text"))).alias("word"))
        .select("word", F.lit("JJ").alias("tag"))
        .distinct()
    )
    return pos_counts(documents(spark, sf), lexicon=lexicon)


def _rounded_features(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(ID, *keep, "text", *[r(c).alias(c) for c in FEATURES], LABEL)


@query
def linguistic_features_raw(spark, sf):
    return _rounded_features(linguistic_features(six_class(spark, sf)))


@query
def linguistic_features_scaled(spark, sf):
    return _rounded_features(J.feature_job(six_class(spark, sf)))


@query
def fixed_length_encoding(spark, sf):
    docs = documents(spark, sf)
    encoded = encode_fixed(docs, stage(token_vocabulary(docs), "vocab"))
    return encoded.select(
        ID,
        F.array_join("input_ids", " ").alias("input_ids"),
        F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_used"),
    )


@query
def token_vocabulary_table(spark, sf):
    return token_vocabulary(documents(spark, sf))


# --- projections, filters, unions, joins, samples ---------------------------------------


@query
def features_label(spark, sf):
    block, label = P.features_label(orders(spark, sf), ORDER_FEATURES)
    return block.join(label, ID).select(ID, r("sum_price", 4).alias("sum_price"), "n_lines", LABEL)


@query
def linguistic_set(spark, sf):
    numbers = P.linguistic_set(linguistic_features(six_class(spark, sf)))
    return numbers.select(ID, *[r(c).alias(c) for c in FEATURES], LABEL)


@query
def drop_missing_rows(spark, sf):
    docs = content(six_class(spark, sf))
    holes = docs.withColumn("text", F.when(F.col(ID) % 7 != 0, F.col("text")))
    return drop_missing(stage(holes, "holes")).select(ID, LABEL, F.length("text").alias("n"))


@query
def label_map(spark, sf):
    names = F.array(*[F.lit(n) for n in TRUTH_LABELS])
    named = six_labels(spark, sf).withColumn("name", F.get(names, F.col(LABEL)))
    return named.select(ID, "name", P.map_label(F.col("name")).alias("code"))


@query
def one_hot(spark, sf):
    return P.one_hot(six_labels(spark, sf), TRUTH_LABELS)


@query
def by_class(spark, sf):
    return P.by_class(six_labels(spark, sf, "n_chars"), 4)


@query
def by_class_stats(spark, sf):
    stats = P.class_stats(numeric(spark, sf), MEASURES)
    return stats.select(LABEL, "n", *[r(c).alias(c) for c in stats.columns if c not in (LABEL, "n")])


@query
def feature_points(spark, sf):
    features = linguistic_features(six_class(spark, sf))
    return P.feature_points(features, "adjective_count", "lexicon_count", "conjunction_count")


@query
def holdout_union(spark, sf):
    split = random_split3(six_labels(spark, sf))
    test, valid = (split.where(F.col("split") == s) for s in ("test", "validation"))
    return P.union_holdout(test, valid)


@query
def attach_features(spark, sf):
    left = table(spark, sf, "documents").select(ID, "n_chars")
    return P.attach(left, table(spark, sf, "labels"))


@query
def sample_n(spark, sf):
    return P.sample_n(six_labels(spark, sf), 100)


@query
def head_n(spark, sf):
    return P.head_n(six_labels(spark, sf), 50)


@query
def rename_reorder_columns(spark, sf):
    table23 = rename_reorder(linguistic_features(binary(spark, sf)))
    return table23.select(*[r(c).alias(c) if c in FEATURES else c for c in table23.columns])


@query
def shape_report(spark, sf):
    split = random_split3(six_labels(spark, sf))
    return P.shape_report(
        train=split.where("split = 'train'").drop("split"),
        test=split.where("split = 'test'").drop("split"),
    )


# --- splits and folds -------------------------------------------------------------------


@query
def stratified_train_test(spark, sf):
    return stratified_split(six_labels(spark, sf))


@query
def random_split_80_10_10(spark, sf):
    return random_split3(table(spark, sf, "documents").select(ID))


@query
def random_split_70_15_15(spark, sf):
    return random_split3(table(spark, sf, "documents").select(ID), 0.3)


@query
def random_split_approximate(spark, sf):
    return random_split3(table(spark, sf, "documents").select(ID), exact=False)


@query
def stratified_folds(spark, sf):
    return stratified_kfold(binary_labels(spark, sf))


@query
def split_label_counts(spark, sf):
    return split_counts(stratified_split(binary_labels(spark, sf)))


@query
def split_dictionary(spark, sf):
    split = random_split3(six_labels(spark, sf), 0.3)
    parts = [split.where(F.col("split") == s).drop("split") for s in ("train", "test", "validation")]
    return split_table(*parts)


# --- resampling -------------------------------------------------------------------------


@query
def under_sampled(spark, sf):
    return under_sample(binary_labels(spark, sf))


@query
def class_weighted(spark, sf):
    weighted = class_weights(six_labels(spark, sf))
    return weighted.withColumn("weight", r("weight"))


@query
def label_distribution(spark, sf):
    return E.label_distribution(binary_labels(spark, sf))


@query
def smote_2d(spark, sf):
    spaces = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))
    point = F.array(F.col("n_chars").cast("double"), spaces.cast("double"))
    grown = smote(binary(spark, sf).select(ID, LABEL, point.alias("features")))
    return grown.select(
        ID, LABEL, r(F.col("features")[0]).alias("x"), r(F.col("features")[1]).alias("y"), "synthetic"
    )


@query
def smote_vectors(spark, sf):
    """Over-sampling of embeddings: rows per class, and whether new points lie between old ones.

    A point between two rows of a class is never farther from the origin than the farther one.
    """
    rows = table(spark, sf, "embeddings")
    grown = smote(rows, "embedding", id_col="vec_id")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    sides = grown.groupBy(LABEL, "synthetic").agg(F.count("*").alias("n"), F.max(norm).alias("far"))
    reach = sides.where(~F.col("synthetic")).select(LABEL, F.col("far").alias("reach"))
    return sides.join(reach, LABEL).select(
        LABEL, "synthetic", "n", (F.col("far") <= F.col("reach") + 1e-9).alias("inside")
    )


# --- feature transforms -----------------------------------------------------------------


@query
def min_max_numeric(spark, sf):
    scaled = min_max(orders(spark, sf), ORDER_FEATURES)
    return scaled.select(ID, *[r(c).alias(c) for c in ORDER_FEATURES], LABEL)


@query
def max_abs_numeric(spark, sf):
    rows = orders(spark, sf)
    train, test = rows.where(f"{ID} % 5 <> 0"), rows.where(f"{ID} % 5 = 0")
    scaled = fit_max_abs(train, ORDER_FEATURES).transform(test)
    return scaled.select(ID, *[r(c).alias(c) for c in ORDER_FEATURES])


def _tfidf(spark, sf, **args) -> DataFrame:
    corpus = content(binary(spark, sf))
    return fit_tfidf(corpus, **args).transform(corpus)


@query
def tfidf(spark, sf):
    return _tfidf(spark, sf).select(ID, "term", r("value").alias("value"))


@query
def tfidf_bigram(spark, sf):
    return _tfidf(spark, sf, ngram_range=(1, 2), min_df=0.01).select(ID, "term", r("value").alias("value"))


@query
def tfidf_min_df(spark, sf):
    return _tfidf(spark, sf, min_df=0.01).select(ID, "term", r("value").alias("value"))


@query
def tfidf_max_abs(spark, sf):
    scaled = max_abs_terms(_tfidf(spark, sf, min_df=0.01))
    return scaled.select(ID, "term", r("value").alias("value"))


@query
def tfidf_train_test(spark, sf):
    """Fitted on four fifths, applied to the rest: unseen terms are dropped."""
    corpus = content(binary(spark, sf))
    model = fit_tfidf(corpus.where(f"{ID} % 5 <> 0"), min_df=0.01)
    return model.transform(corpus.where(f"{ID} % 5 = 0")).select(ID, "term", r("value").alias("value"))


@query
def vocabulary(spark, sf):
    return fit_tfidf(content(binary(spark, sf)), min_df=0.01).feature_names()


@query
def feature_set(spark, sf):
    """Both feature sets by name, as the shapes of their train and test sides."""
    train, test = (
        drop_missing(stage(linguistic_features(part), "processed"))
        for part in (
            binary(spark, sf).where(f"{ID} % 5 <> 0"),
            binary(spark, sf).where(f"{ID} % 5 = 0"),
        )
    )
    out = None
    for name in ("tfidf", "linguistic"):
        features = J.feature_set(name, train, test)
        for side, rows in (("train", features.train), ("test", features.test)):
            part = rows.agg(F.count("*").alias("n_rows")).select(
                F.lit(name).alias("name"),
                F.lit(side).alias("side"),
                "n_rows",
                F.lit(len(features.names)).cast("bigint").alias("n_features"),
            )
            out = part if out is None else out.unionByName(part)
    return out


@query
def chi2_numeric(spark, sf):
    scores = chi2_scores(numeric(spark, sf), MEASURES)
    return scores.select("feature", "idx", r("score", 4).alias("score"))


@query
def chi2_terms_table(spark, sf):
    corpus = content(binary(spark, sf))
    values = fit_tfidf(corpus, min_df=0.01)
    long = values.transform(corpus, keep=(LABEL,))
    names = values.feature_names().join(values.vocabulary.select("term", "docs"), "term")
    long = lookup_join(long, names, "term", weight="docs", how="inner")
    sizes = corpus.groupBy(LABEL).agg(F.count("*").alias("n"))
    scores = chi2_terms(long, sizes)
    return scores.select("feature", "idx", r("score").alias("score"))


@query
def select_k_best_features(spark, sf):
    processed = J.feature_job(binary(spark, sf))
    best = select_k_best(chi2_scores(P.linguistic_set(processed), FEATURES), 10)
    return best.select("feature", "idx", r("score").alias("score"))


@query
def svd_projection(spark, sf):
    """Checks over the projected rows: a column's energy is its singular value squared."""
    corpus = content(binary(spark, sf))
    rows = stage(fit_tfidf_vectors(corpus).transform(corpus), "tfidf")
    model = fit_svd(rows, 100)
    width = len(model.singular_values)
    svd = stage(model.project(rows).select(ID, "svd"), "svd")
    square = F.struct(*[F.sum(F.col("svd")[i] * F.col("svd")[i]).alias(f"e{i}") for i in range(width)])
    energy = F.array(*[F.col(f"_e.e{i}") for i in range(width)])
    wanted = F.array(*[F.lit(float(s * s)) for s in model.singular_values])
    near = F.forall(F.zip_with(energy, wanted, lambda e, w: F.abs(e - w) <= 1e-6 * (w + 1)), lambda x: x)
    falling = F.forall(F.sequence(F.lit(1), F.lit(width - 1)), lambda i: F.get(energy, i) <= F.get(energy, i - 1) + 1e-6)
    drift = np.abs(model.components.T @ model.components - np.eye(width)).max()
    top = model.components[np.abs(model.components).argmax(axis=0), np.arange(width)].min()
    return svd.agg(F.count("*").alias("n"), F.max(F.size("svd")).alias("width"), square.alias("_e")).select(
        "n",
        "width",
        near.alias("energy_is_singular_value"),
        falling.alias("falling"),
        (F.lit(float(drift)) < 1e-8).alias("orthonormal"),
        (F.lit(float(top)) > 0).alias("largest_entry_positive"),
    )


# --- kernels ----------------------------------------------------------------------------


def _kernel(kind: str, gamma: float) -> Query:
    def run(spark, sf):
        stored, queries = vectors(spark, sf)
        marks = P.sample_n(stored, 20, id_col="vec_id")
        values = kernel_table(queries, marks, kind, gamma, "embedding", "vec_id")
        return values.select("vec_id", "landmark", r("value").alias("value"))

    return run


QUERIES["kernel_table_rbf"] = _kernel("rbf", 0.1)
QUERIES["kernel_table_sigmoid"] = _kernel("sigmoid", 0.1)
QUERIES["kernel_table_poly"] = _kernel("poly", 0.1)


@query
def kernel_gamma_scale(spark, sf):
    return gamma_scale(table(spark, sf, "embeddings"), "embedding").select(r("gamma").alias("gamma"))


# --- models -----------------------------------------------------------------------------


def _scored(model, features) -> DataFrame:
    reports = [
        E.class_report(stage(model.transform(side).select(LABEL, "prediction"), "scored"))
        for side in (features.test, features.train)
    ]
    return _sound(*reports)


def _sound(report: DataFrame, trained: DataFrame) -> DataFrame:
    """What a trained model's class report must show: the support of each line, scores from 0 to 1.

    And, on the rows it was trained on, a mean recall above that of a model that answers with
    one class only, on the line of the means.
    """
    lines = trained.where("support > 0 AND line NOT IN ('accuracy', 'macro avg', 'weighted avg')").count()
    learned = trained.where("line = 'macro avg'").first().recall > 1.0 / lines + 0.02
    scores = F.array("precision", "recall", "f1")
    sound = F.forall(scores, lambda s: (s >= 0) & (s <= 1)) & ((F.col("line") != "macro avg") | F.lit(learned))
    return report.select("line", "support", sound.alias("sound"))


def _reduced(spark, sf, how: str = "none") -> J.FeatureSet:
    """TF-IDF of the two-class corpus in 100 components; `how`: over-sampled, as the studies train."""
    return _reduced_once(spark, spark.sparkContext.applicationId, sf, how)


@lru_cache(maxsize=8)
def _reduced_once(spark, application: str, sf: str, how: str) -> J.FeatureSet:
    """The queries of one session that train on these stored features share them."""
    if how != "none":
        return J.resample_train(_reduced_once(spark, application, sf, "none"), how)
    return J.reduce_set(J.tfidf_set(*binary_split(spark, sf)))


@query
def linear_svm(spark, sf):
    train, test = binary_split(spark, sf)
    features = J.tfidf_set(train, test)
    return _scored(SvmSpec().fit(features.train), features)


def _embedding_sides(spark, sf) -> tuple[DataFrame, DataFrame]:
    stored, queries = vectors(spark, sf)
    return tuple(
        stage(rows.select(F.col("vec_id").alias(ID), LABEL, F.col("embedding").alias("features")), "emb")
        for rows in (stored, queries)
    )


@query
def linear_svm_multiclass(spark, sf):
    """Ten classes, one model per class."""
    train, test = _embedding_sides(spark, sf)
    return _scored(SvmSpec().fit(train), J.FeatureSet(train, test, []))


@query
def linear_svm_pairs(spark, sf):
    """Ten classes, one model per pair of classes and their vote."""
    train, test = _embedding_sides(spark, sf)
    return _scored(SvmSpec(multiclass="ovo").fit(train), J.FeatureSet(train, test, []))


def _kernel_svm(spec: SvmSpec) -> Query:
    def run(spark, sf):
        features = _reduced(spark, sf, "oversample")
        return _scored(spec.fit(features.train), features)

    return run


QUERIES["kernel_svm_rbf"] = _kernel_svm(SvmSpec(kernel="rbf", C=10.0))
QUERIES["kernel_svm_sigmoid"] = _kernel_svm(SvmSpec(kernel="sigmoid", C=1000.0, gamma=0.01))
QUERIES["kernel_svm_poly"] = _kernel_svm(SvmSpec(kernel="poly", C=10.0))


@query
def calibrated_probabilities(spark, sf):
    """Checks over the scored rows: probabilities sum to 1 and are one logistic curve of the margin."""
    rows = stage(order_vectors(spark, sf), "train")
    model = SvmSpec(probability=True).fit(rows)
    scored = stage(model.transform(rows).select(F.col("margins")[1].alias("m"), "probability"), "scored")
    p, q = F.col("probability")[1], F.col("probability")[0]
    return scored.agg(
        F.count("*").alias("n"),
        F.bool_and((p >= 0) & (p <= 1) & (F.abs(p + q - 1) < 1e-9)).alias("sums_to_one"),
        # a difference of logarithms: a share of exactly 0 is no division by zero
        (F.abs(F.corr("m", F.log(p) - F.log(q))) > 0.999999).alias("logistic_in_margin"),
    )


@query
def logistic_on_embeddings(spark, sf):
    """The default final estimator on vectors of its own."""
    from pyspark.ml.functions import array_to_vector

    train, test = (
        rows.withColumn("meta", array_to_vector(F.col("features").cast("array<double>")))
        for rows in _embedding_sides(spark, sf)
    )
    classes = sorted(row[LABEL] for row in train.select(LABEL).distinct().collect())
    model = V.logistic_final(train, classes)
    return model.transform(test).select(
        ID, LABEL, F.col("prediction").cast("int").between(0, len(classes) - 1).alias("known_class")
    )


@query
def grid_search_scores(spark, sf):
    """All 108 points in five folds; the best point beats a model of one class in every fold's mean."""
    scores = stage(grid_search(_reduced(spark, sf, "oversample").train), "grid")
    best = scores.groupBy("grid_idx").agg(F.avg("f1_macro").alias("f1")).agg(F.max("f1")).first()[0]
    in_range = F.col("accuracy").between(0, 1) & F.col("f1_macro").between(0, 1) & F.lit(best > 0.5)
    return scores.select("grid_idx", "C", "gamma", "kernel", "fold", in_range.alias("in_range"))


@query
def grid_rank_table(spark, sf):
    rows = table(spark, sf, "orders")
    hit = F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)
    scores = rows.groupBy(
        F.expr("int(o_custkey % 18)").alias("grid_idx"), F.expr("int(o_orderkey % 5)").alias("fold")
    ).agg(F.round(F.avg(hit), 2).alias("accuracy"))
    ranked = grid_rank(scores.withColumn("accuracy", F.floor(F.col("accuracy") * 100)), "accuracy")
    return ranked.select("grid_idx", r("mean_score").alias("mean_score"), "place")


@query
def preset_parameters(spark, sf):
    """Tuned parameters for each language part of the corpus, by data set name."""
    name = (
        F.when(F.col("lang") == "en", "liar_dataset")
        .when(F.col("lang") == "fr", "isot_titles_dataset")
        .when(F.col("lang") == "de", "isot_texts_dataset")
        .otherwise("default")
    )
    parts = (
        table(spark, sf, "documents")
        .groupBy("lang")
        .agg(F.count("*").alias("n"))
        .withColumn("dataset", name)
    )
    return parts.join(F.broadcast(preset_table(spark)), "dataset")


def _votes(spark, sf) -> DataFrame:
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias(ID), "o_custkey")
    rules = [f"{ID} % 3", "o_custkey % 3", f"({ID} + o_custkey) % 3"]
    votes = F.array(*[F.struct(F.lit(f"m{i}").alias("model"), F.expr(f"int({e})").alias("prediction")) for i, e in enumerate(rules)])
    return rows.select(ID, F.explode(votes).alias("v")).select(ID, "v.*")


@query
def vote_hard(spark, sf):
    return V.vote_hard(_votes(spark, sf))


@query
def vote_soft(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias(ID), "o_custkey")
    shares = [f"(({ID} * 7 + o_custkey * {m}) % 11) / 10.0D" for m in (1, 3, 5)]
    cells = [
        F.struct(
            F.lit(f"m{i}").alias("model"),
            F.lit(c).alias("class"),
            F.expr(e if c == 1 else f"1.0D - {e}").alias("probability"),
        )
        for i, e in enumerate(shares)
        for c in (0, 1)
    ]
    long = rows.select(ID, F.explode(F.array(*cells)).alias("v")).select(ID, "v.*")
    out = V.vote_soft(long)
    return out.withColumn("probability", r("probability"))


def _stack(final: str) -> Query:
    def run(spark, sf):
        features = _reduced(spark, sf, "oversample")
        specs = {k: SvmSpec(kernel=k, C=10.0) for k in ("linear", "rbf", "sigmoid")}
        return _scored(V.fit_stacking(features.train, specs, final), features)

    return run


for _final in ("linear", "rbf", "sigmoid", "none"):
    QUERIES[f"stacking_final_{'logistic' if _final == 'none' else _final}"] = _stack(_final)


@query
def stacking_out_of_fold(spark, sf):
    features = _reduced(spark, sf)
    rows = V.out_of_fold(features.train, {"linear": SvmSpec(probability=True)})
    from pyspark.ml.functions import vector_to_array

    return rows.select(ID, LABEL, "fold", vector_to_array("meta")[0].between(0, 1).alias("in_range"))


@query
def bagging(spark, sf):
    rows = stage(order_vectors(spark, sf), "train")
    model = V.fit_bagging(rows, SvmSpec())
    return model.transform(rows).select(ID, F.col("prediction").isin(0, 1).alias("known_class"))


@query
def adaboost(spark, sf):
    features = _reduced(spark, sf, "oversample")
    return _scored(V.fit_adaboost(features.train, SvmSpec()), features)


@query
def adaboost_step(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias(ID),
        F.expr("int(o_custkey % 5)").alias(LABEL),
        F.expr("int(case when o_orderkey % 3 = 0 then o_orderkey % 5 else o_custkey % 5 end)").alias("prediction"),
        F.lit(1.0).alias("weight"),
    )
    out = V.adaboost_round(rows, LABEL, "prediction", "weight", 5)
    return out.select(ID, r("alpha").alias("alpha"), r(F.col("new_weight") * 1e6, 4).alias("new_weight_e6"))


# --- evaluation -------------------------------------------------------------------------


@query
def accuracy(spark, sf):
    return E.accuracy(judged(spark, sf))


@query
def confusion_matrix(spark, sf):
    return E.confusion_matrix(judged(spark, sf))


@query
def confusion_pivot(spark, sf):
    return E.confusion_pivot(judged(spark, sf), ["A", "N", "R"])


def _rounded_report(report: DataFrame) -> DataFrame:
    return report.select("line", *[r(c).alias(c) for c in ("precision", "recall", "f1")], "support")


@query
def class_report(spark, sf):
    return _rounded_report(E.class_report(judged(spark, sf)))


@query
def f1_macro(spark, sf):
    return E.f1_macro(judged(spark, sf)).select(r("f1_macro").alias("f1_macro"))


def _multilabel(spark, sf) -> DataFrame:
    scores = {
        "s_quality": "(n_chars % 1000) / 250.0D - 2.0D",
        "s_toxic": "(n_chars % 777) / 200.0D - 2.0D",
    }
    rows = table(spark, sf, "documents").select(ID, "n_chars").join(table(spark, sf, "labels"), ID)
    return rows.withColumns({k: F.expr(e) for k, e in scores.items()})


@query
def multilabel_metrics(spark, sf):
    out = E.multilabel_metrics(_multilabel(spark, sf), ["s_quality", "s_toxic"], ["quality", "toxic"])
    return out.select(*[r(c).alias(c) for c in ("f1", "roc_auc", "accuracy")])


@query
def argmax_prediction(spark, sf):
    """One label from several scores, as a sequence classifier predicts."""
    scores = F.array("s_quality", "s_toxic")
    return _multilabel(spark, sf).select(
        ID, V.argmax_label(scores, ["quality", "toxic"]).alias("prediction")
    )


# --- vectors ----------------------------------------------------------------------------


def _versions(spark, sf) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding", LABEL)
    first = rows.withColumn("version", F.lit(1))
    changed = rows.where("vec_id % 3 = 0")
    second = changed.withColumns({LABEL: F.col(LABEL) + 100, "version": F.lit(2)})
    return first, second


@query
def upsert_latest(spark, sf):
    first, second = _versions(spark, sf)
    return upsert_vectors(first, second).select("vec_id", LABEL, "version", r(F.col("embedding")[0]).alias("e0"))


@query
def upsert_collection(spark, sf):
    """The same through a stored collection, written twice and read back."""
    first, second = _versions(spark, sf)
    store = VectorCollection(spark, scratch(spark, "collection"))
    store.upsert(first)
    return store.upsert(second).select("vec_id", LABEL, "version", r(F.col("embedding")[0]).alias("e0"))


def _nearest(spark, sf, k: int, **opts) -> DataFrame:
    stored, queries = vectors(spark, sf)
    found = cosine_topk(queries, stored, k, **opts)
    return found.select("query_id", "rank", "base_id", r("score").alias("score"))


@query
def cosine_top1(spark, sf):
    return _nearest(spark, sf, 1)


@query
def cosine_top5(spark, sf):
    return _nearest(spark, sf, 5)


@query
def cosine_top5_cells(spark, sf):
    """The same search with small cells and blocks, as a large collection is searched."""
    return _nearest(spark, sf, 5, cell_rows=100, block_rows=64)


#: Share of the queries whose nearest vector the approximate search must find.
RECALL = 0.9


def _approximate(queries, stored) -> DataFrame:
    probe = probe_for(queries, stored, RECALL, cell_rows=50)
    return ann_topk(queries, stored, 1, probe=probe, cell_rows=50)


@query
def ann_neighbours(spark, sf):
    """The approximate neighbours themselves."""
    stored, queries = vectors(spark, sf)
    return _approximate(queries, stored).select("query_id", "rank", "base_id", "score")


@query
def ann_recall(spark, sf):
    """Recall of the approximate neighbours against the exact search."""
    stored, queries = vectors(spark, sf)
    found = recall_share(_approximate(queries, stored), cosine_topk(queries, stored, 1))
    return found.select("n", (F.col("recall") >= RECALL).alias("recall_holds"))


@query
def ann_top1(spark, sf):
    """One answer a query; its score is that of its pair and never above the exact best."""
    stored, queries = vectors(spark, sf)
    found = _approximate(queries, stored)
    exact = cosine_topk(queries, stored, 1).select("query_id", F.col("score").alias("best"), F.col("base_id").alias("first"))
    equal = (F.col("base_id") != F.col("first")) | (F.abs(F.col("score") - F.col("best")) < 1e-6)
    right = (F.col("score") <= F.col("best") + 1e-6) & equal
    return found.join(exact, "query_id").select("query_id", "rank", right.alias("right"))


def _shortlisted(stored, queries) -> tuple[QuantisedIndex, DataFrame]:
    index = QuantisedIndex(stored)
    return index, stage(index.candidates(queries, **index.settings_for(queries, RECALL)), "shortlist")


@query
def ann_index_neighbours(spark, sf):
    """Nearest rows by the quantised index, with their exact cosines."""
    stored, queries = vectors(spark, sf)
    index, near = _shortlisted(stored, queries)
    return index.rerank(near, queries).select("query_id", "rank", "base_id", r("score").alias("score"))


@query
def ann_index_recall(spark, sf):
    """Recall of the quantised index against the exact search, and whether under a fifth of the pairs was scored."""
    stored, queries = vectors(spark, sf)
    index, near = _shortlisted(stored, queries)
    scored = near.count()
    found = recall_share(index.rerank(near, queries), cosine_topk(queries, stored, 1))
    few = F.lit(scored) < 0.2 * index.n * F.col("n")
    return found.select("n", (F.col("recall") >= RECALL).alias("recall_holds"), few.alias("few_scored"))


@query
def knn_labels(spark, sf):
    stored, queries = vectors(spark, sf)
    return knn_label(queries, stored).select("vec_id", LABEL, "prediction")


@query
def knn_confusion(spark, sf):
    stored, queries = vectors(spark, sf)
    return J.knn_experiment(stored, queries)["confusion"]


# --- attributions -----------------------------------------------------------------------


def _phi(spark, sf) -> DataFrame:
    """Attributions of the linear order score for class 1, and their negatives for class 0."""
    long = A.linear_shap(stage(orders(spark, sf), "orders"), ORDER_WEIGHTS)
    sides = F.array(
        F.struct(F.lit(0).alias("class"), (-F.col("phi")).alias("phi")),
        F.struct(F.lit(1).alias("class"), F.col("phi").alias("phi")),
    )
    return long.select(ID, "feature", "value", F.explode(sides).alias("s")).select(ID, "feature", "value", "s.*")


@query
def linear_shap(spark, sf):
    long = A.linear_shap(stage(orders(spark, sf), "orders"), ORDER_WEIGHTS)
    return long.select(ID, "feature", r("phi", 4).alias("phi"))


@query
def shap_summary(spark, sf):
    out = A.shap_summary(_phi(spark, sf), per_class=True)
    return out.select("class", "feature", r("importance", 4).alias("importance"), "place")


@query
def shap_points(spark, sf):
    phi = _phi(spark, sf)
    values = phi.where("class = 1").select(ID, "feature", "value")
    out = A.shap_points(phi.drop("value"), values)
    return out.select(ID, "class", "feature", r("value", 4).alias("value"), r("phi", 4).alias("phi"))


@query
def decision_path(spark, sf):
    out = A.decision_path(_phi(spark, sf), base=0.5)
    return out.select(ID, "class", "feature", r("running", 4).alias("running"))


@query
def kernel_shap(spark, sf):
    """Attributions of whole vectors add up to the model's own log odds of the row."""
    rows = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias(ID),
        (F.col(LABEL) < 5).cast("int").alias(LABEL),
        F.col("embedding").cast("array<double>").alias("features"),
    )
    rows = stage(rows, "embeddings")
    model = SvmSpec(kernel="rbf", probability=True).fit(rows)
    explained = P.sample_n(rows, 20)
    phi = A.kernel_shap(model.transform, explained, P.sample_n(rows, 10, seed=7))
    whole = phi.groupBy(ID, "class").agg(
        F.count("*").alias("features"), (F.max("base") + F.sum("phi")).alias("total")
    )
    odds = model.transform(explained).select(ID, F.posexplode("probability").alias("class", "p"))
    near = F.abs(F.col("total") - F.log(F.col("p") / (1 - F.col("p")))) < 1e-6
    return whole.join(odds, [ID, "class"]).select(ID, "class", "features", near.alias("adds_up"))


# --- sources ----------------------------------------------------------------------------

CSV_OUT = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _write_articles(spark, sf) -> str:
    folder = scratch(spark, "articles")
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), ID)
    for name, label in (("Fake.csv", 1), ("True.csv", 0)):
        part = rows.where(F.col("quality") == label).select(F.col("source").alias("title"), "text")
        part.write.options(header=True, **CSV_OUT).csv(os.path.join(folder, name))
    return folder


@query
def file_label(spark, sf):
    articles = read_articles(spark, _write_articles(spark, sf))
    squeezed = F.regexp_replace("text", r"[\r\n]+", " ")
    return articles.select("part", LABEL, F.md5(squeezed).alias("digest"))


@query
def file_tree(spark, sf):
    """Lines of the .csv files in two levels of folders, next to files of another kind."""
    folder = scratch(spark, "tree")
    rows = table(spark, sf, "labels")
    for place, part in (("a", rows.where("quality = 0")), ("b/deeper", rows.where("quality = 1"))):
        part.select(ID, "quality").write.csv(os.path.join(folder, place))
    rows.select(F.col(ID).cast("string")).write.text(os.path.join(folder, "notes"))
    return read_tree(spark, folder, ".csv").select("value", F.col("file_name").endswith(".csv").alias("is_csv"))


def _write_statements(spark, sf) -> str:
    folder = scratch(spark, "statements")
    names = F.array(*[F.lit(n) for n in TRUTH_LABELS])
    split = random_split3(six_class(spark, sf).select(ID, "text", LABEL))
    rows = split.select(
        F.col(ID).cast("string").alias("id"),
        F.get(names, F.col(LABEL)).alias("label"),
        F.col("text").alias("statement"),
        *[F.lit("x").alias(c) for c in ("subjects", "speaker", "job", "state", "party")],
        *[F.lit(i).alias(f"c{i}") for i in range(5)],
        F.lit("y").alias("context"),
        "split",
    )
    for name, part in (("train", "train"), ("test", "test"), ("valid", "validation")):
        chosen = rows.where(F.col("split") == part).drop("split")
        path = os.path.join(folder, f"{name}.tsv")
        chosen.write.options(sep="\t", extension="tsv", **CSV_OUT).csv(path)
    return folder


@query
def statements_roundtrip(spark, sf):
    rows = read_statements(spark, _write_statements(spark, sf))
    squeezed = F.regexp_replace("statement", r"[\r\n]+", " ")
    return rows.select("id", "split", LABEL, F.md5(squeezed).alias("digest"))


@query
def features_roundtrip(spark, sf):
    path = scratch(spark, "processed")
    corpus = stratified_split(six_class(spark, sf))
    J.feature_job(corpus, split="split", path=path)
    back = read_features(spark, path, extra=f"{ID} BIGINT, split STRING")
    return back.select(ID, "split", LABEL, *[r(c).alias(c) for c in FEATURES])


@query
def features_scaled_per_split(spark, sf):
    corpus = stratified_split(six_class(spark, sf))
    scaled = J.feature_job(corpus, split="split", fit_per_split=True)
    return scaled.select(ID, "split", LABEL, *[r(c).alias(c) for c in FEATURES])


@query
def feature_job(spark, sf):
    """Raw article files to two scaled corpora, titles and bodies, each with its own range."""
    articles = read_articles(spark, _write_articles(spark, sf))
    scaled = J.feature_job(articles, split="part", fit_per_split=True)
    return scaled.select("part", LABEL, F.md5("text").alias("digest"), *[r(c).alias(c) for c in FEATURES])


@query
def features_csv_roundtrip(spark, sf):
    path = scratch(spark, "processed-csv")
    write_features(rename_reorder(linguistic_features(binary(spark, sf))), path, "csv")
    back = read_features(spark, path, "csv")
    return back.select(F.md5("text").alias("digest"), LABEL, *[r(c).alias(c) for c in FEATURES])


@query
def dataset_registry(spark, sf):
    registry = DatasetRegistry(
        {"binary": lambda: binary(spark, sf), "six_class": lambda: six_class(spark, sf)},
        default="six_class",
    )
    named = registry.load("binary").agg(F.count("*").alias("n"))
    other = registry.load("unknown").agg(F.count("*").alias("n"))
    return named.select(F.lit("binary").alias("name"), "n").unionByName(
        other.select(F.lit("unknown").alias("name"), "n")
    )


@query
def model_reload(spark, sf):
    """A scaler pipeline fitted, stored, loaded and applied."""
    rows = orders(spark, sf)
    path = scratch(spark, "model")
    pipeline = Pipeline(
        stages=[
            VectorAssembler(inputCols=ORDER_FEATURES, outputCol="v"),
            MaxAbsScaler(inputCol="v", outputCol="scaled"),
        ]
    )
    fit_or_load(path, pipeline, rows)
    loaded = fit_or_load(path, pipeline, rows)
    from pyspark.ml.functions import vector_to_array

    scaled = loaded.transform(rows).withColumn("s", vector_to_array("scaled"))
    return scaled.select(ID, *[r(F.col("s")[i]).alias(c) for i, c in enumerate(ORDER_FEATURES)])


# --- studies ----------------------------------------------------------------------------


@query
def selection_job(spark, sf):
    processed = J.feature_job(six_class(spark, sf))
    best = J.selection_job(processed, 3)["selected"]
    return best.select("feature", "idx", r("score").alias("score"))


@query
def selection_classes(spark, sf):
    processed = J.feature_job(six_class(spark, sf))
    stats = J.selection_job(processed, 3)["classes"]
    return stats.select(LABEL, "n", *[r(c, 9).alias(c) for c in stats.columns if c not in (LABEL, "n")])


@query
def knn_experiment(spark, sf):
    """The stored side goes through a collection on disk."""
    stored, queries = vectors(spark, sf)
    return J.knn_experiment(stored, queries, folder=scratch(spark, "knn-store"))["accuracy"]


@query
def multilabel_experiment(spark, sf):
    """Quality and toxicity by one classifier each: rows of the held-out splits, and metrics in range.

    On the training split, exact matches are no rarer than for a model of the most frequent combination.
    """
    rows = documents(spark, sf).select(ID, "text").join(table(spark, sf, "labels"), ID)
    rows = stage(rows.where("quality IS NOT NULL AND toxic IS NOT NULL"), "multilabel")
    tables = J.multilabel_experiment(rows, ["quality", "toxic"])
    combinations = tables["train_scores"].groupBy("quality", "toxic").count()
    most = combinations.agg(F.max("count") / F.sum("count")).first()[0]
    learned = tables["train"].first().accuracy >= most
    out = None
    for part in ("test", "validation"):
        found = tables[part].first()
        sound = learned and all(0 <= found[c] <= 1 for c in ("f1", "roc_auc", "accuracy"))
        line = tables[f"{part}_scores"].agg(F.lit(part).alias("part"), F.count("*").alias("n"), F.lit(sound).alias("sound"))
        out = line if out is None else out.unionByName(line)
    return out


@query
def multilabel_job(spark, sf):
    encoded = J.multilabel_job(binary(spark, sf), {"real": 0, "fake": 1})
    return encoded.select(
        ID,
        "split",
        F.array_join("input_ids", " ").alias("input_ids"),
        F.array_join(F.col("labels").cast("array<int>"), " ").alias("labels"),
    )


@query
def grid_experiment(spark, sf):
    """The whole single-model study: 108 points, five folds, 100 components."""
    train, test = binary_split(spark, sf)
    tables = J.grid_experiment(train, test, svd_k=100)
    out = None
    for metric in ("accuracy", "f1_macro"):
        report = _sound(tables[f"{metric}_report"], tables[f"{metric}_train_report"])
        part = report.withColumn("metric", F.lit(metric))
        out = part if out is None else out.unionByName(part)
    return out


@query
def ensemble_experiment(spark, sf):
    """The voting study with attributions of 10 rows against 10: each class ranks every feature once."""
    train, test = binary_split(spark, sf)
    tables = J.ensemble_experiment(
        train,
        test,
        dataset="isot_texts_dataset",
        ensemble="voting",
        folder=scratch(spark, "ensembles"),
        n_coalitions=60,
    )
    summary = stage(tables["shap_class_summary"], "summary")
    return summary.groupBy("class").agg(
        (F.countDistinct("feature") == F.count("*")).alias("each_once"),
        (F.max("place") == F.count("*")).alias("ranked"),
        F.bool_and(F.col("importance") >= 0).alias("sound"),
    )


@query
def voting_experiment_hard(spark, sf):
    train, test = binary_split(spark, sf)
    tables = J.voting_experiment(train, test, "hard", svd_k=100)
    return _sound(tables["report"], tables["train_report"])


@query
def voting_experiment_soft(spark, sf):
    train, test = binary_split(spark, sf)
    tables = J.voting_experiment(train, test, "soft", C=100.0, gamma=0.01, svd_k=100)
    return _sound(tables["report"], tables["train_report"])
