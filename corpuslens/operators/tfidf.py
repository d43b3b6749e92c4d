"""TF-IDF in long form `(doc_id, term, value)` and as sparse vectors for the learners.

Value of a term: raw count * (ln((1 + n) / (1 + df)) + 1), then unit length per
document. MLlib's own IDF uses another formula, so only its counting and
normalising stages are used for the vector form.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, MaxAbsScaler, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from corpuslens.functions.text import ngrams
from corpuslens.operators.lookup import BROADCAST_ROWS, list_sizes, lookup_join
from corpuslens.operators.ranking import ordered_rank
from corpuslens.schema import ID
from corpuslens.session import stage

MAX_VECTOR_TERMS = 200_000
#: Documents whose terms are looked up at once.
SLICE_ROWS = 1024


def terms(text: Column, low: int = 1, high: int = 1) -> Column:
    """Lower-case terms of two or more characters of a cleaned text, as n-grams."""
    words = F.filter(F.split(F.lower(text), " "), lambda t: F.length(t) >= 2)
    return ngrams(words, low, high)


def postings(
    df: DataFrame, text: str = "text", low: int = 1, high: int = 1, id_col: str = ID
) -> DataFrame:
    """`(doc_id, term, tf)`.

    Documents are placed by id once; counting terms and the unit-length step then
    stay inside a partition. A document is the largest group, never a term. (A
    plain `explode` would make Catalyst filter on the size of the array first and
    so tokenise every text twice.)
    """
    placed = df.select(id_col, text).repartition(id_col)
    return (
        placed.select(id_col, F.explode_outer(terms(F.col(text), low, high)).alias("term"))
        .where(F.col("term").isNotNull())
        .groupBy(id_col, "term")
        .agg(F.count("*").alias("tf"))
    )


def _weighed(sent: Broadcast, names: list[str]):
    """The columns `names`, term and value of each different known term of a row's `_terms`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, idf = sent.value
        for batch in batches:
            for low in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(low, SLICE_ROWS)
                lists = part.column("_terms")
                place = pc.fill_null(pc.index_in(lists.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(part.num_rows), list_sizes(lists))
                found = row[place >= 0] * max(1, len(idf)) + place[place >= 0]
                cell, tf = np.unique(found, return_counts=True)
                row, place = np.divmod(cell, max(1, len(idf)))
                weight = tf * idf[place]
                norm = np.sqrt(np.bincount(row, weight * weight, part.num_rows))
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c).take(at) for c in names], known.take(pa.array(place)), pa.array(weight / norm[row])],
                    names=[*names, "term", "value"],
                )

    return run


@dataclass
class TfidfModel:
    vocabulary: DataFrame  # term, docs, idf (a stored table, not a plan)
    n_docs: int
    low: int
    high: int
    id_col: str = ID

    def transform(self, df: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
        """Long form; terms outside the vocabulary are dropped. `keep`: columns of `df` to carry along.

        Where ids are unique and the vocabulary is small enough to send, a document's terms are
        looked up, counted and weighed inside its row, and nothing moves.
        """
        known = self.vocabulary.select("term", "idf").limit(BROADCAST_ROWS + 1).toArrow()
        ids = df.agg(F.count("*").alias("n"), F.count_distinct(self.id_col).alias("d")).first()
        if known.num_rows <= BROADCAST_ROWS and ids.n == ids.d:
            names = [self.id_col, *keep]
            sent = df.sparkSession.sparkContext.broadcast(
                (known.column("term").combine_chunks(), known.column("idf").to_numpy())
            )
            schema = T.StructType([df.schema[c] for c in names]).add("term", "string").add("value", "double")
            found = terms(F.col(text), self.low, self.high).alias("_terms")
            return df.select(*names, found).mapInArrow(_weighed(sent, names), schema)
        if keep:
            return self._joined(df, text).join(df.select(self.id_col, *keep), self.id_col).select(
                self.id_col, *keep, "term", "value"
            )
        return self._joined(df, text)

    def _joined(self, df: DataFrame, text: str) -> DataFrame:
        counted = postings(df, text, self.low, self.high, self.id_col)
        known = lookup_join(counted, self.vocabulary, "term", weight="docs", how="inner")
        weighted = known.withColumn("_w", F.col("tf") * F.col("idf"))
        document = Window.partitionBy(self.id_col)
        norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(document))
        return weighted.select(self.id_col, "term", (F.col("_w") / norm).alias("value"))

    def feature_names(self) -> DataFrame:
        """`(term, idx)` in sorted order of the terms."""
        return ordered_rank(self.vocabulary.select("term"), "term", out="idx")

    def vector_stages(self, input_col: str, output_col: str) -> tuple[list, list[str]]:
        """MLlib stages that give the same values as sparse vectors, and the term list."""
        rows = (
            self.vocabulary.select("term", "idf").limit(MAX_VECTOR_TERMS + 1).collect()
        )
        if len(rows) > MAX_VECTOR_TERMS:
            raise ValueError(f"more than {MAX_VECTOR_TERMS} terms: raise min_df for the learners")
        rows.sort(key=lambda r: r.term.encode())
        names = [r.term for r in rows]
        if not names:
            raise ValueError("empty vocabulary")
        count = CountVectorizerModel.from_vocabulary(names, input_col, f"{output_col}_tf", minTF=1.0)
        weigh = ElementwiseProduct(
            scalingVec=Vectors.dense([r.idf for r in rows]),
            inputCol=f"{output_col}_tf",
            outputCol=f"{output_col}_w",
        )
        unit = Normalizer(p=2.0, inputCol=f"{output_col}_w", outputCol=output_col)
        return [count, weigh, unit], names


def fit_tfidf(
    df: DataFrame,
    text: str = "text",
    ngram_range: tuple[int, int] = (1, 1),
    min_df: int | float = 1,
    id_col: str = ID,
) -> TfidfModel:
    """Vocabulary and idf of the training texts, a row a document. A fractional `min_df` is a share of documents.

    A document's different terms are found inside its row: no text moves, only counts of terms.
    """
    low, high = ngram_range
    n = df.count()
    least = min_df if isinstance(min_df, int) else min_df * n
    vocabulary = (
        df.select(F.explode_outer(F.array_distinct(terms(F.col(text), low, high))).alias("term"))
        .where(F.col("term").isNotNull())
        .groupBy("term")
        .agg(F.count("*").alias("docs"))
        .where(F.col("docs") >= least)
        .withColumn("idf", F.log(F.lit(1.0 + n) / (1.0 + F.col("docs"))) + 1.0)
    )
    return TfidfModel(stage(vocabulary, "vocabulary"), n, low, high, id_col)


@dataclass
class VectorFeatures:
    """A fitted text -> vector pipeline and the names of its columns."""

    pipeline: PipelineModel
    names: list[str]
    low: int
    high: int

    def transform(self, df: DataFrame, text: str = "text", out: str = "features") -> DataFrame:
        with_terms = df.withColumn("_terms", terms(F.col(text), self.low, self.high))
        vectors = self.pipeline.transform(with_terms)
        return vectors.select(*df.columns, F.col("_scaled").alias(out))


def fit_tfidf_vectors(
    train: DataFrame,
    text: str = "text",
    ngram_range: tuple[int, int] = (1, 1),
    min_df: int | float = 0.01,
    id_col: str = ID,
) -> VectorFeatures:
    """TF-IDF then max-abs scaling, both fitted on `train`, as one JVM pipeline."""
    model = fit_tfidf(train, text, ngram_range, min_df, id_col)
    stages, names = model.vector_stages("_terms", "_tfidf")
    low, high = ngram_range
    unit = PipelineModel(stages).transform(train.withColumn("_terms", terms(F.col(text), low, high)))
    scaler = MaxAbsScaler(inputCol="_tfidf", outputCol="_scaled").fit(unit)
    return VectorFeatures(PipelineModel([*stages, scaler]), names, low, high)
