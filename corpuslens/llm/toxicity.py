"""Toxicity: cumulative-link ordinal regression on sparse word features.

Severity grades 0 to 3 share one weight vector; grade k or more has probability
sigmoid(w.x - threshold_k). The model is fitted on a bounded sample of labelled rows
(`per_class`), words are hashed to 32 bits, and scoring runs in Arrow batches.

The labels say only toxic or not. Grades above 0 are the terciles, among the toxic
sample rows, of the share of words that the labels mark as insulting.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpuslens.functions.hashing import hash_unit
from corpuslens.llm.common import free_name, text_slices

WORD = re.compile(r"[^\W\d_]+")
GRADES = 4


@dataclass(frozen=True)
class SeverityModel:
    """`bins` (32-bit word hashes), their weights, and the ordered thresholds."""

    bins: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray


def _word_counts(text: str) -> tuple[list[str], np.ndarray, int]:
    counts = Counter(WORD.findall(text.lower()))
    return list(counts), np.fromiter(counts.values(), dtype=np.int64, count=len(counts)), sum(counts.values())


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        rows: list[list] = [[], [], [], []]
        for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
            words, counts, total = _word_counts(text)
            rows[0].append(toxic)
            rows[1].append([zlib.crc32(w.encode()) for w in words])
            rows[2].append(counts.tolist())
            rows[3].append(total)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(rows[0], pa.int32()),
                pa.array(rows[1], pa.list_(pa.int64())),
                pa.array(rows[2], pa.list_(pa.int64())),
                pa.array(rows[3], pa.int64()),
            ],
            names=["toxic", "bins", "counts", "total"],
        )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit_cumulative_link(
    x: np.ndarray, grade: np.ndarray, steps: int = 400, rate: float = 0.1, penalty: float = 1e-3
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing thresholds by Adam on the mean negative log-likelihood.

    Thresholds are the first one plus positive steps (their logarithms are fitted).
    """
    levels = GRADES - 1
    n, m = x.shape
    beta = np.zeros(m + levels)
    first, second = np.zeros_like(beta), np.zeros_like(beta)
    for t in range(1, steps + 1):
        gaps = np.exp(beta[m + 1 :])
        thresholds = beta[m] + np.concatenate([[0.0], np.cumsum(gaps)])
        above = _sigmoid((x @ beta[:m])[:, None] - thresholds[None])
        edge = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
        each = np.arange(n)
        p = np.maximum(edge[each, grade] - edge[each, grade + 1], 1e-9)
        slope = edge * (1.0 - edge)
        low, high = slope[each, grade] / p, slope[each, grade + 1] / p
        d_eta = -(low - high) / n
        d_threshold = np.zeros(levels + 2)
        np.add.at(d_threshold, grade, low / n)
        np.add.at(d_threshold, grade + 1, -high / n)
        d_threshold = d_threshold[1:-1]
        tail = np.cumsum(d_threshold[::-1])[::-1]
        gradient = np.concatenate([x.T @ d_eta + penalty * beta[:m], [tail[0]], tail[1:] * gaps])
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        beta -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
    gaps = np.exp(beta[m + 1 :])
    return beta[:m], beta[m] + np.concatenate([[0.0], np.cumsum(gaps)])


def fit_severity(docs: DataFrame, labels: DataFrame, per_class: int = 3000, min_z: float = 6.0) -> SeverityModel:
    """Fit on about `per_class` labelled documents of each class, chosen by hash of the id.

    Words enter the model if their document rate differs between the classes by
    `min_z` standard errors. Without rows of both classes, or without such words, the
    model has no word and every text gets severity 0.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropna()
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = dict(known.groupBy((F.col("toxic") > 0).alias("t")).count().collect())
    nothing = SeverityModel(np.zeros(0, np.int64), np.zeros(0), np.full(GRADES - 1, 40.0))
    if len(sizes) < 2:
        return nothing
    share = F.when(F.col("toxic") > 0, min(1.0, per_class / sizes[True])).otherwise(min(1.0, per_class / sizes[False]))
    chosen = known.where(hash_unit("doc_id", "toxicity") < share).select(
        "doc_id", (F.col("toxic") > 0).cast("int").alias("toxic")
    )
    sample = (
        docs.select("doc_id", "text")
        .dropna()
        .join(F.broadcast(chosen), "doc_id")  # about 2 * per_class rows, whatever the corpus
        .select("toxic", "text")
        .mapInArrow(_sample_features, "toxic int, bins array<bigint>, counts array<bigint>, total bigint")
        .toPandas()
    )
    toxic = sample["toxic"].to_numpy(dtype=np.int64)
    if not 0 < toxic.sum() < len(toxic):
        return nothing
    row = np.repeat(np.arange(len(sample)), sample["bins"].map(len))
    bins, column = np.unique(np.concatenate(sample["bins"].to_numpy()), return_inverse=True)
    value = np.concatenate(sample["counts"].to_numpy()).astype(float)
    share_words = 100.0 * value / np.maximum(sample["total"].to_numpy()[row], 1)
    with_word = np.bincount(column, minlength=len(bins))
    with_toxic = np.bincount(column, weights=toxic[row], minlength=len(bins))
    n1, n0 = toxic.sum(), len(toxic) - toxic.sum()
    p1, p0, p = with_toxic / n1, (with_word - with_toxic) / n0, with_word / len(toxic)
    z = (p1 - p0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
    picked = np.flatnonzero(np.abs(z) >= min_z)
    if not len(picked):
        return nothing
    place = np.full(len(bins), -1)
    place[picked] = np.arange(len(picked))
    used = place[column] >= 0
    x = np.zeros((len(sample), len(picked)))
    x[row[used], place[column[used]]] = np.log1p(share_words[used])
    insult = np.zeros(len(sample))
    mark = used & (z[column] > 0)
    np.add.at(insult, row[mark], share_words[mark])
    grade = np.zeros(len(sample), dtype=np.int64)
    cuts = np.quantile(insult[toxic == 1], [1 / 3, 2 / 3])
    grade[toxic == 1] = 1 + np.searchsorted(cuts, insult[toxic == 1], side="left").clip(0, 2)
    weights, thresholds = fit_cumulative_link(x, grade)
    return SeverityModel(bins[picked].astype(np.int64), weights, thresholds)


def score_severity(docs: DataFrame, model: SeverityModel, *keep: str) -> DataFrame:
    """`keep` columns with `severity` (expected grade), `grade` (most probable) and `toxic`.

    `toxic` is true if grade 1 or more has probability 0.5 or more. A null or empty
    text, or one without words, has all feature values 0. Whole texts are read. Where `keep`
    has a column of such a name, the new one gets underscores before its own.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    read = free_name(list(keep), "text")
    columns = docs.select(*keep, F.col("text").alias(read))
    added = {"severity": F.lit(0.0), "grade": F.lit(0), "toxic": F.lit(True)}
    schema = columns.drop(read).withColumns({free_name(list(keep), n): c for n, c in added.items()}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        weight = dict(zip(m.bins.tolist(), m.weights.tolist()))
        memo: dict[str, float] = {}
        for batch in text_slices(batches, read):
            eta = np.zeros(batch.num_rows)
            for i, text in enumerate(batch.column(read).to_pylist()):
                if not text:
                    continue
                if len(memo) > 300_000:
                    memo.clear()
                words, counts, total = _word_counts(text)
                for j, word in enumerate(words):
                    w = memo.get(word)
                    if w is None:
                        w = memo[word] = weight.get(zlib.crc32(word.encode()), 0.0)
                    if w:
                        eta[i] += w * np.log1p(100.0 * counts[j] / total)
            above = _sigmoid(eta[:, None] - m.thresholds[None])
            each = -np.diff(np.concatenate([np.ones((len(eta), 1)), above, np.zeros((len(eta), 1))], axis=1), axis=1)
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [
                    *kept,
                    pa.array(above.sum(axis=1)),
                    pa.array(each.argmax(axis=1).astype(np.int32)),
                    pa.array(above[:, 0] >= 0.5),
                ],
                names=schema.names,
            )

    return columns.mapInArrow(run, schema)
