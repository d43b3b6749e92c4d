"""Language ID: multinomial naive Bayes over hashed character n-grams.

Counting and scoring run in Arrow batches on the executors. The log-probability
matrix (hash bins x languages) is the only thing broadcast; its size is fixed by
`BINS` and `MAX_LANGUAGES`, not by the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpuslens.functions.hashing import hash_unit
from corpuslens.llm.common import free_name, text_slices

BINS = 1 << 16
MAX_LANGUAGES = 200
UNKNOWN = "und"
#: Mean log-probability of an n-gram where every bin is as likely as any other.
UNIFORM = -float(np.log(BINS))
#: How far from `UNIFORM` to what a language's own texts show a text must come, and how many
#: standard errors a short text is given. Clean texts lie at 0.6 and more, texts of unseen languages at 0.49 and less.
LEAST, ERRORS = 0.5, 3.0
#: Text bytes judged or counted at once: the arrays of a task are about a hundred times that.
SLICE_BYTES = 1 << 20
MIX_2, MIX_3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class LanguageModel:
    """`log_prob[bin, language]` and `log_prior[language]`, languages in name order."""

    languages: tuple[str, ...]
    log_prior: np.ndarray
    log_prob: np.ndarray


def in_fold(doc_id: Column, fold: int = 0, folds: int = 5) -> Column:
    """True where crc32 of the id as text falls in `fold`; a null id is in no fold."""
    remainder = F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds)
    return F.coalesce(remainder == fold, F.lit(False))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), dtype=bool, count=0x110000)


def ngram_bins(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash bins of all character n-grams and the document each belongs to.

    Text is lower-cased and every non-letter reads as a blank. Each letter gives the
    2-gram that ends in it and the 3-gram around it, so no n-gram leaves its text.
    """
    lowered = [text.lower() for text in texts]
    lengths = np.array([len(text) + 1 for text in lowered])
    codes = np.frombuffer(("\n" + "\n".join(lowered) + "\n").encode("utf-32-le"), dtype=np.uint32)
    codes = np.where(_letters()[codes], codes, 0).astype(np.uint64)
    at = np.flatnonzero(codes)
    pair = codes[at - 1] * MIX_3 + codes[at] * MIX_2
    triple = (pair + codes[at + 1]) * MIX_3
    shift = np.uint64(64 - BINS.bit_length() + 1)
    bins = np.stack([(pair * MIX_2) >> shift, (triple ^ (triple >> np.uint64(29))) * MIX_2 >> shift], axis=1)
    ends = np.cumsum(lengths)
    return bins.astype(np.int64), np.searchsorted(ends, at, side="left")


def _counts(languages: tuple[str, ...]):
    schema = pa.schema([("language", pa.int32()), ("bin", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(languages), BINS), dtype=np.int64)
        index = {name: i for i, name in enumerate(languages)}
        for batch in text_slices(batches, limit=SLICE_BYTES):
            texts = batch.column("text").to_pylist()
            bins, doc = ngram_bins(texts)
            label = np.array([index[name] for name in batch.column("lang").to_pylist()])
            flat = (label[doc][:, None] * BINS + bins).ravel()
            totals += np.bincount(flat, minlength=totals.size).reshape(totals.shape)
        language, cell = np.nonzero(totals)
        if len(cell):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(language.astype(np.int32)),
                    pa.array(cell.astype(np.int32)),
                    pa.array(totals[language, cell]),
                ],
                schema=schema,
            )

    return run


def fit_language_model(labelled: DataFrame, per_language: int = 4000, smoothing: float = 0.1) -> LanguageModel:
    """Fit on (doc_id, text, lang) rows.

    About `per_language` documents of each language, chosen by hash order of the id,
    are counted (the documented bound on rows used for fitting); priors come from all
    rows. Rows with a null id, text or language are not used. Without rows the model
    has no language. More than `MAX_LANGUAGES` languages is an error.
    """
    usable = labelled.select("doc_id", "text", "lang").dropna()
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = tuple(sorted(sizes))
    if not languages:
        return LanguageModel((), np.zeros(0), np.zeros((BINS, 0)))
    share = F.create_map(
        *[F.lit(x) for name in languages for x in (name, min(1.0, per_language / sizes[name]))]
    )
    sample = usable.where(hash_unit("doc_id", "langid") < share[F.col("lang")])
    rows = (
        sample.select("text", "lang")
        .mapInArrow(_counts(languages), "language int, bin int, n long")
        .groupBy("language", "bin")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    counts = np.full((BINS, len(languages)), smoothing)
    counts[rows["bin"].to_numpy(), rows["language"].to_numpy()] += rows["n"].to_numpy()
    prior = np.array([sizes[name] for name in languages], dtype=float)
    return LanguageModel(languages, np.log(prior / prior.sum()), np.log(counts / counts.sum(axis=0)))


def _totals(model: LanguageModel, bins: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Log-probability of all n-grams of each of `n` texts in each language."""
    total = np.zeros((n, len(model.languages)))
    step = max(1, (1 << 21) // len(model.languages))
    for low in range(0, len(doc), step):
        part, owner = bins[low : low + step], doc[low : low + step]
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        gathered = model.log_prob[part[:, 0]] + model.log_prob[part[:, 1]]
        total[owner[starts]] += np.add.reduceat(gathered, starts, axis=0)
    return total


def _score(model: LanguageModel, texts: list[str]) -> tuple[list[str], np.ndarray]:
    names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if not model.languages:
        return names, score
    bins, doc = ngram_bins(texts)
    if not len(doc):
        return names, score
    total = _totals(model, bins, doc, len(texts)) + model.log_prior
    best = total.argmax(axis=1)
    likelihood = np.exp(total - total.max(axis=1, keepdims=True))
    posterior = 1.0 / likelihood.sum(axis=1)
    for i in np.unique(doc):
        names[i], score[i] = model.languages[best[i]], posterior[i]
    return names, score


def predict_language(
    docs: DataFrame, model: LanguageModel, *keep: str, names: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """`keep` columns of each row, the predicted language and its posterior (called `names`).

    Where `keep` has a column of such a name, the new one gets underscores before its own.
    A null text, or one without any letter, is `und` with score 0. Ties go to the
    first language by name. Long texts are scored whole, in slices of bounded size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    read = free_name(list(keep), "read")
    columns = docs.select(*keep, F.col("text").alias(read))
    names = (free_name(list(keep), names[0]), free_name(list(keep), names[1]))
    schema = columns.drop(read).withColumns({names[0]: F.lit(""), names[1]: F.lit(0.0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, read):
            texts = [text or "" for text in batch.column(read).to_pylist()]
            found, score = _score(shared.value, texts)
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(found, pa.string()), pa.array(score)], names=schema.names
            )

    return columns.mapInArrow(run, schema)


def _in_half(text: Column) -> Column:
    """Halves by text, so that no text and none of its exact copies is judged by a model that has seen it."""
    return in_fold(text, 0, 2)


def _held_out(model: LanguageModel, other: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation, under each language of `model`, of the n-grams `other` was fitted on.

    A language that `other` does not have, or has no letters of, gets a mean of minus infinity.
    """
    mean, spread = np.full(len(model.languages), -np.inf), np.zeros(len(model.languages))
    for i, name in enumerate(model.languages):
        if name in other.languages:
            share = np.exp(other.log_prob[:, other.languages.index(name)])
            share -= share.min()  # the smoothing, which every bin has
            if share.sum() > 0:
                share /= share.sum()
                mean[i] = share @ model.log_prob[:, i]
                spread[i] = np.sqrt(share @ (model.log_prob[:, i] - mean[i]) ** 2)
    return mean, spread


class LanguageJudge:
    """Whether a text reads like its language, by its mean log-probability per n-gram.

    The yardstick of a language is the mean that labelled text of the other half shows
    under the model. A language whose yardstick is not above `UNIFORM` is not learned.
    """

    def __init__(self, model: LanguageModel, other: LanguageModel):
        mean, spread = _held_out(model, other)
        learned = np.flatnonzero(mean > UNIFORM)
        self.model = LanguageModel(
            tuple(model.languages[i] for i in learned), model.log_prior[learned], model.log_prob[:, learned]
        )
        self.least = UNIFORM + LEAST * (mean[learned] - UNIFORM)
        self.spread = spread[learned]

    def __call__(self, texts: list[str], labels: list[str | None]) -> np.ndarray:
        bins, doc = ngram_bins(texts)
        letters = np.bincount(doc, minlength=len(texts))
        passed = letters > 0
        if not self.model.languages or not passed.any():
            return passed
        total = _totals(self.model, bins, doc, len(texts))
        best = (total + self.model.log_prior).argmax(axis=1)
        n = np.maximum(letters, 1)
        mean = total[np.arange(len(texts)), best] / (2 * n)
        fits = mean + ERRORS * self.spread[best] / np.sqrt(n) >= self.least[best]
        unlearned = np.array([label is not None and label not in self.model.languages for label in labels])
        return passed & (fits | unlearned)


def has_language(docs: DataFrame, *keep: str, name: str = "has_language") -> DataFrame:
    """`keep` columns of each row of (text, lang), and whether its text reads like a language of the table.

    Two models are fitted, each on one half of the texts, and judge the other half, so the
    verdict is held out and does not grow with the length of a text. A text without a letter
    never passes. Rows labelled with a language too thin to learn, and all rows where there
    is no language to learn, pass if they have a letter.
    """
    half = _in_half(F.col("text"))
    first, second = fit_language_model(docs.where(half)), fit_language_model(docs.where(~half))
    judges = {True: LanguageJudge(second, first), False: LanguageJudge(first, second)}
    shared = docs.sparkSession.sparkContext.broadcast(judges)
    read, label, own_half = (free_name([*keep, name], n) for n in ("read", "label", "half"))
    columns = docs.select(
        *keep, F.col("text").alias(read), F.col("lang").cast("string").alias(label), half.alias(own_half)
    )
    schema = columns.drop(read, label, own_half).withColumns({name: F.lit(True)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, read, SLICE_BYTES):
            texts, labels, halves = (batch.column(i).to_pylist() for i in range(batch.num_columns - 3, batch.num_columns))
            found = np.zeros(len(texts), dtype=bool)
            for half, judge in shared.value.items():
                own = [i for i, h in enumerate(halves) if h == half]
                if own:
                    found[own] = judge([texts[i] or "" for i in own], [labels[i] for i in own])
            kept = [batch.column(i) for i in range(batch.num_columns - 3)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found)], names=schema.names)

    return columns.mapInArrow(run, schema)
