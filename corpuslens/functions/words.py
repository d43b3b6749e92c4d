"""Counts per document from properties of its different words.

A word's syllables, tag and list memberships follow from the word alone. Inside a task the
words of a slice of documents are numbered, each different word is judged once, and the
documents add up numbers. The texts come normalised from column expressions.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from corpuslens.functions import tags
from corpuslens.functions.text import STOP_WORDS

#: Text bytes of a slice (one longer text stands alone).
SLICE_BYTES = 4 << 20
WORD_COUNTS = ("syllables", "polysyllables", "monosyllables", "miniwords", "easy", "hard")


class _Words:
    """The words (of `least` characters or more) of texts with one blank between words."""

    def __init__(self, texts: pa.Array, least: int):
        lists = pc.split_pattern(texts, " ")
        words = lists.flatten()
        row = np.repeat(np.arange(len(texts)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        kept = pc.greater_equal(pc.utf8_length(words), least)
        coded = words.filter(kept).dictionary_encode()
        self.vocabulary, self.codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        self.row, self.n = row[kept.to_numpy(zero_copy_only=False)], len(texts)

    def total(self, value: np.ndarray) -> pa.Array:
        """The sum of a number that each different word has, over the words of each text."""
        found = np.bincount(self.row, weights=value[self.codes], minlength=self.n) if len(self.row) else np.zeros(self.n)
        return pa.array(found.astype(np.int32))

    def among(self, words: list[str]) -> np.ndarray:
        return pc.is_in(self.vocabulary, value_set=pa.array(words, pa.string())).to_numpy(zero_copy_only=False)

    def joined(self, chosen: np.ndarray) -> pa.Array:
        """Each text's words among the chosen ones, in order."""
        kept = chosen[self.codes] if len(self.codes) else np.zeros(0, dtype=bool)
        ends = np.cumsum(np.bincount(self.row[kept], minlength=self.n))
        words = self.vocabulary.take(pa.array(self.codes[kept]))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), words), " ")


def _sliced(texts: pa.Array, judge: Callable[[pa.Array], list[pa.Array]], names: list[str]) -> pa.Array:
    """The struct of `judge` for each text, slice by slice; null for a null text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    parts, start = [], 0
    while start < len(texts) or not parts:
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + SLICE_BYTES, side="right")))
        part = texts.slice(start, end - start)
        parts.append(pa.StructArray.from_arrays(judge(part), names=names, mask=pc.is_null(part)))
        start = end
    return pa.concat_arrays(parts)


def word_counts(flat: Column, easy: list[str]) -> Column:
    """Struct of `WORD_COUNTS` for a text of `readability.flat_text`."""

    def judge(texts: pa.Array) -> list[pa.Array]:
        words = _Words(texts, 1)
        stems = pc.replace_substring_regex(words.vocabulary, "([^aeiouy])e$", r"\1")
        groups = pc.count_substring_regex(stems, "[aeiouy]+").to_numpy(zero_copy_only=False)
        short = pc.less_equal(pc.utf8_length(words.vocabulary), 3).to_numpy(zero_copy_only=False)
        known = words.among(easy)
        values = (np.maximum(groups, 1), groups >= 3, groups < 2, short, known, (groups >= 3) & ~known)
        return [words.total(v) for v in values]

    @F.arrow_udf(", ".join(f"{name} int" for name in WORD_COUNTS))
    def counts(texts: pa.Array) -> pa.Array:
        return _sliced(texts, judge, list(WORD_COUNTS))

    return counts(flat)


def _bits(vocabulary: pa.Array) -> np.ndarray:
    """For each word a number with one bit per feature column that counts it, as `tags.feature_bits`."""
    bits = tags.tag_bits()
    found = np.full(len(vocabulary), bits[tags.OTHER_TAG], dtype=np.int64)
    for suffix, tag in reversed(tags.SUFFIX_TAGS):
        found[pc.ends_with(vocabulary, suffix).to_numpy(zero_copy_only=False)] = bits[tag]
    closed: dict[str, int] = {}
    for tag, words in tags.TAG_WORDS.items():
        for word in words.split():
            closed.setdefault(word, bits[tag])
    place = pc.fill_null(pc.index_in(vocabulary, value_set=pa.array(list(closed))), -1).to_numpy(zero_copy_only=False)
    return np.where(place >= 0, np.array(list(closed.values()))[place], found)


def token_counts(cut: Column) -> Column:
    """Struct of `content` (the content text), `stopwords` and the tag counts for a text of `text.token_text`."""
    names = ["content", "stopwords", *tags.TAG_GROUPS]

    def judge(texts: pa.Array) -> list[pa.Array]:
        words = _Words(texts, 2)
        stop, bits = words.among(STOP_WORDS), _bits(words.vocabulary)
        counts = [words.total(bits >> i & 1) for i in range(len(tags.TAG_GROUPS))]
        return [words.joined(~stop), words.total(stop), *counts]

    @F.arrow_udf(", ".join(["content string", *[f"{name} int" for name in names[1:]]]))
    def counts(texts: pa.Array) -> pa.Array:
        return _sliced(texts, judge, names)

    return counts(cut)
