"""Cleaning and tokenising as Column expressions (no Python in the rows)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# English stop words that can still occur after `clean_text`.
STOP_WORDS = (
    "me my myself we our ours ourselves you your yours yourself yourselves he him "
    "his himself she her hers herself it its itself they them their theirs "
    "themselves what which who whom this that these those am is are was were be "
    "been being have has had having do does did doing an the and but if or because "
    "as until while of at by for with about against between into through during "
    "before after above below to from up down in out on off over under again "
    "further then once here there when where why how all any both each few more "
    "most other some such no nor not only own same so than too very can will just "
    "don should now ll re ve ain aren couldn didn doesn hadn hasn haven isn ma "
    "mightn mustn needn shan shouldn wasn weren won wouldn"
).split()

# Fused words the word tokenizer cuts in two (first part, second part).
FUSED_WORDS = [
    ("can", "not"),
    ("gon", "na"),
    ("got", "ta"),
    ("wan", "na"),
    ("gim", "me"),
    ("lem", "me"),
]


def clean_text(text: Column) -> Column:
    """ASCII letters only, single letters dropped, one space between words, lower case."""
    letters = F.regexp_replace(text, "[^a-zA-Z]+", " ")
    words = F.regexp_replace(letters, r"(\b\w\b *)", " ")
    return F.lower(F.trim(F.regexp_replace(words, r"\s+", " ")))


def _cut_text(words: Column) -> Column:
    fused = "|".join(f"{a}(?={b}\\b)" for a, b in FUSED_WORDS)
    return F.regexp_replace(words, rf"\b({fused})", "$1 ")


def _cut_words(words: Column) -> Column:
    return F.split(_cut_text(words), " ")


def tokens_of_clean(clean: Column) -> Column:
    """Word tokens of text that went through `clean_text`."""
    return F.filter(_cut_words(clean), lambda t: t != "")


def token_text(text: Column) -> Column:
    """The letters of the raw text in lower case, with a blank between words; `tokens` are those of two letters or more."""
    return _cut_text(F.lower(F.regexp_replace(text, "[^a-zA-Z]+", " ")))


def tokens(text: Column) -> Column:
    """Word tokens of the cleaned raw text.

    Cleaned text is the words of two or more letters, so the length test on the
    split text stands for two of the three replacements of `clean_text`.
    """
    return F.filter(F.split(token_text(text), " "), lambda t: F.length(t) >= 2)


def content_tokens(token_array: Column) -> Column:
    """Tokens that are not stop words, in order."""
    return F.filter(token_array, lambda t: ~t.isin(STOP_WORDS))


def content_text(token_array: Column) -> Column:
    return F.array_join(content_tokens(token_array), " ")


def stopword_count(token_array: Column) -> Column:
    return F.size(F.filter(token_array, lambda t: t.isin(STOP_WORDS)))


def _runs_of(token_array: Column, n: int) -> Column:
    # Shifted copies of the array are zipped: an array expression inside a lambda
    # would be evaluated again for every element.
    grams = token_array
    for shift in range(1, n):
        count = F.greatest(F.size(token_array) - shift, F.lit(0))
        grams = F.zip_with(
            F.slice(grams, 1, count),
            F.slice(token_array, shift + 1, count),
            lambda a, b: F.concat_ws(" ", a, b),
        )
    return grams


def ngrams(token_array: Column, low: int = 1, high: int = 1) -> Column:
    """All runs of `low`..`high` neighbouring tokens, joined by a space."""
    runs = [_runs_of(token_array, n) for n in range(low, high + 1)]
    return runs[0] if len(runs) == 1 else F.concat(*runs)
