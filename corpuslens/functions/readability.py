r"""Word, sentence and syllable counts and the readability formulas.

All counts come from three normalised strings made once per document:

* `flat`  - punctuation removed, lower case, one space between words;
* `runs`  - `flat` with each vowel group as `1` and all other letters removed, so
  a word is a run of ones and its length is its number of syllables;
* `marks` - `flat` with sentence marks kept, for the sentence count.

Counting then is string length and regular-expression matching on the whole
document; what belongs to a word (syllables, easy-word lists) is judged once for each
different word (`functions/words.py`).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

PUNCTUATION = r"[^\p{L}\p{N}_ \t\n\r\f]+"
PUNCTUATION_KEEP_MARKS = r"[^\p{L}\p{N}_ \t\n\r\f.!?]+"
SPACE = r"[ \t\n\r\f]+"
FIRST_100 = r"^[ \t\n\r\f]*((?:[^ \t\n\r\f]+[ \t\n\r\f]+){0,99}[^ \t\n\r\f]+)"

# Very common short words counted as easy by default. A caller with
# a full familiar-word list passes it as `easy_words`.
EASY_WORDS = (
    "the of and to in is you that it he was for on are as with his they at be this "
    "have from or one had by word but not what all were we when your can said there "
    "use an each which she do how their if will up other about out many then them "
    "these so some her would make like him into time has look two more write go see "
    "number no way could people my than first water been call who oil its now find "
    "long down day did get come made may part over new sound take only little work "
    "know place year live me back give most very after thing our just name good "
    "sentence man think say great where help through much before line right too mean "
    "old any same tell boy follow came want show also around form three small set put "
    "end does another well large must big even such because turn here why ask went"
).split()

MAX_EASY_WORDS = 100_000


def easy_word_list(words: Iterable[str] | DataFrame | None) -> list[str]:
    """The easy words as a bounded list; a table is accepted up to `MAX_EASY_WORDS` rows."""
    if words is None:
        return EASY_WORDS
    if isinstance(words, DataFrame):
        words = [row[0] for row in words.limit(MAX_EASY_WORDS + 1).collect()]
    words = [w.lower() for w in words]
    if len(words) > MAX_EASY_WORDS:
        raise ValueError(f"more than {MAX_EASY_WORDS} easy words: not a word list")
    return words


def flat_text(text: Column) -> Column:
    bare = F.regexp_replace(F.lower(text), PUNCTUATION, "")
    return F.trim(F.regexp_replace(bare, SPACE, " "))


def syllable_runs(flat: Column) -> Column:
    """One run of `1` per word: vowel groups without a silent final e. A digit is no vowel."""
    no_ones = F.replace(flat, F.lit("1"), F.lit("0"))
    silent = F.regexp_replace(F.concat(no_ones, F.lit(" ")), "([^aeiouy ])e ", "$1 ")
    voiced = F.regexp_replace(silent, "[aeiouy]+", "1")
    return F.regexp_replace(F.rtrim(voiced), "[^1 ]+", "")


def marked_text(text: Column) -> Column:
    return F.regexp_replace(text, PUNCTUATION_KEEP_MARKS, "")


def sentence_count(marked: Column) -> Column:
    """Runs between sentence marks with at least three words; at least 1."""
    parts = F.split(marked, "[.!?]+")
    long_enough = F.filter(
        parts, lambda s: s.rlike(r"[^ \t\n\r\f][ \t\n\r\f]+[^ \t\n\r\f]+[ \t\n\r\f]+[^ \t\n\r\f]")
    )
    return F.greatest(F.lit(1), F.size(long_enough))


def lexicon_count(flat: Column) -> Column:
    return F.when(flat == "", 0).otherwise(
        F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit(""))) + 1
    ).cast("int")


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def syllable_count(runs: Column, words: Column) -> Column:
    """Ones plus one for each word without a vowel group."""
    ones = F.length(F.replace(runs, F.lit(" "), F.lit("")))
    return (ones + words - _matches(runs, "1+")).cast("int")


def polysyllable_count(runs: Column) -> Column:
    return _matches(runs, "111+")


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 for an empty denominator."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def flesch_reading_ease(words: Column, sentences: Column, syllables: Column) -> Column:
    value = 206.835 - 1.015 * (words / sentences) - 84.6 * ratio(syllables, words)
    return F.when(words == 0, F.lit(0.0)).otherwise(value)


def flesch_kincaid_grade(words: Column, sentences: Column, syllables: Column) -> Column:
    value = 0.39 * (words / sentences) + 11.8 * ratio(syllables, words) - 15.59
    return F.when(words == 0, F.lit(0.0)).otherwise(value)


def gunning_fog(words: Column, sentences: Column, hard: Column) -> Column:
    return 0.4 * (words / sentences + 100.0 * ratio(hard, words))


def coleman_liau(letters: Column, words: Column, sentences: Column) -> Column:
    value = (
        0.058 * (100.0 * ratio(letters, words)) - 0.296 * (100.0 * ratio(sentences, words)) - 15.8
    )
    return F.when(words == 0, F.lit(0.0)).otherwise(value)


def linsear_number(first: Column) -> Column:
    """Points per sentence of the first 100 words (`first` from `first_100`); NULL without words."""
    hard = polysyllable_count(syllable_runs(flat_text(first)))
    points = F.size(F.split(first, SPACE)) + 2 * hard
    return F.when(first != "", points / sentence_count(marked_text(first)))


def linsear_write(number: Column) -> Column:
    """The formula over a column of `linsear_number`: a column, so that it is computed once."""
    scaled = F.when(number > 20, number / 2).otherwise((number - 2) / 2)
    return F.when(number.isNull(), F.lit(0.0)).otherwise(scaled)


def first_100(text: Column) -> Column:
    return F.regexp_extract(text, FIRST_100, 1)


def dale_chall(words: Column, sentences: Column, easy: Column) -> Column:
    unknown = 100.0 * ratio(words - easy, words)
    score = 0.1579 * unknown + 0.0496 * (words / sentences)
    return F.when(unknown > 5, score + 3.6365).otherwise(score)


def mcalpine_eflaw(words: Column, miniwords: Column, sentences: Column) -> Column:
    return (words + miniwords) / sentences


def reading_time(text: Column, ms_per_char: float = 14.69) -> Column:
    return F.length(F.regexp_replace(text, SPACE, "")) * F.lit(ms_per_char) / 1000.0
