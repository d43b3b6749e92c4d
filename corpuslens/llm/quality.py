"""Quality rules: a threshold table compiled into one projection of built-in functions.

Nothing here is a user function and nothing is shuffled: every measure is an
expression over the row's own text. Values that are used more than once are bound
with `let`, a one-element `transform`, so that they are computed once for a row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Frequent function words of the languages the rules are meant for.
STOP_WORDS = (
    "the of and to in is that it was for on are as with by this "
    "le la les de des du et un une que qui dans en pour "
    "der die das und ist von den mit ein eine nicht zu "
    "el los las del y que en una por con para no"
).split()
#: What is taken off a word's ends before it is looked up, and marks that end a shout.
EDGES = ".,;:!?()[]{}\"'«»„“”…"
MARKS = "!?"
#: measure, smallest value kept, largest value kept. Labelled good texts of all four languages lie
#: inside with room to spare (stop words 0.04 to 0.43, word length 4.2 to 6.3, equal lines up to 0.33,
#: no symbols or marks to speak of); text without function words, of shouts, symbols or lists does not.
THRESHOLDS = [
    ("n_words", 20, 100_000),
    ("mean_word_chars", 3.0, 10.0),
    ("symbol_ratio", 0.0, 0.1),
    ("mark_ratio", 0.0, 0.5),
    ("stop_word_ratio", 0.03, 0.8),
    ("dup_line_ratio", 0.0, 0.4),
]
WINDOW = 8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once."""
    return F.transform(F.array(value), body)[0]


def _pairs(values: Column, shift: int) -> Column:
    """Hash of each element with the one `shift` places on (null beyond the end)."""
    return let(
        values,
        lambda a: F.zip_with(a, F.slice(a, F.lit(shift + 1), F.size(a)), lambda x, y: F.xxhash64(x, y)),
    )


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash occurs at least twice."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def neighbours(z: Column) -> Column:
        same_next = F.zip_with(
            F.slice(z, F.lit(1), F.size(z) - 1), F.slice(z, F.lit(2), F.size(z) - 1), lambda a, b: a["h"] == b["h"]
        )
        return let(
            same_next,
            lambda s: F.zip_with(
                z,
                F.zip_with(
                    F.concat(s, F.array(F.lit(False))), F.concat(F.array(F.lit(False)), s), lambda x, y: x | y
                ),
                lambda place, twice: F.when(twice, place["i"]),
            ),
        )

    places = F.sort_array(F.filter(let(placed, neighbours), lambda i: i.isNotNull()))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(
        places,
        start,
        lambda acc, i: F.struct(
            (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"]).cast("bigint")).alias("n"), i.alias("last")
        ),
        lambda acc: acc["n"],
    )


def repeated_words(words: Column) -> Column:
    """Words inside `WINDOW`-word windows that occur twice or more, the first included."""
    eights = _pairs(_pairs(_pairs(F.transform(words, lambda w: F.xxhash64(w)), 1), 2), 4)
    hashes = F.slice(eights, F.lit(1), F.size(words) - (WINDOW - 1))
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("bigint")).otherwise(
        let(
            hashes,
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(
                _covered(h)
            ),
        )
    )


def quality_rules(docs: DataFrame, thresholds: list[tuple[str, float, float]] = THRESHOLDS) -> DataFrame:
    """doc_id, the base counts, the ratios, `base_failed` and `kept` for each row.

    A null or empty text has no words: all counts and ratios are 0, `base_failed` is
    true and `kept` false. Repeated rows are judged one by one; other columns of the
    input are not read. `kept` needs every measure inside its two thresholds.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    words = F.filter(F.split(text, BLANK), lambda w: w != "")
    counts = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.btrim(F.lower(x), F.lit(EDGES)).isin(STOP_WORDS))).cast("bigint").alias("n_stop_words"),
        ),
    )
    line_counts = let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("bigint").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        ),
    )
    base = docs.select(
        "doc_id",
        counts.alias("w"),
        line_counts.alias("l"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.length(text) - F.length(F.translate(text, MARKS, ""))).cast("bigint").alias("n_marks"),
    ).select(
        "doc_id", "w.n_words", "w.word_chars", "n_symbols", "n_marks", "l.n_dup_lines", "w.n_repeat_words", "w.n_stop_words", "l.n_lines"
    )

    def ratio(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    measured = base.select(
        "*",
        ratio("word_chars", "n_words").alias("mean_word_chars"),
        ratio("n_symbols", "n_words").alias("symbol_ratio"),
        ratio("n_marks", "n_words").alias("mark_ratio"),
        ratio("n_stop_words", "n_words").alias("stop_word_ratio"),
        ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
    )
    passed = F.lit(True)
    for measure, low, high in thresholds:
        passed = passed & F.col(measure).between(F.lit(low), F.lit(high))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return measured.select("*", failed.alias("base_failed"), (~failed & passed).alias("kept"))
