"""The linguistic feature table: one pass over the raw text, no shuffle."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from corpuslens.functions import readability as R, tags, text as X, words as W
from corpuslens.operators.lookup import list_sizes, look_up, lookup_join, send_table
from corpuslens.schema import COLUMNS, FEATURES, ID, LABEL
from corpuslens.session import stage


def with_tokens(df: DataFrame, text: str = "text", out: str = "tokens") -> DataFrame:
    return df.withColumn(out, X.tokens(F.col(text)))


def with_counts(
    df: DataFrame, text: str = "text", easy_words: Iterable[str] | DataFrame | None = None
) -> DataFrame:
    """Adds the counts that the readability formulas share (`words`, `sentences`, ...)."""
    easy = R.easy_word_list(easy_words)
    raw = F.coalesce(F.col(text), F.lit(""))
    return (
        df.withColumn("_flat", R.flat_text(raw))
        .withColumn("words", R.lexicon_count(F.col("_flat")))
        .withColumn("_counts", W.word_counts(F.col("_flat"), easy))
        .withColumns(
            {
                "sentences": R.sentence_count(R.marked_text(raw)),
                "syllables": F.col("_counts.syllables"),
                "polysyllables": F.col("_counts.polysyllables"),
                "monosyllables": F.col("_counts.monosyllables"),
                "letters": F.length(F.replace("_flat", F.lit(" "), F.lit(""))),
                "miniwords": F.col("_counts.miniwords"),
                "easy": F.col("_counts.easy"),
                "hard": F.col("_counts.hard"),
                "_first": R.first_100(raw),
            }
        )
        .withColumn("linsear", R.linsear_number(F.col("_first")))
        .drop("_flat", "_counts", "_first")
    )


def readability_scores(text: Column | str = "text") -> dict[str, Column]:
    """The readability columns over the counts of `with_counts`."""
    raw = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    words, sentences = F.col("words"), F.col("sentences")
    syllables = F.col("syllables")
    return {
        "flesch_reading_ease": R.flesch_reading_ease(words, sentences, syllables),
        "flesch_kincaid_grade_level": R.flesch_kincaid_grade(words, sentences, syllables),
        "gunning_fog_scale": R.gunning_fog(words, sentences, F.col("hard")),
        "coleman_liau_index": R.coleman_liau(F.col("letters"), words, sentences),
        "linsear_write_formula": R.linsear_write(F.col("linsear")),
        "dale_chall_readability": R.dale_chall(words, sentences, F.col("easy")),
        "mcalpine_eflaw_readability": R.mcalpine_eflaw(words, F.col("miniwords"), sentences),
        "reading_time": R.reading_time(raw),
    }


def pos_counts(
    df: DataFrame, text: str = "text", lexicon: DataFrame | None = None, id_col: str = ID
) -> DataFrame:
    """Part-of-speech and tense counts per document.

    Without a lexicon table everything is one projection. With one (`word`, `tag`; one row a
    word) words are looked up inside their row, and those missing there fall back to the built-in
    rules; a lexicon too large for every task is joined to the distinct (document, word) pairs.
    """
    if lexicon is None:
        tagged = df.withColumn("_tags", W.token_counts(X.token_text(F.col(text))))
        return tagged.select(id_col, *[F.col(f"_tags.{n}").alias(n) for n in tags.TAG_GROUPS])
    bit = F.lit(0)
    for i, group in enumerate(tags.TAG_GROUPS.values()):
        bit = bit + F.when(F.col("tag").isin(group), 1 << i).otherwise(0)
    sent = send_table(lexicon.select("word", bit.alias("bits")), "word", "bits")
    if sent is not None:
        return _looked_up(df, text, sent, id_col)
    words = (
        df.select(id_col, F.explode_outer(X.tokens(F.col(text))).alias("word"))
        .groupBy(id_col, "word")
        .agg(F.count("*").alias("n"))
    )
    weights = words.where(F.col("word").isNotNull()).groupBy("word").agg(F.count("*").alias("docs"))
    table = stage(lexicon.select("word", "tag").join(weights, "word"), "lexicon")
    tagged = lookup_join(words, table, "word", "docs").withColumn(
        "tag",
        F.when(F.col("word").isNotNull(), F.coalesce("tag", tags.fine_tag(F.col("word")))),
    )
    sums = [
        F.sum(F.when(F.col("tag").isin(group), F.col("n")).otherwise(0)).cast("int").alias(name)
        for name, group in tags.TAG_GROUPS.items()
    ]
    # A document without words has one row without a word and so counts of zero.
    return tagged.groupBy(id_col).agg(*sums)


def _looked_up(df: DataFrame, text: str, sent: Broadcast, id_col: str) -> DataFrame:
    """Counts per document from the feature bits of each token: the lexicon's, else the rules'."""
    tokenised = with_tokens(df, text).select(id_col, "tokens", tags.feature_bits(F.col("tokens")).alias("bits"))
    names = list(tags.TAG_GROUPS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            tokens = batch.column("tokens")
            rules = batch.column("bits").flatten().to_numpy(zero_copy_only=False)
            bits = look_up(tokens.flatten(), table, rules)
            row = np.repeat(np.arange(batch.num_rows), list_sizes(tokens))
            counts = [np.bincount(row[(bits >> i) & 1 > 0], minlength=batch.num_rows) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c.astype(np.int32)) for c in counts]], names=[id_col, *names]
            )

    kind = df.schema[id_col].dataType.simpleString()
    return tokenised.mapInArrow(run, ", ".join([f"`{id_col}` {kind}", *[f"{n} int" for n in names]]))


def linguistic_features(
    df: DataFrame,
    text: str = "text",
    easy_words: Iterable[str] | DataFrame | None = None,
    lexicon: DataFrame | None = None,
    keep: tuple[str, ...] = (ID, LABEL),
) -> DataFrame:
    """`keep` columns, the content text and the 21 unscaled features as doubles.

    Readability runs on the raw text; tags and stop words on the cleaned tokens.
    """
    kept = [c for c in keep if c in df.columns]
    source = df.select(*kept, F.coalesce(F.col(text), F.lit("")).alias("_raw"))
    tokens = W.token_counts(X.token_text(F.col("_raw")))
    base = with_counts(source.withColumn("_tokens", tokens), "_raw", easy_words)
    columns = readability_scores("_raw") | {
        "text": F.col("_tokens.content"),
        "syllable_count": F.col("syllables"),
        "lexicon_count": F.col("words"),
        "polysyllable_count": F.col("polysyllables"),
        "monosyllable_count": F.col("monosyllables"),
        "stopword_count": F.col("_tokens.stopwords"),
    }
    if lexicon is None:
        columns |= {name: F.col(f"_tokens.{name}") for name in tags.TAG_GROUPS}
    wide = base.withColumns(columns)
    if lexicon is not None:
        wide = wide.join(pos_counts(source, "_raw", lexicon), ID)
    out = [c for c in kept if c not in COLUMNS]
    return wide.select(
        *out,
        "text",
        *[F.col(c).cast("double").alias(c) for c in FEATURES],
        *[c for c in kept if c in COLUMNS],
    )


def drop_missing(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows with a NULL or NaN anywhere, or a text that cleaned down to nothing, are dropped.

    Meant for a stored table: over freshly computed columns the tests would be pushed
    below the projection and compute them again. One test per column, because
    `na.drop()` is a single predicate over all columns, which the optimiser would
    rewrite once for every subset of renamed columns.
    """
    for name, kind in df.dtypes:
        df = df.where(F.col(name).isNotNull())
        if kind in ("double", "float"):
            df = df.where(~F.isnan(name))
    return df.where(F.trim(F.col(text)) != "") if text in df.columns else df


def rename_reorder(df: DataFrame) -> DataFrame:
    """The 23 columns of the processed table in their fixed order."""
    return df.select(*COLUMNS)
