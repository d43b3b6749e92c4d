import pytest
from pyspark.sql import functions as F

from corpuslens.functions import readability as R, text as X
from corpuslens.operators.features import (
    drop_missing,
    linguistic_features,
    pos_counts,
    readability_scores,
    with_counts,
    with_tokens,
)
from corpuslens.schema import COLUMNS, FEATURES


def one(spark, text, *columns):
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    return df.select(*columns).first()


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("", ""),
        ("a", ""),
        ("U.S. 2024!", ""),
        ("don't stop", "don stop"),
        ("Étion café", "tion caf"),
        ("  A cat,  a DOG\n\t& b ", "cat dog"),
    ],
)
def test_clean_text(spark, raw, clean):
    assert one(spark, raw, X.clean_text(F.col("text")))[0] == clean


def test_tokens_shortcut_equals_cleaning(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    direct = X.tokens(F.col("text"))
    cleaned = X.tokens_of_clean(X.clean_text(F.col("text")))
    assert docs.where(direct != cleaned).count() == 0


def test_fused_words_are_cut(spark):
    row = one(spark, "I cannot say gonna, Wanna or cannotx.", X.tokens(F.col("text")))
    assert row[0] == ["can", "not", "say", "gon", "na", "wan", "na", "or", "cannotx"]


def test_stop_words_split(spark):
    df = with_tokens(spark.createDataFrame([(1, "The cats and the dogs would run")], "doc_id int, text string"))
    row = df.select(X.content_text(F.col("tokens")), X.stopword_count(F.col("tokens"))).first()
    assert tuple(row) == ("cats dogs would run", 3)


@pytest.mark.parametrize(
    "text, sentences",
    [("no mark at all here", 1), ("Hi. Ok.", 1), ("...", 1), ("One two three. Four five six! Ok?", 2), ("", 1)],
)
def test_sentences(spark, text, sentences):
    assert one(spark, text, R.sentence_count(R.marked_text(F.col("text"))))[0] == sentences


def python_syllables(word):
    import re

    w = re.sub(r"([^aeiouy])e$", r"\1", word)
    return max(1, len(re.findall("[aeiouy]+", w)))


def test_counts_against_per_word_rule(spark):
    text = "The table is a beautiful place. Rhythm tsk made every idea free; we're here, agreeable people!"
    words = "the table is a beautiful place rhythm tsk made every idea free were here agreeable people".split()
    syllables = [python_syllables(w) for w in words]
    row = with_counts(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert row.words == len(words)
    assert row.syllables == sum(syllables)
    assert row.polysyllables == sum(s >= 3 for s in syllables)
    assert row.monosyllables == sum(s == 1 for s in syllables)
    assert row.letters == sum(map(len, words))
    assert row.miniwords == sum(len(w) <= 3 for w in words)
    easy = set(R.EASY_WORDS)
    assert row.easy == sum(w in easy for w in words)
    assert row.hard == sum(s >= 3 and w not in easy for w, s in zip(words, syllables))
    assert row.sentences == 2


def test_formulas(spark):
    df = with_counts(spark.createDataFrame([(1, "The big dog ran away. It was a happy animal today.")], "doc_id int, text string"))
    c = df.first()
    got = df.select(*[e.alias(n) for n, e in readability_scores().items()]).first()
    w, s, y = c.words, c.sentences, c.syllables
    assert got.flesch_reading_ease == pytest.approx(206.835 - 1.015 * w / s - 84.6 * y / w)
    assert got.flesch_kincaid_grade_level == pytest.approx(0.39 * w / s + 11.8 * y / w - 15.59)
    assert got.gunning_fog_scale == pytest.approx(0.4 * (w / s + 100 * c.hard / w))
    assert got.coleman_liau_index == pytest.approx(5.8 * c.letters / w - 29.6 * s / w - 15.8)
    unknown = 100 * (w - c.easy) / w
    assert got.dale_chall_readability == pytest.approx(0.1579 * unknown + 0.0496 * w / s + 3.6365 * (unknown > 5))
    assert got.mcalpine_eflaw_readability == pytest.approx((w + c.miniwords) / s)
    number = ((w - c.polysyllables) + 3 * c.polysyllables) / s
    assert got.linsear_write_formula == pytest.approx(number / 2 if number > 20 else (number - 2) / 2)
    assert got.reading_time == pytest.approx(len("Thebigdogranaway.Itwasahappyanimaltoday.") * 14.69 / 1000)


def test_linsear_uses_first_hundred_words(spark):
    long = " ".join(["tree"] * 100 + ["agreeable"] * 50)
    row = with_counts(spark.createDataFrame([(1, long)], "doc_id int, text string"))
    value = row.select(readability_scores()["linsear_write_formula"]).first()[0]
    assert value == 50.0


def test_empty_text_gives_zero_not_null(spark):
    df = spark.createDataFrame([(1, "", 0), (2, None, 1), (3, "!!!", 0)], "doc_id int, text string, label int")
    for row in linguistic_features(df).collect():
        assert all(row[f] is not None for f in FEATURES)
        assert row.flesch_reading_ease == 0.0 and row.lexicon_count == 0.0


def test_tags(spark):
    df = spark.createDataFrame(
        [(1, "She quickly walked and they are running with famous dogs to whom")], "doc_id int, text string"
    )
    row = pos_counts(df).first()
    assert (row.adverb_count, row.verb_count, row.adjective_count) == (1, 3, 1)
    assert (row.noun_count, row.pronoun_count, row.conjunction_count) == (1, 3, 1)
    assert (row.present_tense_count, row.past_tense_count) == (2, 1)


def test_lexicon_table_wins_and_falls_back(spark):
    df = spark.createDataFrame([(1, "dogs run fast"), (2, "")], "doc_id int, text string")
    lexicon = spark.createDataFrame([("run", "VBP"), ("fast", "RB")], "word string, tag string")
    rows = {r.doc_id: r for r in pos_counts(df, lexicon=lexicon).collect()}
    assert (rows[1].noun_count, rows[1].verb_count, rows[1].adverb_count) == (1, 1, 1)
    assert sum(rows[2][1:]) == 0


def test_lexicon_of_default_rules_changes_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    empty = spark.createDataFrame([("zzzz", "NN")], "word string, tag string")
    assert pos_counts(docs).exceptAll(pos_counts(docs, lexicon=empty)).count() == 0


def test_drop_missing(spark):
    df = spark.createDataFrame(
        [(1, "", 1.0), (2, None, 1.0), (3, "null", 1.0), (4, "none", 1.0), (5, "x", None)],
        "doc_id int, text string, v double",
    )
    assert sorted(r.doc_id for r in drop_missing(df).collect()) == [3, 4]


def test_feature_table_order(spark):
    df = spark.createDataFrame([(1, "A plain text.", 1)], "doc_id int, text string, label int")
    assert linguistic_features(df).columns == ["doc_id", *COLUMNS]


def test_easy_words_from_table(spark):
    df = spark.createDataFrame([(1, "zebra cat")], "doc_id int, text string")
    easy = spark.createDataFrame([("Zebra",)], "word string")
    assert with_counts(df, easy_words=easy).first().easy == 1


def test_digits_are_not_syllables(spark):
    from corpuslens.functions import readability as R

    words = ["111", "2011", "a1", "1", "1e", "table1", "be1a"]
    df = spark.createDataFrame([(w,) for w in words], "w string").withColumn("flat", R.flat_text(F.col("w")))
    df = df.withColumn("runs", R.syllable_runs(F.col("flat")))
    got = df.select("w", R.syllable_count(F.col("runs"), F.lit(1)).alias("n"), R.polysyllable_count(F.col("runs")).alias("p"))
    assert {r.w: r.n for r in got.collect()} == {"111": 1, "2011": 1, "a1": 1, "1": 1, "1e": 1, "table1": 2, "be1a": 2}
    assert {r.p for r in got.collect()} == {0}
