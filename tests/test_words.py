"""Counts by different words, against a plain count of every word."""

import re

import pyarrow as pa
from pyspark.sql import functions as F

from corpuslens.functions import tags, text as X, words as W
from corpuslens.operators.features import linguistic_features, pos_counts, with_counts

TEXTS = [
    "The cat cannot make a banana; the ANOTHER Étude 1e e é 11 hmm trees.",
    "",
    "   \n\t ",
    None,
    "make make make\nquickly running helpful lives that",
    "日本語 テキスト année 1 a1e _e_ e1",
]


def _by_word(text: str, easy: list[str]) -> dict[str, int]:
    flat = re.sub(r"[ \t\n\r\f]+", " ", re.sub(r"[^\w \t\n\r\f]+", "", (text or "").lower())).split(" ")
    words = [w for w in flat if w]
    n = [len(re.findall("[aeiouy]+", re.sub("(?<=[^aeiouy])e$", "", w))) for w in words]
    return {
        "syllables": sum(max(1, k) for k in n),
        "polysyllables": sum(k >= 3 for k in n),
        "monosyllables": sum(k < 2 for k in n),
        "miniwords": sum(len(w) <= 3 for w in words),
        "easy": sum(w in easy for w in words),
        "hard": sum(k >= 3 and w not in easy for w, k in zip(words, n)),
    }


def test_word_counts_equal_a_count_of_every_word(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    easy = ["another", "cat", "the"]
    for row in with_counts(df, easy_words=easy).collect():
        assert {name: row[name] for name in W.WORD_COUNTS} == _by_word(TEXTS[row.doc_id], easy), row


def test_token_counts_equal_the_rules_for_every_token(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    rules = df.select("doc_id", F.explode(X.tokens(F.col("text"))).alias("t")).select("doc_id", "t", tags.fine_tag(F.col("t")).alias("tag"))
    tagged = [(r.doc_id, r.t, r.tag) for r in rules.collect()]
    found = {r.doc_id: r for r in pos_counts(df).collect()}
    features = {r.doc_id: r for r in linguistic_features(df, keep=("doc_id",)).collect()}
    for i, text in enumerate(TEXTS):
        for name, group in tags.TAG_GROUPS.items():
            wanted = sum(d == i and tag in group for d, _, tag in tagged)
            assert features[i][name] == wanted
            assert found[i][name] == (None if text is None else wanted)
        own = [t for d, t, _ in tagged if d == i]
        assert features[i].text == " ".join(t for t in own if t not in X.STOP_WORDS)
        assert features[i].stopword_count == sum(t in X.STOP_WORDS for t in own)


def test_a_word_is_judged_once_and_slices_are_bounded(monkeypatch):
    words = W._Words(pa.array(["aa bb aa", None, "bb bb c"]), 2)
    assert words.vocabulary.to_pylist() == ["aa", "bb"]
    texts = pa.array(["aa bb", None, "cc " * 50 + "cc", "", "dd"])
    seen = []

    def judge(part):
        seen.append(len(part))
        return [W._Words(part, 1).total(W._Words(part, 1).among(["cc"]))] if len(part) else [pa.array([], pa.int32())]

    monkeypatch.setattr(W, "SLICE_BYTES", 8)
    got = W._sliced(texts, judge, ["n"]).to_pylist()
    assert len(seen) > 2 and sum(seen) == 5
    assert got == [{"n": 0}, None, {"n": 51}, {"n": 0}, {"n": 0}]
    assert len(W._sliced(texts.slice(0, 0), judge, ["n"])) == 0


def test_no_lambda_runs_over_words(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id int, text string")
    plan = linguistic_features(df, keep=("doc_id",))._jdf.queryExecution().optimizedPlan().toString()
    assert "Exchange" not in plan and "transform(" not in plan and "zip_with(" not in plan
