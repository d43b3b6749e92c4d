"""Awkward cases of single operators: blank runs, clashing names, ties, formats, repeated rows, thresholds."""

import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpuslens.llm import chat, langid, packing, pii, quality, sampling, topk, toxicity
from corpuslens.llm.common import table
from corpuslens.llm.queries import BYTE_BPE, CHAT_SQL, PIECE_MODEL
from tests.llm.test_operators import brute_quality


# --- 1: packing ---------------------------------------------------------------------------


@pytest.mark.parametrize("blank", [" ", "\n", "\t 　"])
def test_long_blank_runs(spark, blank):
    texts = [(1, "one" + blank * 2_000_000 + "two"), (2, blank * 60_000), (3, "plain")]
    plain = Tokenizer.from_file(BYTE_BPE)
    want = {d: len(plain.encode(t, add_special_tokens=False).ids) + 1 for d, t in texts}
    out = packing.pack_documents(spark.createDataFrame(texts, "doc_id bigint, text string"), BYTE_BPE)
    got = {r.doc_id: (r.n, r.most) for r in out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("most")).collect()}
    assert got == {d: (n, n) for d, n in want.items()}


# --- 3, 5, 10, 8: names -----------------------------------------------------------------------


def test_kept_columns_may_be_called_like_new_ones(spark):
    docs = spark.createDataFrame(
        [(1, "the good text", 0.5, "x", 2, "en", "r")],
        "doc_id bigint, text string, severity double, score string, ids int, lang string, read string",
    )
    model = toxicity.SeverityModel(np.zeros(0, np.int64), np.zeros(0), np.full(3, 40.0))
    out = toxicity.score_severity(docs, model, "doc_id", "severity", "text")
    assert out.columns == ["doc_id", "severity", "text", "_severity", "grade", "toxic"]
    assert out.first().severity == 0.5 and out.first()._severity < 0.001
    language = langid.fit_language_model(docs)
    out = langid.predict_language(docs, language, "doc_id", "score", "read", "text")
    assert out.columns == ["doc_id", "score", "read", "text", "lang_pred", "_score"]
    assert tuple(out.first()) == (1, "x", "r", "the good text", "en", 1.0)
    assert langid.has_language(docs, *docs.columns).first().has_language
    out = sampling.sample_pieces(docs, PIECE_MODEL, key="ids")
    assert out.columns == ["ids", "_ids", "n_pieces", "lossless"]
    assert out.first().ids == 2 and out.first().lossless
    named = docs.withColumnRenamed("read", "n_replaced")
    assert pii.pseudonymise(named).columns == [*named.columns, "_n_replaced"]


def test_severity_equals_a_plain_scorer(spark, sf):
    docs = table(spark, sf, "documents")
    model = toxicity.fit_severity(docs, table(spark, sf, "labels"))
    weight = dict(zip(model.bins.tolist(), model.weights.tolist()))
    for r in toxicity.score_severity(docs, model, "doc_id", "text").collect():
        words = re.findall(r"[^\W\d_]+", (r.text or "").lower())
        eta = sum(weight.get(zlib.crc32(w.encode()), 0.0) * math.log1p(100 * words.count(w) / len(words)) for w in set(words))
        above = [1 / (1 + math.exp(min(40, max(-40, t - eta)))) for t in model.thresholds]
        each = [a - b for a, b in zip([1, *above], [*above, 0])]
        assert r.severity == pytest.approx(sum(above), abs=1e-9)
        assert r.toxic == (above[0] >= 0.5) and each[r.grade] == pytest.approx(max(each), abs=1e-9)


def test_language_equals_a_plain_naive_bayes(spark, sf):
    """Counts, smoothing, priors and posteriors by loops over characters."""
    docs = table(spark, sf, "documents")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    out = [f for f, _, _ in rows if zlib.crc32(str(f).encode()) % 5 == 0]
    mask, m2, m3 = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F

    def bins(text):
        codes = [0, *[ord(c) if c.isalpha() else 0 for c in (text or "").lower()], 0]
        for i in range(1, len(codes) - 1):
            if codes[i]:
                pair = (codes[i - 1] * m3 + codes[i] * m2) & mask
                triple = (pair + codes[i + 1]) * m3 & mask
                yield (pair * m2 & mask) >> 48
                yield ((triple ^ (triple >> 29)) * m2 & mask) >> 48

    learned = [(t, lang) for d, t, lang in rows if d not in set(out) and lang is not None and t is not None]
    names = sorted({lang for _, lang in learned})
    counts = {n: np.full(1 << 16, 0.1) for n in names}
    for t, lang in learned:
        for b in bins(t):
            counts[lang][b] += 1
    prior = {n: sum(x == n for _, x in learned) / len(learned) for n in names}
    logs = {n: np.log(c / c.sum()) for n, c in counts.items()}
    model = langid.fit_language_model(docs.where(~langid.in_fold(F.col("doc_id"))))
    got = {r.doc_id: r for r in langid.predict_language(docs, model, "doc_id").collect()}
    for d, t, _ in rows:
        own = list(bins(t))
        if not own:
            assert (got[d].lang_pred, got[d].score) == ("und", 0.0)
            continue
        total = np.array([math.log(prior[n]) + logs[n][own].sum() for n in names])
        assert got[d].lang_pred == names[int(total.argmax())]
        assert got[d].score == pytest.approx(1 / np.exp(total - total.max()).sum(), rel=1e-6)


# --- 4: quality ---------------------------------------------------------------------------------


CLEAN = [
    "The committee met on Monday to discuss the plan for the new library, and it was agreed that work would start in May with the old wing.",
    "Le conseil a examiné lundi le projet de la nouvelle bibliothèque, et il a décidé que les travaux commenceraient en mai dans une aile du bâtiment.",
    "Der Ausschuss hat am Montag über den Plan für die neue Bibliothek beraten, und es ist beschlossen, dass die Arbeiten im Mai mit dem alten Flügel beginnen.",
    "El comité se reunió el lunes para hablar del plan de la nueva biblioteca, y se acordó que las obras empezarían en mayo con una parte del edificio.",
]
REJECTED = {
    "n_words": "the " + " ".join(f"w{i} the" for i in range(60_000)),
    "mean_word_chars": "the internationalization " + " ".join(f"electroencephalography{i} of" for i in range(20)),
    "symbol_ratio": " ".join(f"the word{i} #" for i in range(30)),
    "mark_ratio": " ".join(f"THE! WORD{i}!!" for i in range(30)),
    "stop_word_ratio": " ".join(f"noun{i}" for i in range(40)),
    "dup_line_ratio": "\n".join(x for i in range(9) for x in ("the line", f"alpha{i} beta{i} gamma{i} of delta{i} omega{i}")),
}


@pytest.mark.parametrize("measure", [m for m, _, _ in quality.THRESHOLDS])
def test_each_threshold_alone_rejects(spark, measure):
    rows = [*enumerate(CLEAN), (9, REJECTED[measure])]
    one = [t for t in quality.THRESHOLDS if t[0] == measure]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in quality.quality_rules(docs, one).collect()}
    assert all(got[i].kept for i in range(4)) and not got[9].kept and not got[9].base_failed
    others = [t for t in quality.THRESHOLDS if t[0] != measure]
    assert {r.doc_id: r.kept for r in quality.quality_rules(docs, others).collect()}[9]
    assert brute_quality(REJECTED[measure])[5] is False


def test_good_documents_are_kept(spark, sf):
    good = table(spark, sf, "labels").where("quality = 1").select("doc_id")
    judged = quality.quality_rules(table(spark, sf, "documents")).join(good, "doc_id").where("NOT base_failed")
    n, kept = judged.agg(F.count("*"), F.sum(F.col("kept").cast("int"))).first()
    assert n and kept >= 0.99 * n


# --- 7: chats --------------------------------------------------------------------------------------


def test_ties_of_a_turn_follow_the_sql(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "assistant", "z"), (1, 1, "user", "c"), (2, None, "u", "x"), (2, None, "a", "y")]
    rows += [(3, 0, "assistant", "z"), (3, 0, "user", "a"), (4, 5, "user", "b"), (4, 5, "user", "b")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    db = duckdb.connect()
    db.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    columns = ("conv_id", "part", "n_turns", "n_copies", "text")
    want = db.execute(f"SELECT {', '.join(columns)} FROM ({CHAT_SQL})").fetchall()
    assert sorted(tuple(r[c] for c in columns) for r in chat.format_chats(df).collect()) == sorted(want)


# --- 8: personal data --------------------------------------------------------------------------------


def masked(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return [r.text for r in pii.pseudonymise(df, key="k").orderBy("doc_id").collect()]


def test_social_security_numbers_stay_valid(spark):
    numbers = [f"{a:03d}-{b:02d}-{c:04d}" for a in (1, 123, 665, 667, 899) for b in (1, 50, 99) for c in range(1, 9999, 400)]
    out = masked(spark, numbers)
    assert all(re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", x) for x in out)
    assert len(set(out)) == len(numbers) and sum(a == b for a, b in zip(out, numbers)) <= 1
    invalid = ["000-12-3456", "666-12-3456", "900-12-3456", "123-00-4567", "123-45-0000"]
    assert masked(spark, invalid) == invalid


def test_addresses_keep_their_zeros(spark):
    plain, padded, mixed, wrong = masked(spark, ["192.168.1.5", "192.168.001.005", "192.168.1.005", "192.168.1.256"])
    assert wrong == "192.168.1.256" and plain != "192.168.1.5"
    octets = [int(x) for x in plain.split(".")]
    for other, widths in ((padded, (3, 4)), (mixed, (4,))):
        parts = other.split(".")
        assert [int(x) for x in parts] == octets
        assert len(parts[3]) == 3 and (len(parts[2]) == 3 or len(widths) == 1)


def test_dates_stay_in_their_window(spark):
    out = masked(spark, ["2024-02-29", "1970-01-01", "0100-01-01", "9699-12-31", "9999-12-31", "2024-02-29 29.02.2024"])
    years = [int(x[:4]) for x in out[:4]]
    assert all(abs(a - b) <= 11 for a, b in zip(years, (2024, 1970, 100, 9699))) and out[4] == "9999-12-31"
    iso, dots = out[5].split()
    assert iso == out[0] and iso.split("-") == dots.split(".")[::-1]


def test_dates_of_a_window_are_permuted(spark):
    days = spark.range(4000).selectExpr("id AS doc_id", "string(date_add(date'1970-01-01', int(id))) AS text")
    got = [r.text for r in pii.pseudonymise(days).collect()]
    assert len(set(got)) == 4000 and min(got) == "1970-01-01" and max(got) == "1980-12-13"


# --- 9: top k ----------------------------------------------------------------------------------------


def test_groups_skip_cells_that_cannot_matter(spark):
    """Tight clusters around far directions: a group of queries visits few cells, and the answer is exact."""
    random = np.random.default_rng(3)
    centres = 8 * random.normal(size=(20, 12))
    rows = [(i, (centres[i % 20] + 0.05 * random.normal(size=12)).tolist()) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    join = topk.VoronoiJoin(df, F.col("vec_id") % 50 == 0, k=5, block_rows=300, group_queries=8)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in join.answers().collect()}
    base = np.floor(256 * np.array([v for _, v in rows], dtype=np.float32).astype(float)).astype(int)
    for q in range(0, 2000, 50):
        every = sorted((-int(s), i) for i, s in enumerate(base @ base[q]) if i != q)[:5]
        assert [got[q, r] for r in range(1, 6)] == [(i, -s) for s, i in every]
    assert 40 <= join.visits.shape[1] <= 45 and join.visits.mean() < 0.3


def test_repeated_rows_count_once(spark):
    rows = [(i, [float(i), 1.0, 0.5]) for i in range(30)] + [(0, [0.0, 1.0, 0.5])] * 3 + [(29, [29.0, 1.0, 0.5])] * 2
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = topk.inner_product_topk(df, F.col("vec_id") % 10 == 0).collect()
    for q in (0, 10, 20):
        found = sorted((r["rank"], r.vec_id) for r in got if r.query_id == q)
        assert [r for r, _ in found] == [1, 2, 3, 4, 5]
        ids = [v for _, v in found]
        assert len(set(ids)) == 5 and q not in ids
    with pytest.raises(ValueError, match="length"):
        topk.inner_product_topk(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], df.schema), F.col("vec_id") == 1)
