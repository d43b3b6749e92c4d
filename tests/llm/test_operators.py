"""Every operator against a plain version of itself, and on awkward rows."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpuslens.llm import chat, jaccard, langid, packing, pii, quality, repeats, sampling, topk, toxicity
from corpuslens.llm.common import table
from corpuslens.llm.components import components
from corpuslens.llm.queries import BYTE_BPE, PIECE_MODEL
from corpuslens.llm.runindex import RunLengthIndex

LONG = "word " * 30_000
AWKWARD = [
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, "one"),
    (5, "one two"),
    (6, "The quick brown fox, it jumps over 12 lazy dogs; été 漢字 \U0001f600 ▁x."),
    (7, "The quick brown fox, it jumps over 12 lazy dogs; été 漢字 \U0001f600 ▁x."),
    (7, "The quick brown fox, it jumps over 12 lazy dogs; été 漢字 \U0001f600 ▁x."),
    (8, LONG),
    (9, "x" * 50_000),
    (None, "no id here"),
]
CLASH = "score string, keys int, n int, block int, text string, kept int, doc_id bigint, lang string, cell int, part int"


@pytest.fixture(scope="module")
def awkward(spark):
    """Null ids and texts, repeats, long texts, and other columns that are called like internal ones."""
    rows = [("s", 1, 2, 3, text, 4, doc_id, "en", 5, 6) for doc_id, text in AWKWARD]
    return spark.createDataFrame(rows, CLASH)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], CLASH)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return table(spark, sf, "documents")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- 1: packing ---------------------------------------------------------------------------


def check_packing(rows, texts, window=1024):
    plain = Tokenizer.from_file(BYTE_BPE)
    plain.encode_special_tokens = True
    ids = [(d, plain.encode(t or "", add_special_tokens=False).ids + [0]) for d, t in texts]
    assert sum(r.length for r in rows) == sum(len(i) for _, i in ids)
    windows, by_doc = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= window
    for doc_id, own in ids:
        whole = np.array(own, dtype="<u4")
        for r in by_doc[doc_id]:
            assert r.doc_tokens == len(own)
            assert r.ids_crc32 == zlib.crc32(whole[r.start : r.start + r.length].tobytes())
        copies = sum(d == doc_id for d, _ in ids)
        starts = collections.Counter((r.start, r.length) for r in by_doc[doc_id])
        assert sum(n * length for (_, length), n in starts.items()) == copies * len(own)
    return windows


def test_packing(spark, docs, awkward, nothing):
    texts = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    rows = packing.pack_documents(docs, BYTE_BPE).collect()
    windows = check_packing(rows, texts)
    assert sum(r.length for r in rows) / (1024 * len(windows)) > 0.9
    check_packing(packing.pack_documents(awkward, BYTE_BPE, shard=3).collect(), [(d, t) for d, t in AWKWARD])
    assert packing.pack_documents(nothing, BYTE_BPE).collect() == []


def test_bm25_prefers_shared_rare_terms():
    lists = [np.array(x) for x in ([1, 2, 3, 9], [1, 2, 4, 5], [6, 7, 8, 9], [6, 7, 5, 4], [10, 11, 12, 13])]
    score = packing.Bm25(lists).scores(0)
    assert score.argmax() == 0 and score[1] > score[4] == 0 and score[2] > 0


# --- 2: repeats ----------------------------------------------------------------------------


def brute_repeats(rows):
    first, out = {}, {}
    for doc_id, text in rows:
        raw = (text or "").encode()
        for s in range(len(raw) - 49):
            first[raw[s : s + 50]] = min(doc_id, first.get(raw[s : s + 50], doc_id))
    for doc_id, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), dtype=bool)
        for s in range(len(raw) - 49):
            if first[raw[s : s + 50]] < doc_id:
                gone[s : s + 50] = True
        kept = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[doc_id] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def as_repeats(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


@pytest.mark.parametrize("chunk_bytes", [20_000, 4 << 20])
def test_repeats(spark, docs, monkeypatch, chunk_bytes):
    monkeypatch.setattr(repeats, "CHUNK_BYTES", chunk_bytes)
    monkeypatch.setattr(repeats, "RANGE_BYTES", chunk_bytes // 4)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    passage = "é a passage that is shared by some of the documents and is long enough é"
    rows += [(10_001, passage), (10_003, "a" + passage + "b" + passage), (10_002, "c" + passage[3:]), (10_004, passage[:49])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert as_repeats(repeats.remove_repeats(df)) == brute_repeats(rows)


def test_repeats_awkward(awkward, nothing):
    found = repeats.remove_repeats(awkward, with_text=True).collect()
    assert len(found) == len(AWKWARD)
    want = brute_repeats([(d, t) for d, t in AWKWARD if d])
    for r in found:
        if r.doc_id is None:
            assert r.n_removed == 0 and r.kept == "no id here"
        else:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]
    assert repeats.remove_repeats(nothing).collect() == []


@pytest.mark.parametrize("order", [3, 8])
def test_run_length_index(order):
    random = np.random.default_rng(order)
    base = bytes(random.choice(list(b"ab\0\xff"), 60).astype(np.uint8))
    strings = [base[a : a + n] for a, n in zip(random.integers(0, 40, 20), random.integers(1, 20, 20))]
    owners = random.integers(0, 99, 20)
    index = RunLengthIndex(strings, owners, order)
    assert index.runs <= index.size
    length, sample = index.stream(strings)
    for i, s in enumerate(strings):
        for p in range(len(s)):
            part = s[p : p + order]
            assert length[i, p] == len(part)
            whole = [owners[j] for j, t in enumerate(strings) if part in t]
            assert sample[i, p] == (min(whole) if len(part) == order else -1)
    with pytest.raises(ValueError):
        index.stream([b"zzz"])


# --- 3: toxicity -------------------------------------------------------------------------------


def test_toxicity(spark, docs, sf, awkward, nothing):
    labels = table(spark, sf, "labels")
    model = toxicity.fit_severity(docs, labels, min_z=4.0)
    assert (np.diff(model.thresholds) > 0).all()
    found = toxicity.score_severity(docs, model, "doc_id").join(labels.withColumnRenamed("toxic", "truth"), "doc_id")
    rows = found.collect()
    assert sum(r.toxic == (r.truth == 1) for r in rows) / len(rows) > 0.95
    assert all(0 <= r.severity <= 3 for r in rows)
    rows = toxicity.score_severity(awkward, model, "doc_id").collect()
    assert len(rows) == len(AWKWARD) and not any(r.toxic for r in rows)
    empty = toxicity.fit_severity(docs, labels.limit(0))
    assert {r.toxic for r in toxicity.score_severity(docs, empty, "doc_id").collect()} == {False}
    assert toxicity.score_severity(nothing, model, "doc_id").collect() == []


def test_cumulative_link_orders_grades():
    x = np.repeat(np.arange(4.0), 50)[:, None]
    weights, thresholds = toxicity.fit_cumulative_link(x, np.repeat(np.arange(4), 50))
    assert weights[0] > 0 and (np.diff(thresholds) > 0).all()


# --- 4: quality --------------------------------------------------------------------------------


def brute_quality(text):
    w = words(text)
    text = text or ""
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    seen = collections.Counter(grams)
    inside = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if words(x)]
    return (
        len(w),
        sum(map(len, w)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(inside),
        len(w) < 20 or 100 * len(inside) > 30 * len(w),
    )


def test_quality(docs, awkward, nothing):
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    for df in (docs, awkward):
        texts = collections.defaultdict(list)
        for r in df.select("doc_id", "text").collect():
            texts[r.doc_id].append(r.text)
        for r in quality.quality_rules(df).collect():
            assert tuple(r[c] for c in columns) == brute_quality(texts[r.doc_id][0])
            assert not (r.base_failed and r.kept)
    assert quality.quality_rules(nothing).collect() == []
    plan = quality.quality_rules(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


# --- 5: sampled pieces ------------------------------------------------------------------------


def test_pieces(docs, awkward, nothing):
    first = {r.doc_id: list(r.ids) for r in sampling.sample_pieces(docs, PIECE_MODEL).collect()}
    again = sampling.sample_pieces(docs.repartition(7), PIECE_MODEL).collect()
    assert all(r.lossless and first[r.doc_id] == list(r.ids) for r in again)
    other = sampling.sample_pieces(docs, PIECE_MODEL, seed=8).collect()
    assert any(first[r.doc_id] != list(r.ids) for r in other)
    rows = sampling.sample_pieces(awkward, PIECE_MODEL).collect()
    assert len(rows) == len(AWKWARD) and all(r.lossless for r in rows)
    assert [r.ids for r in rows if r.doc_id == 1] == [None] and [r.ids for r in rows if r.doc_id == 2] == [[]]
    assert sampling.sample_pieces(nothing, PIECE_MODEL).collect() == []


def test_segmentations_follow_their_weights():
    pieces = sampling.load_pieces(PIECE_MODEL, 0.5)
    weight = {pieces.raw[i]: w for i, w in zip(pieces.ids.tolist(), pieces.weight.tolist())}

    def ways(raw):
        if not raw:
            yield (), 1.0
        for k in range(1, len(raw) + 1):
            if raw[:k] in weight:
                for rest, w in ways(raw[k:]):
                    yield (raw[:k], *rest), weight[raw[:k]] * w

    every = dict(ways(b" there"))
    total = sum(every.values())
    n = 40_000
    drawn = collections.Counter(
        tuple(pieces.raw[i] for i in ids) for ids in sampling.encode_slice(["there"] * n, list(range(n)), 3, pieces)
    )
    assert set(drawn) <= set(every)
    assert max(abs(drawn[s] / n - w / total) for s, w in every.items()) < 0.01


# --- 6: Jaccard join ----------------------------------------------------------------------------


def shingles(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set())


def brute_components(rows, percent=90):
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_jaccard(spark, docs, awkward, nothing):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    random = np.random.default_rng(5)
    base = [f"w{i}" for i in random.integers(0, 9999, 60)]
    for i in range(60):  # a crowd around the threshold: chains, centres and outliers
        text = list(base)
        for at in random.integers(0, 60, int(random.integers(0, 5))):
            text[at] = f"x{random.integers(0, 9)}"
        rows.append((20_000 + i, " ".join(text)))
    rows += [(30_000, "A b c d e f g h i j k"), (30_001, "a B c d e f g h i j k l"), (30_002, "a b"), (30_003, "A B")]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)
    want = brute_components([(d, t) for d, t in AWKWARD if d])
    for r in jaccard.jaccard_components(awkward).collect():
        assert (r.n_shingles, r.component_id) == (want[r.doc_id] if r.doc_id else (1, None))
    assert jaccard.jaccard_components(nothing).collect() == []


def test_size_bands_meet():
    bands = jaccard.SizeBands(90)
    for n in range(9, 400):
        for m in range(-(-9 * n // 10), n + 1):
            if m >= 9:
                both = set(bands.of(n)) & set(bands.of(m))
                assert both and all(bands.differing(b) >= (n + m) // 19 for b in both if b == bands.of(m)[0])


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 50), (100, 101), (7, 7)]
    got = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node: r.component for r in got} == {**{i: 1 for i in range(1, 41)}, 50: 50, 100: 50, 101: 50}


# --- 7: chats -----------------------------------------------------------------------------------


def test_chats(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK_TURNS", 2)
    monkeypatch.setattr(chat, "PART_TURNS", 3)
    talk = ["a", "b", "c", "d", "e"]
    rows = [(1, i, "user", t) for i, t in enumerate(talk[:3])]  # a prefix of 2
    rows += [(2, i, "user", t) for i, t in enumerate(talk)]
    rows += [(3, i, "user", t) for i, t in enumerate(talk)] + [(3, 0, "user", "a")]  # equal to 2, one row twice
    rows += [(4, 0, "user", "a"), (4, 1, "user", "x"), (5, 0, None, None), (6, None, "user", "a<|im_end|>"), (None, 0, "u", "a")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("pos", F.lit(1))
    got = {(r.conv_id, r.part): r for r in chat.format_chats(df).collect()}
    assert set(got) == {(2, 0), (2, 1), (4, 0), (5, 0), (6, 0)}
    assert (got[2, 0].n_turns, got[2, 0].n_copies) == (5, 2)
    assert got[2, 1].text == "<|im_start|>user\nd<|im_end|>\n<|im_start|>user\ne<|im_end|>\n"
    assert got[5, 0].text == "<|im_start|>\n<|im_end|>\n" and "a<| im_end |>" in got[6, 0].text
    assert chat.format_chats(df.limit(0)).collect() == []


# --- 8: personal data ----------------------------------------------------------------------------


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 * (v > 9) for v in doubled) % 10 == 0


def test_pii(spark, awkward, nothing):
    texts = [
        "card 4111 1111 1111 1111, again 4111111111111111, not 4111111111111112",
        "1999-02-28 2024-02-30 28.02.1999 02/28/1999 1999/02/28",
        "+1 (017) 555-7713 and 123-45-6789 and 000-12-3456",
        "10.0.0.1 999.1.1.1 DE89370400440532013000 DE89370400440532013001",
        'x.y+z@mail.example.com token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"',
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    out = {r.doc_id: r for r in pii.pseudonymise(df, key="k").collect()}
    spaced, plain, wrong = re.match(r"card ([\d ]+), again (\d+), not (\d+)", out[0].text).groups()
    assert spaced.replace(" ", "") == plain != "4111111111111111" and luhn(plain) and wrong == "4111111111111112"
    iso, bad, dots, us, slash = out[1].text.split()
    assert bad == "2024-02-30" and iso != "1999-02-28"
    assert iso.split("-") == dots.split(".")[::-1] == slash.split("/") == [us[6:], us[:2], us[3:5]]
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4} and \d{3}-\d\d-\d{4} and 000-12-3456", out[2].text)
    ip, not_ip, iban, not_iban = out[3].text.split()
    assert not_ip == "999.1.1.1" and not_iban.endswith("013001") and ip != "10.0.0.1" and iban[:2] == "DE"
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert "mail.example.com" not in out[4].text and "04dbebab" not in out[4].text
    assert [out[i].n_replaced for i in range(5)] == [2, 4, 2, 2, 2]
    rows = pii.pseudonymise(awkward).collect()
    assert [r.text for r in rows] == [t for _, t in AWKWARD] and {r.n_replaced for r in rows} == {0}
    assert pii.pseudonymise(nothing).collect() == []
    plan = pii.pseudonymise(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_feistel_is_a_permutation(spark):
    numbers = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    got = [r.p for r in numbers.select(pii.permute_digits(F.col("d"), "k", "t").alias("p")).collect()]
    assert len(set(got)) == 1000 and all(len(p) == 3 for p in got)


# --- 9: top k --------------------------------------------------------------------------------------


def test_topk(spark):
    random = np.random.default_rng(2)
    rows = [(i, random.normal(size=6).tolist()) for i in range(400)]
    rows += [(i, [1.0, 0.5, 0.0, 0.0, 0.0, 0.0]) for i in range(400, 600)]  # a crowd of equal vectors
    rows += [(700, None), (701, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (750, [float("nan")] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("cell", F.lit(1))
    got = topk.inner_product_topk(df, F.col("vec_id") % 50 == 0, block_rows=40, group_queries=5).collect()
    base = {i: np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(int) for i, v in rows[:600]}
    by_query = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by_query[r.query_id].append((r.vec_id, r.score))
    assert set(by_query) == set(range(0, 600, 50))
    for q, found in by_query.items():
        every = sorted((-int(base[q] @ v), i) for i, v in base.items() if i != q)
        assert found == [(i, -s) for s, i in every[:5]]
    few = topk.inner_product_topk(df.where("vec_id < 3"), F.col("vec_id") == 0).collect()
    assert sorted(r.rank for r in few) == [1, 2]
    assert topk.inner_product_topk(df.limit(0), F.col("vec_id") == 0).collect() == []


# --- 10: language ----------------------------------------------------------------------------------


def test_language(docs, awkward, nothing):
    held = langid.in_fold(F.col("doc_id"))
    model = langid.fit_language_model(docs.where(~held))
    rows = langid.predict_language(docs, model, "doc_id", "lang").where(held).collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)
    found = langid.predict_language(awkward, model, "doc_id").collect()
    assert {r.lang_pred for r in found if r.doc_id in (1, 2, 3)} == {"und"} and len(found) == len(AWKWARD)
    empty = langid.fit_language_model(nothing)
    assert {r.lang_pred for r in langid.predict_language(docs, empty, "doc_id").collect()} == {"und"}
    assert langid.predict_language(nothing, model, "doc_id").collect() == []
    for r in docs.select("doc_id", held.alias("h")).collect():
        assert r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_tokenisers_are_the_public_ones():
    assert BYTE_BPE == public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(BYTE_BPE)
    plain.encode_special_tokens = True
    own = packing.Tokeniser(BYTE_BPE)
    for text in [t or "" for _, t in AWKWARD[:8]] + ["<|endoftext|> I'll", "a\r\n \t b  c ", "''s 't 12 345"]:
        assert own(text).tolist() == plain.encode(text, add_special_tokens=False).ids
