"""The pipeline's near copies: shingles of 5 words, 80 per cent."""

import os

import numpy as np

import corpus_pipeline as P
from corpuslens.llm import jaccard
from corpuslens.llm.common import table
from tests.llm.test_operators import words


def brute(rows, width, percent):
    """Smallest id of each row's component."""
    sets = {}
    for d, text in rows:
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    part = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            common = len(sets[a] & sets[b]) if a < b else 0
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                low, high = sorted((part[a], part[b]))
                part = {d: low if p == high else p for d, p in part.items()}
    return part


def planted():
    """Copies with 0 to 40 per cent of text added, chains of changed words, and texts of 1 to 12 words."""
    random = np.random.default_rng(7)
    rows = []
    for n in (8, 20, 60, 150):
        base = [f"w{i}" for i in random.integers(0, 9999, n)]
        rows += [base + [f"y{n}x{share}x{i}" for i in range(n * share // 100)] for share in range(0, 41, 4)]
        for _ in range(25):
            text = list(base)
            for at in random.integers(0, n, int(random.integers(0, 4))):
                text[at] = f"x{random.integers(0, 9)}"
            rows.append(text)
    short = [f"s{i}" for i in range(12)]
    rows += [short[:n] for n in range(1, 13)] + [short[:3]]
    return [(50_000 + i, " ".join(w)) for i, w in enumerate(rows)]


def test_stage(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()] + planted()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = {r.doc_id for r in P.near_copies(spark, docs, sf).collect()}
    want = {d for d, part in brute(rows, 5, 80).items() if d == part}
    assert kept == want
    assert want < {d for d, part in brute(rows, 3, 90).items() if d == part}


def test_components_of_any_width(spark):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for width, percent in ((2, 80), (7, 75), (3, 60), (2, 50)):
        got = jaccard.jaccard_components(docs, percent, width).collect()
        assert {r.doc_id: r.component_id for r in got} == brute(rows, width, percent)


def test_bands_meet_at_lower_shares():
    for percent in (50, 55, 60, 66, 67, 70, 80, 90):
        bands = jaccard.SizeBands(percent)
        for n in range(bands.least, 400):
            for m in range(max(bands.least, -(-percent * n // 100)), n + 1):
                band = bands.of(m)[0]
                most = (100 - percent) * (n + m) // (100 + percent)
                assert band in bands.of(n) and most <= bands.differing(band) < bands.blocks(band)


def test_partners_two_bands_apart(spark):
    """10 of 16 shingles: similarity 0.625, and the smaller set lies two size bands below."""
    short = [f"w{i}" for i in range(12)]
    rows = [(1, " ".join(short)), (2, " ".join([*short, *[f"x{i}" for i in range(6)]]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for percent, linked in ((60, True), (62, True), (63, False)):
        got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs, percent).collect()}
        assert got == ({1: 1, 2: 1} if linked else {1: 1, 2: 2})


def test_many_repeated_rows(spark, monkeypatch):
    """Repeats are one set each: they make no pairs. Small flushes, ranges and parts give the same components."""
    for name, value in (("FLUSH_KEYS", 50), ("RANGE_KEYS", 100), ("SHARE_ROWS", 4)):
        monkeypatch.setattr(jaccard, name, value)
    words_ = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(words_))] * 1000 + [(2, " ".join([*words_, "more"]))] * 1000 + planted()
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), 80, 5).collect()}
    assert got == brute(rows[999:1001] + rows[2000:], 5, 80)


def test_an_id_with_two_texts_links_by_either(spark):
    long, short = [f"l{i}" for i in range(60)], [f"s{i}" for i in range(20)]
    rows = [(1, " ".join(long)), (1, " ".join(short)), (2, " ".join([*long, "x"])), (3, " ".join([*short, "y"]))]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), 80, 3).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 1}


def test_rounds_and_blocks(spark, monkeypatch):
    """One pair of a member a round and parts of few members: rounds go on until no link is left out."""
    for name, value in (("FIRST_PAIRS", 1), ("MORE_PAIRS", 2), ("TEST_PAIRS", 8), ("SHARE_ROWS", 5)):
        monkeypatch.setattr(jaccard, name, value)
    rows = planted()
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), 80, 5).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(rows, 5, 80)


def test_only_the_result_stays_on_disk(spark, monkeypatch):
    """Neither the tables on the way nor shuffle files of them stay."""
    made = []
    staged = jaccard.stage
    monkeypatch.setattr(jaccard, "stage", lambda df, *a, **b: made.append(out := staged(df, *a, **b)) or out)
    found = jaccard.jaccard_components(spark.createDataFrame(planted(), "doc_id bigint, text string"), 80, 5)
    folders = {os.path.dirname(f).removeprefix("file:") for f in found.inputFiles()}
    assert len(folders) == 1 and found.count() == len(planted())
    assert made and all("jaccard-components" in f for f in folders)
    left = {f for df in made for f in df.inputFiles() if os.path.exists(f.removeprefix("file:").removeprefix("//"))}
    assert not left


def test_only_marked_texts_travel(spark):
    rows = [(i, f"text {i}") for i in range(-5000, 5000)] + [(None, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    ids = spark.createDataFrame([(i,) for i in (-4999, -1, 0, 7, 4999)], "doc_id bigint")
    got = {r.doc_id: r.text for r in jaccard._marked(docs, ids).collect()}
    assert all(got[i] == f"text {i}" for i in (-4999, -1, 0, 7, 4999)) and len(got) < 20


def test_no_table_holds_sets_and_a_text_meets_many_partners(spark, monkeypatch):
    """Texts travel to their comparisons, an id once for several partners; every pair is still judged by all its texts."""
    made, staged = [], jaccard.stage
    monkeypatch.setattr(jaccard, "stage", lambda df, *a, **b: made.append(df.schema) or staged(df, *a, **b))
    monkeypatch.setattr(jaccard, "TEXT_PAIRS", 3)
    rows = planted()
    docs = spark.createDataFrame([*rows, *rows[:9], (None, "x"), (-1, None), (-2, "")], "doc_id bigint, text string")
    got = jaccard.jaccard_components(docs, 80, 5).collect()
    assert {r.doc_id: r.component_id for r in got if r.doc_id and r.doc_id > 0} == brute(rows, 5, 80)
    assert made and not any("hashes" in schema.names or "text" in schema.names for schema in made)
    # an id that stands for two texts is compared by both
    texts = [(1, "a b c d e"), (1, "v w x y z"), (2, "a b c d e"), (3, "v w x y z"), (4, "k l m n o")]
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "a bigint, b bigint")
    found = jaccard._compared(pairs, spark.createDataFrame(texts, "doc_id bigint, text string"), 90, 3)
    assert sorted((r.b, r.differ, r.linked) for r in found.collect()) == [
        (2, 0, True), (2, 6, False), (3, 0, True), (3, 6, False), (4, 6, False), (4, 6, False)
    ]
