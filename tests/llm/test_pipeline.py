"""The pipeline's stages, one by one and together, and the queries next to their SQL."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from corpuslens.llm.common import table
from corpuslens.llm.queries import ORACLES, QUERIES
from corpuslens.session import stage
from tests.llm.test_near_copies import brute
from tests.llm.test_operators import AWKWARD, brute_repeats
from tools.check import TABLES, digest


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf, t)}.parquet'")
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    cursor = db.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()]
    assert digest([tuple(r) for r in df.select(*columns).collect()]) == digest(want)


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    for name, function in P.STAGES[:-1]:
        out = stage(function(spark, docs, sf), "test")
        assert out.columns == columns
        before = {r.doc_id: r.text for r in docs.collect()}
        after = {r.doc_id: r.text for r in out.collect()}
        if name == "language ID":
            assert set(before) - set(after) <= {d for d, t in before.items() if not any(map(str.isalpha, t or ""))}
        elif name == "near copies":
            assert set(after) == {d for d, c in brute(before.items(), 5, 80).items() if c == d}
        elif name == "repeated passages":
            want = brute_repeats(list(before.items()))
            for d, (n, gone, _, _) in want.items():
                assert (d in after) == (not n or gone < n)
                if d in after and not gone:
                    assert after[d] == before[d]
                elif d in after:
                    assert n - gone - 8 * want[d][2] <= len(after[d].encode()) <= n - gone
        else:
            assert set(after) == set(before) and not any("example.com" in t for t in after.values())
        docs = out
    assert P.run(spark, sf).agg(F.sum("length")).first()[0] == P.packing(spark, docs, sf).agg(F.sum("length")).first()[0]


def test_awkward_rows(spark, sf):
    rows = [("s", 1, text, doc_id, "en", None, 2) for doc_id, text in AWKWARD]
    docs = spark.createDataFrame(
        rows, "score string, lang_pred int, text string, doc_id bigint, lang string, n_chars bigint, kept int"
    )
    for source in (docs, docs.limit(0)):
        now = source
        for _, function in P.STAGES[:-1]:
            now = stage(function(spark, now, sf), "test")
            assert now.columns == source.columns
        P.packing(spark, now, sf).collect()


def test_near_copies_drop_repeated_rows(spark, sf):
    """One row of each (id, text) stays; an id with different texts keeps them; rows without id stay."""
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text)] * 300 + [(2, text), (3, "an entirely different text of some more words"), (3, "and another one")]
    rows += [(None, text)] * 2
    kept = [tuple(r) for r in P.near_copies(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), sf).collect()]
    assert sorted(kept, key=str) == sorted([(1, text), *rows[301:]], key=str)


def test_language_without_labels(spark, sf):
    docs = spark.createDataFrame([(1, "some words"), (2, "12 34"), (3, None)], "doc_id bigint, text string")
    assert [tuple(r) for r in P.language(spark, docs, sf).collect()] == [(1, "some words")]
