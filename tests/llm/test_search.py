"""Ranked search against a plain scorer, its sharing graph, and awkward rows."""

import math
import re
from collections import Counter

import numpy as np

from corpuslens.llm import search
from corpuslens.llm.common import table
from corpuslens.llm.queries import op12_lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "n int, terms string, score bigint, rank int, doc_id bigint, text string"
ITEMS = "term string, scan int, block int, item_id bigint, text string"


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, k=10):
    counted = [(d, Counter(terms(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n_docs, n_terms = len(counted), sum(c.total() for _, c in counted)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    df = Counter(t for _, c in counted for t in c)
    out = []
    for i, own in asked.items():
        scores = []
        for d, c in counted:
            m = 10 + (90 * c.total() * n_docs) // n_terms
            s = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                for t in own
                if c[t]
            )
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(i, r, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def as_rows(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def test_query_equals_a_plain_scorer(spark, sf):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    assert as_rows(op12_lexical_search(spark, sf)) == brute(docs, items)


def test_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(search, "PIECE_BYTES", 64)  # long texts are cut, long terms are not
    docs = [
        (1, None),
        (2, ""),
        (3, " ,.\n\x00"),
        (4, "Rare É漢字 été 42"),
        (5, "rare, RARE; rare"),
        (5, "rare, RARE; rare"),
        (6, "common " * 400 + "rare"),
        (7, "common word"),
        (8, "common word"),
        (9, "x" * 1000 + " rare \U0001f600common"),
        (None, "word rare"),
        (-3, "word rare"),
    ]
    items = [(1, "rare RARE common"), (2, None), (3, "?!"), (4, "unknown"), (1, "word"), (None, "été É漢字"), (7, "x" * 1000)]
    made = spark.createDataFrame([(0, "t", 9, 9, d, t) for d, t in docs], DOCS)
    asked = spark.createDataFrame([("t", 1, 1, i, t) for i, t in items], ITEMS)
    assert as_rows(search.rank_documents(made, asked)) == brute(docs, items)
    assert as_rows(search.rank_documents(made, asked, k=2)) == brute(docs, items, 2)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(0, "", 0, 0, 1, "a b")], DOCS), spark.createDataFrame([("", 0, 0, 1, "a")], ITEMS)
    for out in (search.rank_documents(docs.limit(0), items), search.rank_documents(docs, items.limit(0))):
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.collect() == []


def test_many_items_in_blocks_and_scans(spark, sf, monkeypatch):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    items = [(i, " ".join((t or "").split()[:12])) for i, t in docs[:60]]
    monkeypatch.setattr(search, "SCAN_ITEMS", 25)
    monkeypatch.setattr(search, "BLOCK_ITEMS", 8)
    asked = spark.createDataFrame([("", 0, 0, i, t) for i, t in items], ITEMS)
    assert as_rows(search.rank_documents(table(spark, sf, "documents"), asked)) == brute(docs, items)


def test_shared_sums_cover_each_item_once():
    rng = np.random.default_rng(3)
    items = [np.unique(rng.integers(0, 30, rng.integers(0, 20))) for _ in range(40)] + [np.arange(10)] * 3
    graph = search.share_sums(items, 30)
    leaves = [{t} for t in range(30)]
    for a, b in zip(graph.left.tolist(), graph.right.tolist()):
        assert not leaves[a] & leaves[b]
        leaves.append(leaves[a] | leaves[b])
    for terms_, nodes in zip(items, graph.nodes):
        parts = [leaves[n] for n in nodes]
        assert sum(map(len, parts)) == len(terms_) and set().union(*parts) == set(terms_.tolist())
    assert [low for low, _ in graph.levels] == [0, *[high for _, high in graph.levels[:-1]]]
    left = Counter(frozenset((a, b)) for n in graph.nodes for a in n.tolist() for b in n.tolist() if a < b)
    assert max(left.values(), default=0) < 2  # nothing that two items share is added up twice
    assert len(graph.left) + sum(len(n) for n in graph.nodes) < sum(len(t) for t in items)
