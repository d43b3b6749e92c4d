"""Ranked lexical search: many queries at once, their common parts evaluated once.

A score is a sum over terms, so items that share terms share partial sums. The pair of
summands that most items of a block have in common becomes a node of its own, and so on
until no pair is in two items: a graph of two-term sums, whose roots are the items. A
task adds up each node once for a batch of documents (its partial accumulators), follows
the graph level by level to the items' scores, and keeps the best of each item.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from corpuslens.llm.common import text_slices
from corpuslens.llm.shingles import word_hashes
from corpuslens.session import stage

#: Characters between terms: all of ASCII but letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Items that one scan of the documents serves, (item, term) pairs of a scan, items of one sharing graph.
SCAN_ITEMS, SCAN_PAIRS, BLOCK_ITEMS = 4096, 400_000, 256
#: Bytes hashed and scores held at once, per task. (Copies tie at the edge of the best: all of a batch may pass it.)
PIECE_BYTES = 1_000_000
CELLS = 1 << 20

_BETWEEN = np.zeros(256, dtype=bool)
_BETWEEN[:128] = [not chr(c).isalnum() for c in range(128)]


@dataclass(frozen=True)
class SharedSums:
    """A sharing graph. Nodes: first the terms of two or more items, then sums of two earlier nodes, by level."""

    n_shared: int
    left: np.ndarray
    right: np.ndarray
    levels: list[tuple[int, int]]
    nodes: list[np.ndarray]


def share_sums(items: list[np.ndarray], n_shared: int) -> SharedSums:
    """Sharing graph of items given as sets of terms 0 ... n_shared - 1.

    A level merges disjoint pairs of nodes, those of most items first, with at least 3/4 of
    the best pair's items each; the last level is reached when no pair is in two items.
    """
    now = [set(t.tolist()) for t in items]
    left: list[int] = []
    right: list[int] = []
    levels = []
    while True:
        uses: dict[int, list[int]] = {}
        for i, nodes in enumerate(now):
            for node in nodes:
                uses.setdefault(node, []).append(i)
        live = np.array(sorted(n for n, own in uses.items() if len(own) > 1), dtype=np.int64)
        if len(live) < 2:
            break
        held = np.zeros((len(items), len(live)), dtype=np.float32)
        for column, node in enumerate(live.tolist()):
            held[uses[node], column] = 1
        together = np.triu(held.T @ held, 1)
        most = together.max()
        if most < 2:
            break
        a, b = np.nonzero(together >= max(2, 0.75 * most))
        best = np.lexsort((b, a, -together[a, b]))
        taken: set[int] = set()
        start = len(left)
        for x, y in zip(live[a[best]].tolist(), live[b[best]].tolist()):
            if x in taken or y in taken:
                continue
            taken |= {x, y}
            node = n_shared + len(left)
            left.append(x)
            right.append(y)
            for i in set(uses[x]) & set(uses[y]):
                now[i] -= {x, y}
                now[i].add(node)
        levels.append((start, len(left)))
    ends = [np.array(sorted(nodes), dtype=np.int64) for nodes in now]
    return SharedSums(n_shared, np.array(left, dtype=np.int64), np.array(right, dtype=np.int64), levels, ends)


def _mined(item_type: str):
    """The sharing graph of one block of (item_id, term) rows, as one row of plain arrays."""
    schema = (
        f"ids array<{item_type}>, shared array<bigint>, own array<bigint>, own_item array<int>, "
        "left array<int>, right array<int>, level_end array<int>, node array<int>, node_item array<int>"
    )

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["item", "term"])
        numbers, at = np.unique(rows["item"].to_numpy(), return_index=True)
        item = np.searchsorted(numbers, rows["item"].to_numpy())
        hashes, _ = word_hashes([t.encode() for t in rows["term"]], _BETWEEN)
        terms, term, uses = np.unique(hashes, return_inverse=True, return_counts=True)
        shared = np.flatnonzero(uses > 1)
        place = np.full(len(terms), -1)
        place[shared] = np.arange(len(shared))
        mine = place[term]
        graph = share_sums([mine[(item == i) & (mine >= 0)] for i in range(len(numbers))], len(shared))
        ids = [None if pd.isna(x) else x for x in rows["item_id"].iloc[at].tolist()]
        out = {
            "ids": ids,
            "shared": terms[shared].view(np.int64),
            "own": terms[term[mine < 0]].view(np.int64),
            "own_item": item[mine < 0],
            "left": graph.left,
            "right": graph.right,
            "level_end": [end for _, end in graph.levels],
            "node": np.concatenate([*graph.nodes, np.zeros(0, dtype=np.int64)]),
            "node_item": np.repeat(np.arange(len(numbers)), [len(x) for x in graph.nodes]),
        }
        return pd.DataFrame({k: [list(v)] for k, v in out.items()})

    return run, schema


def _pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[bytes]]]:
    """(owner, bytes) lists of bounded size; a longer text is cut between two terms."""
    owners: list[int] = []
    parts: list[bytes] = []
    held = 0
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        start = 0
        while start < len(raw):
            end = min(len(raw), start + PIECE_BYTES)
            while end < len(raw):
                gaps = np.flatnonzero(_BETWEEN[np.frombuffer(raw, np.uint8, end - start, start)])
                if len(gaps):
                    end = start + int(gaps[-1]) + 1
                    break
                end = min(len(raw), end + PIECE_BYTES)
            if parts and held + end - start > PIECE_BYTES:
                yield owners, parts
                owners, parts, held = [], [], 0
            owners.append(i)
            parts.append(raw[start:end])
            held += end - start
            start = end
    if parts:
        yield owners, parts


def _postings(sent):
    """doc_id, n (terms of the text) and the query terms in it with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value
        size = max(1, len(vocabulary))
        for batch in text_slices(batches, limit=PIECE_BYTES):
            rows = batch.num_rows
            n = np.zeros(rows, dtype=np.int64)
            keys, counts = [], []
            for owners, parts in _pieces(batch.column("text").to_pylist()):
                hashes, part = word_hashes(parts, _BETWEEN)
                owner = np.array(owners)[part]
                n += np.bincount(owner, minlength=rows)
                at = np.minimum(np.searchsorted(vocabulary, hashes), size - 1)
                hit = vocabulary[at] == hashes if len(vocabulary) else np.zeros(len(hashes), dtype=bool)
                key, count = np.unique(owner[hit] * size + at[hit], return_counts=True)
                keys.append(key)
                counts.append(count)
            key = np.concatenate([*keys, np.zeros(0, dtype=np.int64)])
            count = np.concatenate([*counts, np.zeros(0, dtype=np.int64)])
            key, back = np.unique(key, return_inverse=True)  # pieces of one text come together
            tf = np.zeros(len(key), dtype=np.int64)
            np.add.at(tf, back, count)
            offsets = pa.array(np.searchsorted(key, np.arange(rows + 1) * size).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(n),
                    pa.ListArray.from_arrays(offsets, pa.array((key % size).astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(tf)),
                ],
                names=["doc_id", "n", "terms", "tf"],
            )

    return run


def _frequencies(size: int):
    """Documents that hold each term, then the documents with a term and the number of their terms; of one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 2, dtype=np.int64)
        for batch in batches:
            total[:size] += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
            n = batch.column("n").to_numpy()
            total[size] += np.count_nonzero(n)
            total[size + 1] += n.sum()
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["at", "value"])

    return run


@dataclass(frozen=True)
class _Plan:
    """Per block: item ids, its graph, and where the vocabulary's terms enter it."""

    ids: list
    graph: SharedSums
    node: np.ndarray
    node_item: np.ndarray
    shared_at: np.ndarray
    own_at: np.ndarray


def _plan(row, vocabulary: np.ndarray) -> _Plan:
    ends = list(row["level_end"])
    shared = np.array(row["shared"], dtype=np.int64).view(np.uint64)
    own = np.array(row["own"], dtype=np.int64).view(np.uint64)
    shared_at = np.full(len(vocabulary), -1, dtype=np.int64)
    shared_at[np.searchsorted(vocabulary, shared)] = np.arange(len(shared))
    own_at = np.full(len(vocabulary), -1, dtype=np.int64)
    own_at[np.searchsorted(vocabulary, own)] = row["own_item"]
    graph = SharedSums(
        len(shared),
        np.array(row["left"], dtype=np.int64),
        np.array(row["right"], dtype=np.int64),
        list(zip([0, *ends], ends)),
        [],
    )
    node, node_item = (np.array(row[c], dtype=np.int64) for c in ("node", "node_item"))
    return _Plan(list(row["ids"]), graph, node, node_item, shared_at, own_at)


def block_scores(plan: _Plan, terms: np.ndarray, doc: np.ndarray, value: np.ndarray, width: int) -> np.ndarray:
    """Scores (items x documents) from what each (term, document) contributes."""
    graph = plan.graph
    sums = np.zeros((graph.n_shared + len(graph.left), width), dtype=np.int64)
    at = plan.shared_at[terms]
    held = at >= 0
    sums[at[held], doc[held]] = value[held]
    for low, high in graph.levels:
        sums[graph.n_shared + low : graph.n_shared + high] = sums[graph.left[low:high]] + sums[graph.right[low:high]]
    scores = np.zeros((len(plan.ids), width), dtype=np.int64)
    if len(plan.node):
        owner, start = np.unique(plan.node_item, return_index=True)
        scores[owner] = np.add.reduceat(sums[plan.node], start, axis=0)
    at = plan.own_at[terms]
    held = at >= 0
    np.add.at(scores, (at[held], doc[held]), value[held])
    return scores


class _Best:
    """The k best (score, smaller id; null ids last) of each item so far."""

    def __init__(self, items: int, k: int):
        self.k, self.edge = k, np.ones(items, dtype=np.int64)
        self.item, self.score, self.id = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.null = np.zeros(0, dtype=bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        edge = self.edge
        if scores.shape[1] > self.k:
            edge = np.maximum(edge, np.partition(scores, scores.shape[1] - self.k, axis=1)[:, -self.k])
        item, doc = np.nonzero(scores >= edge[:, None])
        item, score = np.concatenate([self.item, item]), np.concatenate([self.score, scores[item, doc]])
        id_, no_id = np.concatenate([self.id, ids[doc]]), np.concatenate([self.null, null[doc]])
        order = np.lexsort((id_, no_id, -score, item))
        item, score, id_, no_id = item[order], score[order], id_[order], no_id[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        keep = rank < self.k
        self.item, self.score, self.id, self.null = item[keep], score[keep], id_[keep], no_id[keep]
        last = rank == self.k - 1
        self.edge[item[last]] = score[last]


def _ranked(sent, item_type: pa.DataType, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans, weights, n_docs, n_terms = sent.value
        best = [_Best(len(p.ids), k) for p in plans]
        nodes = max(p.graph.n_shared + len(p.graph.left) + len(p.ids) for p in plans)
        width = max(64, CELLS // nodes)
        for whole in batches:
            for low in range(0, whole.num_rows, width):
                batch = whole.slice(low, width)
                lists = batch.column("terms")
                sizes = np.diff(lists.offsets.to_numpy())
                doc = np.repeat(np.arange(batch.num_rows), sizes)
                terms, tf = lists.flatten().to_numpy(), batch.column("tf").flatten().to_numpy()
                length = 10 + (90 * batch.column("n").to_numpy() * n_docs) // n_terms
                value = weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * length[doc]))
                id_ = batch.column("doc_id")
                null = id_.is_null().to_numpy(zero_copy_only=False)
                ids = id_.fill_null(0).to_numpy()
                for plan, own in zip(plans, best):
                    own.add(block_scores(plan, terms, doc, value, batch.num_rows), ids, null)
        for plan, own in zip(plans, best):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([plan.ids[i] for i in own.item], item_type),
                    pa.array(own.id, mask=own.null),
                    pa.array(own.score),
                ],
                names=["item_id", "doc_id", "score"],
            )

    return run


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, term): the distinct terms of each item, A-Z lower-cased. Rows of one id are one item."""
    low = F.translate(F.col(text), UPPER, LOWER)
    terms = F.explode(F.split(low, BETWEEN)).alias("term")
    return items.select(F.col(item_id).alias("item_id"), terms).where("term <> ''").distinct()


def _scan(docs: DataFrame, pairs: DataFrame, item_type: str, k: int) -> DataFrame | None:
    """The k best documents of all items of `pairs` (item_id, item, block, term), from one pass over the texts."""
    spark = docs.sparkSession
    run, schema = _mined(item_type)
    blocks = pairs.groupBy("block").applyInPandas(run, schema).collect()
    if not blocks:
        return None
    hashes = [np.array(b[c], dtype=np.int64) for b in blocks for c in ("shared", "own")]
    vocabulary = np.unique(np.concatenate(hashes).view(np.uint64))
    postings = stage(
        docs.mapInArrow(
            _postings(spark.sparkContext.broadcast(vocabulary)), "doc_id bigint, n bigint, terms array<int>, tf array<bigint>"
        ),
        "search-postings",
    )
    size = len(vocabulary)
    counts = np.zeros(size + 2, dtype=np.int64)
    found = postings.select("n", "terms").mapInArrow(_frequencies(size), "at bigint, value bigint")
    for at, value in found.groupBy("at").agg(F.sum("value")).collect():
        counts[at] = value
    df, n_docs, n_terms = counts[:size], int(counts[size]), int(counts[size + 1])
    if not n_terms:
        return None
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], dtype=np.int64)
    sent = spark.sparkContext.broadcast(([_plan(b, vocabulary) for b in blocks], weights, n_docs, n_terms))
    arrow_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[item_type]
    scored = postings.where("n > 0").mapInArrow(
        _ranked(sent, arrow_type, k), f"item_id {item_type}, doc_id bigint, score bigint"
    )
    return scored


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the `k` best documents with a score above 0 of each item.

    `docs` has (doc_id, text), `items` (item_id, text); other columns are not read. Statistics
    and scores cover every row and whole texts. Equal scores go to the smaller doc_id, null ids
    last; each row is a document of its own, also one that repeats another. Items that share an
    id (also null) are one item with the terms of all their texts. Texts that are null, empty or
    hold no term count as no document; items without terms, and empty tables, give no rows.
    Terms meet by 64-bit hashes. Items beyond `SCAN_ITEMS` take further passes over the texts.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    pairs = stage(item_terms(items), "search-items")
    item_type = pairs.schema["item_id"].dataType.simpleString()
    if item_type not in ("bigint", "int", "string"):
        pairs, item_type = pairs.withColumn("item_id", F.col("item_id").cast("string")), "string"
    item = F.xxhash64("item_id")
    n_pairs, n_items = pairs.agg(F.count("*"), F.countDistinct(item)).first()
    scans = max(1, -(-n_pairs // SCAN_PAIRS), -(-n_items // SCAN_ITEMS))
    blocks = max(1, -(-n_items // (scans * BLOCK_ITEMS)))
    pairs = pairs.withColumn("item", item).select(
        "item_id", "item", "term", F.pmod("item", F.lit(scans)).alias("scan"),
        F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block"),
    )
    parts = [_scan(docs, pairs.where(F.col("scan") == s), item_type, k) for s in range(scans)]
    parts = [p for p in parts if p is not None]
    if not parts:
        return spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id bigint, score bigint")
    scored = parts[0]
    for part in parts[1:]:
        scored = scored.unionByName(part)
    best = [F.desc("score"), F.asc_nulls_last("doc_id")]
    few = Window.partitionBy("item_id", F.pmod(F.xxhash64("doc_id"), F.lit(16))).orderBy(*best)
    order = Window.partitionBy("item_id").orderBy(*best)
    return (
        scored.withColumn("rank", F.row_number().over(few))
        .where(F.col("rank") <= k)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("item_id", "rank", "doc_id", "score")
    )
