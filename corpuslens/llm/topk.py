"""Exact top-k by inner product: a Voronoi join.

Rows and queries belong to the cell of their nearest pivot; there are about as many pivots
as the root of the rows. Summaries of the cells (rows, radius, queries' radius) give for each
group of queries - those of one cell - a lower bound of the k-th best score of all of them,
and an upper bound of what any cell can hold for them: only cells that can matter are visited.
Cells are bundled into blocks, groups into chunks; a row goes to the chunks that visit its
cell, a query to the blocks its group visits, each meeting is one bounded task, in which a
group is compared with the cells it visits alone. The meetings' best k are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf

from corpuslens.functions.hashing import hash_key
from corpuslens.session import stage

SCALE = 256
#: Bounds the pivots, and the table of (group, cell) pairs by its square.
MAX_PIVOTS = 4096
EXACT = 1 << 53


def _matrix(values: pd.Series) -> np.ndarray:
    return np.stack(values.to_numpy()).astype(np.float64) if len(values) else np.zeros((0, 0))


def scaled(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v array<bigint>): floor(256 x) of every component; invalid vectors are left out.

    Invalid: a null id or vector, an empty one, a null or non-finite component.
    """
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    good = (
        F.col(vec_id).isNotNull()
        & F.col(vector).isNotNull()
        & (F.size(vector) > 0)
        & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(math.inf)), F.lit(False)))
    )
    return vectors.where(good).select(
        F.col(vec_id).cast("bigint").alias("vec_id"), F.transform(x, lambda c: F.floor(c * SCALE)).alias("v")
    )


def _nearest(pivots):
    @pandas_udf("cell int, dist double")
    def nearest(v: pd.Series) -> pd.DataFrame:
        p, x = pivots.value, _matrix(v)
        dist = np.empty(len(x))
        cell = np.empty(len(x), dtype=np.int32)
        for low in range(0, len(x), 4096):
            part = x[low : low + 4096]
            square = (part**2).sum(1)[:, None] + (p**2).sum(1)[None] - 2.0 * part @ p.T
            cell[low : low + 4096] = square.argmin(1)
            dist[low : low + 4096] = np.linalg.norm(part - p[cell[low : low + 4096]], axis=1)
        return pd.DataFrame({"cell": cell, "dist": dist})

    return nearest


def visited_cells(pivots: np.ndarray, rows: np.ndarray, radius: np.ndarray, asked: np.ndarray, k: int) -> np.ndarray:
    """(groups, cells): whether a cell can hold one of the k best of a query of the group.

    `rows` and `radius` are the cells' row counts and largest distances from the pivot, `asked` the
    largest distance of a cell's queries from it (negative: the cell has no queries).
    """
    product = pivots @ pivots.T
    size = np.linalg.norm(pivots, axis=1)
    far = np.maximum(asked, 0.0)
    apart = far[:, None] * size[None] + size[:, None] * radius[None] + far[:, None] * radius[None]
    apart += 1e-6 * (1.0 + np.abs(product) + apart)
    low, high = product - apart, product + apart
    order = np.argsort(-low, axis=1, kind="stable")
    held = np.cumsum(rows[order], axis=1) >= k + 1  # one of the rows may be the query itself
    each = np.arange(len(pivots))
    at = np.where(held.any(axis=1), held.argmax(axis=1), 0)
    bound = np.where(held.any(axis=1), low[each, order[each, at]], -np.inf)
    return (high >= bound[:, None]) & (asked >= 0)[:, None]


def _bundles(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(first bundle, number of bundles) of each cell: small cells share one, a large cell has several."""
    first, number = np.zeros(len(sizes), dtype=np.int64), np.ones(len(sizes), dtype=np.int64)
    bundle, held = -1, limit
    for i, n in enumerate(sizes.tolist()):
        if n > limit or held + n > limit:
            bundle, held = bundle + 1, 0
        first[i] = bundle
        if n > limit:
            number[i] = -(-n // limit)
            bundle += number[i] - 1
            held = limit
        else:
            held += n
    return first, number


def _best(k: int, shared):
    schema = "query_id bigint, vec_id bigint, score bigint"

    def of_group(ids: np.ndarray, base: np.ndarray, names: np.ndarray, asked: np.ndarray) -> Iterator[pd.DataFrame]:
        """`ids` rise; the k best (score, smaller id) of each query."""
        for low in range(0, len(asked), 512):
            score = asked[low : low + 512] @ base.T
            own = names[low : low + 512]
            take = min(k + 1, score.shape[1])
            # the k+1 best by (score, smaller id): arg-partition on the score alone may cut a tie
            # the wrong way, so everything not below the (k+1)-th score is kept and ranked
            edge = np.partition(score, score.shape[1] - take, axis=1)[:, score.shape[1] - take]
            q, r = np.nonzero(score >= edge[:, None])
            keep = ids[r] != own[q]
            q, r = q[keep], r[keep]
            best = np.lexsort((ids[r], -score[q, r], q))
            q, r = q[best], r[best]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            q, r = q[rank < k], r[rank < k]
            yield pd.DataFrame({"query_id": own[q], "vec_id": ids[r], "score": score[q, r].astype(np.int64)})

    def solve(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(rows) and len(queries):
            visits = shared.value
            order = np.argsort(rows["vec_id"].to_numpy(), kind="stable")
            ids, cell = rows["vec_id"].to_numpy()[order], rows["cell"].to_numpy()[order]
            base, asked = _matrix(rows["v"])[order], _matrix(queries["v"])
            peak = np.abs(base).max(initial=1) * np.abs(asked).max(initial=1) * base.shape[1]
            if peak >= EXACT:
                base = np.stack(rows["v"].to_numpy())[order].astype(np.int64)
                asked = np.stack(queries["v"].to_numpy()).astype(np.int64)
            names, group = queries["query_id"].to_numpy(), queries["cell"].to_numpy()
            alike: dict[bytes, list[int]] = {}
            for g in np.unique(group):  # groups that visit the same cells of this block go together
                seen = visits[g][cell]
                if seen.any():
                    alike.setdefault(np.packbits(seen).tobytes(), []).append(g)
            for groups in alike.values():
                seen = np.flatnonzero(visits[groups[0]][cell])
                mine = np.flatnonzero(np.isin(group, groups))
                parts += of_group(ids[seen], base[seen], names[mine], asked[mine])
        return pd.concat(parts) if parts else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    return solve, schema


class VoronoiJoin:
    """The summaries and the plan of one join; `visits[g, c]` tells whether group g is compared with cell c."""

    def __init__(self, vectors: DataFrame, is_query, k: int = 5, block_rows: int = 32_768, group_queries: int = 32_768):
        self.spark, self.k, self.is_query = vectors.sparkSession, k, is_query
        data = stage(scaled(vectors).dropDuplicates(["vec_id", "v"]), "topk-vectors")
        n, short, long = data.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v"))).first()
        self.visits = np.zeros((0, 0), dtype=bool)
        if not n:
            return
        if short != long:
            raise ValueError(f"vectors of length {short} and {long}")
        sample = data.orderBy(hash_key("vec_id", "pivot"), "vec_id").limit(min(MAX_PIVOTS, math.isqrt(n - 1) + 1)).collect()
        pivots = np.unique(np.array([r["v"] for r in sample], dtype=np.float64), axis=0)
        nearest = _nearest(self.spark.sparkContext.broadcast(pivots))
        self.placed = stage(data.withColumn("at", nearest("v")).select("vec_id", "v", "at.cell", "at.dist"), "topk-placed")
        asked = F.when(is_query, F.col("dist"))
        found = self.placed.groupBy("cell").agg(
            F.count("*").alias("n"), F.max("dist").alias("r"), F.max(asked).alias("q"), F.count(asked).alias("m")
        )
        cells = np.zeros(len(pivots), dtype=[("n", "i8"), ("r", "f8"), ("q", "f8"), ("m", "i8")])
        cells["q"] = -1.0
        for c in found.collect():
            cells[c["cell"]] = (c["n"], c["r"], -1.0 if c["q"] is None else c["q"], c["m"])
        self.visits = visited_cells(pivots, cells["n"], cells["r"], cells["q"], k) & (cells["n"] > 0)[None]
        self.blocks, self.chunks = _bundles(cells["n"], block_rows), _bundles(cells["m"], group_queries)

    def _ways(self, own: tuple, other: tuple, visits: np.ndarray) -> DataFrame:
        """(cell, first, number, targets): the own bundles of each cell, and those of the cells it meets."""
        rows = []
        for cell, seen in enumerate(visits):
            targets = {int(t) + i for t, m in zip(other[0][seen], other[1][seen]) for i in range(int(m))}
            if targets:
                rows.append((cell, int(own[0][cell]), int(own[1][cell]), sorted(targets)))
        return self.spark.createDataFrame(rows, "cell int, first bigint, number bigint, targets array<bigint>")

    def answers(self) -> DataFrame:
        if not self.visits.any():
            return self.spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
        mine = F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("number"))
        # the two tables of ways have at most MAX_PIVOTS rows
        rows = self.placed.join(F.broadcast(self._ways(self.blocks, self.chunks, self.visits.T)), "cell").select(
            "vec_id", "v", "cell", mine.alias("block"), F.explode("targets").alias("chunk")
        )
        asked = self.placed.where(self.is_query).join(
            F.broadcast(self._ways(self.chunks, self.blocks, self.visits)), "cell"
        )
        asked = asked.select(
            F.col("vec_id").alias("query_id"), "v", "cell", mine.alias("chunk"), F.explode("targets").alias("block")
        )
        rows, asked = rows.toDF(*rows.columns), asked.toDF(*asked.columns)
        solve, schema = _best(self.k, self.spark.sparkContext.broadcast(self.visits))
        partial = (
            rows.groupBy("block", "chunk").cogroup(asked.groupBy("block", "chunk")).applyInPandas(solve, schema)
        )
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return (
            partial.withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= self.k)
            .select("query_id", "rank", "vec_id", "score")
        )


def inner_product_topk(
    vectors: DataFrame, is_query, k: int = 5, block_rows: int = 32_768, group_queries: int = 32_768
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best other rows of each query row.

    `vectors` has (vec_id, embedding); `is_query` is a condition on vec_id. Scores are
    integer inner products of `scaled` vectors, ties go to the smaller vec_id, a query
    with fewer than k candidates returns all. Invalid vectors take no part. Rows that
    repeat an id and a vector count once; an id with several vectors is a candidate with each
    of them, and as a query is answered by the best for any. No id answers itself.
    Vectors of different lengths are an error. An empty table gives no rows.
    """
    return VoronoiJoin(vectors, is_query, k, block_rows, group_queries).answers()
