"""Nearest neighbours over stored vectors, exact and distributed.

Base vectors are assigned to cells around sampled pivots. A hot cell (a third of all
vectors close together) is cut into blocks of bounded size, so it is many tasks; small
cells share a block, so a query travels once to each block, not to each cell. Of copies
of one vector only as many as can be among the k nearest are searched. A query first searches its own cell; the
k-th score found there bounds how far a better neighbour can be, and only the
cells that the triangle inequality cannot exclude are searched after that. The
result is exact. Inside a task, the queries that visit a cell meet its vectors
as a matrix product and only the k best per query leave the task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from corpuslens.functions.hashing import hash_unit
from corpuslens.operators.relational import sample_n
from corpuslens.session import stage

SCORE_DIGITS = 9
SLACK = 1e-6
COPY_RATIO = 1.3
BLOCK_BYTES = 8 << 20
#: A query meets at most this many shared blocks while those have less than BLOCK_BYTES.
MAX_SHARED = 64
#: Numbers of one matrix of distances or scores, and of the scores kept before they are cut to the best.
MATRIX_CELLS, KEPT_CELLS = 1 << 20, 1 << 20


def _matrix(column: pd.Series, cosine: bool) -> np.ndarray:
    rows = np.stack(column.to_numpy()).astype(np.float64)
    if cosine:
        length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
        rows = np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)
    return rows


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances: by differences for a few columns (exact zeros), else by a product."""
    if a.shape[1] <= 32:
        total = np.zeros((len(a), len(b)))
        for j in range(a.shape[1]):
            total += np.square(a[:, j, None] - b[None, :, j])
        return total
    cross = a @ b.T
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * cross, 0.0)


def _top_cells(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best finite scores per row; of equal scores the first column."""
    kth = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
    row, col = np.nonzero((score >= kth[:, None]) & np.isfinite(score))
    order = np.lexsort((col, -score[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
    return row[place < k], col[place < k]


def _best(row: np.ndarray, col: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row; of equal scores the first column."""
    order = np.lexsort((col, -score, row))
    row, col, score = row[order], col[order], score[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row, side="left") < k
    return row[kept], col[kept], score[kept]


def _block_topk(k: int, cosine: bool, exclude_self: bool, with_vector: bool):
    """Top k of one block of base vectors for some queries, each in the cells it visits."""

    def search(queries: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "base_id", "score"] + (["vector"] if with_vector else [])
        if queries.empty or base.empty:
            return pd.DataFrame(columns=columns)
        base = base.sort_values("base_id")
        ids, cell, asker = base["base_id"].to_numpy(), base["cell"].to_numpy(), queries["query_id"].to_numpy()
        visits = np.repeat(np.arange(len(queries)), queries["cells"].map(len).to_numpy())
        wanted = np.concatenate(queries["cells"].to_list())
        order = np.argsort(wanted, kind="stable")
        visits, wanted = visits[order], wanted[order]
        found, held = [(np.zeros(0, dtype=int), np.zeros(0, dtype=int), np.zeros(0))], 0
        for c in np.unique(cell):
            own = np.flatnonzero(cell == c)
            low, high = np.searchsorted(wanted, [c, c + 1])
            stored = _matrix(base["vec"].iloc[own], cosine)
            step = max(128, MATRIX_CELLS // len(own))
            for start in range(low, high, step):
                part = visits[start : min(high, start + step)]
                asked = _matrix(queries["vec"].iloc[part], cosine)
                score = asked @ stored.T if cosine else -np.sqrt(_squared(asked, stored))
                score = np.round(score, SCORE_DIGITS) + 0.0
                if exclude_self:
                    score[asker[part][:, None] == ids[own][None, :]] = -np.inf
                row, col = _top_cells(score, min(k, len(own)))
                found.append((part[row], own[col], score[row, col]))
                held += len(row)
                if held > KEPT_CELLS:
                    found = [_best(*map(np.concatenate, zip(*found)), k)]
                    held = 0
        row, col, score = _best(*map(np.concatenate, zip(*found)), k)
        out = {"query_id": asker[row], "base_id": ids[col], "score": score}
        if with_vector:
            raw = base["vec"].to_numpy()
            out["vector"] = [raw[c] for c in col]
        return pd.DataFrame(out)

    return search


def _slices(rows: int, width: int) -> Iterator[slice]:
    """Rows whose distances to `width` pivots make a matrix of bounded size."""
    step = max(64, MATRIX_CELLS // max(1, width))
    return (slice(low, low + step) for low in range(0, rows, step))


def _nearest(vectors: pd.Series, pivots: np.ndarray, cosine: bool, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(the n nearest pivots, the distance of the first) of each vector."""
    cells, distance = [np.zeros((0, min(n, len(pivots))), dtype=np.int32)], [np.zeros(0)]
    for part in _slices(len(vectors), len(pivots)):
        d = _squared(_matrix(vectors.iloc[part], cosine), pivots)
        if n == 1:
            order = np.where(np.isnan(d), np.inf, d).argmin(axis=1)[:, None]
        else:
            order = np.argsort(d, axis=1, kind="stable")[:, :n]
        cells.append(order.astype(np.int32))
        distance.append(np.sqrt(np.take_along_axis(d, order[:, :1], 1))[:, 0])
    return np.concatenate(cells), np.concatenate(distance)


def _nearest_cell(pivots: np.ndarray, cosine: bool):
    @F.pandas_udf("cell int, distance double")
    def assign(vectors: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in vectors:
            cells, distance = _nearest(batch, pivots, cosine, 1)
            yield pd.DataFrame({"cell": cells[:, 0], "distance": distance})

    return assign


#: Blocks of each cell of a group: the first one (-1: no rows) and how many.
Layout = dict[str, tuple[np.ndarray, np.ndarray]]
VISITS = "array<struct<block: int, cells: array<int>>>"


def _visits(cells: np.ndarray, first: np.ndarray, parts: np.ndarray) -> list[dict]:
    """The blocks that hold these cells, each with those that it holds."""
    cells = cells[first[cells] >= 0]
    if not len(cells):
        return []
    block = first[cells]
    order = np.argsort(block, kind="stable")
    cells, block = cells[order], block[order]
    cuts = np.flatnonzero(np.diff(block)) + 1
    return [
        {"block": int(b) + i, "cells": own}
        for b, own in zip(block[np.concatenate([[0], cuts])], np.split(cells, cuts))
        for i in range(parts[own[0]])
    ]


def _near_visits(pivots: np.ndarray, layout: Layout, cosine: bool, n: int):
    """The nearest cell, and the visits of the n nearest ones."""

    @F.pandas_udf(f"cell int, visits {VISITS}")
    def route(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for vectors, groups in batches:
            cells = _nearest(vectors, pivots, cosine, n)[0]
            visits = [_visits(own, *layout[g]) if g in layout else [] for own, g in zip(cells, groups)]
            yield pd.DataFrame({"cell": cells[:, 0], "visits": pd.Series(visits, dtype=object)})

    return route


def _open_visits(pivots: np.ndarray, layout: Layout, radius: dict[str, np.ndarray], cosine: bool):
    """Visits of the cells other than the searched one that may still hold a better neighbour."""

    @F.pandas_udf(VISITS)
    def visit(
        batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]],
    ) -> Iterator[pd.Series]:
        for vectors, groups, searched, kth in batches:
            worst = kth.to_numpy(dtype=np.float64, na_value=-np.inf)
            reach = np.sqrt(np.maximum(2.0 - 2.0 * worst, 0.0)) if cosine else -worst
            out: list[list[dict]] = []
            for part in _slices(len(vectors), len(pivots)):
                distance = np.sqrt(_squared(_matrix(vectors.iloc[part], cosine), pivots))
                for own, group, cell, far in zip(distance, groups.iloc[part], searched.iloc[part], reach[part]):
                    if group not in layout:
                        out.append([])
                        continue
                    near = own - radius[group] <= far * (1 + SLACK) + SLACK
                    near[cell] = False
                    out.append(_visits(np.flatnonzero(near).astype(np.int32), *layout[group]))
            yield pd.Series(out, dtype=object)

    return visit


def shared_blocks(rows: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(first block, number of blocks) of each cell: small cells share one, a large cell has several."""
    parts = np.maximum(1, -(-rows // limit))
    large = parts > 1
    shared = np.cumsum(np.where(large, 0, rows)) // limit
    after = shared.max() + 1 + np.cumsum(np.where(large, parts, 0)) - parts
    return np.where(large, after, shared), parts


@dataclass(frozen=True)
class Cells:
    """Base vectors in their cells (`base_id, vec, g, cell, distance`), the pivots, and rows and radius by group and cell."""

    placed: DataFrame
    pivots: np.ndarray | None
    stats: list
    width: int

    def layout(self, block_rows: int | None) -> Layout:
        most = max(256, BLOCK_BYTES // (8 * (self.width or 1)))
        total = sum(r.n for r in self.stats)
        limit = most if block_rows is None else max(block_rows, min(most, -(-total // MAX_SHARED)))
        n_cells = 1 if self.pivots is None else len(self.pivots)
        rows: dict[str, np.ndarray] = {}
        for r in self.stats:
            if r.g is not None:
                rows.setdefault(r.g, np.zeros(n_cells, dtype=np.int64))[r.cell] = r.n
        out, low = {}, 0
        for g, own in sorted(rows.items()):
            first, parts = shared_blocks(own, limit)
            out[g] = np.where(own > 0, first + low, -1), parts
            low += int((first + parts).max())
        return out


def _pivot_rows(b: DataFrame, n_cells: int, n: int, cosine: bool) -> np.ndarray:
    """The first `n_cells` vectors in hash order; a task offers only rows below a bound that surely holds enough."""
    below = F.coalesce(hash_unit("base_id") < F.lit((2.0 * n_cells + 100) / n), F.lit(True))
    rows = sample_n(b.where(below), n_cells, id_col="base_id").select("vec").collect()
    if len(rows) < n_cells:
        rows = sample_n(b, n_cells, id_col="base_id").select("vec").collect()
    return _matrix(pd.Series([r.vec for r in rows]), cosine)


def place_cells(
    base: DataFrame,
    k: int,
    *,
    base_id: str,
    vec: str,
    by: str | None = None,
    metric: str = "cosine",
    cell_rows: int = 10_000,
    max_cells: int = 2048,
) -> Cells:
    """The cells that `knn_join` with the same arguments searches."""
    cosine, group = metric == "cosine", F.col(by).cast("string") if by else F.lit("")
    b = base.select(
        F.col(base_id).alias("base_id"), F.col(vec).cast("array<double>").alias("vec"), group.alias("g")
    )
    size = b.agg(
        F.count("*").alias("n"),
        F.approx_count_distinct(F.xxhash64("vec")).alias("d"),
        F.max(F.size("vec")).alias("width"),
    ).first()
    n = size.n
    if n > COPY_RATIO * size.d:
        # Of equal vectors only the smallest ids can be among the k nearest (one more
        # if a query may be excluded). The cut happens before the shuffle.
        same = Window.partitionBy("g", "vec").orderBy("base_id")
        b = b.withColumn("_rn", F.row_number().over(same)).where(F.col("_rn") <= k + 1).drop("_rn")
        n = b.count()
    n_cells = max(1, min(max_cells, n // cell_rows))
    pivots = None
    if n_cells > 1:
        # A bounded number of pivots; any choice is exact, a spread one prunes more.
        pivots = _pivot_rows(b, n_cells, n, cosine)
        near = _nearest_cell(pivots, cosine)(F.col("vec"))
        placed = b.withColumn("_near", near).select("*", "_near.cell", "_near.distance").drop("_near")
        placed = stage(placed, "cells")
    else:
        placed = b.withColumns({"cell": F.lit(0), "distance": F.lit(0.0)})
    stats = (
        placed.groupBy("g", "cell")
        .agg(F.count("*").alias("n"), F.max("distance").alias("radius"))
        .collect()
    )  # at most groups x max_cells rows
    return Cells(placed, pivots, stats, size.width)


def knn_join(
    queries: DataFrame,
    base: DataFrame,
    k: int = 1,
    *,
    query_id: str,
    base_id: str,
    vec: str,
    by: str | None = None,
    metric: str = "cosine",
    exclude_self: bool = False,
    with_vector: bool = False,
    cell_rows: int = 10_000,
    max_cells: int = 2048,
    block_rows: int | None = None,
    probe: int | None = None,
    cells: Cells | None = None,
) -> DataFrame:
    """`query_id, rank, base_id, score[, vector]`: the k nearest base vectors per query.

    `score` is the cosine similarity or the negative Euclidean distance; equal
    scores go to the smaller id, and a zero vector has cosine 0 to everything.
    `by` restricts neighbours to the same group. A block holds `block_rows` vectors,
    more where that would make over `MAX_SHARED` blocks, or 8 MB of numbers, and as
    many queries. With `probe` only that many nearest cells are searched (approximate);
    without it the result is exact. `cells`: those of `place_cells`, if already there.
    """
    if metric not in ("cosine", "euclidean"):
        raise ValueError(metric)
    spark, cosine = base.sparkSession, metric == "cosine"
    group = F.col(by).cast("string") if by else F.lit("")
    q = queries.select(
        F.col(query_id).alias("query_id"), F.col(vec).cast("array<double>").alias("vec"), group.alias("g")
    )
    cells = cells or place_cells(
        base, k, base_id=base_id, vec=vec, by=by, metric=metric, cell_rows=cell_rows, max_cells=max_cells
    )
    pivots, placed, layout = cells.pivots, cells.placed, cells.layout(block_rows)
    chunk_rows = max(256, BLOCK_BYTES // (8 * (cells.width or 1)))
    schema = T.StructType(
        [
            T.StructField("query_id", q.schema["query_id"].dataType),
            T.StructField("base_id", placed.schema["base_id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
        + ([T.StructField("vector", T.ArrayType(T.DoubleType()))] if with_vector else [])
    )
    search = _block_topk(k, cosine, exclude_self, with_vector)
    if not layout:
        return spark.createDataFrame([], T.StructType([*schema, T.StructField("rank", T.IntegerType())]))
    spots = [
        (g, int(c), int(first[c]), int(parts[c])) for g, (first, parts) in layout.items() for c in np.flatnonzero(first >= 0)
    ]

    def laid_out(rows: DataFrame) -> DataFrame:
        """With the first block of the cell and their number."""
        if len(spots) == 1 and not by:
            return rows.withColumns({"first": F.lit(spots[0][2]), "parts": F.lit(spots[0][3])})
        return rows.join(F.broadcast(spark.createDataFrame(spots, "g string, cell int, first int, parts int")), ["g", "cell"])

    stored = laid_out(placed).withColumn("block", F.expr("int(first + pmod(xxhash64(base_id), parts))"))

    def run(routed: DataFrame) -> DataFrame:
        """Search `routed` (query_id, vec, block, cells) in those cells of the block."""
        load = [(r.block, -(-r["count"] // chunk_rows)) for r in routed.groupBy("block").count().collect()]
        if not load:
            return best(spark.createDataFrame([], schema))
        if len(load) == 1:
            (only, n_chunks), block = load[0], F.col("block")
            left = routed.withColumn("chunks", F.lit(n_chunks))
            right = stored.where(block == only).withColumn("chunks", F.lit(n_chunks))
        else:
            chunks = F.broadcast(spark.createDataFrame(load, "block int, chunks int"))
            left, right = routed.join(chunks, "block"), stored.join(chunks, "block")
        left = left.withColumn("chunk", F.expr("int(pmod(xxhash64(query_id), chunks))")).select(
            "query_id", "vec", "cells", "block", "chunk"
        )
        right = right.withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)"))).select(
            "base_id", "vec", "cell", "block", "chunk"
        )
        key = ["block", "chunk"]
        found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(
            lambda lq, rb: search(lq, rb), schema
        )
        return best(found)

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "base_id")
        # row_number <= k is cut on the map side before the shuffle.
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def visiting(rows: DataFrame, visits: str) -> DataFrame:
        return rows.withColumn("_v", F.explode(visits)).select("query_id", "vec", "_v.block", "_v.cells")

    if pivots is None:
        asked = laid_out(q.withColumn("cell", F.lit(0)))
        return run(
            asked.withColumn("block", F.explode(F.expr("sequence(first, first + parts - 1)"))).select(
                "query_id", "vec", "block", F.array("cell").alias("cells")
            )
        )
    near = _near_visits(pivots, layout, cosine, probe or 1)(F.col("vec"), F.col("g"))
    routed = q.withColumn("_near", near).select("*", "_near.cell", "_near.visits").drop("_near")
    if probe:
        return run(visiting(routed, "visits"))
    first = stage(run(visiting(routed, "visits")), "neighbours")
    kth = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    radius: dict[str, np.ndarray] = {}
    for r in cells.stats:
        radius.setdefault(r.g, np.full(len(pivots), -np.inf))[r.cell] = r.radius
    visit = _open_visits(pivots, layout, radius, cosine)
    rest = routed.join(kth, "query_id", "left").withColumn("_open", visit("vec", "g", "cell", "kth"))
    second = run(visiting(rest, "_open")).drop("rank")
    return best(first.drop("rank").unionByName(second))


def cosine_topk(queries: DataFrame, base: DataFrame, k: int = 1, id_col: str = "vec_id", vec: str = "embedding", **opts) -> DataFrame:
    """Exact nearest stored vectors by cosine."""
    return knn_join(queries, base, k, query_id=id_col, base_id=id_col, vec=vec, **opts)


def ann_topk(queries: DataFrame, base: DataFrame, k: int = 1, probe: int = 4, **opts) -> DataFrame:
    """Approximate: only the `probe` cells nearest to a query are searched."""
    return cosine_topk(queries, base, k, probe=probe, **opts)


def recall_share(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: `n` queries of `exact` (one neighbour each) and the share of them that `found` has, or one of equal score."""
    best = exact.select("query_id", F.col("base_id").alias("first"), F.col("score").alias("best"))
    near = found.where("rank = 1").select("query_id", "base_id", "score")
    hit = (F.col("base_id") == F.col("first")) | (F.abs(F.col("score") - F.col("best")) < 10.0**-SCORE_DIGITS)
    return best.join(near, "query_id", "left").agg(
        F.count("*").alias("n"), F.avg(F.coalesce(hit, F.lit(False)).cast("double")).alias("recall")
    )


def probe_for(queries: DataFrame, base: DataFrame, recall: float, id_col: str = "vec_id", sample: int = 400, **opts) -> int:
    """Cells to search so that about `recall` of the queries find their nearest vector.

    Raised until a sample of the queries, searched exactly as well, finds it three
    standard errors above `recall`; searching all cells finds everything.
    """
    asked = stage(sample_n(queries, sample, id_col=id_col), "probe")
    exact = stage(cosine_topk(asked, base, 1, id_col, **opts), "probe")
    placing = {name: opts[name] for name in ("by", "cell_rows", "max_cells") if name in opts}
    cells = place_cells(base, 1, base_id=id_col, vec=opts.get("vec", "embedding"), **placing)
    n = asked.count()
    wanted = min(1.0, recall + 3 * math.sqrt(recall * (1 - recall) / max(1, n)))
    probe = 4
    while True:
        found = recall_share(ann_topk(asked, base, 1, probe, id_col=id_col, cells=cells, **opts), exact).first()
        if not found.n or found.recall >= wanted:
            return probe
        probe += max(1, probe // 2)


def knn_label(
    queries: DataFrame,
    base: DataFrame,
    id_col: str = "vec_id",
    vec: str = "embedding",
    label: str = "label",
    **opts,
) -> DataFrame:
    """Every query with the label of its nearest stored vector as `prediction`."""
    nearest = cosine_topk(queries, base, 1, id_col, vec, **opts).select(
        F.col("query_id").alias(id_col), "base_id", "score"
    )
    labels = base.select(F.col(id_col).alias("base_id"), F.col(label).alias("prediction"))
    return queries.select(id_col, label).join(nearest.join(labels, "base_id"), id_col)
