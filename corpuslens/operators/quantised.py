"""An approximate index of stored vectors: cells of short codes, exact scores for a shortlist.

Every valid row is indexed. It belongs to the cell of its nearest pivot and is stored as a
product-quantised code: its unit vector is cut into subspaces of `SUBSPACE` columns, each
replaced by the number of its nearest centroid, one byte. Pivots and centroids are fitted
on a bounded sample; nothing else is.

A query is sent once to each block that holds a cell it visits. There it is compared with
the codes through a table of its products with the centroids, and only its `shortlist` best
leave the task. After the merge the vectors of the shortlist alone are read and scored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from corpuslens.functions.hashing import hash_unit
from corpuslens.operators.neighbors import (
    COPY_RATIO,
    SCORE_DIGITS,
    _matrix,
    _squared,
    _top_cells,
    cosine_topk,
    recall_share,
    shared_blocks as _blocks,
)
from corpuslens.operators.relational import sample_n
from corpuslens.session import stage

SUBSPACE = 4
#: Rows the pivots and centroids are fitted on, fewer where that many rows hold more numbers than the second bound.
SAMPLE, SAMPLE_NUMBERS = 8192, 4 << 20
MAX_CELLS = 4096
CENTROIDS, ROUNDS = 256, 12
SLICE = 128
#: Queries that one block of codes meets in one task.
CHUNK_QUERIES = 2048


def _valid(vec: str) -> Column:
    x = F.col(vec)
    finite = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(math.inf)), F.lit(False)))
    return x.isNotNull() & (F.size(x) > 0) & finite


def _closest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    found = [_squared(rows[i : i + 1024], centres).argmin(axis=1) for i in range(0, len(rows), 1024)]
    return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)


def fit_centroids(rows: np.ndarray, centroids: int = CENTROIDS, rounds: int = ROUNDS) -> np.ndarray:
    """At most `centroids` means of `rows`, which start from evenly spaced different rows."""
    different = np.unique(rows, axis=0)
    centres = different[np.linspace(0, len(different) - 1, min(centroids, len(different))).astype(int)]
    for _ in range(rounds):
        near = _closest(rows, centres)
        held = np.bincount(near, minlength=len(centres))
        for j in range(rows.shape[1]):
            total = np.bincount(near, rows[:, j], len(centres))
            centres[:, j] = np.where(held > 0, total / np.maximum(held, 1), centres[:, j])
    return centres


class QuantisedIndex:
    """Index of the rows of `base`, by cosine.

    Rows with a null id, or a vector that is null, empty or holds null or non-finite entries,
    are left out, of the index and of the queries alike; a zero vector has cosine 0 to all.
    Ids are unique. Vectors of different lengths are an error.
    """

    def __init__(
        self, base: DataFrame, id_col: str = "vec_id", vec: str = "embedding", sample: int = SAMPLE, block_rows: int = 32_768
    ):
        self.id_col, self.vec, self.block_rows, self.spark = id_col, vec, block_rows, base.sparkSession
        self.base = self._read(base, "base_id")
        self.id_type = self.base.schema["base_id"].dataType
        size = self.base.agg(
            F.count("*").alias("n"),
            F.approx_count_distinct(F.xxhash64("vec")).alias("d"),
            F.min(F.size("vec")).alias("short"),
            F.max(F.size("vec")).alias("long"),
        ).first()
        self.n, self.copies = size.n, size.n > COPY_RATIO * size.d
        if not self.n:
            return
        if size.short != size.long:
            raise ValueError(f"vectors of length {size.short} and {size.long}")
        self.width = size.long
        take = max(1, min(sample, SAMPLE_NUMBERS // self.width))
        drawn = self.base.where(hash_unit("base_id", "quantised") < 2.0 * take / self.n)
        rows = sample_n(drawn, take, id_col="base_id").select("vec").collect()
        unit = _matrix(pd.Series([r.vec for r in rows]), True) if rows else np.zeros((1, self.width))
        self.pivots = np.unique(unit[: min(MAX_CELLS, math.isqrt(self.n - 1) + 1)], axis=0)
        self.columns = np.array_split(np.arange(self.width), -(-self.width // SUBSPACE))
        self.books = [fit_centroids(unit[:, c].copy()) for c in self.columns]
        self.model = self.spark.sparkContext.broadcast((self.pivots, self.columns, self.books))
        same = [F.xxhash64("vec").alias("same"), F.xxhash64(F.reverse("vec")).alias("same2")]
        coded = self.base.select("base_id", *same, self._encoder()("vec").alias("at"))
        self.codes = stage(coded.select("base_id", "same", "same2", "at.cell", "at.code"), "codes")
        self.rows = np.zeros(len(self.pivots), dtype=np.int64)
        for r in self.codes.groupBy("cell").count().collect():  # at most MAX_CELLS rows
            self.rows[r.cell] = r["count"]

    def _read(self, rows: DataFrame, name: str) -> DataFrame:
        read = rows.select(F.col(self.id_col).alias(name), F.col(self.vec).cast("array<double>").alias("vec"))
        return read.where(F.col(name).isNotNull() & _valid("vec"))

    def _encoder(self):
        model = self.model

        @F.pandas_udf("cell int, code binary")
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            pivots, columns, books = model.value
            for batch in batches:
                if not len(batch):
                    yield pd.DataFrame({"cell": [], "code": []})
                    continue
                unit = _matrix(batch, True)
                code = np.stack([_closest(unit[:, c], b) for c, b in zip(columns, books)], axis=1).astype(np.uint8)
                yield pd.DataFrame({"cell": _closest(unit, pivots).astype(np.int32), "code": [c.tobytes() for c in code]})

        return encode

    def _routed(self, queries: DataFrame, probe: int, first: np.ndarray, parts: np.ndarray) -> DataFrame:
        """One row for each query and block it meets, with the cells it visits there."""
        model, filled = self.model, np.flatnonzero(self.rows)

        def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            pivots = model.value[0][filled]
            for batch in batches:
                for low in range(0, len(batch), 1024):
                    part = batch.iloc[low : low + 1024]
                    order = np.argsort(_squared(_matrix(part["vec"], True), pivots), axis=1, kind="stable")
                    out: list[tuple] = []
                    for asker, vector, near in zip(part["query_id"], part["vec"], order[:, :probe]):
                        met: dict[int, list[int]] = {}
                        for cell in filled[near].tolist():
                            for block in range(first[cell], first[cell] + parts[cell]):
                                met.setdefault(int(block), []).append(cell)
                        out += [(asker, vector, block, cells) for block, cells in met.items()]
                    yield pd.DataFrame(out, columns=["query_id", "vec", "block", "cells"])

        schema = T.StructType([queries.schema["query_id"], queries.schema["vec"]])
        schema = schema.add("block", T.IntegerType()).add("cells", T.ArrayType(T.IntegerType()))
        return queries.mapInPandas(route, schema)

    def candidates(
        self, queries: DataFrame, k: int = 1, probe: int | None = None, shortlist: int | None = None, exclude_self: bool = False
    ) -> DataFrame:
        """query_id, base_id: the `shortlist` rows with the best codes in the `probe` nearest cells (all cells if not given)."""
        shortlist = max(k, shortlist or 16 * k)
        asked = self._read(queries, "query_id")
        pair = T.StructType().add("query_id", asked.schema["query_id"].dataType).add("base_id", self.id_type)
        if not self.n:
            return self.spark.createDataFrame([], pair)
        first, parts = _blocks(self.rows, self.block_rows)
        routed = stage(self._routed(asked, probe or len(self.pivots), first, parts), "routed")
        load = [(r.block, -(-r["count"] // CHUNK_QUERIES)) for r in routed.groupBy("block").count().collect()]
        # one row a block: at most MAX_CELLS blocks and two for each block_rows rows
        chunks = self.spark.createDataFrame(load, "block int, chunks int")
        codes = self.codes
        if self.copies:
            # of equal vectors only the smallest ids can be among the k best; cut before the shuffle
            same = Window.partitionBy("same", "same2").orderBy("base_id")
            codes = codes.withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k + 1)
        place = self.spark.createDataFrame(
            [(c, int(first[c]), int(parts[c])) for c in range(len(first))], "cell int, first int, parts int"
        )  # at most MAX_CELLS rows
        left = routed.join(chunks, "block").withColumn("chunk", F.expr("int(pmod(xxhash64(query_id), chunks))"))
        right = (
            codes.join(F.broadcast(place), "cell")
            .withColumn("block", F.expr("int(first + pmod(xxhash64(base_id), parts))"))
            .join(chunks, "block")
            .withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)")))
            .select("base_id", "cell", "code", "block", "chunk")
        )
        left = left.select("query_id", "vec", "cells", "block", "chunk")
        model, n_cells = self.model, len(self.pivots)

        def search(asked: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
            found = [pd.DataFrame(columns=["query_id", "base_id", "near"])]
            if len(asked) and len(stored):
                _, columns, books = model.value
                stored = stored.sort_values("base_id")
                ids, cell = stored["base_id"].to_numpy(), stored["cell"].to_numpy()
                code = np.frombuffer(b"".join(stored["code"]), dtype=np.uint8).reshape(len(ids), -1)
                for low in range(0, len(asked), SLICE):
                    part = asked.iloc[low : low + SLICE]
                    unit = _matrix(part["vec"], True)
                    near = np.zeros((len(ids), len(part)))
                    for j, (c, book) in enumerate(zip(columns, books)):
                        near += (book @ unit[:, c].T)[code[:, j]]  # whole rows are gathered
                    near = np.ascontiguousarray(near.T)
                    seen = np.zeros((len(part), n_cells), dtype=bool)
                    for i, cells in enumerate(part["cells"]):
                        seen[i, cells] = True
                    near[~seen[:, cell]] = -np.inf
                    asker = part["query_id"].to_numpy()
                    if exclude_self:
                        near[asker[:, None] == ids[None, :]] = -np.inf
                    row, col = _top_cells(near, min(shortlist, len(ids)))
                    found.append(pd.DataFrame({"query_id": asker[row], "base_id": ids[col], "near": near[row, col]}))
            return pd.concat(found[1:] or found, ignore_index=True)

        key = ["block", "chunk"]
        met = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(
            search, T.StructType([*pair, T.StructField("near", T.DoubleType())])
        )
        order = Window.partitionBy("query_id").orderBy(F.desc("near"), "base_id")
        # row_number <= shortlist is cut on the map side before the shuffle
        ranked = met.withColumn("rank", F.row_number().over(order))
        return ranked.where(F.col("rank") <= shortlist).select("query_id", "base_id")

    def rerank(self, candidates: DataFrame, queries: DataFrame, k: int = 1) -> DataFrame:
        """query_id, rank, base_id, score: the k candidates of each query with the largest cosine, ties to the smaller id."""
        asked = self._read(queries, "query_id").withColumnRenamed("vec", "q")

        def dot(a: str, b: str) -> Column:
            return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

        size = F.sqrt(dot("q", "q")) * F.sqrt(dot("vec", "vec"))
        score = F.when(size > 0, dot("q", "vec") / size).otherwise(0.0)
        scored = candidates.join(self.base, "base_id").join(asked, "query_id")
        scored = scored.select("query_id", "base_id", (F.round(score, SCORE_DIGITS) + 0.0).alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "base_id")
        ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return ranked.select("query_id", "rank", "base_id", "score")

    def topk(self, queries: DataFrame, k: int = 1, probe: int | None = None, shortlist: int | None = None, exclude_self: bool = False) -> DataFrame:
        """query_id, rank (from 1), base_id, score: approximate neighbours with their exact cosines."""
        return self.rerank(self.candidates(queries, k, probe, shortlist, exclude_self), queries, k)

    def settings_for(self, queries: DataFrame, recall: float, sample: int = 400) -> dict[str, int]:
        """`probe` and `shortlist` with which a sample of the queries finds its nearest row three standard errors above `recall`.

        The cells that hold the sample's exact answers give `probe`; `shortlist` doubles until the
        recall holds, and where it has reached all rows the visited cells grow: all of both is exact.
        """
        if not self.n:
            return {"probe": 1, "shortlist": 1}
        rows = queries.select(self.id_col, self.vec).where(F.col(self.id_col).isNotNull())
        asked = stage(sample_n(rows.where(_valid(self.vec)), sample, id_col=self.id_col), "sample")
        stored = self.base.select(F.col("base_id").alias(self.id_col), F.col("vec").alias(self.vec))
        exact = stage(cosine_topk(asked, stored, 1, self.id_col, self.vec), "sample")
        answers = (
            exact.join(self.codes.select("base_id", "cell"), "base_id")
            .join(self._read(asked, "query_id"), "query_id")
            .select("vec", "cell")
            .collect()
        )  # at most `sample` rows
        if not answers:
            return {"probe": 1, "shortlist": 1}
        wanted = min(1.0, recall + 3 * math.sqrt(recall * (1 - recall) / len(answers)))
        filled = np.flatnonzero(self.rows)
        distance = _squared(_matrix(pd.Series([a.vec for a in answers]), True), self.pivots[filled])
        own = distance[np.arange(len(answers)), np.searchsorted(filled, [a.cell for a in answers])]
        place = np.sort((distance < own[:, None]).sum(axis=1)) + 1
        probe = int(place[min(len(place), math.ceil((1 + wanted) / 2 * len(place))) - 1])
        shortlist = 4
        while True:
            found = recall_share(self.topk(asked, 1, probe, shortlist), exact).first()
            if found.recall >= wanted or (shortlist >= self.n and probe >= len(filled)):
                return {"probe": probe, "shortlist": shortlist}
            if shortlist >= self.n:
                probe = min(len(filled), 2 * probe)
            shortlist = min(self.n, 2 * shortlist)
