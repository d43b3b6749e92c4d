"""Embedding whitening by Chebyshev-filtered subspace iteration.

The covariance V of the vectors is never formed. A pass sends a small block Q to the
tasks, each task centres its rows first and adds up (x - mean)(x - mean)'Q, and the sums
of the tasks are added by Spark. A Chebyshev polynomial of V, applied by its three-term
recurrence (one pass a degree), damps the unwanted part of the spectrum; QR and
Rayleigh-Ritz then give the wanted pairs, until their residuals are at rounding level.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpuslens.llm.common import free_name
from corpuslens.session import stage

SCALE, SHIFT = 1024, 100_000
MAX_DIMENSIONS = 4096
#: Largest growth of a wanted direction against an unwanted one in one filter: beyond it, the
#: weaker wanted directions would drown in the rounding of the strongest.
MAX_GROWTH = 1e11
MAX_DEGREE = 16
LONG = 1 << 63


class NotCertified(ArithmeticError):
    """The residuals did not come down to rounding level."""


@dataclass(frozen=True)
class Whitening:
    """`n` rows with per-dimension `sums`; unit eigenvectors in columns, eigenvalues falling, trace of V."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    residual: float
    passes: int

    @property
    def projection(self) -> np.ndarray:
        return self.components / np.sqrt(self.eigenvalues)


def grid_vectors(vectors: DataFrame, vector: str = "embedding", keep: tuple[str, ...] = ()) -> DataFrame:
    """(`keep`..., x array<bigint>): floor(1024 c) + 100000 of every entry c; invalid vectors are left out.

    Invalid: null, empty, or holding a null or non-finite entry.
    """
    entries = F.transform(F.col(vector), lambda c: c.cast("double"))
    good = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(
        entries, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(math.inf)), F.lit(False))
    )
    x = F.transform(entries, lambda c: F.floor(c * SCALE).cast("bigint") + F.lit(SHIFT).cast("bigint"))
    return vectors.where(good).select(*keep, x.alias(free_name(list(keep), "x")))


def _rows(batch: pa.RecordBatch, name: str, d: int, width: int = 4096) -> Iterator[np.ndarray]:
    column = batch.column(name)
    for low in range(0, batch.num_rows, width):
        part = column.slice(low, width)
        yield part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), d)


def _added(data: DataFrame, size: int, of_rows) -> np.ndarray:
    """Sum over all rows of `of_rows(batch)`, an array of `size` numbers; every task adds up its own rows."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += of_rows(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["part"])

    parts = data.mapInArrow(partial, "part array<double>").select(F.posexplode("part").alias("at", "value"))
    out = np.zeros(size)
    for at, value in parts.groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[at] = value
    return out


class _Covariance:
    """The products V Q of the centred rows, a distributed pass each."""

    def __init__(self, data: DataFrame, name: str, n: int, sums: np.ndarray):
        self.data, self.name, self.n, self.sums, self.passes = data.select(name), name, n, sums, 0

    def __call__(self, q: np.ndarray) -> np.ndarray:
        d, b = q.shape
        n, name = self.n, self.name
        sent = self.data.sparkSession.sparkContext.broadcast((q, self.sums))

        def product(batch: pa.RecordBatch) -> np.ndarray:
            block, sums = sent.value
            total = np.zeros((d, b))
            for x in _rows(batch, name, d):
                centred = (x * n - sums) / n
                total += centred.T @ (centred @ block)
            return total.ravel()

        out = _added(self.data, d * b, product).reshape(d, b) / n
        sent.unpersist()
        self.passes += 1
        return out


def lower_end(multiply, d: int, steps: int = 8, seed: int = 42) -> float:
    """A number not above the smallest eigenvalue (0 at least), by a few Lanczos steps."""
    steps = min(steps, d)
    basis = np.zeros((d, steps))
    v = np.random.default_rng(seed).standard_normal(d)
    alpha, beta = np.zeros(steps), np.zeros(steps)
    v /= np.linalg.norm(v)
    for j in range(steps):
        basis[:, j] = v
        w = multiply(v[:, None])[:, 0]
        alpha[j] = v @ w
        w -= basis[:, : j + 1] @ (basis[:, : j + 1].T @ w)
        w -= basis[:, : j + 1] @ (basis[:, : j + 1].T @ w)
        beta[j] = np.linalg.norm(w)
        if beta[j] <= 1e-12 * max(abs(alpha[0]), 1e-300):
            return 0.0  # an invariant subspace says nothing of the rest
        v = w / beta[j]
    tri = np.diag(alpha) + np.diag(beta[:-1], 1) + np.diag(beta[:-1], -1)
    return max(0.0, float(np.linalg.eigvalsh(tri)[0] - beta[-1]))


def _degree(top: float) -> int:
    """Largest degree at which the Chebyshev polynomial at `top` (> 1) stays below `MAX_GROWTH`."""
    return max(2, min(MAX_DEGREE, int(math.acosh(MAX_GROWTH) / math.acosh(max(top, 1.0 + 1e-9)))))


def chebyshev_filter(multiply, q: np.ndarray, low: float, high: float, top: float) -> np.ndarray:
    """T_m of the map of [low, high] to [-1, 1], at V, times q; scaled so that `top` stays near 1."""
    half, centre = (high - low) / 2, (high + low) / 2
    degree = _degree((top - centre) / half)
    sigma = first = half / (top - centre)
    before, now = q, (multiply(q) - centre * q) * (sigma / half)
    for _ in range(degree - 1):
        after = 1.0 / (2.0 / first - sigma)
        before, now = now, 2.0 * after / half * (multiply(now) - centre * now) - sigma * after * before
        sigma = after
    return now


def leading_pairs(
    multiply, d: int, k: int, trace: float, tolerance: float = 1e-13, seed: int = 42, rounds: int = 40
) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues falling, unit eigenvectors in columns, largest residual over the first eigenvalue).

    The block has 4k columns. A block as wide as the space needs no filter. Certified: every
    wanted residual |Vq - eq| is at most `tolerance` times the first eigenvalue; or, where
    rounding keeps them above that, they no longer fall and are below 1e-11 times it.
    """
    b = min(d, 4 * k)
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, b)))
    low, best = None, math.inf
    for _ in range(rounds):
        image = multiply(q)
        values, turn = np.linalg.eigh((q.T @ image + image.T @ q) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, image = q @ turn, image @ turn
        top = max(values[0], 0.0)
        wanted = min(k, d)
        if top <= 1e-14 * max(trace, 1.0) or trace <= 0:
            return values[:0], q[:, :0], 0.0
        off = np.linalg.norm(image - q * values, axis=0)[:wanted].max() / top
        if b == d or off <= tolerance or (off <= 1e-11 and off > 0.5 * best):
            return values[:wanted], q[:, :wanted], float(off)
        best = min(best, off)
        if low is None:
            low = lower_end(multiply, d, seed=seed)
        high = max(values[-1], low + 1e-9 * top)
        if values[0] <= high * (1 + 1e-12):  # a flat spectrum: nothing to damp yet
            high = low + 0.5 * (values[0] - low)
        q, _ = np.linalg.qr(chebyshev_filter(multiply, q, low, high, values[0]))
    raise NotCertified(f"residual {best:.1e} of the first eigenvalue after {rounds} filters")


def fit_whitening(data: DataFrame, name: str = "x", k: int = 8) -> Whitening | None:
    """Whitening by the `k` strongest components of all rows of `data` (from `grid_vectors`); None without rows.

    Directions without variance (1e-10 of the trace or less) can't be whitened and are no
    components. Signs: the entry of largest size is positive. Vectors of different lengths,
    or of more than 4,096 entries, are an error.
    """
    n, short, long = data.agg(F.count("*"), F.min(F.size(name)), F.max(F.size(name))).first()
    if not n:
        return None
    if short != long:
        raise ValueError(f"vectors of length {short} and {long}")
    if long > MAX_DIMENSIONS:
        raise ValueError(f"vectors of {long} entries; at most {MAX_DIMENSIONS}")
    d = int(long)

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d, dtype=object)
        for batch in batches:
            for x in _rows(batch, name, d):
                if np.abs(x).max(initial=0) >= LONG // 8192:
                    raise OverflowError("entries too large for sums in 64-bit integers")
                total += x.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], names=["part"])

    parts = data.select(name).mapInArrow(columns, "part array<bigint>").select(F.posexplode("part").alias("at", "value"))
    sums = np.zeros(d, dtype=np.int64)
    for at, value in parts.groupBy("at").agg(F.sum("value")).collect():
        sums[at] = value

    def spread(batch: pa.RecordBatch) -> np.ndarray:
        return np.array([sum(float((((x * n - sums) / n) ** 2).sum()) for x in _rows(batch, name, d))])

    trace = float(_added(data.select(name), 1, spread)[0]) / n
    covariance = _Covariance(data, name, n, sums)
    values, vectors, residual = leading_pairs(covariance, d, k, trace)
    held = values > 1e-10 * trace
    values, vectors = values[held], vectors[:, held]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return Whitening(n, sums, vectors * signs, values, trace, residual, covariance.passes + 2)


def identity_error(data: DataFrame, model: Whitening, name: str = "x") -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, from one pass over them."""
    d, c = model.components.shape
    n, sums, projection = model.n, model.sums, model.projection

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        total = np.zeros((c + 1, c))
        for x in _rows(batch, name, d):
            z = ((x * n - sums) / n) @ projection
            total += np.concatenate([z.T @ z, z.sum(axis=0)[None]])
        return total.ravel()

    total = _added(data.select(name), (c + 1) * c, moments).reshape(c + 1, c) / n
    covariance = total[:c] - np.outer(total[c], total[c])  # the means are rounding errors of 0
    return float(np.abs(covariance - np.eye(c)).max(initial=0.0))


def whiten_embeddings(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 8) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error of each valid row.

    Null, empty and non-finite vectors are left out; rows with equal or null ids stay, each a
    row of the fit. A table without valid rows, or whose rows are all equal, has no component
    and gives no rows; fewer than `k` directions with variance give as many components.
    `deviation` (sum over dimensions of (n x - S)^2) is exact; one beyond 64 bits is an error.
    Other columns are not read.
    """
    spark = vectors.sparkSession
    data = stage(grid_vectors(vectors.select(F.col(vec_id).alias("vec_id"), vector), vector, ("vec_id",)), "whitening")
    empty = "vec_id {}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    empty = empty.format(data.schema["vec_id"].dataType.simpleString())
    model = fit_whitening(data, "x", k)
    if model is None or not len(model.eigenvalues):
        return spark.createDataFrame([], empty)
    error = identity_error(data, model)
    d, c = model.components.shape
    n, sums, projection, id_type = model.n, model.sums, model.projection, data.schema["vec_id"].dataType
    share = model.eigenvalues / model.trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x in _rows(batch, "x", d):
                if np.abs(x).max() >= LONG // max(n, 1) // 4:
                    raise OverflowError("n x - S needs more than 64 bits")
                apart = x * n - sums
                if float(np.abs(apart).max()) ** 2 * d >= LONG // 2:
                    squares = [sum(v * v for v in row) for row in apart.tolist()]
                    if max(squares) >= LONG:
                        raise OverflowError("a deviation needs more than 64 bits")
                    deviation = np.array(squares, dtype=np.int64)
                else:
                    deviation = (apart * apart).sum(axis=1)
                z = (apart / n) @ projection
                m = len(x)
                ids = batch.column("vec_id").slice(at, m).take(pa.array(np.repeat(np.arange(m), c)))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * c, n, dtype=np.int64)),
                        pa.array(np.repeat(deviation, c)),
                        pa.array(z.ravel()),
                        pa.array(np.tile(share, m)),
                        pa.array(np.full(m * c, error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )
                at += m

    return data.select("vec_id", "x").mapInArrow(project, empty)
