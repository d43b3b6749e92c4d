"""Many linear hinge-loss models trained side by side: one pass over the rows serves them all.

A model is a `Problem`: which features (raw or kernel values against landmark rows), which
class is positive, which fold it must not see, how much a row weighs. A pass sends the trial
weights of all unfinished problems to the tasks; each task computes the kernel values of its
rows once, adds up losses and gradients of every problem, and Spark adds the tasks' sums.
The rows are stored as blocks of numbers that a pass uses as they are. A problem whose step was
too long asks for its losses at all shorter steps in one pass, not in a pass for each.
The driver keeps one L-BFGS state per problem: numbers in the model's size, never a row.

The hinge is rounded off over the last tenth before the margin, so that it has a gradient.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from corpuslens.functions.vectors import packed, vector_width
from corpuslens.operators.kernels import kernel_values
from corpuslens.operators.ranking import by_class
from corpuslens.session import stage

ROUNDING = 0.1
HISTORY = 8
#: Numbers of a batch of problems (weights of all of them), of one stored block of rows, of one row of a summed array.
BATCH_CELLS, BLOCK_CELLS, CHUNK = 1 << 22, 1 << 18, 1 << 14
#: Numbers of one array that a task works on, rows by features, landmarks or problems; bytes of a file of blocks.
SLICE_CELLS, FILE_BYTES = 1 << 18, 16 << 20
BLOCK_ROWS = 10_000
#: Times that a step may be halved; so many are asked for at first, the others where these do not do.
HALVINGS, SCANNED = 40, 10
#: Sums of fewer numbers than this, over all tasks together, come to the driver as they are.
DIRECT_CELLS = 1 << 21
#: Features up to which a row is kept as a dense vector.
DENSE_FEATURES = 4096
TASK_WORK = 2e7


#: Name, width and landmark set of a kernel.
Kernel = tuple[str, float, int]


@dataclass(frozen=True)
class Problem:
    """One model. `positive` and `among` are class places; `held` are (fold column, fold) left out.

    `marks` names the landmark set, `weight` the row weight (-1: none), `shares` the weight of each
    class (None: 1).
    """

    kernel: str
    gamma: float
    C: float
    positive: int
    among: tuple[int, ...] | None = None
    held: tuple[tuple[int, int], ...] = ()
    marks: int = 0
    weight: int = -1
    shares: tuple[float, ...] | None = None

    @property
    def map(self) -> Kernel:
        return (self.kernel, 0.0, 0) if self.kernel == "linear" else (self.kernel, self.gamma, self.marks)


@dataclass(frozen=True)
class Boosted:
    """Members whose mistakes make a row heavier: stacked weights, rows per member, log factors."""

    kernel: Kernel
    coef: np.ndarray  # (features + 1) x (members * raws)
    raws: int
    alphas: np.ndarray


@dataclass(frozen=True)
class TrainingTable:
    """Rows ready for passes, as blocks of `PACKED`: class places, folds, row weights and features."""

    rows: DataFrame
    classes: list
    counts: list[int]
    width: int
    marks: list[np.ndarray]
    tasks: int

    def sizes(self, problems: list[Problem]) -> list[tuple[int, float]]:
        """(rows, summed weight) that each problem learns from, from one pass."""
        kinds = list(dict.fromkeys((p.held, p.weight) for p in problems))
        k = len(self.classes)

        def sums(block: Block) -> np.ndarray:
            out = np.zeros((len(kinds), 2, k))
            for i, (held, weight) in enumerate(kinds):
                kept = np.ones(len(block.y))
                for column, fold in held:
                    kept *= block.folds[:, column] != fold
                out[i, 0] = np.bincount(block.y, kept, k)
                out[i, 1] = np.bincount(block.y, kept * block.w[:, weight], k) if weight >= 0 else out[i, 0]
            return out.ravel()

        found = _summed(self, len(kinds) * 2 * k, sums, False, len(kinds)).reshape(len(kinds), 2, k)
        place = {kind: i for i, kind in enumerate(kinds)}
        out = []
        for p in problems:
            i, n, total = place[p.held, p.weight], 0, 0.0
            for y in range(k):
                if p.among is None or y in p.among:
                    n += int(found[i, 0, y])
                    total += found[i, 1, y] * (p.shares[y] if p.shares else 1.0)
            out.append((n, total))
        return out


def training_table(
    df: DataFrame,
    vec: str,
    label: str,
    counts: dict,
    id_col: str,
    marks: list[np.ndarray],
    folds: list[str] = (),
    weights: list[str] = (),
    work: float = 1.0,
) -> TrainingTable:
    """`df` written once in the form the passes read; in at least as many tasks as cores if `work`, the models, asks for it.

    `counts`: rows of each class.
    """
    place = by_class(label, {c: i for i, c in enumerate(counts)})
    row_weights = F.array(*[F.col(w).cast("double") for w in weights]).cast("array<double>")
    vector = packed(df, vec)
    rows = df.select(
        place.cast("int").alias("_y"),
        F.array(*[F.col(f).cast("int") for f in folds] or [F.lit(0)]).alias("_folds"),
        row_weights.alias("_w"),
        vector["indices"].alias("indices"),
        vector["values"].alias("values"),
    )
    width, n = int(vector_width(df, vec) or 0), sum(counts.values())
    each = max([width, *map(len, marks)])
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, math.ceil(n * each * work / TASK_WORK))
    few = min(tasks, cores)
    step = max(1, min(BLOCK_ROWS, BLOCK_CELLS // max(1, min(width, DENSE_FEATURES)), -(-n // few)))
    row_bytes = 8 * (min(width, DENSE_FEATURES) + len(folds) + len(weights) + 1)
    most = max(1, min(FILE_BYTES // (row_bytes * step), -(-n // (few * step))))
    # files of bounded size, and enough of them to feed the tasks
    rows = stage(rows.mapInArrow(_pack(width, step), PACKED), "training", maxRecordsPerFile=most)
    if tasks < cores:
        rows = rows.coalesce(tasks)
    return TrainingTable(rows, list(counts), list(counts.values()), width, marks, rows.rdd.getNumPartitions())


# --- blocks of rows ---------------------------------------------------------------------


class _Dense:
    def __init__(self, x: np.ndarray):
        self.x = x

    def times(self, w: np.ndarray) -> np.ndarray:
        return self.x @ w

    def back(self, r: np.ndarray) -> np.ndarray:
        return self.x.T @ r


class _Sparse:
    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, n: int, width: int):
        self.row, self.column, self.value, self.n, self.width = row, column, value[:, None], n, width

    def times(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, w.shape[1]))
        np.add.at(out, self.row, w[self.column] * self.value)
        return out

    def back(self, r: np.ndarray) -> np.ndarray:
        out = np.zeros((self.width, r.shape[1]))
        np.add.at(out, self.column, r[self.row] * self.value)
        return out


#: A block: its rows, class places, folds and weights (a row after the other); features dense in `x`,
#: or the entries of each row (their number in `sizes`) in `columns` and `x`.
PACKED = "n int, y binary, folds binary, w binary, sizes binary, columns binary, x binary"


@dataclass
class Block:
    """Some rows of a task: class places, folds (a column each), row weights and features."""

    y: np.ndarray
    folds: np.ndarray
    w: np.ndarray | None
    raw: _Dense | _Sparse | None
    _maps: dict = field(default_factory=dict)
    _products: dict = field(default_factory=dict)

    def features(self, kernel: Kernel, marks: list[np.ndarray]) -> _Dense | _Sparse:
        if kernel[0] == "linear":
            return self.raw
        if kernel not in self._maps:
            own = marks[kernel[2]]
            if kernel[2] not in self._products:
                self._products[kernel[2]] = self.raw.x @ own.T  # kernels of the same landmarks share it
            self._maps[kernel] = _Dense(kernel_values(self._products[kernel[2]], self.raw.x, own, *kernel[:2]))
        return self._maps[kernel]


def _pack(width: int, step: int):
    """Rows to blocks of at most `step` rows; up to `DENSE_FEATURES` features all are kept, else only the entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), *[pa.binary()] * 6]
        names = ["n", "y", "folds", "w", "sizes", "columns", "x"]
        for batch in batches:
            for low in range(0, batch.num_rows, step):
                part = batch.slice(low, step)
                n = part.num_rows
                where, values = part.column("indices"), part.column("values")
                sizes = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(n), sizes)
                value = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                column = np.arange(len(value)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                packed_rows = pc.fill_null(pc.list_value_length(where), 0).to_numpy(zero_copy_only=False) > 0
                if packed_rows.any():
                    column[packed_rows[row]] = where.flatten().to_numpy(zero_copy_only=False)
                found = [None, None, value]
                if width <= DENSE_FEATURES:
                    found[2] = np.zeros((n, width))
                    found[2][row, column] = value
                else:
                    found[:2] = sizes, column
                weights = part.column("_w")
                w = weights.flatten().to_numpy(zero_copy_only=False)
                w = w if len(w) else None
                y = part.column("_y").to_numpy(zero_copy_only=False).astype(np.int64)
                folds = part.column("_folds").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                cells = [n, *[None if a is None else np.ascontiguousarray(a).tobytes() for a in (y, folds, w, *found)]]
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, types)], names=names)

    return run


def blocks(batch: pa.RecordBatch, width: int, dense: bool, cells: int) -> Iterator[Block]:
    """The rows of stored blocks, a few at a time: `cells` numbers a row are worked with. `dense`: sparse rows are filled up."""
    for at in range(batch.num_rows):

        def numbers(name: str, kind=np.int64, at=at) -> np.ndarray | None:
            value = batch.column(name)[at]
            return np.frombuffer(value.as_buffer(), kind) if value.is_valid else None

        n = batch.column("n")[at].as_py()
        y, folds = numbers("y"), numbers("folds").reshape(n, -1)
        w, sizes, column, x = numbers("w", np.float64), numbers("sizes"), numbers("columns"), numbers("x", np.float64)
        w = None if w is None else w.reshape(n, -1)
        ends = None if sizes is None else np.concatenate([[0], np.cumsum(sizes)])
        x = x.reshape(n, width) if sizes is None else x
        step = max(1, SLICE_CELLS // max(1, cells, width if dense else 0))
        for low in range(0, n, step):
            high = min(n, low + step)
            if sizes is None:
                raw = _Dense(x[low:high])
            else:
                own = slice(ends[low], ends[high])
                row = np.repeat(np.arange(high - low), sizes[low:high])
                if dense:
                    filled = np.zeros((high - low, width))
                    filled[row, column[own]] = x[own]
                    raw = _Dense(filled)
                else:
                    raw = _Sparse(row, column[own], x[own], high - low, width)
            yield Block(y[low:high], folds[low:high], None if w is None else w[low:high], raw)


@dataclass(frozen=True)
class _Group:
    """Problems on the same features, as arrays."""

    kernel: Kernel
    coef: np.ndarray
    positive: np.ndarray
    weight: np.ndarray
    held: list[tuple[int, np.ndarray]]  # of a fold column: the fold that each problem leaves out (-1: none)
    share: np.ndarray  # classes x problems; 0 for classes left out


def _group(kernel: Kernel, problems: list[Problem], coef: np.ndarray, n_classes: int) -> _Group:
    share = np.ones((n_classes, len(problems)))
    for j, p in enumerate(problems):
        if p.among is not None:
            share[[c for c in range(n_classes) if c not in p.among], j] = 0.0
        if p.shares is not None:
            share[:, j] *= p.shares
    arrays = [np.array([getattr(p, a) for p in problems]) for a in ("positive", "weight")]
    columns = sorted({c for p in problems for c, _ in p.held})
    held = [(c, np.array([dict(p.held).get(c, -1) for p in problems])) for c in columns]
    return _Group(kernel, coef, *arrays, held, share)


def _row_weights(block: Block, group: _Group) -> np.ndarray:
    if len(group.held) == 1 and len(block.y):
        # weights by class and fold are looked up, not computed for each row
        column, fold = group.held[0]
        own = block.folds[:, column]
        low = int(own.min())
        k = int(own.max()) - low + 1
        table = group.share[:, None] * (np.arange(low, low + k)[:, None] != fold[None])[None]
        out = table.reshape(-1, len(fold))[block.y * k + (own - low)]
    else:
        out = group.share[block.y]
        for column, fold in group.held:
            out = out * (block.folds[:, column][:, None] != fold[None])
    weighted = group.weight >= 0
    if weighted.all():
        out *= block.w[:, group.weight]
    elif weighted.any():
        out[:, weighted] *= block.w[:, group.weight[weighted]]
    return out


def _sides(block: Block, group: _Group) -> np.ndarray:
    """1 or -1 by row and problem; one column where all problems have the same positive class."""
    positive = group.positive[:1] if (group.positive == group.positive[0]).all() else group.positive
    return np.where(block.y[:, None] == positive[None], 1.0, -1.0)


def _slopes(short: np.ndarray) -> np.ndarray:
    """Slopes of the hinge; leaves in `short` what the loss is their multiple of."""
    slope = short / ROUNDING
    np.clip(slope, 0.0, 1.0, out=slope)
    short -= slope * (ROUNDING / 2)
    return slope


def _margins(block: Block, group: _Group, marks: list[np.ndarray]) -> np.ndarray:
    return block.features(group.kernel, marks).times(group.coef[:-1]) + group.coef[-1]


def _chosen(margins: np.ndarray, raws: int) -> np.ndarray:
    """Class places per (row, member): the sign for two classes, else the largest margin."""
    if raws == 1:
        return (margins > 0).astype(np.int64)
    return margins.reshape(len(margins), -1, raws).argmax(axis=2)


def _boost_weights(block: Block, boosted: Boosted, marks: list[np.ndarray]) -> np.ndarray:
    if not len(boosted.alphas):
        return np.ones(len(block.y))
    margins = block.features(boosted.kernel, marks).times(boosted.coef[:-1]) + boosted.coef[-1]
    wrong = _chosen(margins, boosted.raws) != block.y[:, None]
    return np.exp(wrong @ boosted.alphas)


def _shorter_sums(
    block: Block, group: _Group, along: np.ndarray, steps: np.ndarray, marks: list[np.ndarray], boosted: Boosted | None, ahead: int = HALVINGS
) -> np.ndarray:
    """`ahead` x problems: losses from the weights of `group` on, `along` a direction by ever shorter `steps`."""
    side = _sides(block, group)
    weight = _row_weights(block, group)
    if boosted is not None:
        weight *= _boost_weights(block, boosted, marks)[:, None]
    short = 1.0 - side * _margins(block, group, marks)
    gain = side * (block.features(group.kernel, marks).times(along[:-1]) + along[-1])
    out = np.zeros((ahead, len(steps)))
    left = np.empty_like(short)
    for j in range(ahead):
        np.multiply(gain, steps / 2.0 ** (j + 1), out=left)
        np.subtract(short, left, out=left)
        slope = _slopes(left)
        slope *= weight
        out[j] = np.einsum("ij,ij->j", slope, left)
    return out


def _loss_sums(block: Block, group: _Group, marks: list[np.ndarray], boosted: Boosted | None) -> np.ndarray:
    """(features + 2) x problems: gradient, its intercept, and the loss."""
    side = _sides(block, group)
    weight = _row_weights(block, group)
    if boosted is not None:
        weight *= _boost_weights(block, boosted, marks)[:, None]
    short = 1.0 - side * _margins(block, group, marks)
    pull = _slopes(short)
    pull *= weight
    loss = np.einsum("ij,ij->j", pull, short)
    pull *= -side
    return np.concatenate([block.features(group.kernel, marks).back(pull), pull.sum(axis=0)[None], loss[None]])


# --- passes -----------------------------------------------------------------------------


def _summed(
    table: TrainingTable, size: int, of_block: Callable[[Block], np.ndarray], dense: bool, cells: int
) -> np.ndarray:
    """Sum of `of_block` (an array of `size` numbers) over all blocks of all tasks; it works with `cells` numbers a row."""
    width, cells = table.width, max([cells, *map(len, table.marks)])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for block in blocks(batch, width, dense, cells):
                total += of_block(block)
        parts = [total[low : low + CHUNK] for low in range(0, size, CHUNK)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(parts), dtype=np.int32)), pa.array(parts, pa.list_(pa.float64()))], names=["at", "part"]
        )

    parts = table.rows.mapInArrow(partial, "at int, part array<double>")
    if size * table.tasks > DIRECT_CELLS:
        parts = parts.groupBy("at").applyInPandas(
            lambda rows: pd.DataFrame({"at": rows["at"].iloc[:1], "part": [np.sum(rows["part"].to_list(), axis=0)]}),
            "at int, part array<double>",
        )
    out = np.zeros(size)
    for row in parts.collect():
        out[row.at * CHUNK : row.at * CHUNK + len(row.part)] += row.part
    return out


class _State:
    """L-BFGS with backtracking of one problem."""

    def __init__(self, start: np.ndarray):
        self.x, self.trial = start, start
        self.f = self.g = self.d = None
        self.t, self.halvings, self.steps, self.small = 1.0, 0, 0, 0
        self.scans = False  # the next pass is asked for the losses at all shorter steps
        self.pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
        self.done = False

    def _direction(self) -> np.ndarray:
        q = self.g.copy()
        alphas = []
        for s, y, rho in reversed(self.pairs):
            a = rho * (s @ q)
            q -= a * y
            alphas.append(a)
        if self.pairs:
            s, y, _ = self.pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y, rho), a in zip(self.pairs, reversed(alphas)):
            q += (a - rho * (y @ q)) * s
        return -q

    def shorter(self, losses: np.ndarray) -> None:
        """Take the losses after 1, 2, ... further halvings; set `trial` to the first that is low enough, or `done`.

        If none is, and the step may be halved further, the losses after the next halvings are asked for.
        """
        self.scans = False
        for loss in losses[: HALVINGS - self.halvings]:
            self.halvings += 1
            self.t /= 2
            if loss <= self.f + 1e-4 * self.t * (self.g @ self.d):
                self.trial = self.x + self.t * self.d
                return
        self.done = self.halvings >= HALVINGS
        self.scans = not self.done

    def feed(self, f: float, g: np.ndarray, max_iter: int, tol: float) -> None:
        """Take loss and gradient at `trial`; set the next `trial`, or `done`."""
        if self.f is not None and not f <= self.f + 1e-4 * self.t * (self.g @ self.d):
            self.scans, self.done = True, self.halvings >= HALVINGS
            return
        if self.f is not None:
            s, y = self.trial - self.x, g - self.g
            if s @ y > 1e-12 * (y @ y):
                self.pairs = [*self.pairs[-HISTORY + 1 :], (s, y, 1.0 / (s @ y))]
            self.small = self.small + 1 if self.f - f <= tol * max(abs(f), 1e-3) else 0
            self.steps += 1
        self.x, self.f, self.g = self.trial, f, g
        if self.small >= 2 or self.steps >= max_iter or np.abs(g).max() <= 1e-7:
            self.done = True
            return
        self.d = self._direction()
        if self.g @ self.d >= 0:
            self.pairs, self.d = [], -self.g
        self.halvings = 0
        self.t = 1.0 if self.pairs else min(1.0, 1.0 / max(np.abs(g).sum(), 1e-12))
        self.trial = self.x + self.t * self.d


def _widths(table: TrainingTable, p: Problem) -> int:
    return table.width if p.kernel == "linear" else len(table.marks[p.marks])


def batches_of(table: TrainingTable, problems: list[Problem]) -> Iterator[list[int]]:
    """Numbers of problems that fit into one batch."""
    held: list[int] = []
    cells = 0
    for i, p in enumerate(problems):
        size = _widths(table, p) + 2
        if held and cells + size > BATCH_CELLS:
            yield held
            held, cells = [], 0
        held.append(i)
        cells += size
    if held:
        yield held


def _groups(table: TrainingTable, problems: list[Problem], coefs: list[np.ndarray]) -> list[tuple[list[int], _Group]]:
    by_map: dict[Kernel, list[int]] = {}
    for i, p in enumerate(problems):
        by_map.setdefault(p.map, []).append(i)
    return [
        (own, _group(kernel, [problems[i] for i in own], np.stack([coefs[i] for i in own], axis=1), len(table.classes)))
        for kernel, own in by_map.items()
    ]


def _is_dense(table: TrainingTable, problems: list[Problem]) -> bool:
    return table.width <= DENSE_FEATURES or any(p.kernel != "linear" for p in problems)


def _asked(
    table: TrainingTable, problems: list[Problem], states: dict[int, _State], live: list[int], dense: bool, boosted: Boosted | None
) -> dict[int, np.ndarray]:
    """What each of `live` waits for, from one pass: gradient and loss at its trial, or the losses at shorter steps."""
    scanning, others = ([i for i in live if states[i].scans is scans] for scans in (True, False))
    full = _groups(table, [problems[i] for i in others], [states[i].trial for i in others])
    scans = [
        (own, g, np.stack([states[scanning[k]].d for k in own], axis=1), np.array([states[scanning[k]].t for k in own]))
        for own, g in _groups(table, [problems[i] for i in scanning], [states[i].x for i in scanning])
    ]
    ahead = HALVINGS if any(states[i].halvings for i in scanning) else SCANNED
    sent = table.rows.sparkSession.sparkContext.broadcast(
        ([g for _, g in full], [part[1:] for part in scans], table.marks, boosted)
    )

    def sums(block: Block) -> np.ndarray:
        parts, shorter, marks, members = sent.value
        out = [_loss_sums(block, g, marks, members).ravel() for g in parts]
        return np.concatenate([*out, *[_shorter_sums(block, g, d, t, marks, members, ahead).ravel() for g, d, t in shorter]])

    places = [([others[k] for k in own], g.coef.shape[0] + 1) for own, g in full]
    places += [([scanning[k] for k in own], ahead) for own, *_ in scans]
    cells = max([len(live), len(boosted.alphas) * boosted.raws if boosted else 0])
    found = _summed(table, sum(len(own) * rows for own, rows in places), sums, dense, cells)
    sent.unpersist()
    out, low = {}, 0
    for own, rows in places:
        part = found[low : low + rows * len(own)].reshape(rows, len(own))
        low += rows * len(own)
        out |= {i: part[:, column] for column, i in enumerate(own)}
    return out


def train(
    table: TrainingTable,
    problems: list[Problem],
    max_iter: int = 50,
    tol: float = 1e-4,
    start: list[np.ndarray] | None = None,
    boosted: Boosted | None = None,
    total: float | None = None,
) -> list[np.ndarray]:
    """Weights (features, then the intercept) of each problem.

    Mean loss of its rows plus |w|^2 / (2 n C). `boosted` multiplies the row weights, whose sum is then `total`.
    """
    out: list[np.ndarray] = [None] * len(problems)
    counted = table.sizes(problems)
    for batch in batches_of(table, problems):
        states = {i: _State(start[i] if start else np.zeros(_widths(table, problems[i]) + 1)) for i in batch}
        dense = _is_dense(table, [problems[i] for i in batch])
        while live := [i for i in batch if not states[i].done]:
            found = _asked(table, problems, states, live, dense, boosted)
            for i in live:
                n, weight = counted[i]
                weight = total or weight
                ridge = 1.0 / (n * problems[i].C)
                state, part = states[i], found[i]
                if state.scans:
                    w, d = state.x[:-1], state.d[:-1]
                    t = state.t / 2.0 ** np.arange(1, len(part) + 1)
                    state.shorter(part / weight + ridge / 2 * (w @ w + t * (2 * (w @ d) + t * (d @ d))))
                else:
                    w = state.trial[:-1]
                    gradient = part[:-1] / weight
                    gradient[:-1] += ridge * w
                    state.feed(part[-1] / weight + ridge / 2 * (w @ w), gradient, max_iter, tol)
        for i in batch:
            out[i] = states[i].x
    return out


def held_out_counts(
    table: TrainingTable, problems: list[Problem], coefs: list[np.ndarray], raws: int
) -> np.ndarray:
    """(models, classes, classes): rows of the fold that a model has not seen, by truth and choice.

    `raws` problems in a row make one model; folds are those of the first column.
    """
    k = len(table.classes)
    models = len(problems) // raws
    spark = table.rows.sparkSession
    out = np.zeros((models, k, k))
    for batch in batches_of(table, problems):
        own = sorted({i // raws for i in batch})
        numbers = [m * raws + j for m in own for j in range(raws)]
        groups = _groups(table, [problems[i] for i in numbers], [coefs[i] for i in numbers])
        sent = spark.sparkContext.broadcast(([(np.array(o), g) for o, g in groups], table.marks))
        size, held = len(own), np.array([dict(problems[m * raws].held)[0] for m in own])

        def sums(block: Block, sent=sent, size=size, held=held) -> np.ndarray:
            parts, marks = sent.value
            margins = np.zeros((len(block.y), size * raws))
            for o, g in parts:
                margins[:, o] = _margins(block, g, marks)
            choice = _chosen(margins, raws)
            seen = block.folds[:, 0][:, None] == held[None]
            row, model = np.nonzero(seen)
            cell = (model * k + block.y[row]) * k + choice[row, model]
            return np.bincount(cell, minlength=size * k * k).astype(np.float64)

        out[own] = _summed(table, size * k * k, sums, _is_dense(table, problems), size * raws).reshape(size, k, k)
        sent.unpersist()
    return out


def _lists(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as a list array."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(rows).ravel()))


def cross_margins(
    table: TrainingTable, parts: list[tuple[int, dict[int, list[int]]]], problems: list[Problem], coefs: list[np.ndarray]
) -> DataFrame:
    """`_y, _folds, _w, raw`: each row once, `raw` the margins of the models that left its fold out.

    Each of `parts` is a fold column and, for each of its folds, the problems that left it out, in
    the same order for every fold. `raw` has the numbers of all parts, one part after the other.
    """
    spark, width, dense = table.rows.sparkSession, table.width, _is_dense(table, problems)
    sizes = [max(map(len, own.values())) for _, own in parts]
    packs = []
    for (column, by_fold), low in zip(parts, np.cumsum([0, *sizes]).tolist()):
        for fold, own in by_fold.items():
            for o, g in _groups(table, [problems[i] for i in own], [coefs[i] for i in own]):
                packs.append((column, fold, low + np.array(o), g))
    size = sum(sizes)
    cells = max([size, *map(len, table.marks)])
    sent = spark.sparkContext.broadcast((packs, table.marks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs, marks = sent.value
        for batch in batches:
            for block in blocks(batch, width, dense, cells):
                raw = np.zeros((len(block.y), size))
                for column, fold, at, group in packs:
                    mine = np.flatnonzero(block.folds[:, column] == fold)
                    if len(mine):
                        raw[np.ix_(mine, at)] = _margins(block, group, marks)[mine]
                weights = pa.nulls(len(block.y), pa.list_(pa.float64())) if block.w is None else _lists(block.w)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.y.astype(np.int32)), _lists(block.folds.astype(np.int32)), weights, _lists(raw)],
                    names=["_y", "_folds", "_w", "raw"],
                )

    return table.rows.mapInArrow(run, "_y int, _folds array<int>, _w array<double>, raw array<double>")


def boost_sums(table: TrainingTable, boosted: Boosted, last: np.ndarray) -> tuple[float, float]:
    """(summed weight, summed weight of the rows that the model `last` gets wrong)."""
    spark = table.rows.sparkSession
    sent = spark.sparkContext.broadcast((boosted, last, table.marks))

    def sums(block: Block) -> np.ndarray:
        members, coef, marks = sent.value
        weight = _boost_weights(block, members, marks)
        margins = block.features(members.kernel, marks).times(coef[:-1]) + coef[-1]
        wrong = _chosen(margins, members.raws)[:, 0] != block.y
        return np.array([weight.sum(), weight[wrong].sum()])

    dense = table.width <= DENSE_FEATURES or boosted.kernel[0] != "linear"
    found = _summed(table, 2, sums, dense, (len(boosted.alphas) + 1) * boosted.raws)
    sent.unpersist()
    return float(found[0]), float(found[1])


def logistic_curves(
    margins: DataFrame, targets: list[tuple[Column, Column, Column]], max_iter: int = 50
) -> list[tuple[float, float]]:
    """(slope, intercept) of a logistic curve for each (margin, truth, row weight) of column expressions.

    Newton steps on all curves at once, on margins moved to their mean and shrunk to their range: of
    many rows with nearly equal margins the equations would else be singular to rounding. Margins that are
    equal but for rounding get a flat curve. Targets are drawn in by one row a class, so that a
    class of few rows, or one that the margin separates, has a finite curve.
    """
    columns = [
        c.cast("double").alias(f"{name}{i}") for i, target in enumerate(targets) for name, c in zip("mtw", target)
    ]
    rows = stage(margins.select(*columns), "curves")
    n = len(targets)
    found = rows.agg(
        *[F.sum(f"w{i}") for i in range(n)],
        *[F.sum(F.col(f"w{i}") * F.col(f"t{i}")) for i in range(n)],
        *[F.sum(F.col(f"w{i}") * F.col(f"m{i}")) for i in range(n)],
        *[F.min(f"m{i}") for i in range(n)],
        *[F.max(f"m{i}") for i in range(n)],
    ).first()
    total, positive, centre, least, most = np.array(found, dtype=np.float64).reshape(5, n)
    centre /= np.where(total > 0, total, 1.0)
    flat = ~(most - least > 1e-12 * np.maximum(np.abs(least), np.abs(most)))
    spread = np.where(flat, 1.0, most - least)
    high, low = (positive + 1) / (positive + 2), 1 / (total - positive + 2)
    ab = np.stack([np.zeros(n), np.log((positive + 1) / (total - positive + 1))], axis=1)
    value, step = np.full(n, np.inf), np.zeros((n, 2))
    spark = rows.sparkSession
    live = np.ones(n, dtype=bool)
    for _ in range(max_iter):
        trial = ab + step
        sent = spark.sparkContext.broadcast((trial, high, low))

        def partial(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            (curve, up, down), out = sent.value, np.zeros((6, n))
            for batch in batches:
                m, t, w = (
                    np.stack([batch.column(f"{c}{i}").to_numpy() for i in range(n)], axis=1) for c in "mtw"
                )
                m, t = np.where(flat, 0.0, (m - centre) / spread), np.where(t > 0, up, down)
                z = m * curve[:, 0] + curve[:, 1]
                p = 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))
                loss = np.logaddexp(0.0, z) - t * z
                d, h = p - t, np.maximum(p * (1 - p), 1e-12)
                out += np.stack([(w * x).sum(axis=0) for x in (loss, d * m, d, h * m * m, h * m, h)])
            yield pa.RecordBatch.from_arrays([pa.array([out.ravel().tolist()], pa.list_(pa.float64()))], names=["part"])

        parts = rows.mapInArrow(partial, "part array<double>").select(F.posexplode("part").alias("at", "v"))
        found = np.zeros(6 * n)
        for at, v in parts.groupBy("at").agg(F.sum("v")).collect():
            found[at] = v
        sent.unpersist()
        loss, ga, gb, haa, hab, hbb = found.reshape(6, n)
        better = loss <= value + 1e-12 * np.abs(value)
        for j in np.flatnonzero(live):
            if not better[j]:
                step[j] /= 4
                live[j] = np.abs(step[j]).max() > 1e-10
                continue
            gain = value[j] - loss[j]
            ab[j], value[j] = trial[j], loss[j]
            hessian = np.array([[haa[j], hab[j]], [hab[j], hbb[j]]]) + np.eye(2) * 1e-9 * max(1.0, hbb[j])
            step[j] = -np.linalg.solve(hessian, [ga[j], gb[j]])
            live[j] = max(abs(ga[j]), abs(gb[j])) > 1e-7 * max(total[j], 1.0) and gain > 1e-12 * max(1.0, loss[j])
            if not live[j]:
                step[j] = 0.0
        if not live.any():
            break
    return [(float(a / s), float(b - a / s * c)) for (a, b), s, c in zip(ab, spread, centre)]
